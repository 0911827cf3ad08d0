"""Token-id files: canonical length-limited Huffman codes of the ids, in blocks that decode independently.

Ids are counted over the whole corpus, package-merge gives each a code of at most `MAX_BITS` bits, and codes are
canonical, so a code book is its lengths alone.  A document's bits start at a byte; every `BLOCK` ids of it a
checkpoint holds the bit offset at which decoding can start.  Documents are coded where they are read, moved once, as
bits, into ascending order of doc_id, and gathered into segments of about `SEGMENT_IDS` ids.

Layout of a folder: `codebook` (id, bits), and `segments`, one row each: part and start (its place among the files,
ids before it in its part), doc_ids (int64), doc_sizes (uint32, ids per document), checkpoints (uint64, bit offsets
of all blocks in order) and payload.  All integers are little-endian; code bits fill bytes from the top.  Segments are
rows of Parquet files, so they are written whole or not at all and any store that Spark knows will do.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_small_batches, load
from .tokens import public_path, word_level

MAX_BITS, BLOCK, SEGMENT_IDS, END_ID = 18, 256, 1 << 20, 2


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol with a count, 0 for others, by package-merge: optimal among codes of at most `limit` bits."""
    used = np.nonzero(counts)[0]
    bits = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        bits[used] = 1
        return bits
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaves = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        leaves.append(by < len(weights))
    take, found = 2 * len(weights) - 2, np.zeros(len(weights), np.uint8)
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        found[:n] += 1
        take = 2 * (take - n)
    bits[order] = found
    return bits


class CodeBook:
    """Canonical codes from their lengths: shorter first, then by id."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int64)
        self.limit = max(1, int(bits.max(initial=1)))
        order = np.lexsort((np.arange(len(bits)), self.bits))
        order = order[self.bits[order] > 0]
        n = self.bits[order]
        ends = np.cumsum(1 << (self.limit - n))  # of the stretch of the decoding table that a code takes
        self.codes = np.zeros(len(bits), np.uint64)  # each code's bits at the top of 64
        self.codes[order] = ((ends - (1 << (self.limit - n))) << (64 - self.limit)).astype(np.uint64) if self.limit < 64 else 0
        self.table = np.zeros(1 << self.limit, np.uint32)  # the next bits to symbol << 5 | length
        self.table[: ends[-1] if len(ends) else 0] = np.repeat(order << 5 | n, 1 << (self.limit - n))
        self.bits = self.bits.astype(np.uint8)

    def encode(self, ids: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
        """Documents of these sizes, one after another: their bits, each padded to a byte, where each one's bytes
        start (and where the last one's end), and the bit offsets of each one's blocks from its start."""
        n = self.bits[ids]
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, dtype=np.int64, out=upto[1:])
        first = np.concatenate([[0], np.cumsum(sizes)])
        starts = np.concatenate([[0], np.cumsum((upto[first[1:]] - upto[first[:-1]] + 7) >> 3)])
        at = upto[:-1] + np.repeat(starts[:-1] * 8 - upto[first[:-1]], sizes)
        words = at >> 5
        heads = np.nonzero(np.diff(words, prepend=-1))[0]
        out = np.zeros(int(starts[-1] // 4 + 2), np.uint64)
        if len(heads):
            # codes that begin in one word share no bits, so their sum is their union; it may reach into the next word
            sums = np.add.reduceat(self.codes[ids] >> (at & 31).astype(np.uint64), heads)
            out[words[heads]] = sums >> np.uint64(32)
            out[words[heads] + 1] |= sums & np.uint64(0xFFFFFFFF)
        marks = [(at[f : f + s : block] - a * 8).astype(np.uint64) for a, f, s in zip(starts.tolist(), first.tolist(), sizes.tolist())]
        return out.astype(">u4").tobytes(), starts, marks

    def decode(self, payload: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all blocks in order: all blocks advance together, one table look-up a symbol."""
        raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        order = np.argsort(-counts, kind="stable")
        pos, n = checkpoints[order].astype(np.int64), counts[order]
        longest = int(n[0]) if len(n) else 0
        out = np.zeros((longest, len(n)), np.uint32)
        live = len(n) - np.searchsorted(n[::-1], np.arange(longest), "right")  # blocks with more than so many ids
        drop, table = np.uint32(32 - self.limit), self.table
        for k in range(longest):
            p = pos[: live[k]]
            entry = table[(window[p >> 3] << (p & 7).astype(np.uint32)) >> drop]
            np.right_shift(entry, 5, out=out[k, : live[k]])
            p += entry & 31
        back = np.argsort(order, kind="stable")
        flat = out.T[back]
        return flat[np.arange(longest)[None, :] < counts[:, None]]


def block_counts(sizes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Ids of each block of documents of these sizes."""
    blocks = -(-sizes // block)
    out = np.full(int(blocks.sum()), block, np.int64)
    out[np.cumsum(blocks)[sizes > 0] - 1] = (sizes - (blocks - 1) * block)[sizes > 0]
    return out


def _ids(path: str, end_id: int):
    def run(batches):
        encode = word_level(path).encode
        for b in batches:
            rows = [np.append(encode(t or ""), np.uint32(end_id)) for t in b.column(1).to_pylist()]
            kind = np.uint16 if all(int(x.max()) < 1 << 16 for x in rows) else np.uint32
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(len, rows)), pa.int64()), pa.array([x.astype(kind).tobytes() for x in rows], pa.binary())], names=["id", "n", "ids"]
            )

    return run


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch one after another, without copying where all rows have the same width, and ids per row."""
    sizes, column = b.column(1).to_numpy(zero_copy_only=False), b.column(2)
    widths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (widths == 2 * sizes).all():
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint16), sizes
    rows = [np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32) for n, x in zip(sizes.tolist(), column.to_pylist())]
    return np.concatenate([*rows, np.empty(0, np.uint16)]).astype(np.int64), sizes


def _counted(batches):
    total = np.zeros(1, np.int64)
    for b in batches:
        found = np.bincount(_flat(b)[0])
        if len(found) > len(total):
            found, total = total, found.astype(np.int64)
        total[: len(found)] += found
    ids = np.nonzero(total)[0]
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})


def _coded(bits: bytes, block: int):
    def run(batches):
        book = _book(bits)
        for b in batches:
            stream, starts, marks = book.encode(*_flat(b), block)
            each = [stream[a:z] for a, z in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(each, pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())], names=["id", "n", "bits", "marks"])

    return run


@lru_cache(4)
def _book(bits: bytes) -> CodeBook:
    return CodeBook(np.frombuffer(bits, np.uint8))


_SEGMENT = "part int, start long, n_ids long, n_docs long, doc_ids binary, doc_sizes binary, checkpoints binary, payload binary"


def _segments(segment_ids: int):
    def run(batches):
        part, start, held = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal start, held
            ids, sizes, bits, marks = zip(*held)
            at = np.concatenate([[0], np.cumsum(list(map(len, bits)))[:-1]]).astype(np.uint64) * np.uint64(8)
            points = np.concatenate([np.frombuffer(m, np.uint64) + a for m, a in zip(marks, at)])
            n = int(sum(sizes))
            # a null id is stored as the least integer
            docs = np.array([-(1 << 63) if i is None else i for i in ids], "<i8")
            row = {"part": part, "start": start, "n_ids": n, "n_docs": len(ids), "doc_ids": docs.tobytes(), "doc_sizes": np.array(sizes, "<u4").tobytes(), "checkpoints": points.astype("<u8").tobytes(), "payload": b"".join(bits)}
            start, held = start + n, []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=list(row))

        size = 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                held.append(row)
                size += row[1]
                if size >= segment_ids:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block: int = BLOCK, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of every text, each followed by end_id, in ascending order of id.

    Null text is the empty one; null ids come first; rows with equal ids follow one another.  Texts of any length are
    read whole.  An empty table gives a code book and segments without rows; other columns are ignored.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    scratch = Scratch(spark, "ids")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = scratch.keep(rows.mapInArrow(_ids(path or public_path("word_bpe_49k.json"), end_id), "id long, n long, ids binary"), "ids")
    counts = ids.mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    total = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        total[r["id"]] = r["n"]
    bits = code_lengths(total, max(MAX_BITS, int(np.ceil(np.log2(max(2, len(counts)))))))
    book = [(int(i), int(bits[i])) for i in np.nonzero(bits)[0]]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    coded = ids.mapInArrow(_coded(bits.tobytes(), block), "id long, n long, bits binary, marks binary")
    ordered = coded.withColumn("tie", F.xxhash64("bits")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    ordered.select("id", "n", "bits", "marks").mapInArrow(_segments(segment_ids), _SEGMENT).write.option("compression", "uncompressed").parquet(f"{folder}/segments")
    scratch.drop(ids)


def _read(bits: bytes, block: int, digest: bool):
    def run(batches):
        book = _book(bits)
        for b in batches:
            for row in b.to_pylist():
                sizes = np.frombuffer(row["doc_sizes"], "<u4").astype(np.int64)
                ids = book.decode(row["payload"], np.frombuffer(row["checkpoints"], "<u8"), block_counts(sizes, block)).astype("<u4")
                ends = np.cumsum(sizes)
                docs = [None if i == -(1 << 63) else i for i in np.frombuffer(row["doc_ids"], "<i8").tolist()]
                each = [ids[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist())]
                last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array(each, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(np.full(len(docs), row["part"], np.int32)), pa.array(ends - sizes + row["start"]), pa.array(sizes), last],
                    names=["id", "part", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id", block: int = BLOCK, digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the folder's files; with digest, ids_crc32 in place of ids.

    start counts the ids of all documents before it.  Segments are decoded one by one and independently.
    """
    in_small_batches(spark)
    book = spark.read.parquet(f"{folder}/codebook").collect()  # at most the vocabulary
    bits = np.zeros(max((r["id"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        bits[r["id"]] = r["bits"]
    segments = spark.read.parquet(f"{folder}/segments")
    parts = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one per file
    before = np.concatenate([[0], np.cumsum([n for _, n in parts])]).astype(int).tolist()
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(parts, before)], "part int, base long")
    last = "ids_crc32 long" if digest else "ids binary"
    read = segments.mapInArrow(_read(bits.tobytes(), block, digest), f"id long, part int, start long, n_tokens long, {last}")
    return read.join(F.broadcast(bases), "part").select(F.col("id").alias(id_col), (F.col("start") + F.col("base")).alias("start"), "n_tokens", last.split(" ")[0])


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark, 'token-files').root}/files"
    write_token_files(load(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, digest=True)
