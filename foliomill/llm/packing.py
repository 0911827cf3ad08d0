"""Best-fit packing of token sequences by exact-complement hashing.

Documents are cut into pieces of at most `capacity` tokens and written once as (doc, piece, length, rank), the rank
counted per task and length.  Only the histogram of lengths, `capacity` numbers at most, reaches the driver.  There an
index of the single, pair and triple length sums that the available counts allow is consulted for each length from
the longest down: combinations that fill its gap exactly are consumed as often as their counts last, and what has no
exact complement is packed best-fit, bins with equal contents at a time.  A few such plans are made and the one with the
fewest sequences is taken.  The plan is a list of patterns with
multiplicities.  Each piece's rank among all pieces of its length then tells its sequence and offset.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, in_small_batches, load
from .tokens import byte_level, public_path

CAPACITY, END_ID = 1024, 2


class SumIndex:
    """Which sums one, two or three available lengths can make, kept up to date as counts run out."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        self.pairs = np.zeros(capacity + 1, np.int64)  # available pairs by their sum
        for length, count in sorted(counts.items()):
            self.set(length, count)

    def set(self, length: int, count: int) -> None:
        before, self.n[length] = int(self.n[length]), count
        if (before > 0) != (count > 0):
            others = np.nonzero(self.n[: len(self.n) - length] > 0)[0]
            self.pairs[others[others != length] + length] += 1 if count > 0 else -1
        if (before > 1) != (count > 1) and 2 * length < len(self.n):
            self.pairs[2 * length] += 1 if count > 1 else -1

    def pair(self, total: int) -> tuple[int, ...]:
        if total < 2 or not self.pairs[total]:
            return ()
        large = np.arange(total - 1, (total - 1) // 2, -1)
        ok = (self.n[large] > 0) & (self.n[total - large] > 0) & ((2 * large != total) | (self.n[large] > 1))
        found = large[ok]
        return (int(found[0]), int(total - found[0])) if len(found) else ()

    def triple(self, total: int) -> tuple[int, ...]:
        first = np.arange(total - 2, 0, -1)
        for c in first[(self.n[first] > 0) & (self.pairs[total - first] > 0)].tolist():
            self.set(c, int(self.n[c]) - 1)
            rest = self.pair(total - c)
            self.set(c, int(self.n[c]) + 1)
            if rest:
                return (c, *rest)
        return ()

    def complement(self, gap: int, most: int = 3) -> tuple[int, ...]:
        """One to `most` available lengths that fill the gap exactly, the fewest and then the longest first."""
        if self.n[gap] > 0:
            return (gap,)
        return (most > 1 and self.pair(gap)) or (most > 2 and gap > 2 and self.triple(gap)) or ()


def complements_first(counts: dict[int, int], capacity: int, most: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that exact complements of up to `most` lengths make, for lengths above `least` from the longest down,
    then best-fit for the rest."""
    index, patterns = SumIndex({k: v for k, v in counts.items() if k < capacity}, capacity), []
    if counts.get(capacity):
        patterns.append(((capacity,), counts[capacity]))
    for length in range(capacity - 1, least, -1):
        while index.n[length] > 0:
            index.set(length, int(index.n[length]) - 1)
            found = index.complement(capacity - length, most)
            index.set(length, int(index.n[length]) + 1)
            if not found:
                break
            used = Counter((length, *found))
            times = min(int(index.n[k]) // v for k, v in used.items())
            for k, v in used.items():
                index.set(k, int(index.n[k]) - v * times)
            patterns.append(((length, *found), times))
    return patterns + best_fit({k: int(index.n[k]) for k in range(1, capacity) if index.n[k]}, capacity)


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) with multiplicities that use up all counts.  Lengths are 1 to capacity.

    Pairs and triples can use up short pieces that long ones would need later, so the plan is made with complements of
    up to three, two and one lengths and for all lengths or those over half; what isn't full is then pooled and planned
    once more.  The plan with the fewest sequences is taken, and of equals the one with the most complements.
    """
    n = lambda plan: sum(times for _, times in plan)
    plans = [complements_first(counts, capacity, most, least) for most in (3, 2, 1) for least in (0, capacity // 2)]
    for plan in list(plans):
        pool: Counter = Counter()
        for lengths, times in plan:
            if sum(lengths) < capacity:
                for k in lengths:
                    pool[k] += times
        plans.append([x for x in plan if sum(x[0]) == capacity] + min((complements_first(pool, capacity, 3, least) for least in (0, capacity // 2)), key=n))
    return min(plans, key=n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit with lengths in falling order; bins of equal contents are handled together."""
    bins: dict[int, list[list]] = {}  # gap: [contents, how many]
    for length, left in sorted(counts.items(), reverse=True):
        while left:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                each = capacity // length
                for many, times in ((each, left // each), (left % each, 1)):
                    if many and times:
                        bins.setdefault(capacity - many * length, []).append([(length,) * many, times])
                left = 0
                continue
            group = bins[gap][-1]
            times = min(left, group[1])
            group[1] -= times
            left -= times
            contents = (*group[0], length)
            if not group[1]:
                bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
            bins.setdefault(gap - length, []).append([contents, times])
    return [(tuple(c), n) for groups in bins.values() for c, n in groups]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Sorted intervals of ranks per length: where each starts, the sequence that takes its first piece, the offset."""
    used, rows, sequence = Counter(), [], 0
    for lengths, times in patterns:
        at = 0
        for length in lengths:
            rows.append((length, used[length], sequence, at))
            used[length] += times
            at += length
        sequence += times
    rows.sort()
    length, lo, seq, at = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 4
    return {"key": length << 44 | lo, "lo": lo, "sequence": seq, "offset": at}


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        encode, ranks, task = byte_level(path).encode, Counter(), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                start, k = 0, 0
                end = len(ids) % capacity or capacity
                while start < len(ids):
                    n = end - start
                    rows.append((doc, k, start, n, zlib.crc32(ids[start:end]), task, ranks[n]))
                    ranks[n] += 1
                    start, end, k = end, end + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PIECE.types)] if rows else [pa.array([], t) for t in _PIECE.types], schema=_PIECE)

    return run


_PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])


def _placed(table: dict[str, np.ndarray]):
    def run(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            i = np.searchsorted(table["key"], length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(5)), pa.array(table["sequence"][i] + rank - table["lo"][i]), pa.array(table["offset"][i])],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (null: empty) and the end id.  Longer ones than `capacity` are cut; the first piece
    is the shorter one.  Repeated rows and null ids are packed like any other; texts of any length are read whole; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    scratch = Scratch(spark, "pack")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    pieces = scratch.keep(rows.mapInArrow(_pieces(path or public_path("byte_bpe_50k.json"), end_id, capacity), schema), "pieces")
    counts = scratch.keep(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    table = slots(plan_patterns({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    placed = ranked.mapInArrow(_placed(table), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
