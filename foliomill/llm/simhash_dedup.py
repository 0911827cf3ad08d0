"""SimHash near-deduplication by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits.  The binary Golay code of length 23 is perfect:
every word decodes to one codeword within 3 errors.  Decoding a segment and its 23 one-bit neighbours gives one or
six codeword indices, and two segments that differ in at most 2 bits share one of them, through the word midway.
At most 4 differing bits over segments A, B and C (pigeonhole) leave these keys, one of which both sides have:

  A equal        all of A, codeword index of B; or, if B has 3 errors or more, all of A, index of C
  B equal        all of B, codeword index of A; or all of B, index of C
  C equal        all of C, codeword index of A; or all of C, index of B
  none equal     A and B have at most 2 errors, C at most 2, so that one of its three thirds is equal:
                 index of A, index of B, that third

Keys have 30 bits or more.  Every pair within 4 bits meets under some key, and each is verified.

Only distinct fingerprints are compared.  Rows (key, node) are dealt by key, and the task that has all nodes of a key finds
their components, in blocks of bit counts; pairs are never made as rows.  A task gives one row for each node that it linked.
Nodes are compared with those that their component hasn't reached yet, which is linear in dense groups.  Crowded keys of
several components are first split into finer keys, of which a linked pair shares one.  Nothing is left out.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, in_large_batches, in_small_batches, load, text_or_empty

WORDS, SEED, BITS = 4, 42, 4
#: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Nodes that are compared at once; more under one key are split, at most this often, and more
#: sets are dealt in blocks.
CROWD, SPLITS = 512, 4
#: Rows of keys and shingles that a task reads, on average; and the most shingles of a block of sets.
KEY_ROWS, SET_ROWS, BLOCK = 1 << 21, 1 << 21, 1 << 22
#: Widths of the segments A, B and C.
SEGMENTS = (23, 23, 18)
#: For similarities: segments of 23 of the 256 bits, one for each table of keys; odd numbers that mix hashes.
TABLES = 11
ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (1 << 64) - 1 for k in range(TABLES)], np.uint64)


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `words` words, repeats included; of the whole sequence if it is shorter; none if empty."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    whole, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1]
    return np.array([h(whole[i:j], seed) for i, j in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; zero without any.  Long texts are counted in blocks."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096]
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(words: int, seed: int):
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t, words, seed)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(words, seed), "id long, fp long")


def _syndrome(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GOLAY << (i - 11)
    return word


@lru_cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the single bits, and for each of the 2048 syndromes its error pattern of weight 3 at most."""
    bits = np.array([_syndrome(1 << i) for i in range(23)], np.int64)
    errors = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            errors[np.bitwise_xor.reduce(bits[list(places)])] = sum(1 << i for i in places)
    return bits, errors


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word the codeword indices (12 bits) of it and its one-bit neighbours; which are not repeats."""
    bits, errors = golay_tables()
    syndromes = np.zeros(len(words), np.int64)
    for i in range(23):
        syndromes ^= np.where(words >> i & 1, bits[i], 0)
    near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23))], axis=1)
    of = np.concatenate([syndromes[:, None], syndromes[:, None] ^ bits[None, :]], axis=1)
    found = np.sort((near ^ errors[of]) >> 11, axis=1)
    return found, np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of each fingerprint, as 64-bit integers that carry their case in the top bits."""
    u = fps.view(np.uint64)
    parts, at = [], 0
    for width in SEGMENTS:
        parts.append((u >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    a, b, c = parts
    (ka, ma), (kb, mb), (kc, mc) = map(codeword_indices, parts)
    rows, keys = [], []

    def emit(case: int, whole: np.ndarray, index: np.ndarray, mask: np.ndarray) -> None:
        r, j = np.nonzero(mask)
        rows.append(r)
        keys.append((case << 40) | (whole[r] << 12) | index[r, j])

    third = SEGMENTS[2] // 3
    for j in range(ka.shape[1]):  # A and B by index, a third of C as it is
        r = np.nonzero(ma[:, j])[0]
        if len(r):
            rr, jj = np.nonzero(mb[r])
            both = (ka[r[rr], j] << 12) | kb[r[rr], jj]
            for k in range(3):
                rows.append(r[rr])
                keys.append(((k + 1) << 40) | ((c[r[rr]] >> (third * k) & ((1 << third) - 1)) << 24) | both)
    for case, (whole, index, mask) in enumerate(((a, kb, mb), (a, kc, mc), (b, ka, ma), (b, kc, mc), (c, ka, ma), (c, kb, mb)), 4):
        emit(case, whole, index, mask)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches):
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 8192):
            rows, keys = fuzzy_keys(fps[at : at + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(rows + at))], names=["key", "node"])


def spread(nodes: DataFrame) -> DataFrame:
    """Dealt to as many tasks as a shuffle has: a row is small and has many keys, so few tasks read many rows."""
    return nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")


def bit_parts(level: int, parts: int = BITS + 1) -> list[int]:
    """Masks that share out the 64 bits; two fingerprints within BITS bits agree under one of them."""
    order = np.random.default_rng(level).permutation(64).tolist()
    masks = [sum(1 << i for i in order[k::parts]) for k in range(parts)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bit_components(x: np.ndarray, most: int) -> np.ndarray:
    """For each row of (n, k) words the first row that steps of at most `most` bits lead to.

    Each row is compared once with the rows that no component has reached by then.
    """
    root, left = np.full(len(x), -1, np.int64), np.arange(len(x))
    while len(left):
        start, front, left = left[0], left[:1], left[1:]
        root[start] = start
        while len(front) and len(left):
            hit, step, at = np.zeros(len(left), bool), 1, 0
            while at < len(front):
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    break
                step = max(1, (1 << 18) // len(rest))
                apart = sum(np.bitwise_count(x[front[at : at + step], k, None] ^ x[left[rest], k]).astype(np.int16) for k in range(x.shape[1]))
                hit[rest[(apart <= most).any(axis=0)]] = True
                at += step
            front, left = left[hit], left[~hit]
            root[front] = start
    return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as (node, least node reachable), without those that are the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def key_links(keys: np.ndarray, nodes: np.ndarray, x: np.ndarray, most: int, crowd: int, splits: int = 0, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the same nodes as all pairs under one key whose words x differ in at most `most` bits.

    Keys are first settled by the bits to their first node; what that leaves apart is compared, and while `splits` allow
    it, crowds are split by parts of the bits, one of which a pair has in common (for one word and at most BITS bits).
    """
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    sizes = np.diff(starts, append=len(keys))
    order, sizes = order[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
    if not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, x, starts = nodes[order], x[order], np.cumsum(sizes) - sizes
    head = np.repeat(starts, sizes)
    near = np.bitwise_count(x ^ x[head]).sum(axis=1, dtype=np.int64) <= most
    a, b = [nodes[near]], [nodes[head[near]]]
    for g in np.flatnonzero((np.add.reduceat(~near, starts) > 0) & (sizes > 2)).tolist():
        at = slice(int(starts[g]), int(starts[g] + sizes[g]))
        if sizes[g] > crowd and level < splits:
            for mask in bit_parts(level):
                finer = key_links(x[at, 0].view(np.int64) & np.int64(mask), nodes[at], x[at], most, crowd, splits, level + 1)
                a.append(finer[0])
                b.append(finer[1])
        else:
            a.append(nodes[at])
            b.append(nodes[at][bit_components(x[at], most)])
    return np.concatenate(a), np.concatenate(b)


def gathered(batches) -> list[np.ndarray] | None:
    """The long columns of all batches."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts)] if parts else None


def _linked(most: int, crowd: int, splits: int):
    def run(batches):
        columns = gathered(batches)
        if columns is not None:
            x = np.stack(columns[2:] or columns[1:2], axis=1).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest(*key_links(columns[0], columns[1], x, most, crowd, splits))], names=["a", "b"])

    return run


def in_parts(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many rows: as many as a shuffle has, or more, so that none reads many more than `each`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def key_components(keys: DataFrame, rows: int, most: int, scratch: Scratch, splits: int = 0) -> DataFrame:
    """(node, component) of nodes joined by pairs under one of about `rows` keys (key, node, words...) that differ in at
    most `most` bits; without words the node is the word."""
    spark = keys.sparkSession
    links = keys.repartition(in_parts(spark, rows, KEY_ROWS), "key").mapInArrow(_linked(most, CROWD, splits), "a long, b long")
    in_large_batches(spark)
    found = scratch.keep(links, "links")
    in_small_batches(spark)
    return connected_components(spark, found, scratch)


def fingerprint_components(fps: DataFrame, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """(fp, root) for distinct fingerprints: root is the least fingerprint reachable by steps of at most `bits` <= 4 bits."""
    if bits > BITS:
        raise ValueError("the keys find pairs of at most 4 differing bits")
    keys = spread(fps.select(F.col("fp").alias("node"))).mapInArrow(_keyed, "key long, node long")
    roots = key_components(keys, 117 * fps.count(), bits, scratch, SPLITS)
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Null and empty texts have fingerprint zero and link like any other.  Rows with equal fingerprints are linked; a
    null id keeps its row but never names a component unless the component has no other.  Repeated rows are returned
    each.  An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, id_col, text_col, words, seed), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = scratch.keep(fingerprint_components(distinct, scratch, bits), "roots")
    named = roots.join(distinct, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = scratch.keep(roots.join(ids, "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Four 64-bit fingerprints of a set of shingles, under four mixings of their hashes."""
    mixed = []
    for k in range(4):
        h = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed.append(fingerprint(h ^ (h >> np.uint64(31))))
    return np.array(mixed, np.uint64)


def anchors(found: np.ndarray) -> np.ndarray:
    """Of each table the least shingle hash under the table's mixing: sets of similarity s share one with chance s."""
    least = np.full(TABLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 14):
        least = np.minimum(least, (found[at : at + (1 << 14), None] * ODD).min(axis=0))
    return least


def anchored_keys(words: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of (n, 4) words and (n, TABLES) anchors: in each table a segment's codeword indices, each beside the
    table's anchor, without which a key of 12 bits would gather ever more strangers as the table of texts grows."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, : TABLES * 23].reshape(len(words), TABLES, 23).astype(np.int64)
    segments = bits @ (1 << np.arange(23))
    rows, keys = [], []
    for table in range(TABLES):
        index, mask = codeword_indices(segments[:, table])
        r, j = np.nonzero(mask)
        of = least.view(np.uint64)[r, table] ^ ((index[r, j] + (table << 12) + 1).astype(np.uint64) * ODD[0])
        rows.append(r)
        keys.append((of * ODD[1]).view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def shingle_set(text: str | None, words: int, seed: int) -> tuple[np.ndarray, int]:
    """The distinct shingle hashes of a text in order, and a digest of them that stands for the set."""
    found = np.unique(shingle_hashes(text, words, seed))
    return found, xxhash.xxh3_64_intdigest(found.tobytes())


#: Columns of a set's fingerprints and anchors.
WIDE = [f"w{k}" for k in range(4)]
ANCHORS = [f"a{k}" for k in range(TABLES)]


def _wide(words: int, seed: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words, seed) for t in b.column(1).to_pylist()]
            found = np.array([np.concatenate([wide_fingerprint(s), anchors(s)]) for s, _ in sets], np.uint64).reshape(-1, 4 + TABLES).view(np.int64)
            nodes = pa.array(np.array([d for _, d in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), nodes, *(pa.array(found[:, k]) for k in range(4 + TABLES))], names=["id", "digest", "node", *WIDE, *ANCHORS])

    return run


def _sets(words: int, seed: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words, seed) for t in b.column(0).to_pylist()]
            nodes = pa.array(np.array([d for _, d in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([nodes, b.column(1), pa.array([s.tobytes() for s, _ in sets], pa.binary())], names=["node", "part", "shingles"])

    return run


def set_components(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of distinct hashes the first one that steps of this Jaccard similarity or more lead to.

    Each set is compared once, by itself, with the sets that no component has reached by then.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    flags = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    root, left = np.full(len(sets), -1, np.int64), np.arange(len(sets))
    flat, stops = ids, ends
    while len(left):
        start, front = left[0], [left[0]]
        gone = left == start
        root[start] = start
        while front:
            if gone.sum() * 4 >= len(left):
                left = left[~gone]
                flat = np.concatenate([own[i] for i in left.tolist()] or [ids[:0]])
                stops, gone = np.cumsum(sizes[left]), np.zeros(len(left), bool)
            if not len(left):
                break
            f = front.pop()
            flags[own[f]] = True
            counts = np.concatenate([[0], np.cumsum(flags[flat])])
            flags[own[f]] = False
            shared = counts[stops] - counts[stops - sizes[left]]
            hit = ~gone & (shared / np.maximum(sizes[f] + sizes[left] - shared, 1) >= similarity)
            root[left[hit]] = start
            front += left[hit].tolist()
            gone |= hit
        if gone.any():
            left = left[~gone]
            flat = np.concatenate([own[i] for i in left.tolist()] or [ids[:0]])
            stops = np.cumsum(sizes[left])
    return root


def _similar(similarity: float):
    """(a, b) that join what the sets of each part of (part, node, shingles) do."""

    def run(batches):
        parts, nodes, sets = [], [], []
        for b in batches:
            parts += b.column(0).to_pylist()
            nodes += b.column(1).to_pylist()
            sets += [np.frombuffer(s, np.uint64) for s in b.column(2).to_pylist()]
        order = np.argsort(np.array(parts, np.int64), kind="stable")
        cuts = np.flatnonzero(np.diff(np.array(parts, np.int64)[order])) + 1
        nodes, a, b = np.array(nodes, np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for of in np.split(order, cuts) if len(order) else []:
            found = set_components([sets[i] for i in of.tolist()], similarity)
            a.append(nodes[of])
            b.append(nodes[of[found]])
        a, b = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _starred(similarity: float):
    """Whether each set of (part, node, shingles, pivot, its shingles, ...) has the similarity to the pivot's."""

    def run(batches):
        for b in batches:
            near = []
            for s, p in zip(b.column(2).to_pylist(), b.column(4).to_pylist()):
                s, p = np.frombuffer(s, np.uint64), np.frombuffer(p, np.uint64)
                shared = len(np.intersect1d(s, p, assume_unique=True))
                near.append(shared / max(len(s) + len(p) - shared, 1) >= similarity)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(near, pa.bool_())], names=["part", "node", "shingles", "pivot", "main"])

    return run


def set_links(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs of one part of (node, part, shingles) whose sets have this
    Jaccard similarity.

    The sets of a part meet in one task.  Those of a large part are first compared with one of them, and unless that
    joins all, dealt in blocks, of which each two meet in a task; two blocks of sets that it joined needn't.  So every
    pair that may still join something is compared, however large a part is: the time of a large part grows with its
    square, the rows with its number of blocks.
    """
    spark = sets.sparkSession
    weight = (F.length("shingles") / 8).cast("long")
    sizes = scratch.keep(sets.groupBy("part").agg(F.count("*").alias("n"), F.sum(weight).alias("w")), "sizes")
    total = sizes.agg(F.sum("w")).first()[0] or 0
    crowded = sizes.where((F.col("n") > CROWD) | (F.col("w") > BLOCK))
    many = crowded.agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
    similar = lambda rows, w: rows.repartition(in_parts(spark, w, SET_ROWS), "part").mapInArrow(_similar(similarity), "a long, b long")
    if not many["n"]:
        return similar(sets.select("part", "node", "shingles"), total)
    small = sets.join(crowded.select("part"), "part", "left_anti").select("part", "node", "shingles")
    large = sets.join(crowded.select("part"), "part", "left_semi").select("part", "node", "shingles")
    pivots = large.groupBy("part").agg(F.min(F.struct(F.xxhash64("node").alias("by"), "node")).alias("first")).select("part", F.col("first.node").alias("pivot"))
    pivots = pivots.join(large.select(F.col("node").alias("pivot"), F.col("shingles").alias("pivot_shingles")), "pivot").select("part", "pivot", "pivot_shingles")
    starred = large.join(pivots, "part").select("part", "node", "shingles", "pivot", "pivot_shingles")
    starred = scratch.keep(starred.mapInArrow(_starred(similarity), "part long, node long, shingles binary, pivot long, main boolean"), "starred")
    stars = starred.where("main").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    block = F.least(F.greatest(F.col("w") / 8, CROWD * F.col("w") / F.col("n")), F.lit(BLOCK))
    counts = starred.groupBy("part").agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(F.when(F.col("main"), weight).otherwise(0)).alias("w_main"), F.count_if("main").alias("n_main"))
    counts = counts.where("n_main < n").select(
        "part", F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("w_main")) / block)).cast("int").alias("rest"), F.ceil(F.col("w_main") / block).cast("int").alias("mains")
    )
    dealt = starred.join(counts, "part")
    at = F.when(F.col("main"), F.col("rest") + F.pmod(F.xxhash64("node", F.lit(1)), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("main"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)
    dealt = dealt.withColumn("at", at).withColumn("other", F.explode(others)).where("at <> other or rest + mains = 1")
    dealt = dealt.select(F.xxhash64("part", F.least("at", "other"), F.greatest("at", "other")).alias("part"), "node", "shingles")
    return similar(small, total).unionByName(stars).unionByName(similar(dealt, 16 * many["w"]))


def _wide_keyed(batches):
    for b in batches:
        found = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5 + TABLES)], axis=1)
        for at in range(0, len(found), 4096):
            rows, keys = anchored_keys(found[at : at + 4096, :4], np.ascontiguousarray(found[at : at + 4096, 4:]))
            of = pa.array(rows + at)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(b.column(k).take(of) for k in range(5))], names=["key", "node", *WIDE])


def similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, seed: int = SEED) -> DataFrame:
    """One row per input row: id, component_id, for near copies whose sets of distinct shingles have this Jaccard
    similarity or more.

    At 0.8 two 64-bit fingerprints differ in some 10 bits, beyond what the exact keys can find.  So sets have four
    fingerprints of other mixings, 256 bits; Golay keys of eleven segments, each beside a shingle that the sets' order
    picks, propose pairs (of similarity 0.8: 99.9 in 100, of 0.9: all but one in 100,000), those that differ in more
    bits than one in 30,000 such pairs does are left out.  Texts that the rest joins, however many, are compared all with
    all by their sets, which alone decide (see set_links).  Equal sets are linked first.  Null and empty texts are alike, texts of any length are read whole, and other cases are as in near_copies.
    """
    return similar_rows(docs, id_col, text_col, words, similarity, seed).select(F.col("id").alias(id_col), "component_id")


def digest(text_col: str = "text") -> Column:
    """What similar_rows tells the texts of one id apart by."""
    return F.xxhash64(text_or_empty(text_col))


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, seed: int = SEED) -> DataFrame:
    """similar_copies as (id, digest of the text, root of the group, component_id)."""
    spark = docs.sparkSession
    in_small_batches(spark)
    scratch = Scratch(spark, "similar")
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi  # share of bits, from the cosine of equal-sized sets
    most = round(256 * differ + 4 * (256 * differ * (1 - differ)) ** 0.5)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), digest(text_col).alias("digest"))
    prints = scratch.keep(rows.mapInArrow(_wide(words, seed), "id long, digest long, node long, " + ", ".join(c + " long" for c in WIDE + ANCHORS)), "prints")
    nodes = scratch.keep(prints.groupBy("node").agg(F.min("id").alias("least"), *(F.min(c).alias(c) for c in ["digest", *WIDE, *ANCHORS])), "nodes")
    keys = spread(nodes.select("node", *WIDE, *ANCHORS)).mapInArrow(_wide_keyed, ", ".join(c + " long" for c in ["key", "node", *WIDE]))
    parts = key_components(keys, 60 * nodes.count(), most, scratch)
    texts = scratch.keep(parts.join(nodes.select("node", "digest"), "node").select("digest", F.col("component").alias("part")), "texts")
    found = rows.join(texts, "digest").select("text", "part").mapInArrow(_sets(words, seed), "node long, part long, shingles binary")
    sets = scratch.keep(found.groupBy("node").agg(F.first("part").alias("part"), F.first("shingles").alias("shingles")), "sets")
    links = scratch.keep(set_links(sets, similarity, scratch), "similar")
    roots = connected_components(spark, links, scratch)
    rooted = scratch.keep(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(rooted.join(ids, "root").select("node", "root", "component_id"), "named")
    return prints.select("id", "digest", "node").join(named, "node").select("id", "digest", "root", "component_id")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(load(spark, sf_dir, "documents"))
