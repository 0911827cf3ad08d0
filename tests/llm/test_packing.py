import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import packing as P
from foliomill.llm.tokens import by_library, public_path


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_plan_uses_every_piece_once_and_fits(counts):
    plan = P.plan_patterns(counts, 64)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)
    bins, total = sum(t for _, t in plan), sum(k * v for k, v in counts.items())
    assert bins <= max(-(-total // 32), 1) + 1  # no two half-empty ones


def test_exact_complements():
    assert P.plan_patterns({60: 5, 4: 5}, 64) == [((60, 4), 5)]
    assert P.plan_patterns({40: 2, 14: 2, 10: 2}, 64) == [((40, 14, 10), 2)]
    assert sum(t for _, t in P.plan_patterns({30: 4, 16: 2, 9: 4}, 64)) == 3
    assert P.plan_patterns({}, 64) == []


def test_near_the_lower_bound():
    lengths = np.random.default_rng(0).integers(1, 1025, 20_000)
    plan = P.plan_patterns({int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))})
    assert sum(t for _, t in plan) <= 1.02 * lengths.sum() / 1024


def check(docs, packed):
    path = public_path("byte_bpe_50k.json")
    found = packed.collect()
    expected = Counter()
    for r in docs.collect():
        ids = np.array([*by_library(path, r["text"] or ""), 2], "<u4")
        end = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(end, len(ids), 1024)]):
            piece = ids[start : end + 1024 * k]
            expected[r["doc_id"], k, start, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins), sum(r["length"] for r in found)


def test_pieces_of_a_table(docs, empty):
    check(docs, P.pack(docs))
    assert P.pack(empty).count() == 0


def test_query(spark, sf_dir):
    n, total = check(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.op2_best_fit_packing(spark, sf_dir))
    assert n <= 1.02 * total / 1024 + 1
