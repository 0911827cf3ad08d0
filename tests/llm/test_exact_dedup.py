import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from foliomill.llm import exact_dedup as E


def test_groups_and_winners(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for capacity in (2, 1024):
        found = E.exact_copies(docs, capacity=capacity).collect()
        assert len(found) == len(rows)
        kept = defaultdict(int)
        text_of = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
        for r in found:
            members = groups[text_of[r["text_sha256"]]]
            assert r["group_size"] == len(members)
            assert r["keep_id"] == max((m for m in members if m is not None), default=None)
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] += r["kept"]
        assert set(kept.values()) == {1}


def test_empty(empty):
    assert E.exact_copies(empty).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    m = E.MisraGries(3)
    for part in (dict(a=50, b=1, c=1), dict(a=10, d=1, e=1, f=1), dict(b=30, g=1), dict(a=20, h=1, i=1)):
        m.add(part)
    assert len(m.counts) <= 3 and {"a", "b"} <= set(m.counts)


def test_keeping_rows_returns_repeated_rows_once(docs):
    kept = E.exact_copies(docs).where("kept")
    out = E.keep_rows(docs, kept.select("doc_id", "text_sha256"), F.sha2(F.coalesce("text", F.lit("")), 256))
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in kept.collect())
