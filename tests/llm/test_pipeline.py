"""The pipeline against plain versions of its stages, written apart from them, and the queries' registration."""

import math
import zlib
from collections import Counter

import corpus_pipeline as C
from foliomill.llm import entry
from foliomill.llm.tokens import by_library, public_path


def test_registered():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert "pipeline" in queries and {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in entry.queries()}


def languages(rows):
    """Of (id, text, lang) the sure language of each text: words, then shorter n-grams, by plain counting."""
    learn = [(t, lang) for i, t, lang in rows if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    names = sorted({lang for _, lang in learn})
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    parts = lambda w, k: [w] if k == 0 else list(w) if k == 1 else [f"_{w}_"[i : i + k] for i in range(len(w) + 3 - k)]
    counts = [{lang: Counter() for lang in names} for _ in range(6)]
    for t, lang in learn:
        for w in letters(t):
            for k in range(6):
                counts[k][lang].update(parts(w, k))
    total = [{lang: sum(c[lang].values()) + 0.5 * len(set().union(*c.values())) for lang in names} for c in counts]
    kept = set()
    for i, t, _ in rows:
        words = letters(t or "")
        score, n = Counter(), 0
        for w in words:
            for k in (0, 5, 4, 3, 2, 1):
                known = [x for x in parts(w, k) if any(x in counts[k][lang] for lang in names)]
                if known:
                    n += 1
                    for lang in names:
                        score[lang] += sum(math.log((counts[k][lang][x] + 0.5) / total[k][lang]) for x in known) / len(known)
                    break
        prior = {lang: math.log(sum(x == lang for _, x in learn) / len(learn)) for lang in names}
        if words:
            best = max(names, key=lambda lang: score[lang] + prior[lang])
            sure = {lang: score[lang] * (min(n, 30) / n if n else 0) + prior[lang] for lang in names}
            if 1 / sum(math.exp(v - sure[best]) for v in sure.values()) >= C.SURE:
                kept.add(i)
    return kept


def shingle_groups(rows):
    """Of (id, text) the ids that stay: the smallest of each group linked by a Jaccard similarity of 0.8."""
    sets = []
    for i, t in sorted(rows):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets}
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if (not x and not y) or (x | y and len(x & y) >= 0.8 * len(x | y)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").collect()}
    got = docs
    for name, stage in C.STAGES[:-1]:
        before = got
        got = stage(spark, before, sf_dir)
        assert got.columns == docs.columns
        rows, ids = before.collect(), {r["doc_id"] for r in got.collect()}
        if name == "language":
            assert len(ids ^ languages([(r["doc_id"], r["text"], r["lang"]) for r in rows])) <= 1
        elif name == "toxicity":
            gone = {r["doc_id"] for r in rows} - ids
            assert all(toxic.get(i, 1) == 1 for i in gone)
        elif name == "exact copies":
            last = {}
            for r in rows:
                last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
            assert ids == set(last.values())
        else:
            assert ids == shingle_groups([(r["doc_id"], r["text"]) for r in rows])
    left, pieces = {r["doc_id"]: r["text"] for r in got.collect()}, Counter()
    for r in C.run(spark, sf_dir).collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {i: len(by_library(public_path("byte_bpe_50k.json"), t or "")) + 1 for i, t in left.items()}


def test_odd_rows(spark, docs, empty, tmp_path):
    for frame in (docs, empty):
        folder = f"file://{tmp_path}/{frame is docs}"
        labels = frame.selectExpr("doc_id", "1 as quality", "cast(doc_id % 7 = 0 as int) as toxic")
        labels.write.parquet(f"{folder}/labels.parquet")
        at = frame
        for _, stage in C.STAGES:
            at = stage(spark, at, folder)
        at.count()


def test_rows_that_share_an_id_are_kept_each_by_its_own_verdict(spark):
    words = [f"w{k}" for k in range(120)]
    text, near = " ".join(words), " ".join([*words[:60], "x", *words[61:]])
    rows = [(1, "one text"), (1, "another text"), (2, "one text"), (None, "another text"), (None, "a third"), (3, text), (None, near), (None, "a third")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = C.exact(spark, frame, "")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert pairs(got) == sorted([(2, "one text"), (1, "another text"), (None, "a third"), (3, text), (None, near)], key=str)
    assert pairs(C.near(spark, got, "")) == sorted([(2, "one text"), (1, "another text"), (None, "a third"), (3, text)], key=str)
