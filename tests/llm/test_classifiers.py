"""Held-out accuracy of language and toxicity, and how texts are restored."""

import random

import numpy as np
import pyarrow as pa

from foliomill.llm import langid, toxicity

TOXIC = ("idiot", "moron", "scum")


def test_language_held_out(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in langid.op6_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert held and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_odd_rows(docs, empty):
    model = langid.Model.fit(langid.learnable(docs))
    assert model.languages == ["de", "en"]
    found = langid.identify(docs, model)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == docs.count()
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (30, 31, 32))
    assert rows[None]["held_out"] is False and rows[38]["lang_pred"] in ("de", "en")
    assert langid.identify(empty, model).count() == 0
    nothing = langid.Model.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    kept = langid.kept(docs, model, 0.0)
    assert kept.schema == docs.schema and kept.count() == docs.count() - 3


def test_numerals_are_not_letters_and_long_words_are_learned(spark):
    long = "ab" * 60
    rows = [(k, f"{long} the house", "en") for k in range(8)] + [(k, "das haus und der", "de") for k in range(8, 16)]
    model = langid.Model.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "0" + long in model.rows
    scorer = langid.Scorer(model)
    assert {scorer.predict(t) for t in ("\u00b2", "\u2462 12", "\u00bd \u2167", "_", "")} == {("und", 0.0)}
    assert scorer.predict("haus " * 3 + "the " * 2)[0] == scorer.predict("haus " * 300 + "the " * 200)[0]


def brute_language(rows, held):
    """Word-first back-off by plain counting, over all learnable rows: no sample, no bound, no cache."""
    import math
    import zlib
    from collections import Counter

    learn = [(t, lang) for i, t, lang in rows if lang is not None and t is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2) and i is not None]
    langs = sorted({lang for _, lang in learn})
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    padded = lambda w, k: [w[i : i + 1] for i in range(len(w))] if k == 1 else [f"_{w}_"[i : i + k] for i in range(len(w) + 3 - k)]
    counts = [{lang: Counter() for lang in langs} for _ in range(6)]
    for t, lang in learn:
        for w in letters(t):
            counts[0][lang][w] += 1
            for k in range(1, 6):
                counts[k][lang].update(padded(w, k))
    size = [len(set().union(*c.values())) for c in counts]
    totals = [{lang: sum(c[lang].values()) for lang in langs} for c in counts]
    log = lambda k, x, lang: math.log((counts[k][lang][x] + 0.5) / (totals[k][lang] + 0.5 * size[k]))
    prior = {lang: math.log(sum(x == lang for _, x in learn) / len(learn)) for lang in langs}
    out = {}
    for i, t, _ in rows:
        if not t or not letters(t):
            out[i] = "und"
            continue
        score = dict(prior)
        for w in letters(t):
            for k in range(0, 6):
                order = [0, 5, 4, 3, 2, 1][k]
                known = [x for x in ([w] if not order else padded(w, order)) if any(counts[order][lang][x] for lang in langs)]
                if known:
                    for lang in langs:
                        score[lang] += sum(log(order, x, lang) for x in known) / len(known)
                    break
        out[i] = max(langs, key=lambda lang: score[lang])
    return out


def test_query_agrees_with_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.op6_language_id(spark, sf_dir).collect()}
    expected = brute_language(rows, None)
    assert len(found) == len(rows) and sum(found[i] != expected[i] for i in found) <= 0.005 * len(rows)


def test_unseen_words_back_off_to_shorter_grams(docs):
    model = langid.Model.fit(docs)
    assert (model.word("the") == model.table[model.rows["0the"]]).all()
    assert "0brownish" not in model.rows and "0quick" in model.rows and model.word("brownish") is not None
    assert model.word("龍") is None


def corpus(spark):
    rng = random.Random(2)
    plain = "the of and with they was for were this that from have not are but you all any can her one our out day get has him his how".split()
    plain += ["".join(rng.choice(["ba", "ko", "ri", "tu", "ne", "sal", "mi"]) for _ in range(3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 6 == 0:
            words[rng.randint(0, 39)] = rng.choice(TOXIC)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, docs, empty):
    texts, labels = corpus(spark)
    model, lexicon = toxicity.fit(texts, labels)
    assert {"=" + w for w in TOXIC} <= set(lexicon.shares)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(texts, model, lexicon).collect()}
    assert all(got[r["doc_id"]]["predicted"] == r["toxic"] for r in labels.collect())
    assert {r["held_out"] for r in got.values()} == {True, False}
    scorer = toxicity.Scorer(model, lexicon)
    for text in ("you 1d10t", "what an i d i o t he is", "idiooot!", "m0ron***", "$cum.", "sc-um", "Idiot"):
        assert scorer.score(text) >= 0.7, text
    for text in (None, "", "the day was one", "they can get 100 of them", "a b c"):
        assert scorer.score(text) < 0.7, text
    odd = toxicity.score_toxicity(docs, model, lexicon)
    assert odd.count() == docs.count() and toxicity.score_toxicity(empty, model, lexicon).count() == 0
    kept = toxicity.kept(texts, model, lexicon)
    assert kept.schema == texts.schema and kept.count() == 200


def test_toxicity_query_on_held_out_rows(spark):
    """The query at production parameters: labelled documents of the fold that it didn't learn from."""
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").collect()}
    found = toxicity.op3_toxicity(spark, folder).collect()
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count() and all(0 <= r["score"] <= 1 for r in found)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [p for t, p in held if t == 1], [p for t, p in held if t == 0]
    assert len(toxic) >= 10 and sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.01 * len(clean)  # some labels are noise


def test_toxicity_without_labels(spark, docs, empty):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model, lexicon = toxicity.fit(docs, nothing)
    assert len({r["score"] for r in toxicity.score_toxicity(docs, model, lexicon).collect()}) == 1
    toxicity.fit(empty, nothing)


def test_restoring_leaves_clean_text_alone(spark):
    texts, _ = corpus(spark)
    r = toxicity.Restorer(toxicity.character_model(texts))
    assert r.text("The day, was. One*** (from)") == "the day was one from"
    assert r.chunk("w-i-t-h") == "with" and r.chunk("th3y") == "they" and r.chunk("---") == ""


def test_copies_of_one_document_are_not_evidence():
    same = [[1, 2, 3, 4, 5, 6, 7, 8]] * 30
    apart = [[k * 8 + j for j in range(8)] for k in range(5)]
    assert toxicity.independent(same) < 1.1 and toxicity.independent(apart) == 5 and toxicity.independent([]) == 0


def test_spacing_and_repeats_are_read_in_the_lattice():
    rng = random.Random(4)
    words = "the of and with they was for were this that from have not are but you all any can her one our out day a is he i see good letter off".split()
    texts = [" ".join(rng.choice([*words, *TOXIC]) for _ in range(40)) for _ in range(300)]
    counts = next(toxicity._trigrams([pa.RecordBatch.from_pydict({"text": texts})])).to_pydict()
    n = np.zeros(toxicity.LETTERS**3)
    n[counts["gram"]] = counts["n"]
    n = n.reshape((toxicity.LETTERS,) * 3) + 0.01
    r = toxicity.Restorer(np.log(n / n.sum(axis=2, keepdims=True)))
    for text, found in {
        "he is a m o r o n": "he is a moron",
        "y o u i d i o t": "you idiot",
        "i  d  i  o  t": "idiot",
        "m\to\nr o n.": "moron",
        "s c u m": "scum",
        "i d 1 o t": "idiot",
        "m" + "o" * 100 + "ron": "moron",
        "idiiot": "idiot",
        "!diot": "idiot",
        "off! a letter, good": "off a letter good",
    }.items():
        assert r.text(text) == found, text
    assert "idiot" in r.text("the-good-" * 12 + "1d10t")
    assert len(r.text("a b " * 3000)) >= 6000
