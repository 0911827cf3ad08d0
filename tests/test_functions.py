"""Functions and operators on small inputs made for each case."""

from pyspark.sql import functions as F

from foliomill.functions import status as S
from foliomill.functions import text as T
from foliomill.plans import boilerplate, cleanup, headings, links, outline, quality, structure
from foliomill.sources import html


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_text_repairs(spark):
    assert one(spark, "a , b ; c", T.close_up_punctuation) == "a, b; c"
    assert one(spark, "One.Two three?Four e.g.x", T.space_sentences) == "One. Two three? Four e.g.x"
    assert one(spark, "12 % of 3, 5 % and 7 kg", lambda x: T.close_up_units(T.close_up_percent(x))) == "12% of 3,5% and 7kg"
    assert one(spark, "sen- tence", T.join_hyphenated) == "sentence"
    assert one(spark, "oneTwo ThreeFour", T.split_camel) == "one Two Three Four"
    assert one(spark, "to a.b@c.org now", T.strip_emails) == "to now"
    assert one(spark, "Éa  Ña!", T.slug) == "ea-na"
    assert one(spark, " A b/c--D ", T.class_key) == "a_b_c_d"
    assert one(spark, None, T.close_up_punctuation) is None
    assert one(spark, "", T.words) == []
    assert one(spark, "A Short Title", T.looks_like_heading) is True
    assert one(spark, "a sentence that ends.", T.looks_like_heading) is False


def test_status_maps_differ(spark):
    for word, report, state, project in (("unavailable", "passed_with_warnings", "unavailable", "unavailable"), ("nonsense", "failed", "unavailable", "unavailable"), (" PASS ", "passed", "passed", "passed"), (None, "failed", "unavailable", "unavailable")):
        assert (one(spark, word, S.report_status), one(spark, word, S.state_status), one(spark, word, S.project_status)) == (report, state, project)
    frame = spark.createDataFrame([("passed",), ("failed",), ("passed_with_warnings",)], "s string")
    assert frame.agg(S.worst(F.col("s")).alias("w")).first()["w"] == "failed"
    assert frame.where("false").agg(S.worst(F.col("s")).alias("w")).first()["w"] == "passed"


def test_short_documents_count_lines_from_both_ends(spark):
    docs = spark.createDataFrame([(1, "s", "en", "a\nb"), (2, "s", "en", ""), (3, "s", "en", None)], "doc_id long, source string, lang string, text string")
    assert sorted(r["line"] for r in boilerplate.edge_lines(docs).collect()) == ["a", "a", "b", "b"]


def test_decisions_in_tables_are_blocked(spark):
    docs = spark.createDataFrame([(1, "s", "x, y " * 500), (3, "s", "one, two"), (5, "s", "a, b\nc")], "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["status"], round(r["score"], 4)) for r in cleanup.decisions(docs).where("error_class = 'spacing-punctuation'").collect()}
    assert got == {1: ("blocked", 0.0), 3: ("review_needed", 0.8275), 5: ("safe_auto_fix", 0.8875)}


def test_paragraphs(spark):
    long = "w" * 70
    docs = spark.createDataFrame([(1, f"{long}\n{long}.\nnext\nlast")], "doc_id long, text string")
    assert [(r["n_lines"]) for r in structure.paragraphs(docs).orderBy("island").collect()] == [2, 1, 1]


def test_page_slots_of_broken_html(spark):
    page = '<html><nav><a href="/x">X</a></nav><h1 id="t">Head<p>One <b>two<br>three<p>Four<script>no()</script><div>five'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    got = [(r["block"], r["level"], r["text"], r["dom_id"]) for r in html.slots(pages).orderBy("page_id", "ord").collect()]
    assert got == [("nav", None, "X", None), ("h1", 1, "Head", "t"), ("p", None, "One twothree", None), ("p", None, "Four", None), ("div", None, "five", None)]


def test_heading_changes(spark):
    cols = "page_id long, level int, text string"
    before = spark.createDataFrame([(1, 1, "Same"), (1, 2, "Lost Heading")], cols)
    after = spark.createDataFrame([(1, 1, "Same"), (1, 2, "42")], cols)
    got = {(r["change"], r["reason"], r["confidence"]) for r in headings.changes(before, after).collect()}
    assert got == {("removed", "semantic-heading-normalization", 0.76), ("recovered", "recovered-section-heading", 0.7)}


def test_citation_ranges(spark):
    docs = spark.createDataFrame([(1, "x [AB1]-[AB3] [AB2]"), (2, "[AB1]-[AB99]"), (3, "none"), (4, "[AB5]-[AB4]")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["ref"]) for r in links.citations(docs).collect()) == [(1, 1), (1, 2), (1, 3)]


def test_greedy_matching_takes_each_once(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.85), (1, 1, 1, 0.3), (2, 0, 0, 0.5), (2, 0, 1, 0.5)], "page_id long, l int, h int, score double")
    assert sorted((r["page_id"], r["l"], r["h"]) for r in links.matched(rows).collect()) == [(1, 0, 0), (1, 1, 1), (2, 0, 1)]


def test_outline_prefers_nested_under_containers(spark):
    cols = "page_id long, ord int, level int, title string, page int"
    rows = [(1, 0, 1, "Part one", 0)] + [(1, k, 2, f"Nested title {k}", k) for k in range(1, 5)] + [(2, 0, 1, "Plain", 0), (2, 1, 2, "Sub", 1)]
    got = [(r["page_id"], r["title"]) for r in outline.selected(spark.createDataFrame(rows, cols)).orderBy("page_id", "page").collect()]
    assert got == [(1, "Part one")] + [(1, f"Nested title {k}") for k in range(1, 5)] + [(2, "Plain")] or got[1:] == [(1, f"Nested title {k}") for k in range(2, 5)] + [(2, "Plain")]


def test_budgets_are_strict(spark):
    cols = "s long, w long, h long"
    rows = spark.createDataFrame([(10, 10, 20), (11, 10, 20), (20, 10, 20), (21, 10, 20), (1, None, None)], cols)
    assert [r["x"] for r in rows.select(quality.over_budget(F.col("s"), F.col("w"), F.col("h")).alias("x")).collect()] == ["passed", "passed_with_warnings", "passed_with_warnings", "failed", "failed"]
