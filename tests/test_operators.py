"""Predicates, normalising, ranges, boxes and streamed states on small inputs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliomill.functions import predicates as P
from foliomill.plans import normalise, packages
from foliomill.streaming import jobs

CASES = {
    "external": (["https://a.b", "HTTP://x"], ["/a", "ftp://x"]),
    "page_number": (["12", "Page 3"], ["12 a", ""]),
    "figure_caption": (["Figure 3. x", "Table 1"], ["A figure"]),
    "bullet_item": (["• x", "- y"], ["-y", "x - y"]),
    "ordered_item": (["12) some item", "(3) more text"], ["1234) text", "3) abc"]),
    "synthetic_label": (["chapter 7", "page_12b"], ["chapter seven"]),
    "truncated_heading": (["The rise of the", "Terms and"], ["The rise", "of"]),
    "table_header": (["Name / Value / Unit Price Long Header"], ["name value unit price"]),
    "author_line": (["Anna Maria Nowak", "Editor in chief"], ["one two", "A"]),
    "date_line": (["Kraków, 12.03.2021", "2021-03-12"], ["12.03"]),
    "reference_title": (["References", "further reading list"], ["A reference"]),
    "index_entry": (["apple, 12; pear 14-16, plum 200"], ["apple, 12"]),
    "placeholder_title": (["Untitled", "export_a.pdf", ""], ["A Title"]),
    "ambiguous_href": (["", "https://www/x", "doi:abc"], ["https://a.com/", "doi:10.1/x"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_predicates(spark, name):
    yes, no = CASES[name]
    rows = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no], "x string, e boolean")
    assert [(r["x"], r["y"]) for r in rows.select("x", P.BOOLEAN[name](F.col("x")).alias("y")).collect()] == [(x, True) for x in yes] + [(x, False) for x in no]


def test_every_predicate_has_sql():
    assert set(P.SQL_FORMS) == set(P.BOOLEAN) | set(P.LABELS)


def test_normalising(spark):
    x = spark.createDataFrame([("a &amp;lt; na­tion ( x ) costs 5 % , see http : //www . example . com / p .New",)], "x string")
    assert x.select(normalise.normalize(F.col("x")).alias("y")).first()["y"] == "a &lt; nation (x) costs 5%, see http://www.example.com/p. New"
    assert x.select(normalise.compact_links(F.lit("http : //www . a . org / p doi : 10.1/x")).alias("y")).first()["y"] == "http://www.a.org/p doi:10.1/x"


def test_in_order_matching_never_goes_back():
    rows = pd.DataFrame([(1, 0, "label", "alpha"), (1, 1, "label", "beta"), (1, 2, "block", "beta first"), (1, 3, "block", "alpha"), (1, 4, "block", "beta again")], columns=["page_id", "ord", "kind", "text"])
    assert normalise._in_order(rows).iloc[0].tolist() == [1, 2, 2, 4]


def test_chapters_with_front_matter(spark):
    cols = "page_id long, ord int, level int, title string, page int"
    e = spark.createDataFrame([(1, 0, 2, "early", 0), (1, 1, 1, "One", 2), (1, 2, 1, "Two", 5), (1, 3, 2, "in two", 7), (2, 0, 2, "only", 3)], cols)
    got = [(r["page_id"], r["title"], r["start"], r["stop"]) for r in packages.chapters(e).orderBy("page_id", "start").collect()]
    assert got == [(1, "Front Matter", 0, 1), (1, "One", 2, 4), (1, "Two", 5, 7), (2, "Content", 0, 3)]


def test_streamed_states_equal_batch_ones(spark, sf_dir):
    streamed = {tuple(r) for r in jobs.q41_streamed_jobs(spark, sf_dir).collect()}
    batch = {(r["job_id"], r["status"], r["updated_s"], r["n_events"]) for r in jobs.q39_job_states(spark, sf_dir).collect()}
    assert streamed == batch


def test_active_jobs_never_expire(spark):
    rows = spark.createDataFrame([(1, 1, "error", "2024-01-01 00:00:00"), (2, 2, "click", "2024-01-01 00:00:00"), (3, 3, "purchase", "2024-01-01 06:00:00"), (4, 4, "view", "2024-01-01 12:00:00")], "event_id long, user_id long, event_type string, ts string")
    last = jobs.latest(jobs.job_events(rows.withColumn("ts", F.to_timestamp("ts")).withColumn("value", F.lit(0.0))))
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    expired = last.where(F.col("status").isin(*jobs.ENDED) & (F.col("updated_at") < now - F.expr("INTERVAL 6 HOURS")))
    assert [r["job_id"] for r in expired.collect()] == [1]


def test_poll_intervals(spark):
    rows = spark.createDataFrame([("ready", 5, 0), ("queued", 500, 1200), ("running", 0, 5000), ("repairing", 10, 2500), ("repairing", 130, 3500), ("repairing", 300, 5000)], "s string, e int, ms int")
    assert all(r["got"] == r["ms"] for r in rows.select("ms", jobs.poll_interval(F.col("s"), F.col("e")).alias("got")).collect())
