"""Before a release: signals out of reports, kinds of pages, articles, captions and figures, last runs, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rules as R
from ..functions import text as T
from ..sources import html
from ..sources.tables import load
from . import toc
from .titles import HEADINGS, canonical, canonical_sql, fragments_match, fragments_sql

#: What an error says if it is about a link.
BROKEN = "fragment|could not be found|missing|href"
NON_EDITORIAL = r"(advert|sponsor|reklama|copyright|all rights reserved)"
SPONSORED = ("partner", "marka", "promoc", "ofert", "kampani", "subscri", "buy now")
#: Entries that make a page one of contents; characters below which pages with and without pictures hold
#: nothing of their own; below which a picture makes a gallery.
ENTRIES, WITH_IMAGE, WITHOUT, GALLERY = 6, 220, 120, 260
#: Characters below which an article is too little to stand alone.
FRAGILE = 400


def q94_quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals read out of each page's nested report, written as JSON and parsed again: errors by what they say, and
    counts of the state before and after that are whole numbers in both."""
    issues = toc.contents_map(load(spark, sf_dir, "pages"))
    says = F.transform("issues", lambda i: F.when(i == "missing-file", F.concat(F.lit("Fragment could NOT be found: "), F.col("path"))).when(i == "duplicate-target", "Duplicate ID in page").otherwise("spacing of label"))
    per = issues.select("page_id", F.explode(says).alias("e")).groupBy("page_id").agg(F.sort_array(F.collect_list("e")).alias("errors"))
    counts = F.struct(F.lit("passed").alias("state"), F.size("errors").alias("n"), F.lit(1).alias("old"))
    report = F.struct(F.struct(F.col("errors").alias("errors")).alias("internal_links"), F.struct(F.when(F.size("errors") > 4, "FAILED").otherwise("Passed").alias("status"), F.size("errors").alias("error_count")).alias("summary"), counts.alias("before"))
    text = per.select("page_id", F.to_json(report).alias("j"))
    read = text.select("page_id", "j", F.from_json("j", "internal_links struct<errors: array<string>>, summary struct<status: string, error_count: int>, before map<string, string>").alias("r"))
    of = lambda p: F.size(F.filter("r.internal_links.errors", lambda e: F.lower(e).rlike(p)))
    whole = lambda v: F.coalesce(v, F.lit("0")).rlike("^-?[0-9]+$")
    after = F.create_map(F.lit("n"), F.lit("0"), F.lit("new"), F.lit("2"), F.lit("state"), F.lit("passed"))
    keys = F.array_sort(F.array_union(F.map_keys("r.before"), F.map_keys("after")))
    rows = read.withColumn("after", after).withColumn("keys", keys)
    numeric = F.filter("keys", lambda k: whole(F.try_element_at(F.col("r.before"), k)) & whole(F.try_element_at(F.col("after"), k)))
    return rows.select("page_id", F.lower("r.summary.status").alias("status"), F.col("r.summary.error_count").alias("n_errors"), of(BROKEN).alias("n_broken"), of("duplicate id").alias("n_duplicates"), F.array_join(numeric, ",").alias("numeric_keys"))


def page_measures(pages: DataFrame) -> DataFrame:
    """(page_id, host, title, n_chars, n_images, n_headings, n_links, n_hits, low): what a page's class depends on."""
    raw = F.coalesce("html", F.lit(""))
    body = T.squeeze(F.regexp_replace(raw, "<[^>]*>", " "))
    h1 = F.btrim(F.regexp_extract(raw, r"<h1>([^<]*)", 1))
    title = F.when(h1 != "", h1).otherwise(F.btrim(F.regexp_extract(raw, r"<title>([^<]*)", 1)))
    rows = pages.select("page_id", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), title.alias("title"), F.length(body).alias("n_chars"), T.count(raw, "<img").alias("n_images"), T.count(raw, "<h[1-3]>").alias("n_headings"), T.count(raw, "<a href=").alias("n_links"), F.lower(F.concat_ws(" ", title, body)).alias("low"), T.count(raw, r"\?</p>").alias("n_questions"))
    hits = sum((F.contains("low", F.lit(w)).cast("int") for w in SPONSORED), F.lit(0))
    return rows.withColumn("n_hits", hits)


def page_class() -> Column:
    return (
        F.when(F.col("low").rlike(NON_EDITORIAL), "non-editorial").when((F.col("n_links") >= ENTRIES) & (F.col("n_chars") < 1500), "toc").when(F.contains("low", F.lit("cover")) & (F.col("n_images") >= 1) & (F.col("n_chars") < 250), "cover")
        .when(F.contains("low", F.lit("back")) & F.contains("low", F.lit("cover")), "back-matter").when((F.col("n_images") >= 1) & (F.col("n_chars") < WITH_IMAGE), "non-editorial").when((F.col("n_chars") < WITHOUT) & (F.col("n_headings") <= 1) & (F.col("n_images") == 0), "non-editorial").otherwise("editorial")
    )


def page_kind() -> Column:
    return F.when(F.col("class") == "cover", "cover").when(F.col("class") == "toc", "contents").when(F.col("n_hits") >= 2, "sponsored").when(F.col("n_questions") >= 2, "interview").when((F.col("n_images") >= 1) & (F.col("n_chars") < GALLERY), "gallery").otherwise("article")


def q95_page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_measures(load(spark, sf_dir, "pages")).withColumn("class", page_class())
    return rows.select("page_id", "title", "n_chars", "n_images", "n_headings", "class", page_kind().alias("kind"))


def q96_release_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: shares of pages by class, and whether it may be released: at least half editorial, eight in ten without
    a look."""
    rows = page_measures(load(spark, sf_dir, "pages")).withColumn("class", page_class())
    g = rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_if(F.col("class") == "editorial").alias("n_editorial"), F.count_if(F.col("class") == "toc").alias("n_toc"), F.count_if(F.col("n_headings") == 0).alias("n_bare"), F.sum("n_chars").alias("n_chars"))
    share = F.round(F.col("n_editorial") / F.col("n_pages"), 6)
    return g.withColumn("share", share).withColumn("verdict", F.when(F.col("share") < 0.5, "fail").when((F.col("share") < 0.8) | (F.col("n_bare") > 0), "pass_with_review").otherwise("pass"))


def articles(rows: DataFrame) -> DataFrame:
    """(doc_id, article, n_blocks, n_chars, kind): blocks grouped from one heading of the first two levels to the next.

    What comes before the first heading belongs to it.  An article that is too small joins the one before it.
    """
    w = Window.partitionBy("doc_id").orderBy("i")
    starts = F.col("level").between(1, 2)
    part = F.greatest(F.lit(1), F.sum(F.when(starts, 1).otherwise(0)).over(w))
    each = rows.withColumn("part", part).groupBy("doc_id", "part").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("text").rlike(r"\?$")).alias("n_questions"), F.count_if(R.sponsored.of(F.col("text"))).alias("n_sponsored"))
    v = Window.partitionBy("doc_id").orderBy("part")
    own = F.when((F.col("part") == 1) | (F.col("n_chars") >= FRAGILE), 1).otherwise(0)
    merged = each.withColumn("article", F.sum(own).over(v)).groupBy("doc_id", "article").agg(F.count("*").alias("n_parts"), F.sum("n_blocks").alias("n_blocks"), F.sum("n_chars").alias("n_chars"), F.sum("n_questions").alias("q"), F.sum("n_sponsored").alias("s"))
    return merged.select("doc_id", "article", "n_parts", "n_blocks", "n_chars", F.when(F.col("s") > 0, "sponsored").when(F.col("q") >= 2, "interview").otherwise("article").alias("kind"))


def q97_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(toc.repaired(toc.blocks(load(spark, sf_dir, "documents"))))


def q98_heading_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that stand as headings of their own joined with the heading next to them, and blocks that only repeat
    the title after it: per document how many of each, and a digest of the headings made.

    Numbered headings are taken apart first.  In a run of neighbours that could join, every other one does, which is
    what going from left to right takes.
    """
    b = toc.blocks(load(spark, sf_dir, "documents"))
    apart = F.when(F.col("text").rlike("^1[.]2 ") & F.col("element").startswith("h"), F.array(F.lit("1.2"), F.substr("text", F.lit(5)))).otherwise(F.array("text"))
    rows = b.select("doc_id", "i", "element", F.posexplode(apart).alias("k", "text"))
    w = Window.partitionBy("doc_id").orderBy("i", "k")
    number = lambda c: F.col(c).rlike(r"^[0-9]+([.][0-9]+)*$")
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("text").over(w)).withColumn("next_element", F.lead("element").over(w))
    able = F.col("element").startswith("h") & F.coalesce(F.col("next_element").startswith("h"), F.lit(False)) & (number("text") | number("next"))
    pairs = rows.where(able)
    runs = pairs.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy("doc_id").orderBy("n")))
    taken = runs.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("n"))).where("at % 2 = 1")
    text = F.when(number("text"), F.concat("text", F.lit(" "), "next")).otherwise(F.concat("next", F.lit(" "), "text"))
    joined = taken.groupBy("doc_id").agg(F.count("*").alias("n_joined"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), "|")).alias("made"))
    first = rows.where(F.col("element").startswith("h")).groupBy("doc_id").agg(F.min(F.struct("n", "text")).alias("f")).select("doc_id", F.col("f.n").alias("first"), F.col("f.text").alias("title"))
    after = rows.join(first, "doc_id").where(F.col("n") > F.col("first"))
    fits = (F.length("text") <= 60) & fragments_match(canonical(F.col("text")), canonical(F.col("title")))
    stop = after.groupBy("doc_id").agg(F.min(F.when(~fits, F.col("n"))).alias("stop"), F.max("n").alias("last"), F.first("first").alias("first"))
    repeats = stop.select("doc_id", (F.coalesce("stop", F.col("last") + 1) - F.col("first") - 1).alias("n_repeats"))
    return first.select("doc_id").join(joined, "doc_id", "left").join(repeats, "doc_id", "left").select("doc_id", F.coalesce("n_joined", F.lit(0)).alias("n_joined"), F.coalesce("made", F.lit("")).alias("made"), F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"))


def q99_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions joined with the figure before or after them, from the start of a text: a figure stands before every sixth
    line.  Of neighbours that could join, every other pair does."""
    b = toc.blocks(load(spark, sf_dir, "documents")).select("doc_id", F.col("i") * 2 + 1, R.figure_caption.of(F.col("text")).alias("caption")).toDF("doc_id", "i", "caption")
    figures = b.where("(i - 1) % 12 IN (0, 2)").select("doc_id", F.col("i") - 1, F.lit(None).cast("boolean").alias("caption")).toDF("doc_id", "i", "caption")
    w = Window.partitionBy("doc_id").orderBy("i")
    rows = b.unionByName(figures).withColumn("kind", F.when(F.col("caption").isNull(), "figure").when(F.col("caption"), "caption").otherwise("text"))
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("kind").over(w))
    pairs = rows.where("(kind = 'figure' AND next = 'caption') OR (kind = 'caption' AND next = 'figure')")
    runs = pairs.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy("doc_id").orderBy("n")))
    taken = runs.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("n"))).where("at % 2 = 1")
    return taken.groupBy("doc_id").agg(F.count("*").alias("n_joined"), F.count_if(F.col("kind") == "caption").alias("n_before"), F.min("n").alias("first"))


def q100_last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest completed order, the one completed before it, and what changed between the two."""
    done = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("suite"), F.struct("o_orderdate", "o_orderkey", "o_totalprice").alias("run"))
    last = done.groupBy("suite").agg(F.max("run").alias("last"), F.count("*").alias("n_runs"))
    before = done.join(last, "suite").where("run < last").groupBy("suite").agg(F.max("run").alias("before"))
    both = last.join(before, "suite", "left")
    delta = F.round(F.col("last.o_totalprice") - F.col("before.o_totalprice"), 2)
    return both.select("suite", "n_runs", F.col("last.o_orderkey").alias("last_run"), F.coalesce("before.o_orderkey", F.lit(-1)).alias("run_before"), F.coalesce(delta, F.lit(0.0)).alias("delta"), F.when(delta.isNull(), "first").when(delta > 0, "up").when(delta < 0, "down").otherwise("same").alias("change"))


def q101_inventory_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page says of itself against what it shows: title and heading, author, language and the url's, date."""
    raw = F.coalesce("html", F.lit(""))
    p = load(spark, sf_dir, "pages").select(
        "page_id", F.btrim(F.regexp_extract(raw, r"<title>([^<]*)", 1)).alias("title"), F.btrim(F.regexp_extract(raw, r"<h1>([^<]*)", 1)).alias("heading"), F.regexp_extract(raw, r'<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/([a-z]{2})/", 1).alias("at"),
    )
    shown = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("heading", r"^([^ ]+) .*$", "$1 else")).otherwise(F.col("heading"))
    author = F.element_at(F.array(F.lit("Unknown"), F.lit("Jan Kowalski"), F.lit("untitled")), (F.col("page_id") % 3 + 1).cast("int"))
    asked = F.when(F.col("page_id") % 5 == 0, F.lit("12.3.2021")).when(F.col("page_id") % 5 == 1, F.lit("2020-02-30")).otherwise(F.lit(""))
    rows = p.withColumn("heading", shown).withColumn("author", author).withColumn("asked", asked)
    title, heading = F.col("title"), F.col("heading")
    found = F.array_compact(F.array(
        F.when((title != "") & (heading != "") & ~P.placeholder_title(title) & ~fragments_match(canonical(title), canonical(heading)), "metadata-heading-conflict"),
        F.when(F.lower("author").isin(*P.PLACEHOLDERS), "placeholder-author"), F.when((F.col("lang") != "") & (F.col("at") != "") & (F.col("lang") != F.col("at")), "language-mismatch"),
    ))
    d, m, y = (F.regexp_extract("asked", r"^([0-9]{1,2})[.]([0-9]{1,2})[.]([0-9]{4})$", k) for k in (1, 2, 3))
    iso = F.when(F.col("asked").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("asked")).when(y != "", F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")))
    date = F.coalesce(F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"), F.lit("1970-01-01"))
    return rows.select("page_id", F.array_join(found, ",").alias("conflicts"), F.size(found).alias("n_conflicts"), date.alias("date"))


QUERIES = {q.__name__: q for q in (q94_quality_signals, q95_page_classes, q96_release_ratios, q97_articles, q98_heading_fragments, q99_captions, q100_last_runs, q101_inventory_conflicts)}

_HITS = " + ".join(f"contains(low, '{w}')::int" for w in SPONSORED)
_PAGES = rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS raw, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
b AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body, CASE WHEN trim(regexp_extract(raw, '<h1>([^<]*)', 1)) <> '' THEN trim(regexp_extract(raw, '<h1>([^<]*)', 1)) ELSE trim(regexp_extract(raw, '<title>([^<]*)', 1)) END AS title FROM p),
m AS (SELECT page_id, host, title, length(body) AS n_chars, len(regexp_extract_all(raw, '<img')) AS n_images, len(regexp_extract_all(raw, '<h[1-3]>')) AS n_headings, len(regexp_extract_all(raw, '<a href=')) AS n_links, len(regexp_extract_all(raw, '\?</p>')) AS n_questions, lower(title || ' ' || body) AS low FROM b),
c AS (SELECT *, {_HITS} AS n_hits, CASE WHEN regexp_matches(low, '{NON_EDITORIAL}') THEN 'non-editorial' WHEN n_links >= {ENTRIES} AND n_chars < 1500 THEN 'toc' WHEN contains(low, 'cover') AND n_images >= 1 AND n_chars < 250 THEN 'cover' WHEN contains(low, 'back') AND contains(low, 'cover') THEN 'back-matter'
  WHEN n_images >= 1 AND n_chars < {WITH_IMAGE} THEN 'non-editorial' WHEN n_chars < {WITHOUT} AND n_headings <= 1 AND n_images = 0 THEN 'non-editorial' ELSE 'editorial' END AS class FROM m)
"""
SQL = {
    "q94_quality_signals": toc._MAP.replace("SELECT page_id, ord, label, heading_text, list_filter", "SELECT page_id, ord, label, path, heading_text, list_filter") + rf""", s AS (SELECT page_id, list(CASE i WHEN 'missing-file' THEN 'Fragment could NOT be found: ' || path WHEN 'duplicate-target' THEN 'Duplicate ID in page' ELSE 'spacing of label' END) AS errors FROM (SELECT page_id, path, unnest(issues) AS i FROM i) GROUP BY page_id)
SELECT page_id, CASE WHEN len(errors) > 4 THEN 'failed' ELSE 'passed' END AS status, len(errors)::int AS n_errors, len(list_filter(errors, lambda e: regexp_matches(lower(e), '{BROKEN}')))::int AS n_broken, len(list_filter(errors, lambda e: contains(lower(e), 'duplicate id')))::int AS n_duplicates, 'n,new,old' AS numeric_keys FROM s""",
    "q95_page_classes": _PAGES + f"SELECT page_id, title, n_chars, n_images, n_headings, class, CASE WHEN class = 'cover' THEN 'cover' WHEN class = 'toc' THEN 'contents' WHEN n_hits >= 2 THEN 'sponsored' WHEN n_questions >= 2 THEN 'interview' WHEN n_images >= 1 AND n_chars < {GALLERY} THEN 'gallery' ELSE 'article' END AS kind FROM c",
    "q96_release_ratios": _PAGES + """, g AS (SELECT host, count(*) AS n_pages, count(*) FILTER (class = 'editorial') AS n_editorial, count(*) FILTER (class = 'toc') AS n_toc, count(*) FILTER (n_headings = 0) AS n_bare, sum(n_chars)::bigint AS n_chars FROM c GROUP BY host),
r AS (SELECT *, round(n_editorial / n_pages::double, 6) AS share FROM g) SELECT *, CASE WHEN share < 0.5 THEN 'fail' WHEN share < 0.8 OR n_bare > 0 THEN 'pass_with_review' ELSE 'pass' END AS verdict FROM r""",
    "q97_articles": toc._REPAIRED + rf""", p AS (SELECT *, greatest(1, sum(CASE WHEN level BETWEEN 1 AND 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)) AS part FROM r),
e AS (SELECT doc_id, part, count(*) AS n_blocks, sum(length(text)) AS n_chars, count(*) FILTER (regexp_matches(text, '\?$')) AS q, count(*) FILTER ({R.sponsored.sql('text')}) AS s FROM p GROUP BY ALL),
y AS (SELECT *, sum(CASE WHEN part = 1 OR n_chars >= {FRAGILE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY part) AS article FROM e)
SELECT doc_id, article::bigint AS article, count(*) AS n_parts, sum(n_blocks)::bigint AS n_blocks, sum(n_chars)::bigint AS n_chars, CASE WHEN sum(s) > 0 THEN 'sponsored' WHEN sum(q) >= 2 THEN 'interview' ELSE 'article' END AS kind FROM y GROUP BY doc_id, article""",
    "q98_heading_fragments": toc._REPAIRED + rf""", x AS (SELECT doc_id, i, element, CASE WHEN regexp_matches(text, '^1[.]2 ') AND starts_with(element, 'h') THEN ['1.2', substr(text, 5)] ELSE [text] END AS t FROM b), y AS (SELECT doc_id, i, element, generate_subscripts(t, 1) AS k, unnest(t) AS text FROM x),
z AS (SELECT *, row_number() OVER w AS n, lead(text) OVER w AS next, lead(element) OVER w AS next_element, regexp_matches(text, '^[0-9]+([.][0-9]+)*$') AS num FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i, k)),
v AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM z WHERE starts_with(element, 'h') AND coalesce(starts_with(next_element, 'h'), false) AND (num OR regexp_matches(next, '^[0-9]+([.][0-9]+)*$'))),
t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY n) % 2 = 1),
j AS (SELECT doc_id, count(*) AS n_joined, md5(string_agg(CASE WHEN num THEN text || ' ' || next ELSE next || ' ' || text END, '|' ORDER BY n)) AS made FROM t GROUP BY doc_id),
o AS (SELECT doc_id, min(n) AS first, arg_min(text, n) AS title FROM z WHERE starts_with(element, 'h') GROUP BY doc_id),
q AS (SELECT z.doc_id, z.n, first, length(text) <= 60 AND {fragments_sql(canonical_sql('text'), canonical_sql('title'))} AS fits FROM z JOIN o ON z.doc_id = o.doc_id AND z.n > o.first),
d AS (SELECT doc_id, coalesce(min(n) FILTER (NOT fits), max(n) + 1) - any_value(first) - 1 AS n_repeats FROM q GROUP BY doc_id)
SELECT doc_id, coalesce(n_joined, 0) AS n_joined, coalesce(made, '') AS made, coalesce(n_repeats, 0) AS n_repeats FROM o LEFT JOIN j USING (doc_id) LEFT JOIN d USING (doc_id)""",
    "q99_captions": toc._REPAIRED + rf""", x AS (SELECT doc_id, i * 2 + 1 AS i, CASE WHEN {R.figure_caption.sql('text')} THEN 'caption' ELSE 'text' END AS kind FROM b), u AS (SELECT * FROM x UNION ALL SELECT doc_id, i - 1, 'figure' FROM x WHERE (i - 1) % 12 IN (0, 2)),
z AS (SELECT *, row_number() OVER w AS n, lead(kind) OVER w AS next FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)), v AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM z WHERE (kind = 'figure' AND next = 'caption') OR (kind = 'caption' AND next = 'figure')),
t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY n) % 2 = 1)
SELECT doc_id, count(*) AS n_joined, count(*) FILTER (kind = 'caption') AS n_before, min(n) AS first FROM t GROUP BY doc_id""",
    "q100_last_runs": """WITH o AS (SELECT o_custkey AS suite, o_orderkey, o_totalprice, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey) AS n_runs, lead(o_orderkey) OVER w AS b, round(o_totalprice - lead(o_totalprice) OVER w, 2) AS delta
  FROM orders WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))
SELECT suite, n_runs, o_orderkey AS last_run, coalesce(b, -1) AS run_before, coalesce(delta, 0.0)::double AS delta, CASE WHEN delta IS NULL THEN 'first' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'same' END AS change FROM o WHERE rn = 1""",
    "q101_inventory_conflicts": rf"""WITH p AS (SELECT page_id, trim(regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1)) AS title, trim(regexp_extract(coalesce(html, ''), '<h1>([^<]*)', 1)) AS h1, regexp_extract(coalesce(html, ''), '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(coalesce(url, ''), '://[^/?#]*/([a-z]{{2}})/', 1) AS seg FROM pages),
s AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN regexp_replace(h1, '^([^ ]+) .*$', '\1 else') ELSE h1 END AS heading FROM p),
c AS (SELECT *, {canonical_sql('title')} AS ca, {canonical_sql('heading')} AS cb FROM s),
f AS (SELECT page_id, list_filter([CASE WHEN title <> '' AND heading <> '' AND NOT (lower(title) IN {P.PLACEHOLDERS} OR regexp_matches(title, '{P.TECHNICAL}')) AND NOT {fragments_sql('ca', 'cb')} THEN 'metadata-heading-conflict' END, CASE WHEN page_id % 3 IN (0, 2) THEN 'placeholder-author' END, CASE WHEN lang <> '' AND seg <> '' AND lang <> seg THEN 'language-mismatch' END], lambda x: x IS NOT NULL) AS x FROM c)
SELECT page_id, coalesce(array_to_string(x, ','), '') AS conflicts, len(x)::int AS n_conflicts, CASE WHEN page_id % 5 = 0 THEN '2021-03-12' ELSE '1970-01-01' END AS date FROM f""",
}
