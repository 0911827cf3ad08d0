"""Links and references: what they point to, citations and what covers them, records and how far to trust them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import html
from ..sources.tables import load

#: Widest range of citations that is written out.
SPAN = 64
CITATION = r"\[AB[0-9]+\](?:-\[AB[0-9]+\])?"


def paths(pages: DataFrame) -> DataFrame:
    """(path): the path of every page's url, without query and fragment, and all paths above it."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return pages.select(F.regexp_replace(path, r"/+$", "").alias("path")).where("path <> ''").distinct()


def q18_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site-relative links whose target is no page's path: a left anti join on (host, path), counted by label."""
    pages = load(spark, sf_dir, "pages")
    found = html.links(pages).where(F.col("href").startswith("/")).select("page_id", "label", F.regexp_replace(F.regexp_extract("href", r"^([^?#]*)", 1), r"/+$", "").alias("path"))
    broken = found.join(paths(pages), "path", "left_anti")
    return broken.groupBy("path").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"), F.min("label").alias("label"))


def q19_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and labels that occur more than once in a page."""
    found = html.links(load(spark, sf_dir, "pages"))
    return found.groupBy("page_id", "href").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"), F.min("ord").alias("first_at")).where("n > 1")


def cited(docs: DataFrame) -> DataFrame:
    """Texts with citations added: one of seven records, and every fifth document a range of three."""
    one = F.concat(F.lit(" [AB"), (F.col("doc_id") % 7 + 1).cast("string"), F.lit("]"))
    many = F.when(F.col("doc_id") % 5 == 0, F.lit(" [AB2]-[AB4]")).otherwise(F.lit(""))
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), one, many).alias("text"))


def citations(docs: DataFrame) -> DataFrame:
    """(doc_id, ref): each record that a document cites, once; ranges are written out up to SPAN."""
    marks = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(CITATION), 0)).alias("m"))
    number = lambda k: F.regexp_extract_all("m", F.lit("AB([0-9]+)"), 1)[k].cast("int")
    ends = marks.select("doc_id", number(0).alias("a"), F.coalesce(F.try_element_at(F.regexp_extract_all("m", F.lit("AB([0-9]+)"), 1), F.lit(2)).cast("int"), number(0)).alias("b"))
    wide = ends.where((F.col("b") >= F.col("a")) & (F.col("b") - F.col("a") < SPAN))
    return wide.select("doc_id", F.explode(F.sequence("a", "b")).alias("ref")).distinct()


def q23_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = citations(cited(load(spark, sf_dir, "documents")))
    return c.groupBy("ref").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def q24_citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited records against those there are: covered, ambiguous (several records), missing, unused."""
    c = citations(cited(load(spark, sf_dir, "documents"))).groupBy("ref").agg(F.count("*").alias("n_docs"))
    records = load(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 2 == 0, F.col("item_id") + 3).otherwise(F.col("item_id")).cast("int").alias("ref"))
    r = records.groupBy("ref").agg(F.count("*").alias("n_records"))
    status = F.when(F.col("n_docs").isNull(), "unused").when(F.col("n_records").isNull(), "missing").when(F.col("n_records") > 1, "ambiguous").otherwise("covered")
    return c.join(r, "ref", "full_outer").select("ref", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_records", F.lit(0)).alias("n_records"), status.alias("status"))


def q25_link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page scored against its headings: shared words over the smaller set, and nearness; 0.22 or more."""
    pages = load(spark, sf_dir, "pages")
    token = lambda c: F.array_distinct(F.filter(F.transform(T.letters_only(F.col(c)), F.lower), lambda w: F.length(w) >= 3))
    heads = html.headings(pages).where("level <= 1").select("page_id", F.col("ord").alias("h"), token("text").alias("ht"))
    found = html.links(pages).select("page_id", F.col("ord").alias("l"), "label", token("label").alias("lt"))
    pairs = found.join(heads, "page_id").where((F.size("lt") > 0) & (F.size("ht") > 0))
    shared = F.size(F.array_intersect("lt", "ht")) / F.least(F.size("lt"), F.size("ht"))
    scored = pairs.select("page_id", "l", "h", F.round(0.8 * shared + F.lit(0.2) / (F.lit(1) + F.col("l")), 6).alias("score"))
    return scored.where("score >= 0.22")


def q48_link_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matching of those candidates, the best first and of equal scores the later heading and link.

    A fold over each page's own few candidates inside the row.
    """
    return matched(q25_link_candidates(spark, sf_dir))


def matched(candidates: DataFrame) -> DataFrame:
    each = candidates.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("score", "h", "l")), asc=False).alias("c"))
    none = F.array().cast("array<struct<score: double, h: int, l: int>>")

    def place(kept, c):
        free = ~F.exists(kept, lambda k: (k["h"] == c["h"]) | (k["l"] == c["l"]))
        return F.when(free, F.concat(kept, F.array(c))).otherwise(kept)

    return each.select("page_id", F.explode(F.aggregate("c", none, place)).alias("k")).select("page_id", "k.l", "k.h", "k.score")


def confidence(title: Column, ref: Column, n_links: Column, unresolved: Column, repaired: Column) -> Column:
    """0 to 0.99: how far a reference's record is to be trusted."""
    points = F.when(title != "", 0.2).otherwise(0.0) + F.when(ref.isNotNull(), 0.1).otherwise(0.0) + F.when(n_links > 0, 0.4).otherwise(-0.2)
    points = points + F.when((F.length(title) >= 2) & ~F.lower(title).rlike("^(https?:|www)"), 0.15).otherwise(0.0)
    points = points + F.least(F.lit(0.1), 0.04 * repaired) - F.least(F.lit(0.35), 0.12 * unresolved)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), points))


def link_status(url: Column) -> Column:
    """Whether a link is well formed: http with a dotted host, or a DOI; empty ones are unresolved."""
    return F.when(F.coalesce(url, F.lit("")) == "", "unresolved").when(url.rlike(r"^https?://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+") | url.rlike(r"doi\.org/10\."), "syntactically_valid").otherwise("likely_valid")


def q26_reference_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of pages: title, number of links, those that can't be followed, those that were repaired."""
    pages = load(spark, sf_dir, "pages")
    n = html.links(pages).groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(F.col("label").rlike(r"[,.]$")).alias("repaired"), F.count_if(F.length("label") <= 2).alias("unresolved"))
    rows = pages.select("page_id", "url", F.btrim(F.regexp_extract(F.coalesce("html", F.lit("")), r"<title>([^<]*)", 1)).alias("title")).join(n, "page_id", "left")
    c = lambda x: F.coalesce(x, F.lit(0))
    points = confidence(F.col("title"), F.when(F.col("page_id") % 3 != 0, F.col("page_id")), c("n_links"), c("unresolved"), c("repaired"))
    rows = rows.select("page_id", F.round(points, 6).alias("confidence"), link_status(F.when(F.col("page_id") % 11 != 0, F.col("url"))).alias("link_status"))
    return rows.withColumn("review", (F.col("confidence") < 0.65) | (F.col("link_status") == "unresolved"))


QUERIES = {q.__name__: q for q in (q18_broken_links, q19_duplicate_links, q23_citations, q24_citation_coverage, q25_link_candidates, q26_reference_confidence, q48_link_matching)}

_L = r"""WITH l AS (SELECT page_id, (generate_subscripts(r, 1) - 1)::int AS ord, regexp_extract(unnest(r), '^<a href="([^"]*)">', 1) AS href, trim(regexp_extract(unnest(r), '>(.*)$', 1)) AS label
  FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a href="[^"]*">[^<]*') AS r FROM pages)),
h AS (SELECT page_id, (generate_subscripts(r, 1) - 1)::int AS ord, unnest(r) AS raw FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<(?:title|h[1-3])>[^<]*') AS r FROM pages))
"""
_C = r"""WITH d AS (SELECT doc_id, coalesce(text, '') || ' [AB' || (doc_id % 7 + 1) || ']' || CASE WHEN doc_id % 5 = 0 THEN ' [AB2]-[AB4]' ELSE '' END AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(m, 'AB([0-9]+)', 1) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[AB[0-9]+\](?:-\[AB[0-9]+\])?')) AS m FROM d)),
e AS (SELECT doc_id, n[1]::int AS a, coalesce(n[2], n[1])::int AS b FROM m),
c AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1))::int AS ref FROM e WHERE b >= a AND b - a < 64)
"""
_W = r"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '\p{{L}}+'), lambda w: lower(w)), lambda w: length(w) >= 3))"
_CANDIDATES = _L + f""", ht AS (SELECT page_id, ord AS h, {_W.format(x="regexp_replace(raw, '^<[a-z0-9]+>', '')")} AS ht FROM h WHERE starts_with(raw, '<title') OR starts_with(raw, '<h1')),
lt AS (SELECT page_id, ord AS l, {_W.format(x='label')} AS lt FROM l),
s AS (SELECT page_id, l, h, round(0.8 * (len(list_intersect(lt, ht)) / least(len(lt), len(ht))::double) + 0.2 / (1 + l)::double, 6) AS score FROM lt JOIN ht USING (page_id) WHERE len(lt) > 0 AND len(ht) > 0)"""
SQL = {
    "q18_broken_links": _L + r""", p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
f AS (SELECT page_id, label, regexp_replace(regexp_extract(href, '^([^?#]*)', 1), '/+$', '') AS path FROM l WHERE starts_with(href, '/'))
SELECT path, count(*) AS n_links, count(DISTINCT page_id) AS n_pages, min(label) AS label FROM f WHERE path NOT IN (SELECT path FROM p WHERE path <> '') GROUP BY path""",
    "q19_duplicate_links": _L + "SELECT page_id, href, count(*) AS n, count(DISTINCT label) AS n_labels, min(ord) AS first_at FROM l GROUP BY page_id, href HAVING count(*) > 1",
    "q23_citations": _C + "SELECT ref, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM c GROUP BY ref",
    "q24_citation_coverage": _C + """, k AS (SELECT ref, count(*) AS n_docs FROM c GROUP BY ref), r AS (SELECT CASE WHEN item_id % 2 = 0 THEN item_id + 3 ELSE item_id END::int AS ref, count(*) AS n_records FROM benchmark GROUP BY 1)
SELECT coalesce(k.ref, r.ref) AS ref, coalesce(n_docs, 0) AS n_docs, coalesce(n_records, 0) AS n_records,
 CASE WHEN n_docs IS NULL THEN 'unused' WHEN n_records IS NULL THEN 'missing' WHEN n_records > 1 THEN 'ambiguous' ELSE 'covered' END AS status FROM k FULL JOIN r ON k.ref = r.ref""",
    "q25_link_candidates": _CANDIDATES + "SELECT * FROM s WHERE score >= 0.22",
    "q48_link_matching": _CANDIDATES + """, g AS (SELECT page_id, list([{'score': score, 'h': h, 'l': l}] ORDER BY score DESC, h DESC, l DESC) AS c FROM s WHERE score >= 0.22 GROUP BY page_id),
k AS (SELECT page_id, unnest(list_reduce(c, lambda a, b: CASE WHEN len(list_filter(a, lambda x: x.h = b[1].h OR x.l = b[1].l)) > 0 THEN a ELSE list_concat(a, b) END)) AS k FROM g) SELECT page_id, k.l AS l, k.h AS h, k.score AS score FROM k""",
    "q26_reference_confidence": _L + r""", n AS (SELECT page_id, count(*) AS n_links, count(*) FILTER (regexp_matches(label, '[,.]$')) AS repaired, count(*) FILTER (length(label) <= 2) AS unresolved FROM l GROUP BY page_id),
r AS (SELECT page_id, url, trim(regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1)) AS title, coalesce(n_links, 0) AS n_links, coalesce(repaired, 0) AS repaired, coalesce(unresolved, 0) AS unresolved FROM pages LEFT JOIN n USING (page_id)),
k AS (SELECT page_id, round(greatest(0.0, least(0.99, (CASE WHEN title <> '' THEN 0.2 ELSE 0 END + CASE WHEN page_id % 3 <> 0 THEN 0.1 ELSE 0 END + CASE WHEN n_links > 0 THEN 0.4 ELSE -0.2 END
  + CASE WHEN length(title) >= 2 AND NOT regexp_matches(lower(title), '^(https?:|www)') THEN 0.15 ELSE 0 END + least(0.1, 0.04 * repaired) - least(0.35, 0.12 * unresolved))::double)), 6) AS confidence,
 CASE WHEN page_id % 11 = 0 OR coalesce(url, '') = '' THEN 'unresolved' WHEN regexp_matches(url, '^https?://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') OR regexp_matches(url, 'doi\.org/10\.') THEN 'syntactically_valid' ELSE 'likely_valid' END AS link_status FROM r)
SELECT *, confidence < 0.65 OR link_status = 'unresolved' AS review FROM k""",
}
