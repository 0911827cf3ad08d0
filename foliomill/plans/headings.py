"""Headings: scan, change between two states of a page, gates, hierarchy, titles that match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import html
from ..sources.tables import load

#: Texts of headings that layout leaves behind.
MARKERS = ("page", "strona", "advertisement", "copyright", "go to solution")


def suspicious(x: Column) -> Column:
    """Empty, digits only, or with a word that layout leaves behind."""
    out = (F.coalesce(x, F.lit("")) == "") | x.rlike(r"^[0-9]+$")
    for m in MARKERS:
        out = out | F.lower(x).contains(m)
    return out


def after_image(pages: DataFrame) -> DataFrame:
    """The same headings after a repair: every fourth page's in capitals, every seventh page's h1 lost."""
    h = html.headings(pages)
    return h.where(~((F.col("page_id") % 7 == 3) & (F.col("element") == "h1"))).withColumn("text", F.when(F.col("page_id") % 4 == 0, F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))).otherwise(F.col("text")))


def reason(x: Column, removed: bool) -> tuple[Column, Column]:
    """Why a heading changed, and how sure that is."""
    word = F.when(suspicious(x), "layout-artifact-filtered" if removed else "recovered-section-heading").when(F.length(x) <= 4, "short-ambiguous-heading")
    word = word.when(~x.rlike(r"\p{Ll}") & (F.length(x) <= 40), "uppercase-layout-candidate").otherwise("semantic-heading-normalization")
    sure = F.when(suspicious(x), 0.92 if removed else 0.7).when(F.length(x) <= 4, 0.58).when(~x.rlike(r"\p{Ll}") & (F.length(x) <= 40), 0.66).otherwise(0.76 if removed else 0.74)
    return word, sure


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer join on page, level and text: what only one side has was removed or recovered."""
    keys = ["page_id", "level", "text"]
    b, a = before.select(*keys).distinct().withColumn("b", F.lit(1)), after.select(*keys).distinct().withColumn("a", F.lit(1))
    rows = b.join(a, keys, "full_outer").where("a IS NULL OR b IS NULL").withColumn("change", F.when(F.col("a").isNull(), "removed").otherwise("recovered"))
    (w1, s1), (w2, s2) = reason(F.col("text"), True), reason(F.col("text"), False)
    gone = F.col("change") == "removed"
    return rows.select(*keys, "change", F.when(gone, w1).otherwise(w2).alias("reason"), F.when(gone, s1).otherwise(s2).alias("confidence"))


def q15_heading_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = html.headings(load(spark, sf_dir, "pages"))
    return h.select("page_id", "ord", "element", "level", "text", suspicious(F.col("text")).alias("suspicious"), T.looks_like_heading(F.col("text")).alias("heading_like"))


def q16_heading_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return changes(html.headings(pages), after_image(pages))


def q17_heading_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page after the repair: no h1 fails, several or a suspicious one need review, else it passes."""
    pages = load(spark, sf_dir, "pages")
    counts = after_image(pages).groupBy("page_id").agg(F.count_if(F.col("level") == 1).alias("n_h1"), F.count_if(suspicious(F.col("text"))).alias("n_suspicious"))
    rows = pages.select("page_id").join(counts, "page_id", "left").select("page_id", F.coalesce("n_h1", F.lit(0)).alias("n_h1"), F.coalesce("n_suspicious", F.lit(0)).alias("n_suspicious"))
    return rows.withColumn("gate", F.when(F.col("n_h1") == 0, "fail").when((F.col("n_h1") > 1) | (F.col("n_suspicious") > 0), "pass_with_review").otherwise("pass"))


def q27_title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page's h1 the benchmark item whose words overlap it most, over the smaller set of words; ties: the
    smaller id.  Candidates share a word of five letters or more; a common word costs a row for each page and item that
    have it, and the items are a fixed list."""
    heads = html.headings(load(spark, sf_dir, "pages")).where("level = 1").select("page_id", F.array_distinct(F.filter(F.transform(T.letters_only(F.col("text")), F.lower), lambda w: F.length(w) >= 3)).alias("t"))
    items = load(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.filter(F.transform(T.letters_only(F.coalesce("text", F.lit(""))), F.lower), lambda w: F.length(w) >= 3)).alias("u"))
    by = items.select("item_id", F.explode("u").alias("w")).where(F.length("w") >= 5)
    pairs = heads.select("page_id", F.explode("t").alias("w")).join(by, "w").select("page_id", "item_id").distinct()
    scored = pairs.join(heads, "page_id").join(items, "item_id").select("page_id", "item_id", F.round(F.size(F.array_intersect("t", "u")) / F.least(F.size("t"), F.size("u")), 6).alias("similarity"))
    best = scored.groupBy("page_id").agg(F.max(F.struct("similarity", (-F.col("item_id")).alias("i"))).alias("b"))
    return best.select("page_id", (-F.col("b.i")).alias("item_id"), F.col("b.similarity").alias("similarity"))


def q46_heading_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels made regular: the first heading of a page is level 1, later ones 2 if they were at most 2, else 3; equal
    neighbours count once; later headings that repeat the first are dropped."""
    w = Window.partitionBy("page_id").orderBy("ord")
    h = html.headings(load(spark, sf_dir, "pages")).withColumn("key", T.match_key(F.col("text"))).where("key <> ''")
    h = h.withColumn("last", F.lag("key").over(w)).where("last IS NULL OR last <> key").withColumn("rn", F.row_number().over(w)).withColumn("first", F.first("key").over(w))
    kept = h.where("rn = 1 OR key <> first").withColumn("fixed", F.when(F.col("rn") == 1, 1).when(F.col("level") <= 2, 2).otherwise(3))
    return kept.groupBy("level", "fixed").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


def q47_page_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by the parser, per kind: how many, characters, and whether they stand in navigation."""
    s = html.slots(load(spark, sf_dir, "pages"))
    return s.select("page_id", "block", F.length("text").alias("n"), F.array_contains("ancestors", "nav").alias("in_nav")).groupBy("block", "in_nav").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_chars"), F.countDistinct("page_id").alias("n_pages"))


QUERIES = {q.__name__: q for q in (q15_heading_scan, q16_heading_changes, q17_heading_gate, q27_title_matches, q46_heading_hierarchy, q47_page_slots)}

_SUSPICIOUS = "(coalesce({x}, '') = '' OR regexp_matches({x}, '^[0-9]+$') OR " + " OR ".join(f"contains(lower({{x}}), '{m}')" for m in MARKERS) + ")"
_S = _SUSPICIOUS.format(x="text")
_H = r"""WITH raw AS (SELECT page_id, r, generate_subscripts(r, 1) - 1 AS ord, unnest(r) AS raw FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<(?:title|h[1-3])>[^<]*') AS r FROM pages)),
h AS (SELECT page_id, ord::int AS ord, regexp_extract(raw, '^<([a-z0-9]+)>', 1) AS element, CASE WHEN starts_with(raw, '<title') THEN 0 ELSE try_cast(substr(raw, 3, 1) AS int) END AS level,
  trim(regexp_replace(regexp_replace(raw, '^<[a-z0-9]+>', ''), '[ \t\r\n]+', ' ', 'g')) AS text FROM raw),
h2 AS (SELECT page_id, ord, element, level, CASE WHEN page_id % 4 = 0 THEN upper(replace(text, 'ß', 'ss')) ELSE text END AS text FROM h WHERE NOT (page_id % 7 = 3 AND element = 'h1'))
"""
SQL = {
    "q15_heading_scan": _H + rf"""SELECT page_id, ord, element, level, text, {_S} AS suspicious,
 length(text) <= 90 AND len(ws) <= 12 AND NOT regexp_matches(text, '[.!?;:,]$') AND coalesce(len(list_filter(ws, lambda w: regexp_matches(w, '^\p{{Lu}}'))) / nullif(len(ws), 0)::double, 0) >= 0.55 AS heading_like
FROM (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM h)""",
    "q16_heading_changes": _H + rf"""SELECT coalesce(b.page_id, a.page_id) AS page_id, coalesce(b.level, a.level) AS level, coalesce(b.text, a.text) AS text, CASE WHEN a.page_id IS NULL THEN 'removed' ELSE 'recovered' END AS change,
 CASE WHEN {_SUSPICIOUS.format(x='coalesce(b.text, a.text)')} THEN CASE WHEN a.page_id IS NULL THEN 'layout-artifact-filtered' ELSE 'recovered-section-heading' END WHEN length(coalesce(b.text, a.text)) <= 4 THEN 'short-ambiguous-heading'
  WHEN NOT regexp_matches(coalesce(b.text, a.text), '\p{{Ll}}') AND length(coalesce(b.text, a.text)) <= 40 THEN 'uppercase-layout-candidate' ELSE 'semantic-heading-normalization' END AS reason,
 (CASE WHEN {_SUSPICIOUS.format(x='coalesce(b.text, a.text)')} THEN CASE WHEN a.page_id IS NULL THEN 0.92 ELSE 0.7 END WHEN length(coalesce(b.text, a.text)) <= 4 THEN 0.58
  WHEN NOT regexp_matches(coalesce(b.text, a.text), '\p{{Ll}}') AND length(coalesce(b.text, a.text)) <= 40 THEN 0.66 WHEN a.page_id IS NULL THEN 0.76 ELSE 0.74 END)::double AS confidence
FROM (SELECT DISTINCT page_id, level, text FROM h) b FULL JOIN (SELECT DISTINCT page_id, level, text FROM h2) a USING (page_id, level, text) WHERE a.page_id IS NULL OR b.page_id IS NULL""",
    "q17_heading_gate": _H + f""", c AS (SELECT page_id, count(*) FILTER (level = 1) AS n_h1, count(*) FILTER {_S.join(['(', ')'])} AS n_suspicious FROM h2 GROUP BY page_id),
g AS (SELECT page_id, coalesce(n_h1, 0) AS n_h1, coalesce(n_suspicious, 0) AS n_suspicious FROM pages LEFT JOIN c USING (page_id))
SELECT *, CASE WHEN n_h1 = 0 THEN 'fail' WHEN n_h1 > 1 OR n_suspicious > 0 THEN 'pass_with_review' ELSE 'pass' END AS gate FROM g""",
    "q27_title_matches": _H + r""", t AS (SELECT page_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '\p{L}+'), lambda w: lower(w)), lambda w: length(w) >= 3)) AS t FROM h WHERE level = 1),
u AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}+'), lambda w: lower(w)), lambda w: length(w) >= 3)) AS u FROM benchmark),
x AS (SELECT item_id, unnest(u) AS w FROM u),
p AS (SELECT DISTINCT page_id, item_id FROM (SELECT page_id, unnest(t) AS w FROM t) JOIN x USING (w) WHERE length(w) >= 5),
s AS (SELECT page_id, item_id, round(len(list_intersect(t, u)) / least(len(t), len(u))::double, 6) AS similarity FROM p JOIN t USING (page_id) JOIN u USING (item_id))
SELECT page_id, item_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, item_id) = 1""",
    "q46_heading_hierarchy": _H + r""", k AS (SELECT *, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS key FROM h), l AS (SELECT *, lag(key) OVER (PARTITION BY page_id ORDER BY ord) AS last FROM k WHERE key <> ''),
n AS (SELECT *, row_number() OVER w AS rn, first_value(key) OVER w AS first FROM l WHERE last IS NULL OR last <> key WINDOW w AS (PARTITION BY page_id ORDER BY ord)),
f AS (SELECT page_id, level, CASE WHEN rn = 1 THEN 1 WHEN level <= 2 THEN 2 ELSE 3 END AS fixed FROM n WHERE rn = 1 OR key <> first)
SELECT level, fixed, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM f GROUP BY ALL""",
}
