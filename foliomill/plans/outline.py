"""Outlines: entries of tables of contents, which of them to keep, and what lies under each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import html
from ..sources.tables import load

#: Titles of parts that aren't body text, of tables of contents, and of containers.
PARATEXT = r"^(?:cover|title page|copyright|preface|foreword|acknowledg|index|appendix)"
CONTENTS = r"^(?:contents|table of contents|inhalt|sommaire)"
CONTAINER = r"^(?:part|chapter|book|unit|section) "
#: Nested entries from which a nested outline is preferred, and body entries at the top up to which it may be.
NESTED, TOP = 4, 4


def entries(pages: DataFrame) -> DataFrame:
    """(page_id, ord, level, title, page): a page's navigation as an outline.

    The link's place gives its page, two places share one, and every third link is at the top level; a link without a
    label is no entry.  Pages count from 0.
    """
    found = html.links(pages).where("label <> ''")
    return found.select("page_id", "ord", F.when(F.col("ord") % 3 == 0, 1).otherwise(2).alias("level"), F.col("label").alias("title"), F.greatest(F.lit(0), F.floor(F.col("ord") / 2).cast("int")).alias("page"))


def specificity(level: Column, title: Column) -> Column:
    """0 to 11: how well an entry names its page."""
    low, n_words = F.lower(title), F.size(F.split(title, " "))
    yes = lambda c, points: F.when(c, points).otherwise(0)
    return (
        yes(~low.rlike(PARATEXT), 4) + yes(~low.rlike(CONTENTS), 2) + yes(level > 1, 2) + yes(~low.rlike(CONTAINER), 1) + yes((n_words > 1) & (n_words <= 12), 1) + yes(F.length(title) >= 12, 1)
    )


def one_per_page(e: DataFrame) -> DataFrame:
    """The most specific entry of each page, the first of equals."""
    w = Window.partitionBy("page_id", "page").orderBy(F.desc("points"), "ord")
    return e.withColumn("points", specificity(F.col("level"), F.col("title"))).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def selected(e: DataFrame) -> DataFrame:
    """Of each outline the entries of one level: the nested ones if there are enough and the top holds only containers
    or parts that aren't body text, with the top's entries outside their range; else the top ones."""
    body = ~F.lower("title").rlike(PARATEXT) & ~F.lower("title").rlike(CONTENTS)
    box = F.lower("title").rlike(CONTAINER)
    per = e.groupBy("page_id").agg(
        F.count_if(F.col("level") == 2).alias("nested"), F.count_if((F.col("level") == 1) & body).alias("top_body"), F.count_if((F.col("level") == 1) & body & ~box).alias("top_plain"),
        F.min(F.when(F.col("level") == 2, F.col("page"))).alias("lo"), F.max(F.when(F.col("level") == 2, F.col("page"))).alias("hi"),
    )
    prefer = (F.col("nested") >= NESTED) & ((F.col("top_body") == 0) | ((F.col("top_body") <= TOP) & (F.col("top_plain") == 0)))
    outside = (F.col("page") < F.col("lo")) | (F.col("page") > F.col("hi"))
    keep = F.when(prefer, (F.col("level") == 2) | outside | F.lower("title").rlike(CONTENTS) | ~box).otherwise((F.col("level") == 1) | (F.col("nested") == 0))
    return one_per_page(e.join(per, "page_id").where(keep).select("page_id", "ord", "level", "title", "page"))


def q20_outline_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_page(entries(load(spark, sf_dir, "pages"))).select("page_id", "page", "level", "title", "points")


def q21_outline_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(entries(load(spark, sf_dir, "pages"))).select("page_id", "page", "level", "title")


def q22_rows_in_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: each line's ship date falls in the order window that began last before it, per week of orders.

    Sections are the distinct first order dates of each week; a range join would compare all pairs, so both sides, by
    then a row for each day and week of the calendar, are put in one ordered sequence and the last section is carried
    forward.
    """
    orders = load(spark, sf_dir, "orders").select(F.date_trunc("week", "o_orderdate").alias("start")).distinct()
    lines = load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    points = lines.select(F.col("day").cast("timestamp").alias("at"), F.lit(None).cast("timestamp").alias("start"), "n", "quantity")
    starts = orders.select(F.col("start").alias("at"), "start", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("quantity")).distinct()
    w = Window.orderBy("at", F.col("n").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = points.unionByName(starts).withColumn("section", F.last("start", ignorenulls=True).over(w)).where("n IS NOT NULL AND section IS NOT NULL")
    return found.groupBy(F.date_format("section", "yyyy-MM-dd").alias("section")).agg(F.sum("n").alias("n_lines"), F.round(F.sum("quantity"), 2).alias("quantity"))


def q49_outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent of each entry: the last one before it at a smaller level; children and depth per outline."""
    w = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    e = entries(load(spark, sf_dir, "pages"))
    parent = F.when(F.col("level") > 1, F.last(F.when(F.col("level") == 1, F.col("ord")), ignorenulls=True).over(w))
    tree = e.withColumn("parent", parent)
    return tree.groupBy("page_id").agg(F.count_if(F.col("parent").isNull()).alias("n_roots"), F.count("parent").alias("n_children"), F.countDistinct("parent").alias("n_parents"), F.max(F.when(F.col("parent").isNull(), 1).otherwise(2)).alias("depth"))


QUERIES = {q.__name__: q for q in (q20_outline_entries, q21_outline_selection, q22_rows_in_sections, q49_outline_tree)}

_E = r"""WITH l AS (SELECT page_id, (generate_subscripts(r, 1) - 1)::int AS ord, trim(regexp_extract(unnest(r), '>(.*)$', 1)) AS title
  FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a href="[^"]*">[^<]*') AS r FROM pages)),
e AS (SELECT page_id, ord, CASE WHEN ord % 3 = 0 THEN 1 ELSE 2 END AS level, title, (ord // 2)::int AS page FROM l WHERE title <> '')
"""
_POINTS = rf"""(CASE WHEN NOT regexp_matches(lower(title), '{PARATEXT}') THEN 4 ELSE 0 END + CASE WHEN NOT regexp_matches(lower(title), '{CONTENTS}') THEN 2 ELSE 0 END + CASE WHEN level > 1 THEN 2 ELSE 0 END
 + CASE WHEN NOT regexp_matches(lower(title), '{CONTAINER}') THEN 1 ELSE 0 END + CASE WHEN len(string_split(title, ' ')) BETWEEN 2 AND 12 THEN 1 ELSE 0 END + CASE WHEN length(title) >= 12 THEN 1 ELSE 0 END)"""
SQL = {
    "q20_outline_entries": _E + f"SELECT page_id, page, level, title, {_POINTS}::int AS points FROM e QUALIFY row_number() OVER (PARTITION BY page_id, page ORDER BY {_POINTS} DESC, ord) = 1",
    "q21_outline_selection": _E + rf""", b AS (SELECT *, NOT regexp_matches(lower(title), '{PARATEXT}') AND NOT regexp_matches(lower(title), '{CONTENTS}') AS body, regexp_matches(lower(title), '{CONTAINER}') AS box, regexp_matches(lower(title), '{CONTENTS}') AS toc FROM e),
p AS (SELECT page_id, count(*) FILTER (level = 2) AS nested, count(*) FILTER (level = 1 AND body) AS top_body, count(*) FILTER (level = 1 AND body AND NOT box) AS top_plain, min(page) FILTER (level = 2) AS lo, max(page) FILTER (level = 2) AS hi FROM b GROUP BY page_id),
k AS (SELECT b.* FROM b JOIN p USING (page_id) WHERE CASE WHEN nested >= 4 AND (top_body = 0 OR (top_body <= 4 AND top_plain = 0)) THEN level = 2 OR page < lo OR page > hi OR toc OR NOT box ELSE level = 1 OR nested = 0 END)
SELECT page_id, page, level, title FROM k QUALIFY row_number() OVER (PARTITION BY page_id, page ORDER BY {_POINTS} DESC, ord) = 1""",
    "q22_rows_in_sections": """WITH s AS (SELECT DISTINCT date_trunc('week', o_orderdate)::timestamp AS start FROM orders), l AS (SELECT l_shipdate::date AS day, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
j AS (SELECT l.*, s.start FROM l ASOF JOIN s ON l.day::timestamp >= s.start)
SELECT start::date::varchar AS section, sum(n)::bigint AS n_lines, round(sum(quantity), 2) AS quantity FROM j GROUP BY 1""",
    "q49_outline_tree": _E + """, t AS (SELECT *, CASE WHEN level > 1 THEN last_value(CASE WHEN level = 1 THEN ord END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM e)
SELECT page_id, count(*) FILTER (parent IS NULL) AS n_roots, count(parent) AS n_children, count(DISTINCT parent) AS n_parents, max(CASE WHEN parent IS NULL THEN 1 ELSE 2 END) AS depth FROM t GROUP BY page_id""",
}
