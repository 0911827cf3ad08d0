"""References read out of units of text: ids, links, titles, records and which of them to show; links that lead nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..sources import html
from ..sources.tables import load
from .titles import HEADINGS
from .toc import path_of

TOKEN = r"(?:https?://|www\.)[^ ]+|10\.[0-9]{4,9}/[^ ]+"
ID = r"^(\[ *[A-Za-z0-9][A-Za-z0-9, -]{0,31} *\]|[0-9]{1,3}[.)]|[A-Z]{1,6}-?[0-9]+)"
IDS = r"\[[A-Za-z0-9]+\]"
BANNED = r"(?i)\b(item|source title|description|link|url)\b"
#: Parts of a record's confidence: without anything, title, id, links, at most for shared words,
#: description; taken off for several ids, a title that isn't one, and each link that doesn't resolve up to a bound.
BASE, TITLE, OWN_ID, LINKS, SHARED, DESCRIBED, SEVERAL, INVALID, UNRESOLVED, UNRESOLVED_MOST = 0.15, 0.22, 0.08, 0.3, 0.24, 0.05, 0.35, 0.2, 0.08, 0.2
#: Confidence from which a record is shown, and from which it needs no review.
SHOWN, SURE = 0.65, 0.85


def units(pages: DataFrame) -> DataFrame:
    """(page_id, ord, x): every link of a page written as a unit of a list of references, in one of five ways."""
    k, n, label, href = F.col("ord") % 5, (F.col("ord") + 1).cast("string"), F.col("label"), F.col("href")
    x = F.when(k == 0, F.concat(F.lit("["), n, F.lit("] "), label, F.lit(". A note on it https://example.org"), href, F.lit(",")))
    x = x.when(k == 1, F.concat(n, F.lit(") "), label, F.lit(" www.example.com"), href, F.lit(" and doi 10.1000/q"), F.col("page_id").cast("string"), F.lit("."))).when(k == 2, label)
    x = x.when(k == 3, F.concat(F.lit("[3] [4] "), label, F.lit(" https://x.example.net"), href)).otherwise(F.concat(F.lit("AB"), n, F.lit(" "), label, F.lit(" http://the"), href))
    return html.links(pages).where("label <> ''").select("page_id", "ord", T.squeeze(x).alias("x"))


def resolved(token: Column) -> Column:
    """A link's token as a link, without signs at its end; null if its host has no dot."""
    t = F.regexp_replace(token, r"[.,;:)]+$", "")
    full = F.when(t.startswith("www."), F.concat(F.lit("https://"), t)).when(t.startswith("10."), F.concat(F.lit("https://doi.org/"), t)).otherwise(t)
    return F.when(F.regexp_extract(full, r"^https?://([^/?#]*)", 1).contains("."), full)


def records(u: DataFrame) -> DataFrame:
    """Units with their id, its number, links and title, the record's confidence, and whether to review or show it.

    A record needs a link and a title, and one id if it has several links or ids.
    """
    x = F.col("x")
    tokens = F.regexp_extract_all("x", F.lit(TOKEN), 0)
    body = T.squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, ID, ""), IDS, ""), TOKEN, ""))
    rows = u.select("page_id", "ord", "x", F.regexp_replace(F.regexp_extract(x, ID, 1), r"[^A-Za-z0-9-]", "").alias("ref_id"), tokens.alias("tokens"), T.count(x, IDS).alias("n_ids"), body.alias("body"))
    rows = rows.withColumn("links", F.array_compact(F.transform("tokens", resolved))).withColumn("title", F.btrim(F.regexp_replace(F.regexp_extract("body", r"^(.*?)(\. .*)?$", 1), r" (and doi|doi)[ .]*$", ""), F.lit(" .,;:"))).withColumn("about", F.btrim(F.regexp_extract("body", r"^.*?\. (.*)$", 1), F.lit(" .,;:")))
    bare = lambda c: F.filter(F.transform(T.letters_only(F.col(c)), F.lower), lambda w: F.length(w) >= 3)
    rows = rows.withColumn("at", F.array_join("links", " "))
    shared = F.size(F.array_intersect(bare("title"), bare("at"))) / F.greatest(F.lit(1), F.size(F.array_distinct(bare("title"))))
    unresolved = (F.size("tokens") - F.size("links")).cast("int")
    yes = lambda c, points: F.when(c, points).otherwise(0.0)
    points = F.lit(BASE) + yes(F.col("title") != "", TITLE) + yes(F.col("ref_id") != "", OWN_ID) + yes(F.size("links") > 0, LINKS) + F.least(F.lit(SHARED), F.lit(SHARED) * shared) + yes(F.col("about") != "", DESCRIBED)
    points = points - yes(F.col("n_ids") > 1, SEVERAL) - yes(F.length("title") < 2, INVALID) - F.least(F.lit(UNRESOLVED_MOST), UNRESOLVED * unresolved)
    rows = rows.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), points)), 3)).withColumn("n_unresolved", unresolved)
    direct = (F.size("tokens") > 0) & (F.col("title") != "") & ((F.size("tokens") == 1) | (F.col("ref_id") != "")) & (F.col("n_ids") <= 1)
    shown = direct & (F.size("links") > 0) & ~F.col("title").rlike(BANNED) & (F.col("confidence") >= SHOWN)
    number = F.coalesce(F.nullif(F.regexp_extract("ref_id", "([0-9]{1,3})", 1), F.lit("")).cast("int"), F.lit(-1))
    return rows.select(
        "page_id", "ord", "x", "ref_id", number.alias("number"), F.size("links").alias("n_links"), "n_unresolved", "title", "about", "confidence", direct.alias("direct"),
        ((F.col("confidence") < SURE) | (F.col("n_unresolved") > 0) | (F.col("n_ids") > 1)).alias("review"), shown.alias("shown"), R.reference_entry.of(x).alias("entry_like"),
    )


def q90_reference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(units(load(spark, sf_dir, "pages"))).drop("x")


def q91_citation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a page in the order in which its text first cites them, those that it doesn't cite last, as they were.

    A text cites every record of an even number, from the last to the first.
    """
    rows = records(units(load(spark, sf_dir, "pages"))).where("direct").select("page_id", "ord", F.when(F.col("number") % 2 == 0, -F.col("number")).alias("cited"))
    w = Window.partitionBy("page_id").orderBy(F.col("cited").isNull(), "cited", "ord")
    return rows.select("page_id", "ord", F.row_number().over(w).alias("place"), F.col("cited").isNotNull().alias("cited"))


def q92_reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page whether its units make a section of references (two entries, two links, two short ones), what was made
    of them, and the gate: it fails where there are links and nothing to show."""
    r = records(units(load(spark, sf_dir, "pages")))
    rows = r.groupBy("page_id").agg(
        F.count("*").alias("n_units"), F.count_if("direct").alias("n_records"), F.count_if("shown").alias("n_shown"), F.count_if(F.col("direct") & F.col("review")).alias("n_review"), F.sum("n_unresolved").alias("n_unresolved"),
        F.sum("n_links").alias("n_links"), F.count_if("entry_like").alias("n_entries"), F.count_if(F.length("x") <= 260).alias("n_short"),
    )
    section = (F.col("n_entries") >= 2) & (F.col("n_links") >= 2) & (F.col("n_short") >= 2)
    return rows.withColumn("section", section).withColumn("gate", F.when((F.col("n_links") > 0) & (F.col("n_shown") == 0), "failed").when(F.col("n_review") > 0, "passed_with_warnings").otherwise("passed"))


def q93_unwrapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose links to paths that aren't there are replaced by their labels; what is left of the page.

    A page's broken links are gathered, which one page bounds, and folded over its text.
    """
    pages = load(spark, sf_dir, "pages").where("html IS NOT NULL")
    known = pages.select(path_of(F.col("url")).alias("path")).where("path <> ''").distinct()
    found = html.links(pages).select("page_id", "ord", "href", path_of(F.col("href")).alias("path"))
    broken = found.where((F.col("ord") % 4 != 0) & F.col("href").startswith("/")).join(known, "path", "left_anti").groupBy("page_id").agg(F.sort_array(F.collect_set("href")).alias("broken"))
    both = pages.select("page_id", "html").join(broken, "page_id")
    out = both.select("page_id", F.size("broken").alias("n_targets"), F.aggregate("broken", F.col("html"), lambda x, h: F.replace(x, F.concat(F.lit('<a href="'), h, F.lit('">')), F.lit("<a>"))).alias("x"))
    out = out.select("page_id", "n_targets", F.regexp_replace("x", "<a>([^<]*)</a>", "$1").alias("x"))
    return out.select("page_id", "n_targets", T.count(F.col("x"), "<a href=").alias("n_left"), F.md5("x").alias("digest"))


QUERIES = {q.__name__: q for q in (q90_reference_records, q91_citation_order, q92_reference_summary, q93_unwrapped_links)}

_SQ = r"trim(regexp_replace({x}, '[ \t\r\n]+', ' ', 'g'))"
_WORDS = r"list_filter(list_transform(regexp_extract_all({x}, '\p{{L}}+'), lambda w: lower(w)), lambda w: length(w) >= 3)"
_FULL = r"CASE WHEN starts_with(t, 'www.') THEN 'https://' || t WHEN starts_with(t, '10.') THEN 'https://doi.org/' || t ELSE t END"
_BODY = _SQ.format(x=f"regexp_replace(regexp_replace(regexp_replace(x, '{ID}', ''), '{IDS}', '', 'g'), '{TOKEN}', '', 'g')")
_UNIT = rf"""CASE ord % 5 WHEN 0 THEN '[' || (ord + 1) || '] ' || label || '. A note on it https://example.org' || href || ',' WHEN 1 THEN (ord + 1) || ') ' || label || ' www.example.com' || href || ' and doi 10.1000/q' || page_id || '.' WHEN 2 THEN label
  WHEN 3 THEN '[3] [4] ' || label || ' https://x.example.net' || href ELSE 'AB' || (ord + 1) || ' ' || label || ' http://the' || href END"""
_R = HEADINGS + rf""", u AS (SELECT page_id, ord, {_SQ.format(x=_UNIT)} AS x FROM l WHERE label <> ''),
a AS (SELECT *, regexp_replace(regexp_extract(x, '{ID}', 1), '[^A-Za-z0-9-]', '', 'g') AS ref_id, regexp_extract_all(x, '{TOKEN}') AS tokens, len(regexp_extract_all(x, '{IDS}')) AS n_ids, {_BODY} AS body FROM u),
b AS (SELECT *, list_filter(list_transform(list_transform(list_transform(tokens, lambda t: regexp_replace(t, '[.,;:)]+$', '')), lambda t: {_FULL}), lambda f: CASE WHEN contains(regexp_extract(f, '^https?://([^/?#]*)', 1), '.') THEN f END), lambda f: f IS NOT NULL) AS links,
  trim(regexp_replace(regexp_extract(body, '^(.*?)(\. .*)?$', 1), ' (and doi|doi)[ .]*$', ''), ' .,;:') AS title, trim(regexp_extract(body, '^.*?\. (.*)$', 1), ' .,;:') AS about FROM a),
w AS (SELECT *, {_WORDS.format(x='title')} AS wt, {_WORDS.format(x="coalesce(array_to_string(links, ' '), '')")} AS wl, len(tokens) - len(links) AS n_unresolved FROM b),
c AS (SELECT *, round(greatest(0.0, least(0.99, ({BASE} + CASE WHEN title <> '' THEN {TITLE} ELSE 0 END + CASE WHEN ref_id <> '' THEN {OWN_ID} ELSE 0 END + CASE WHEN len(links) > 0 THEN {LINKS} ELSE 0 END + least({SHARED}, {SHARED} * (len(list_intersect(wt, wl)) / greatest(1, len(list_distinct(wt)))::double))
  + CASE WHEN about <> '' THEN {DESCRIBED} ELSE 0 END - CASE WHEN n_ids > 1 THEN {SEVERAL} ELSE 0 END - CASE WHEN length(title) < 2 THEN {INVALID} ELSE 0 END - least({UNRESOLVED_MOST}, {UNRESOLVED} * n_unresolved))::double)), 3) AS confidence,
  len(tokens) > 0 AND title <> '' AND (len(tokens) = 1 OR ref_id <> '') AND n_ids <= 1 AS direct FROM w),
r AS (SELECT page_id, ord, x, ref_id, coalesce(try_cast(nullif(regexp_extract(ref_id, '([0-9]{{1,3}})', 1), '') AS int), -1) AS number, len(links)::int AS n_links, n_unresolved::int AS n_unresolved, title, about, confidence, direct,
  confidence < {SURE} OR n_unresolved > 0 OR n_ids > 1 AS review, direct AND len(links) > 0 AND NOT regexp_matches(title, '{BANNED}') AND confidence >= {SHOWN} AS shown, {R.reference_entry.sql('x')} AS entry_like FROM c)
"""
SQL = {
    "q90_reference_records": _R + "SELECT * EXCLUDE (x) FROM r",
    "q91_citation_order": _R + "SELECT page_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY number % 2 <> 0, CASE WHEN number % 2 = 0 THEN -number END, ord) AS place, number % 2 = 0 AS cited FROM r WHERE direct",
    "q92_reference_summary": _R + """, s AS (SELECT page_id, count(*) AS n_units, count(*) FILTER (direct) AS n_records, count(*) FILTER (shown) AS n_shown, count(*) FILTER (direct AND review) AS n_review, sum(n_unresolved)::bigint AS n_unresolved, sum(n_links)::bigint AS n_links, count(*) FILTER (entry_like) AS n_entries, count(*) FILTER (length(x) <= 260) AS n_short FROM r GROUP BY page_id)
SELECT *, n_entries >= 2 AND n_links >= 2 AND n_short >= 2 AS section, CASE WHEN n_links > 0 AND n_shown = 0 THEN 'failed' WHEN n_review > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS gate FROM s""",
    "q93_unwrapped_links": HEADINGS + r""", p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1), '/+$', '') AS path FROM pages WHERE html IS NOT NULL),
b AS (SELECT page_id, list_sort(list_distinct(list(href))) AS broken FROM l WHERE ord % 4 <> 0 AND starts_with(href, '/') AND regexp_replace(regexp_extract(href, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1), '/+$', '') NOT IN (SELECT path FROM p WHERE path <> '') GROUP BY page_id),
x AS (SELECT page_id, len(broken)::int AS n_targets, regexp_replace(list_reduce(list_prepend(html, broken), lambda x, h: replace(x, '<a href="' || h || '">', '<a>')), '<a>([^<]*)</a>', '\1', 'g') AS x FROM pages JOIN b USING (page_id))
SELECT page_id, n_targets, len(regexp_extract_all(x, '<a href=')) AS n_left, md5(x) AS digest FROM x""",
}
