"""Titles and lines by rule: what a line may be, kinds of sections, and how well two titles agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..sources import html
from ..sources.tables import load
from .blocks import LINES, lines_of

#: Scores of a title's agreement, the first that holds: same key; same but for signs; one inside the
#: other; same first two words; three words in common; two.
LADDER = (100, 98, 88, 84, 78, 68)
#: Names of sections by kind.
KINDS = (("cover", ("okładka", "okladka", "cover", "front matter")), ("index", ("index", "name index", "opening index")), ("reference", ("glossary", "table of contents", "spis treści", "spis tresci")))
CHAPTER = r"^(?i:chapter|part|appendix|section|rozdział|sekcja) +[0-9]+[A-Za-z-]*[ :–—-]*"


def q82_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line by every rule, and whether it is a page's junk: an address or a number anywhere, imprints and short
    capitals at a text's first or last line."""
    lines = lines_of(load(spark, sf_dir, "documents"))
    ends = lines.groupBy("doc_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    x, at_end = F.col("x"), (F.col("pos") == F.col("lo")) | (F.col("pos") == F.col("hi"))
    junk = R.junk_anywhere.of(x) | (at_end & R.junk_at_margin.of(x)) | R.photo_credit.of(x)
    return lines.join(ends, "doc_id").select("doc_id", "pos", *(rule.of(x).alias(name) for name, rule in R.LINES.items()), junk.alias("junk"))


def section_kind(title: Column, first: Column) -> Column:
    """Kind of a section by its title; a cover only where it comes first."""
    low = F.lower(F.btrim(F.coalesce(title, F.lit(""))))
    names = dict(KINDS)
    return F.when(first & low.isin(*names["cover"]), "cover").when(low.startswith("appendix"), "appendix").when(low.isin(*names["index"]), "index").when(low.isin(*names["reference"]), "reference").otherwise("section")


def q83_section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles cleaned of a leading `contents`, of words that a hyphen broke and of noise; kind and style level of each.

    Titles are the pages' headings; every eleventh is given a section's name, every seventh a broken word.
    """
    h = html.headings(load(spark, sf_dir, "pages"))
    named = F.element_at(F.array(*(F.lit(x) for x in NAMES)), ((F.col("page_id") + F.col("ord")) % len(NAMES) + 1).cast("int"))
    raw = F.when((F.col("page_id") + F.col("ord")) % 11 == 0, named).when((F.col("page_id") + F.col("ord")) % 7 == 0, F.concat(F.lit("Contents: a long sec- tion "), F.col("text"))).otherwise(F.col("text"))
    rows = h.select("page_id", "ord", "element", raw.alias("raw"))
    clean = F.regexp_replace(F.regexp_replace("raw", r"^(?i:contents)( *[:–—-] *| +)", ""), r"([a-z]{2,}) *- +([a-z]{2,})", "$1$2")
    rows = rows.withColumn("title", F.btrim(T.squeeze(clean), F.lit(" -")))
    rows = rows.withColumn("title", F.when(R.noise_title.of(F.col("title")), "").otherwise(F.col("title")))
    level = F.when(F.col("element") == "title", 1).otherwise(F.coalesce(F.nullif(F.regexp_extract("element", "h([1-9])", 1), F.lit("")).cast("int"), F.lit(0)))
    return rows.select("page_id", "ord", "title", section_kind(F.col("title"), F.col("ord") == 0).alias("kind"), level.alias("level"), R.board_title.of(F.col("title")).alias("board"), R.weak_title.of(F.col("title")).alias("weak"))


#: Names that q83 gives to some titles.
NAMES = ("Cover", "Appendix A", "Name Index", "Glossary", "Spis treści", "12", "a b c d e f g h")


def canonical(x: Column) -> Column:
    """A title without chapter's number, numbering and signs at its ends, in lower case."""
    x = F.regexp_replace(F.regexp_replace(T.squeeze(x), CHAPTER, ""), r"^[0-9]+(\.[0-9]+)* *[:–—-]* *", "")
    return F.lower(F.btrim(x, F.lit(" -:;,.")))


def fragments_match(a: Column, b: Column) -> Column:
    """Equal, or one of at least four characters inside the other."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | ((F.length(short) >= 4) & F.contains(long, short)))


def title_key(x: Column) -> Column:
    """A title without its number and signs at its ends, in lower case."""
    return F.lower(F.btrim(T.squeeze(F.regexp_replace(T.squeeze(x), r"^[0-9]+\. *", "")), F.lit(" .,:;!?-")))


def agreement(a: Column, b: Column) -> Column:
    """0 to 100: how well two titles agree."""
    bare = lambda x: F.regexp_replace(title_key(x), r"[^0-9\p{Ll}]", "")
    words = lambda x: F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[0-9\p{L}]+"), 0), lambda w: ~w.isin(*R.MINOR))
    short = F.least(F.length(bare(a)), F.length(bare(b)))
    shared = F.size(F.array_intersect(words(a), words(b)))
    none = (title_key(a) == "") | (title_key(b) == "")
    inside = (bare(a) != "") & (bare(b) != "") & (F.contains(bare(a), bare(b)) | F.contains(bare(b), bare(a))) & (short >= 6)
    same_start = (F.size(words(a)) > 0) & (F.slice(words(a), 1, 2) == F.slice(words(b), 1, 2))
    tests = (title_key(a) == title_key(b), (bare(a) != "") & (bare(a) == bare(b)), inside, same_start, shared >= 3, shared == 2)
    out = F.when(none, 0)
    for holds, points in zip(tests, LADDER):
        out = out.when(holds, points)
    return out.otherwise(0)


def q84_title_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's title against its other headings and the labels of its links: the best, the earlier of equals; whether
    it settles the title (68 or more), and whether the two match as fragments and as plain keys."""
    pages = load(spark, sf_dir, "pages")
    h = html.headings(pages)
    title = h.where("element = 'title'").groupBy("page_id").agg(F.min_by("text", "ord").alias("title"))
    labels = html.links(pages).select("page_id", (F.col("ord") + 1000).alias("ord"), F.col("label").alias("text"))
    other = h.where("element <> 'title'").select("page_id", "ord", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("2. "), F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))))).when(F.col("page_id") % 3 == 1, F.regexp_replace("text", r"^(.+) [^ ]+$", "$1")).otherwise(F.col("text")).alias("text"))
    pairs = other.unionByName(labels).join(title, "page_id")
    a, b = F.col("title"), F.col("text")
    scored = pairs.select("page_id", "ord", agreement(a, b).alias("points"), fragments_match(canonical(a), canonical(b)).alias("fragments"), fragments_match(F.when(F.length(T.match_key(a)) >= 8, T.match_key(a)).otherwise(F.lit("")), F.when(F.length(T.match_key(b)) >= 8, T.match_key(b)).otherwise(F.lit(""))).alias("plain"))
    best = scored.groupBy("page_id").agg(F.max_by(F.struct("ord", "points", "fragments", "plain"), F.struct("points", -F.col("ord"))).alias("b"), F.count_if("fragments").alias("n_fragments"), F.count_if("plain").alias("n_plain"))
    return best.select("page_id", F.col("b.ord").alias("ord"), F.col("b.points").alias("points"), (F.col("b.points") >= LADDER[-1]).alias("settled"), F.col("b.fragments").alias("fragments"), "n_fragments", "n_plain")


QUERIES = {q.__name__: q for q in (q82_line_rules, q83_section_kinds, q84_title_agreement)}

HEADINGS = r"""WITH raw AS (SELECT page_id, r, generate_subscripts(r, 1) - 1 AS ord, unnest(r) AS raw FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<(?:title|h[1-3])>[^<]*') AS r FROM pages)),
h AS (SELECT page_id, ord::int AS ord, regexp_extract(raw, '^<([a-z0-9]+)>', 1) AS element, CASE WHEN starts_with(raw, '<title') THEN 0 ELSE try_cast(substr(raw, 3, 1) AS int) END AS level,
  trim(regexp_replace(regexp_replace(raw, '^<[a-z0-9]+>', ''), '[ \t\r\n]+', ' ', 'g')) AS text FROM raw),
l AS (SELECT page_id, (generate_subscripts(r, 1) - 1)::int AS ord, regexp_extract(unnest(r), '^<a href="([^"]*)">', 1) AS href, trim(regexp_extract(unnest(r), '>(.*)$', 1)) AS label
  FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a href="[^"]*">[^<]*') AS r FROM pages))
"""
SQUEEZE = r"trim(regexp_replace({x}, '[ \t\r\n]+', ' ', 'g'))"


def canonical_sql(x: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace({SQUEEZE.format(x=x)}, '{CHAPTER}', ''), '^[0-9]+(\.[0-9]+)* *[:–—-]* *', ''), ' -:;,.'))"


def fragments_sql(a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR (least(length({a}), length({b})) >= 4 AND CASE WHEN length({a}) <= length({b}) THEN contains({b}, {a}) ELSE contains({a}, {b}) END)))"


_KEY = rf"lower(trim(regexp_replace(regexp_replace({SQUEEZE}, '^[0-9]+\. *', ''), '[ \t\r\n]+', ' ', 'g'), ' .,:;!?-'))"
_PLAIN = r"CASE WHEN length(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '', 'g')) >= 8 THEN regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '', 'g') ELSE '' END"
_LIST = ", ".join(map(R.quoted, R.MINOR))
SQL = {
    "q82_line_rules": LINES + f""", e AS (SELECT doc_id, min(pos) AS lo, max(pos) AS hi FROM f GROUP BY doc_id)
SELECT doc_id, pos, {", ".join(f"{rule.sql('x')} AS {name}" for name, rule in R.LINES.items())}, ({R.junk_anywhere.sql('x')} OR ((pos = lo OR pos = hi) AND {R.junk_at_margin.sql('x')}) OR {R.photo_credit.sql('x')}) AS junk FROM f JOIN e USING (doc_id)""",
    "q83_section_kinds": HEADINGS + rf""", r AS (SELECT page_id, ord, element, CASE WHEN (page_id + ord) % 11 = 0 THEN [{", ".join(map(R.quoted, NAMES))}][(page_id + ord) % {len(NAMES)} + 1] WHEN (page_id + ord) % 7 = 0 THEN 'Contents: a long sec- tion ' || text ELSE text END AS raw FROM h),
c AS (SELECT *, trim(trim(regexp_replace(regexp_replace(regexp_replace(raw, '^(?i:contents)( *[:–—-] *| +)', ''), '([a-z]{{2,}}) *- +([a-z]{{2,}})', '\1\2', 'g'), '[ \t\r\n]+', ' ', 'g')), ' -') AS c FROM r),
t AS (SELECT page_id, ord, element, CASE WHEN {R.noise_title.sql('c')} THEN '' ELSE c END AS title FROM c)
SELECT page_id, ord, title, CASE WHEN ord = 0 AND lower(title) IN {KINDS[0][1]} THEN 'cover' WHEN starts_with(lower(title), 'appendix') THEN 'appendix' WHEN lower(title) IN {KINDS[1][1]} THEN 'index' WHEN lower(title) IN {KINDS[2][1]} THEN 'reference' ELSE 'section' END AS kind,
 CASE WHEN element = 'title' THEN 1 ELSE try_cast(substr(element, 2, 1) AS int) END AS level, {R.board_title.sql('title')} AS board, {R.weak_title.sql('title')} AS weak FROM t""",
    "q84_title_agreement": HEADINGS + rf""", t AS (SELECT page_id, min_by(text, ord) AS title FROM h WHERE element = 'title' GROUP BY page_id),
o AS (SELECT page_id, ord, CASE page_id % 3 WHEN 0 THEN '2. ' || upper(replace(text, 'ß', 'ss')) WHEN 1 THEN regexp_replace(text, '^(.+) [^ ]+$', '\1') ELSE text END AS text FROM h WHERE element <> 'title' UNION ALL SELECT page_id, ord + 1000, label FROM l),
k AS (SELECT page_id, ord, title, text, {_KEY.format(x='title')} AS ka, {_KEY.format(x='text')} AS kb, list_filter(regexp_extract_all(lower(title), '[0-9\p{{L}}]+'), lambda w: w NOT IN ({_LIST})) AS wa, list_filter(regexp_extract_all(lower(text), '[0-9\p{{L}}]+'), lambda w: w NOT IN ({_LIST})) AS wb,
  {canonical_sql('title')} AS ca, {canonical_sql('text')} AS cb, {_PLAIN.format(x='title')} AS pa, {_PLAIN.format(x='text')} AS pb FROM o JOIN t USING (page_id)),
b AS (SELECT *, regexp_replace(ka, '[^0-9\p{{Ll}}]', '', 'g') AS ba, regexp_replace(kb, '[^0-9\p{{Ll}}]', '', 'g') AS bb FROM k),
s AS (SELECT page_id, ord, CASE WHEN ka = '' OR kb = '' THEN 0 WHEN ka = kb THEN 100 WHEN ba <> '' AND ba = bb THEN 98 WHEN ba <> '' AND bb <> '' AND (contains(ba, bb) OR contains(bb, ba)) AND least(length(ba), length(bb)) >= 6 THEN 88
  WHEN len(wa) > 0 AND wa[1:2] = wb[1:2] THEN 84 WHEN len(list_intersect(wa, wb)) >= 3 THEN 78 WHEN len(list_intersect(wa, wb)) = 2 THEN 68 ELSE 0 END AS points, {fragments_sql('ca', 'cb')} AS fragments, {fragments_sql('pa', 'pb')} AS plain FROM b)
SELECT page_id, arg_max(ord, points * 100000 - ord) AS ord, max(points) AS points, max(points) >= 68 AS settled, arg_max(fragments, points * 100000 - ord) AS fragments, count(*) FILTER (fragments) AS n_fragments, count(*) FILTER (plain) AS n_plain FROM s GROUP BY page_id""",
}
