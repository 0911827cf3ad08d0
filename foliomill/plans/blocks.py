"""Lines and blocks made of documents: predicates and labels, lists and tables inside paragraphs, ids, running lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..sources.tables import load

#: A slug that ends in a number as repeats do.
NUMBERED = "^(.+)-([1-9][0-9]{0,7})$"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, x): every line of every text, white space single; empty lines are left out."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", T.squeeze(F.col("line")).alias("x")).where("x <> ''")


def q51_line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All predicates of every line."""
    x = F.col("x")
    return lines_of(load(spark, sf_dir, "documents")).select("doc_id", "pos", *(f(x).alias(name) for name, f in P.BOOLEAN.items()))


def q52_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title quality, context, bucket and source type of every line."""
    x = F.col("x")
    return lines_of(load(spark, sf_dir, "documents")).select("doc_id", "pos", *(f(x).alias(name) for name, f in P.LABELS.items()))


def block_kind(x):
    """What a line is made into: the first that holds."""
    cells = F.filter(F.transform(F.split(x, r"\|"), lambda c: F.btrim(c)), lambda c: c != "")
    return (
        F.when(F.size(cells).between(2, 6), "table").when(P.definition(x), "definitions").when(P.ordered_item(x), "ordered").when(P.bullet_item(x), "bullet")
        .when(T.count(x, ";") >= 2, "semicolons").when(P.index_entry(x), "index").when(P.figure_caption(x), "caption").when(P.reference_title(x), "references").when(T.looks_like_heading(x), "heading").otherwise("paragraph")
    )


def q53_block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(load(spark, sf_dir, "documents")).withColumn("kind", block_kind(F.col("x")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.sum(F.length("x")).alias("n_chars"))


def q54_inline_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every line, between marks, as an inline list, and taken apart again.

    Three kinds by document: numbered, bulleted, semicolons; a list needs two markers, numbers that count up, and
    for semicolons three items of at most 140 characters.
    """
    items = F.filter(F.transform(F.split(T.squeeze(F.col("line")), r"[.,;:!?()]"), lambda s: F.btrim(s)), lambda s: s != "")
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    rows = lines.select("doc_id", "pos", ((F.col("doc_id") + F.col("pos")) % 3).alias("kind"), items.alias("items"))
    inline = F.when(F.col("kind") == 0, F.array_join(F.transform("items", lambda s, i: F.concat((i + 1).cast("string"), F.lit(") "), s)), " ")).when(F.col("kind") == 1, F.array_join(F.transform("items", lambda s: F.concat(F.lit("• "), s)), " ")).otherwise(F.array_join("items", "; "))
    rows = rows.select("doc_id", "pos", "kind", inline.alias("x"))
    split = F.when(F.col("kind") == 0, F.split("x", r" ?[0-9]+\) ")).when(F.col("kind") == 1, F.split("x", r" ?• ")).otherwise(F.split("x", "; "))
    rows = rows.select("doc_id", "pos", "kind", "x", F.filter(split, lambda s: s != "").alias("found"))
    numbers = F.transform(F.regexp_extract_all("x", F.lit(r"([0-9]+)\) "), 1), lambda n: n.cast("int"))
    counts_up = F.forall(F.transform(numbers, lambda n, i: n - i), lambda d: d == 1)
    short = F.forall("found", lambda s: F.length(s) <= 140)
    is_list = F.when(F.col("kind") == 0, (F.size("found") >= 2) & counts_up).when(F.col("kind") == 1, F.size("found") >= 2).otherwise((F.size("found") >= 3) & short)
    return rows.select("doc_id", "pos", F.size("found").alias("n_items"), is_list.alias("is_list"), F.md5(F.array_join("found", "|")).alias("items"))


def q55_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of a document's lines as ids, unique within it: a repeat gets the least number from 2 on that neither an
    earlier repeat nor a line's own slug has."""
    w = Window.partitionBy("doc_id", "slug").orderBy("pos")
    slug = T.slug("x")
    rows = lines_of(load(spark, sf_dir, "documents")).select("doc_id", "pos", F.when(slug == "", "section").otherwise(slug).alias("slug")).withColumn("k", F.row_number().over(w))
    own = rows.where("k = 1").select("doc_id", F.regexp_extract("slug", NUMBERED, 1).alias("slug"), F.regexp_extract("slug", NUMBERED, 2).cast("int").alias("n")).where("slug <> ''")
    taken = own.groupBy("doc_id", "slug").agg(F.collect_list("n").alias("taken"))  # at most a document's lines
    repeats = rows.where("k > 1").join(taken, ["doc_id", "slug"], "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    number = F.element_at(F.array_except(F.sequence(F.lit(2), F.col("k") + F.size("taken")), "taken"), F.col("k") - 1)
    numbered = repeats.select("doc_id", "pos", F.concat("slug", F.lit("-"), number.cast("string")).alias("id"))
    return rows.where("k = 1").select("doc_id", "pos", F.col("slug").alias("id")).unionByName(numbered)


def q56_package_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based UUIDs (version 5, URL namespace) of title, source and language; and digests of whole texts.  The title
    is the first line that isn't empty."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.squeeze), lambda x: x != "")
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.try_element_at(lines, F.lit(1)).alias("x"))
    seed = F.concat_ws("|", F.lower(F.coalesce("x", F.lit(""))), F.col("source"), F.col("lang"))
    h = rows.select("doc_id", F.sha1(F.concat(space, F.encode(seed, "utf-8"))).alias("h"), F.sha1(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("digest"))
    variant = F.lower(F.hex((F.conv(F.substring("h", 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    part = lambda a, n: F.substring("h", a, n)
    return h.select("doc_id", F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)).alias("urn"), "digest")


def q57_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of a source: running headers (three times or more, 120 characters at most) go, but for the first;
    what is left per source.  Counts are joined back so that a frequent line isn't gathered in one task."""
    docs = load(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "source", "pos", F.lower(T.trim_space(F.col("line"))).alias("line")).where("line <> ''")
    known = lines.groupBy("source", "line").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    kept = lines.join(known, ["source", "line"]).where((F.col("n") < 3) | (F.length("line") > 120) | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    return kept.groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.countDistinct("doc_id").alias("n_docs"))


def q58_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns numbered where a number is known (every fourth) and filled forward: the last known one and the gap."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.col("turn") * 10).alias("known"))
    at = turns.withColumn("last", F.last(F.when(F.col("known").isNotNull(), F.struct("known", "turn")), ignorenulls=True).over(w))
    filled = at.select("conv_id", "turn", (F.col("last.known") + F.col("turn") - F.col("last.turn")).alias("number"), F.col("known").isNull().alias("inferred"))
    return filled.groupBy("conv_id").agg(F.sum("number").alias("total"), F.count_if("inferred").alias("n_inferred"), F.count_if(F.col("number").isNull()).alias("n_open"))


def q59_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's metadata with fallbacks, requested, then present, then derived, and which fields that changed."""
    p = load(spark, sf_dir, "pages").select("page_id", F.btrim(F.regexp_extract(F.coalesce("html", F.lit("")), r"<title>([^<]*)", 1)).alias("present"), F.btrim(F.regexp_extract(F.coalesce("html", F.lit("")), r"<h1>([^<]*)", 1)).alias("derived"), F.regexp_extract(F.coalesce("html", F.lit("")), r'<html lang="([a-z]+)"', 1).alias("lang"))
    asked = F.when(F.col("page_id") % 5 == 0, F.lit("Untitled")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("Requested "), F.col("page_id").cast("string")))
    usable = lambda x: F.when(~P.placeholder_title(x), x)
    title = F.coalesce(usable(asked), usable(F.when(F.col("page_id") % 3 != 0, F.col("present"))), usable(F.col("derived")), F.lit("Unknown"))
    cut = F.when(F.length(title) > 40, F.concat(F.regexp_extract(F.left(title, F.lit(40)), r"^(.*) [^ ]*$", 1), F.lit("..."))).otherwise(title)
    out = p.select("page_id", cut.alias("title"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("en")).alias("lang"), "present")
    return out.select("page_id", "title", "lang", (~F.col("title").eqNullSafe(F.col("present"))).alias("changed"))


QUERIES = {q.__name__: q for q in (q51_line_predicates, q52_line_labels, q53_block_kinds, q54_inline_lists, q55_unique_ids, q56_package_ids, q57_running_lines, q58_numbering, q59_metadata)}


LINES = r"""WITH l AS (SELECT doc_id, (generate_subscripts(p, 1) - 1)::int AS pos, trim(regexp_replace(unnest(p), '[ \t\r\n]+', ' ', 'g')) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
f AS (SELECT *, list_filter(string_split(x, ' '), lambda w: w <> '') AS ws FROM l WHERE x <> '')
"""
_S = P.SQL_FORMS
_HEADING = r"length(x) <= 90 AND len(ws) <= 12 AND NOT regexp_matches(x, '[.!?;:,]$') AND coalesce(len(list_filter(ws, lambda w: regexp_matches(w, '^\p{Lu}'))) / nullif(len(ws), 0)::double, 0) >= 0.55"
_SLUG = f"trim(regexp_replace(translate(lower(x), '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[^a-z0-9]+', '-', 'g'), '-')"
SQL = {
    "q51_line_predicates": LINES + "SELECT doc_id, pos, " + ", ".join(f"({_S[n]}) AS {n}" for n in P.BOOLEAN) + " FROM f",
    "q52_line_labels": LINES + "SELECT doc_id, pos, " + ", ".join(f"{_S[n]} AS {n}" for n in P.LABELS) + " FROM f",
    "q53_block_kinds": LINES + rf""", k AS (SELECT doc_id, x, CASE WHEN len(list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c <> '')) BETWEEN 2 AND 6 THEN 'table' WHEN {_S['definition']} THEN 'definitions' WHEN {_S['ordered_item']} THEN 'ordered' WHEN {_S['bullet_item']} THEN 'bullet'
 WHEN len(regexp_extract_all(x, ';')) >= 2 THEN 'semicolons' WHEN {_S['index_entry']} THEN 'index' WHEN {_S['figure_caption']} THEN 'caption' WHEN {_S['reference_title']} THEN 'references' WHEN {_HEADING} THEN 'heading' ELSE 'paragraph' END AS kind FROM f)
SELECT kind, count(*) AS n, min(doc_id) AS first_doc, sum(length(x))::bigint AS n_chars FROM k GROUP BY kind""",
    "q54_inline_lists": r"""WITH l AS (SELECT doc_id, (generate_subscripts(p, 1) - 1)::int AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
i AS (SELECT doc_id, pos, (doc_id + pos) % 3 AS kind, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g')), '[.,;:!?()]'), lambda s: trim(s)), lambda s: s <> '') AS items FROM l)
SELECT doc_id, pos, len(items)::int AS n_items, CASE WHEN kind = 2 THEN len(items) >= 3 AND len(list_filter(items, lambda s: length(s) > 140)) = 0 ELSE len(items) >= 2 END AS is_list, md5(coalesce(array_to_string(items, '|'), '')) AS items FROM i""",
    "q55_unique_ids": LINES + rf""", s AS (SELECT doc_id, pos, coalesce(nullif({_SLUG}, ''), 'section') AS slug FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) AS k FROM s),
t AS (SELECT doc_id, regexp_extract(slug, '{NUMBERED}', 1) AS slug, list(regexp_extract(slug, '{NUMBERED}', 2)::int) AS taken FROM k WHERE k = 1 AND regexp_matches(slug, '{NUMBERED}') GROUP BY ALL)
SELECT doc_id, pos, CASE WHEN k = 1 THEN slug ELSE slug || '-' || list_filter(range(2, k + coalesce(len(taken), 0) + 1), lambda n: NOT coalesce(list_contains(taken, n::int), false))[k - 1] END AS id FROM k LEFT JOIN t USING (doc_id, slug)""",
    "q56_package_ids": r"""WITH x AS (SELECT doc_id, source, lang, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(regexp_replace(l, '[ \t\r\n]+', ' ', 'g'))), lambda l: l <> '')[1] AS x FROM documents),
u AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('|', lower(coalesce(x, '')), source, lang))) AS h, sha1(encode(coalesce(text, ''))) AS digest FROM x)
SELECT doc_id, 'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS urn, digest FROM u""",
    "q57_running_lines": r"""WITH l AS (SELECT doc_id, source, generate_subscripts(p, 1) AS pos, lower(trim(unnest(p), ' ' || chr(9) || chr(13))) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents)),
k AS (SELECT *, count(*) OVER (PARTITION BY source, line) AS n, row_number() OVER (PARTITION BY source, line ORDER BY doc_id, pos) AS rn FROM l WHERE line <> '')
SELECT source, count(*) AS n_lines, sum(length(line))::bigint AS n_chars, count(DISTINCT doc_id) AS n_docs FROM k WHERE n < 3 OR length(line) > 120 OR rn = 1 GROUP BY source""",
    "q58_numbering": """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN turn * 10 END AS known FROM conversations),
f AS (SELECT *, last_value(CASE WHEN known IS NOT NULL THEN known - turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) + turn AS number FROM t)
SELECT conv_id, sum(number)::bigint AS total, count(*) FILTER (known IS NULL) AS n_inferred, count(*) FILTER (number IS NULL) AS n_open FROM f GROUP BY conv_id""",
    "q59_metadata": rf"""WITH p AS (SELECT page_id, trim(regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1)) AS present, trim(regexp_extract(coalesce(html, ''), '<h1>([^<]*)', 1)) AS derived, regexp_extract(coalesce(html, ''), '<html lang="([a-z]+)"', 1) AS lang,
 CASE page_id % 5 WHEN 0 THEN 'Untitled' WHEN 1 THEN 'Requested ' || page_id END AS asked FROM pages),
c AS (SELECT page_id, lang, present, CASE WHEN asked IS NOT NULL AND NOT (lower(asked) = 'untitled') THEN asked WHEN page_id % 3 <> 0 AND NOT (lower(trim(present)) IN {P.PLACEHOLDERS} OR regexp_matches(present, '{P.TECHNICAL}')) THEN present
 WHEN NOT (lower(trim(derived)) IN {P.PLACEHOLDERS} OR regexp_matches(derived, '{P.TECHNICAL}')) THEN derived ELSE 'Unknown' END AS title FROM p),
o AS (SELECT page_id, CASE WHEN length(title) > 40 THEN regexp_extract(left(title, 40), '^(.*) [^ ]*$', 1) || '...' ELSE title END AS title, coalesce(nullif(lang, ''), 'en') AS lang, present FROM c)
SELECT page_id, title, lang, title IS DISTINCT FROM present AS changed FROM o""",
}
