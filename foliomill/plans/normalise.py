"""Normalising text and what is read out of it: entities, spacing and links repaired, split words joined, scanned text
as parts, reference entries, gates and the state of a conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import text as T
from ..sources import html
from ..sources.tables import load
from ..streaming import jobs
from . import quality

#: Entities and what they stand for, the last one last.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
SOFT_HYPHEN, NBSP = "­", " "
DOMAINS = ("com", "org", "net", "edu", "pl", "de")


def normalize(x) -> Column:
    """Entities resolved, soft hyphens gone, all white space single, links compacted, brackets and punctuation closed
    up, sentences spaced, percentages and units closed up.  Nothing after the first squeeze puts spaces together."""
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.replace(F.replace(x, F.lit(SOFT_HYPHEN), F.lit("")), F.lit(NBSP), F.lit(" "))
    x = compact_links(T.squeeze(x))
    x = F.regexp_replace(F.regexp_replace(x, r"\( +", "("), r" +([,.;:!?)])", "$1")
    return T.close_up_units(T.close_up_percent(T.space_sentences(x)))


def compact_links(x) -> Column:
    """Links that spaces broke: after the scheme, after www, before a known domain, before what follows it, in DOIs."""
    x = F.regexp_replace(x, r"(https?) ?: ?/ ?/ ?", "$1://")
    x = F.regexp_replace(x, r"(www) ?\. ?", "$1.")
    x = F.regexp_replace(x, r"([a-z0-9-]) ?\. ?(" + "|".join(DOMAINS) + r")\b", "$1.$2")
    x = F.regexp_replace(x, r"\.(" + "|".join(DOMAINS) + r") / ?([a-z0-9])", ".$1/$2")
    return F.regexp_replace(x, r"(?i)(doi) ?: ?(10\.)", "$1:$2")


def spoiled(docs: DataFrame) -> DataFrame:
    """(doc_id, source, x): texts with entities, soft hyphens, hard spaces, brackets and broken links put in."""
    x = F.replace(F.replace(F.replace("text", F.lit(" and "), F.lit(" &amp; ")), F.lit("ion"), F.lit(f"i{SOFT_HYPHEN}on")), F.lit(" the "), F.lit(f"{NBSP}the ( "))
    return docs.where("text is not null").select("doc_id", "source", F.concat(x, F.lit(" ) see http : //www . example . com /p"), F.col("doc_id").cast("string"), F.lit(" or doi : 10.1000/q"), F.col("doc_id").cast("string")).alias("x"))


def q72_normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spoiled(load(spark, sf_dir, "documents")).select("doc_id", normalize(F.col("x")).alias("n"))
    return rows.select("doc_id", F.md5("n").alias("normalised"), F.length("n").cast("long").alias("n_chars"))


def q73_compacted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that can be read once they are compacted, per source and kind."""
    rows = spoiled(load(spark, sf_dir, "documents")).select("source", compact_links(T.squeeze(F.replace("x", F.lit(NBSP), F.lit(" ")))).alias("c"))
    found = rows.select("source", F.explode(F.regexp_extract_all("c", F.lit(r"(?:https?://|doi:)[^ ]+"), 0)).alias("link"))
    return found.groupBy("source", F.when(F.col("link").startswith("doi:"), "doi").otherwise("url").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("link").alias("n_links"))


def q74_joined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that were cut in two (every fifth of eight letters or more) joined again where the whole is better known
    than either half; of overlapping pairs the left one goes first.

    Pairs are made inside each document and looked up in the lexicon, which every task has, so that only those to join
    move; in a run of overlapping pairs every other one is taken, which is what going from left to right takes.
    """
    docs = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.transform(T.letters_only(F.col("text")), F.lower).alias("w"))
    lexicon = docs.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 10")
    token = lambda t, cut, k: F.struct(t.alias("t"), F.lit(cut).alias("cut"), F.lit(k).alias("k"))
    halves = lambda x, pos: F.when((F.length(x) >= 8) & (pos % 5 == 0), F.array(token(F.left(x, F.lit(4)), True, 0), token(F.substr(x, F.lit(5)), True, 1))).otherwise(F.array(token(x, False, 0)))
    tokens = docs.select("doc_id", F.flatten(F.transform("w", halves)).alias("s"))
    pairs = tokens.select("doc_id", F.posexplode(F.zip_with("s", F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.struct(a["cut"].alias("cut"), a["k"].alias("k"), a["t"].alias("l"), b["t"].alias("r")))).alias("i", "p"))
    pairs = pairs.select("doc_id", "i", "p.*").where("length(l) >= 2 AND length(r) >= 2").withColumn("m", F.concat("l", "r"))
    known = lambda c, n: F.broadcast(lexicon.select(F.col("word").alias(c), F.col("n").alias(n)))
    scored = pairs.join(known("m", "nm"), "m").join(known("l", "nl"), "l", "left").join(known("r", "nr"), "r", "left")
    good = scored.where(F.col("nm") > F.greatest(F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0))))
    v = Window.partitionBy("doc_id").orderBy("i")
    runs = good.withColumn("run", F.col("i") - F.row_number().over(v))
    taken = runs.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("i"))).where("at % 2 = 1")
    return taken.groupBy("doc_id").agg(F.count("*").alias("n_joined"), F.count_if(F.col("cut") & (F.col("k") == 0)).alias("n_restored"))


def q75_scanned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as parts of a page: h1 in capitals, h3 numbered, h2 other headings, and paragraphs of what is between."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", "pos", T.squeeze(F.col("raw")).alias("line")).where("line <> ''")
    line = F.col("line")
    kind = F.when((F.length(line) <= 60) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}"), "h1").when(line.rlike(r"^[0-9]+(\.[0-9]+)* \p{Lu}") & (F.length(line) <= 90), "h3").when(T.looks_like_heading(line), "h2").otherwise("p")
    w = Window.partitionBy("doc_id").orderBy("pos")
    parts = lines.select("doc_id", "pos", "line", kind.alias("kind")).withColumn("new", F.when((F.col("kind") == "p") & (F.lag("kind").over(w) == "p"), 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    merged = parts.groupBy("doc_id", "part", "kind").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
    return merged.groupBy("kind").agg(F.count("*").alias("n_parts"), F.sum("n_lines").alias("n_lines"), F.sum("n_chars").alias("n_chars"), F.countDistinct("doc_id").alias("n_docs"))


ENTRY = r"^\[?R([0-9]+)\]?[.:]? (.+?)\. (.*?) ?((?:https?://|www\.)[^ ]+)?$"


def q76_reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries made of the passages, `[R7] Title. Description link`, read back into their parts."""
    w = T.letters_only(F.coalesce("text", F.lit("")))
    rows = load(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("[R"), F.col("item_id").cast("string"), F.lit("] "), F.array_join(F.slice(w, 1, 4), " "), F.lit(". "), F.array_join(F.slice(w, F.lit(5), F.greatest(F.size(w), F.lit(1))), " "), F.when(F.col("item_id") % 3 != 0, F.concat(F.lit(" https://www.example.com/r"), F.col("item_id").cast("string"))).otherwise(F.lit(""))).alias("x"))
    part = lambda k: F.regexp_extract("x", ENTRY, k)
    out = rows.select("item_id", F.try_to_number(part(1), F.lit("999999999")).cast("long").alias("ref"), part(2).alias("title"), F.btrim(part(3)).alias("description"), part(4).alias("link"))
    return out.withColumn("review", F.col("link") == "")


def q77_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four gates of each page, A title, B headings, C links, D text, and the release that they allow."""
    pages = load(spark, sf_dir, "pages")
    h = html.headings(pages).groupBy("page_id").agg(F.count_if(F.col("level") == 1).alias("h1"), F.count_if(F.col("level") == 0).alias("titles"))
    n = html.links(pages).groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.length("label") <= 2).alias("short"))
    x = pages.select("page_id", F.length(F.coalesce("html", F.lit(""))).alias("size"), T.count(F.coalesce("html", F.lit("")), r"[*%#$]{3}").alias("junk")).join(h, "page_id", "left").join(n, "page_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    gate = lambda fail, review: F.when(fail, "fail").when(review, "pass_with_review").otherwise("pass")
    g = {"a": gate(z("titles") == 0, z("titles") > 1), "b": gate(z("h1") == 0, z("h1") > 1), "c": gate(z("links") == 0, z("short") >= 2), "d": gate(F.col("size") < 800, F.col("junk") > 10)}
    rows = x.select("page_id", *(v.alias(k) for k, v in g.items()))
    worst = F.greatest(*(S.rank(S.report_status(F.col(k))) for k in g))
    return rows.withColumn("release", S.of_rank(worst))


def q78_conversion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's job, grade and findings as one state: severity, and alerts without repeats in order."""
    job = jobs.latest(jobs.job_events(load(spark, sf_dir, "events"))).select(F.col("job_id").alias("doc_id"), "status", "n_events")
    g = quality.graded(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    rows = g.join(job, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("unavailable")))
    alerts = F.array_sort(F.array_distinct(F.concat("blockers", "warnings", F.when(F.col("status") == "failed", F.array(F.lit("conversion_failed"))).otherwise(F.array().cast("array<string>")))))
    severity = F.when((F.col("grade") == "fail") | (F.col("status") == "failed"), "error").when((F.col("grade") == "pass_with_review") | (F.col("status") == "unavailable"), "warning").otherwise("success")
    return rows.select("doc_id", "status", severity.alias("severity"), F.array_join(alerts, ",").alias("alerts"), F.size(alerts).alias("n_alerts"))


def q79_issue_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation labels assigned to a page's blocks in order: each to the first unused block after the last match that
    shares a word with it.  A page at a time, over its own blocks."""
    s = html.slots(load(spark, sf_dir, "pages"))
    rows = s.select("page_id", "ord", F.when(F.array_contains("ancestors", "nav") | (F.col("block") == "li"), "label").otherwise("block").alias("kind"), F.lower("text").alias("text"))
    return rows.groupBy("page_id").applyInPandas(_in_order, "page_id long, n_labels int, n_matched int, last int")


def _in_order(pdf):
    import pandas as pd

    pdf = pdf.sort_values("ord")
    labels = [set(t.split()) for t in pdf[pdf["kind"] == "label"]["text"]]
    blocks = [(o, set(t.split())) for o, t in pdf[pdf["kind"] == "block"][["ord", "text"]].itertuples(index=False)]
    at, matched, last = 0, 0, -1
    for words in labels:
        found = next((k for k in range(at, len(blocks)) if words & blocks[k][1]), None)
        if found is not None:
            at, matched, last = found + 1, matched + 1, int(blocks[found][0])
    return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "n_labels": [len(labels)], "n_matched": [matched], "last": [last]})


QUERIES = {q.__name__: q for q in (q72_normalised_texts, q73_compacted_links, q74_joined_words, q75_scanned_parts, q76_reference_entries, q77_gates, q78_conversion_states, q79_issue_matching)}

_D = "|".join(DOMAINS)
_SPOILED = r"""WITH s AS (SELECT doc_id, source, replace(replace(replace(text, ' and ', ' &amp; '), 'ion', 'i' || chr(173) || 'on'), ' the ', chr(160) || 'the ( ') || ' ) see http : //www . example . com /p' || doc_id || ' or doi : 10.1000/q' || doc_id AS x FROM documents WHERE text IS NOT NULL)
"""


def _sql_links(x: str) -> str:
    for pattern, by in (("(https?) ?: ?/ ?/ ?", r"\1://"), (r"(www) ?\. ?", r"\1."), (rf"([a-z0-9-]) ?\. ?({_D})\b", r"\1.\2"), (rf"\.({_D}) / ?([a-z0-9])", r".\1/\2"), (r"(?i)(doi) ?: ?(10\.)", r"\1:\2")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _sql_normal(x: str) -> str:
    for entity, char in ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, entity, char.replace("'", "''"))
    x = f"regexp_replace(replace(replace({x}, chr(173), ''), chr(160), ' '), '[\\r\\n\\t]', ' ', 'g')"
    x = _sql_links(f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))")
    for pattern, by in ((r"\( +", "("), (r" +\)", ")"), (r"[ ]+([,.;:!?])", r"\1"), (r"(\p{Ll})([.!?])(\p{Lu})", r"\1\2 \3"), (r"([0-9])([,.]) ([0-9]+) ?%", r"\1\2\3%"), ("([0-9]) +%", r"\1%"), ("([0-9]) +(" + "|".join(T.UNITS) + r")\b", r"\1\2")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"


SQL = {
    "q72_normalised_texts": _SPOILED + f", n AS (SELECT doc_id, {_sql_normal('x')} AS n FROM s) SELECT doc_id, md5(n) AS normalised, length(n) AS n_chars FROM n",
    "q73_compacted_links": _SPOILED + r", c AS (SELECT source, " + _sql_links(r"trim(regexp_replace(replace(x, chr(160), ' '), '[ \t\r\n]+', ' ', 'g'))") + r""" AS c FROM s),
l AS (SELECT source, unnest(regexp_extract_all(c, '(?:https?://|doi:)[^ ]+')) AS link FROM c) SELECT source, CASE WHEN starts_with(link, 'doi:') THEN 'doi' ELSE 'url' END AS kind, count(*) AS n, count(DISTINCT link) AS n_links FROM l GROUP BY ALL""",
    "q74_joined_words": r"""WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, lower(unnest(ws)) AS word FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS ws FROM documents WHERE text IS NOT NULL)),
lex AS (SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 10),
h AS (SELECT doc_id, pos, length(word) >= 8 AND pos % 5 = 0 AS cut, CASE WHEN length(word) >= 8 AND pos % 5 = 0 THEN [left(word, 4), substr(word, 5)] ELSE [word] END AS hs FROM w),
t AS (SELECT doc_id, pos, cut, generate_subscripts(hs, 1) - 1 AS k, unnest(hs) AS t FROM h),
p AS (SELECT doc_id, cut, k, row_number() OVER v AS i, t AS l, lead(t) OVER v AS r FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY pos, k)),
g AS (SELECT p.* FROM p JOIN lex m ON m.word = p.l || p.r LEFT JOIN lex a ON a.word = p.l LEFT JOIN lex b ON b.word = p.r WHERE r IS NOT NULL AND length(l) >= 2 AND length(r) >= 2 AND m.n > greatest(coalesce(a.n, 0), coalesce(b.n, 0))),
u AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS nth FROM u)
SELECT doc_id, count(*) AS n_joined, count(*) FILTER (cut AND k = 0) AS n_restored FROM x WHERE nth % 2 = 1 GROUP BY doc_id""",
    "q75_scanned_parts": r"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, trim(regexp_replace(unnest(p), '[ \t\r\n]+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
w AS (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l WHERE line <> ''),
k AS (SELECT doc_id, pos, line, CASE WHEN length(line) <= 60 AND regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '\p{Ll}') THEN 'h1' WHEN regexp_matches(line, '^[0-9]+(\.[0-9]+)* \p{Lu}') AND length(line) <= 90 THEN 'h3'
 WHEN length(line) <= 90 AND len(ws) <= 12 AND NOT regexp_matches(line, '[.!?;:,]$') AND coalesce(len(list_filter(ws, lambda x: regexp_matches(x, '^\p{Lu}'))) / nullif(len(ws), 0)::double, 0) >= 0.55 THEN 'h2' ELSE 'p' END AS kind FROM w),
n AS (SELECT *, CASE WHEN kind = 'p' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) = 'p' THEN 0 ELSE 1 END AS new FROM k), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM n),
m AS (SELECT doc_id, part, kind, count(*) AS n_lines, sum(length(line)) AS n_chars FROM g GROUP BY ALL)
SELECT kind, count(*) AS n_parts, sum(n_lines)::bigint AS n_lines, sum(n_chars)::bigint AS n_chars, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY kind""",
    "q76_reference_entries": r"""WITH w AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '\p{L}+') AS w FROM benchmark),
x AS (SELECT item_id, '[R' || item_id || '] ' || coalesce(array_to_string(w[1:4], ' '), '') || '. ' || coalesce(array_to_string(w[5:], ' '), '') || CASE WHEN item_id % 3 <> 0 THEN ' https://www.example.com/r' || item_id ELSE '' END AS x FROM w),
p AS (SELECT item_id, regexp_extract(x, '^\[?R([0-9]+)\]?[.:]? (.+?)\. (.*?) ?((?:https?://|www\.)[^ ]+)?$', ['ref', 'title', 'description', 'link']) AS e FROM x)
SELECT item_id, try_cast(e.ref AS bigint) AS ref, e.title AS title, trim(e.description) AS description, e.link AS link, e.link = '' AS review FROM p""",
    "q77_gates": r"""WITH h AS (SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '<h1>[^<]*')) AS h1, len(regexp_extract_all(coalesce(html, ''), '<title>[^<]*')) AS titles, length(coalesce(html, '')) AS size, len(regexp_extract_all(coalesce(html, ''), '[*%#$]{3}')) AS junk,
 list_transform(regexp_extract_all(coalesce(html, ''), '<a href="[^"]*">[^<]*'), lambda r: trim(regexp_extract(r, '>(.*)$', 1))) AS labels FROM pages),
g AS (SELECT page_id, CASE WHEN titles = 0 THEN 'fail' WHEN titles > 1 THEN 'pass_with_review' ELSE 'pass' END AS a, CASE WHEN h1 = 0 THEN 'fail' WHEN h1 > 1 THEN 'pass_with_review' ELSE 'pass' END AS b,
 CASE WHEN len(labels) = 0 THEN 'fail' WHEN len(list_filter(labels, lambda x: length(x) <= 2)) >= 2 THEN 'pass_with_review' ELSE 'pass' END AS c, CASE WHEN size < 800 THEN 'fail' WHEN junk > 10 THEN 'pass_with_review' ELSE 'pass' END AS d FROM h)
SELECT *, CASE WHEN 'fail' IN (a, b, c, d) THEN 'failed' WHEN 'pass_with_review' IN (a, b, c, d) THEN 'passed_with_warnings' ELSE 'passed' END AS release FROM g""",
    "q78_conversion_states": quality._G + """, j AS (SELECT user_id AS doc_id, arg_max(CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'repairing' WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' ELSE 'queued' END, (ts, event_id)) AS status FROM events GROUP BY user_id),
q AS (SELECT g.doc_id, coalesce(status, 'unavailable') AS status, grade, list_sort(list_distinct(list_concat(b, w, CASE WHEN status = 'failed' THEN ['conversion_failed'] ELSE [] END))) AS alerts FROM g LEFT JOIN j USING (doc_id))
SELECT doc_id, status, CASE WHEN grade = 'fail' OR status = 'failed' THEN 'error' WHEN grade = 'pass_with_review' OR status = 'unavailable' THEN 'warning' ELSE 'success' END AS severity, coalesce(array_to_string(alerts, ','), '') AS alerts, len(alerts)::int AS n_alerts FROM q""",
}
