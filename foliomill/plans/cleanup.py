"""Text repairs: proposals with scores, decisions by thresholds, and what they change.

The test tables hold clean prose, so each query first roughens its text in a fixed way, the same in its SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import load

#: Weights of a proposal's parts, and the scores from which it is applied and reviewed.
LEXICAL, CONTEXT, LANGUAGE, DOM, BONUS = 0.35, 0.25, 0.15, 0.15, 0.10
SAFE, REVIEW = 0.85, 0.65
#: Caps of the surroundings' part, the first that holds.
CAPS = (("heading", 0.6), ("caption", 0.5), ("note", 0.45), ("anchor", 0.75))
#: Fixed values: (lexical, context, language, bonus) of each kind of repair.
KINDS = {"spacing-punctuation": (1.0, 0.95, 1.0, 0.0), "spacing-sentence": (0.92, 0.88, 1.0, 0.0), "spacing-number-unit": (1.0, 0.95, 1.0, 0.0), "numeric-fragment": (1.0, 0.98, 1.0, 0.0)}


def score(kind: str, place: Column) -> Column:
    """Of a repair in a place: heading, caption, note, anchor, or anything else; 0 in a table."""
    lexical, context, language, bonus = KINDS[kind]
    dom = F.lit(1.0)
    for name, cap in reversed(CAPS):
        dom = F.when(place == name, F.lit(cap)).otherwise(dom)
    base = F.lit(LEXICAL * lexical + CONTEXT * context + LANGUAGE * language + BONUS * bonus)
    return F.when(place == "table", F.lit(0.0)).otherwise(base + F.lit(DOM) * dom)


def decided(points: Column) -> Column:
    return F.when(points >= SAFE, "safe_auto_fix").when(points >= REVIEW, "review_needed").otherwise("blocked")


def place_of(docs: DataFrame) -> Column:
    """Documents of one short line stand for headings, long single lines for tables."""
    one = ~F.col("text").contains("\n")
    return F.when(one & (F.length("text") <= 90), "heading").when(one & (F.length("text") > 2000), "table").otherwise("body")


def roughened(docs: DataFrame) -> DataFrame:
    """doc_id, place, and texts with a space before commas (odd ids) and none between sentences (every third)."""
    return docs.where("text is not null").select(
        "doc_id", "source", place_of(docs).alias("place"),
        F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit(","), F.lit(" ,"))).otherwise(F.col("text")).alias("spaced"),
        F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(". "), F.lit("."))).otherwise(F.col("text")).alias("joined"),
        F.concat("text", F.lit(" 12 % and 3, 5% of 7 kg")).alias("numbers"),
    )


def decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, source, error_class, n_hits, score, status, fixed): one row per document and kind with any hit."""
    rough = roughened(docs)
    kinds = (
        ("spacing-punctuation", "spaced", r"[ ]+[,.;:!?]", T.close_up_punctuation),
        ("spacing-sentence", "joined", r"\p{Ll}[.!?]\p{Lu}", T.space_sentences),
        ("spacing-number-unit", "numbers", r"[0-9] +(?:%|kg)", lambda x: T.close_up_units(T.close_up_percent(x))),
        ("numeric-fragment", "numbers", r"[0-9][,.] [0-9]+ ?%", T.close_up_percent),
    )
    # one pass over the rows: an array of what each kind found
    found = [
        F.struct(F.lit(kind).alias("error_class"), T.count(F.col(col), pattern).alias("n_hits"), score(kind, F.col("place")).alias("score"), F.md5(repair(F.col(col))).alias("fixed"))
        for kind, col, pattern, repair in kinds
    ]
    rows = rough.select("doc_id", "source", F.explode(F.filter(F.array(*found), lambda x: x["n_hits"] > 0)).alias("d")).select("doc_id", "source", "d.*")
    return rows.withColumn("status", decided(F.col("score")))


def q04_repair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(load(spark, sf_dir, "documents")).select("doc_id", "error_class", "n_hits", F.round("score", 6).alias("score"), "status", "fixed")


def q05_decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per status and kind: decisions and hits; documents changed; whether anything blocks a release."""
    d = decisions(load(spark, sf_dir, "documents"))
    return d.groupBy("status", "error_class").agg(
        F.count("*").alias("n_decisions"), F.sum("n_hits").alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"),
        F.bool_or(F.col("status") == "blocked").alias("blocks"),
    )


def q06_number_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text repaired: its digest, its tail and its length."""
    rough = roughened(load(spark, sf_dir, "documents"))
    fixed = T.close_up_units(T.close_up_percent(F.col("numbers")))
    return rough.select("doc_id", F.md5(fixed).alias("fixed"), F.right(fixed, F.lit(20)).alias("tail"), F.length(fixed).cast("long").alias("n_chars"))


def q07_protected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: tokens that no repair may touch, by kind, over texts that also carry a link."""
    docs = load(spark, sf_dir, "documents").select("source", F.concat(F.coalesce("text", F.lit("")), F.lit(" see www.example.com/"), F.col("doc_id").cast("string"), F.lit(" doi 10.1000/x"), F.col("doc_id").cast("string")).alias("t"))
    counts = {"emails": T.EMAIL, "versions": T.VERSION, "urls": T.URL, "dois": T.DOI}
    return docs.select("source", *(T.count(F.col("t"), p).alias(k) for k, p in counts.items())).groupBy("source").agg(*(F.sum(k).alias(k) for k in counts))


def q08_stripped_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with e-mail addresses, and their text without them."""
    docs = load(spark, sf_dir, "documents").where(T.has_email(F.col("text")))
    return docs.select("doc_id", T.count_emails(F.col("text")).alias("n_emails"), F.md5(T.strip_emails(F.col("text"))).alias("stripped"))


def q14_camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a text glued together as camel case, and split again."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    every = T.letters_only(F.replace("text", F.lit("ß"), F.lit("ss")))
    glued = F.array_join(F.transform(every, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    return docs.select("doc_id", glued.alias("glued")).select("doc_id", F.md5("glued").alias("glued"), F.md5(T.split_camel(F.col("glued"))).alias("split"), T.count(F.col("glued"), r"\p{Ll}\p{Lu}").alias("n_joins"))


QUERIES = {q.__name__: q for q in (q04_repair_decisions, q05_decision_summary, q06_number_repair, q07_protected_tokens, q08_stripped_emails, q14_camel_split)}

_ROUGH = r"""
WITH rough AS (
  SELECT doc_id, source, CASE WHEN NOT contains(text, chr(10)) AND length(text) <= 90 THEN 'heading' WHEN NOT contains(text, chr(10)) AND length(text) > 2000 THEN 'table' ELSE 'body' END AS place,
    CASE WHEN doc_id % 2 = 1 THEN replace(text, ',', ' ,') ELSE text END AS spaced,
    CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', '.') ELSE text END AS joined,
    text || ' 12 % and 3, 5% of 7 kg' AS numbers
  FROM documents WHERE text IS NOT NULL),
percent AS (
  SELECT *, regexp_replace(regexp_replace(numbers, '([0-9])([,.]) ([0-9]+) ?%', '\1\2\3%', 'g'), '([0-9]) +%', '\1%', 'g') AS p FROM rough),
units AS (SELECT *, regexp_replace(p, '([0-9]) +(kg|cm|mm|km|ml|GB|MB)\b', '\1\2', 'g') AS u FROM percent),
found AS (
  SELECT doc_id, place, 'spacing-punctuation' AS error_class, len(regexp_extract_all(spaced, '[ ]+[,.;:!?]')) AS n_hits, 0.7375 AS base, md5(regexp_replace(spaced, '[ ]+([,.;:!?])', '\1', 'g')) AS fixed FROM units
  UNION ALL SELECT doc_id, place, 'spacing-sentence', len(regexp_extract_all(joined, '\p{Ll}[.!?]\p{Lu}')), 0.692, md5(regexp_replace(joined, '(\p{Ll})([.!?])(\p{Lu})', '\1\2 \3', 'g')) FROM units
  UNION ALL SELECT doc_id, place, 'spacing-number-unit', len(regexp_extract_all(numbers, '[0-9] +(?:%|kg)')), 0.7375, md5(u) FROM units
  UNION ALL SELECT doc_id, place, 'numeric-fragment', len(regexp_extract_all(numbers, '[0-9][,.] [0-9]+ ?%')), 0.745, md5(p) FROM units),
scored AS (SELECT *, CASE place WHEN 'table' THEN 0.0 WHEN 'heading' THEN base + 0.15 * 0.6 ELSE base + 0.15 END AS points FROM found WHERE n_hits > 0),
decided AS (SELECT doc_id, error_class, n_hits, round(points::double, 6) AS score, CASE WHEN points >= 0.85 THEN 'safe_auto_fix' WHEN points >= 0.65 THEN 'review_needed' ELSE 'blocked' END AS status, fixed FROM scored)
"""
SQL = {
    "q04_repair_decisions": _ROUGH + "SELECT doc_id, error_class, n_hits, score, status, fixed FROM decided",
    "q05_decision_summary": _ROUGH + "SELECT status, error_class, count(*) AS n_decisions, sum(n_hits)::bigint AS n_hits, count(DISTINCT doc_id) AS n_docs, status = 'blocked' AS blocks FROM decided GROUP BY status, error_class",
    "q06_number_repair": _ROUGH + "SELECT doc_id, md5(u) AS fixed, right(u, 20) AS tail, length(u) AS n_chars FROM units",
    "q07_protected_tokens": r"""
WITH d AS (SELECT source, coalesce(text, '') || ' see www.example.com/' || doc_id || ' doi 10.1000/x' || doc_id AS t FROM documents)
SELECT source, sum(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')))::bigint AS emails, sum(len(regexp_extract_all(t, '[vV]?[0-9]+\.[0-9]+\.[0-9]+')))::bigint AS versions,
  sum(len(regexp_extract_all(t, '(?:https?://|www\.)[^ \n\t<>]+')))::bigint AS urls, sum(len(regexp_extract_all(t, '10\.[0-9]{4,9}/[^ \n\t]+')))::bigint AS dois FROM d GROUP BY source""",
    "q08_stripped_emails": r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n_emails,
  md5(trim(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS stripped
FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')""",
    "q14_camel_split": r"""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(replace(text, 'ß', 'ss'), '\p{L}+'), lambda w: upper(w[1:1]) || lower(substr(w, 2))) AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, coalesce(array_to_string(ws, ''), '') AS glued FROM w)
SELECT doc_id, md5(glued) AS glued, md5(regexp_replace(glued, '(\p{Ll})(\p{Lu})', '\1 \2', 'g')) AS split, len(regexp_extract_all(glued, '\p{Ll}\p{Lu}')) AS n_joins FROM g""",
}
