"""Lines that repeat across documents: headers, footers and other boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from ..functions.text import trim_space

#: Lines looked at from either end of a document, longest line counted, and documents' ends it must occur at.
EDGE, MAX_CHARS, MIN_COUNT = 3, 90, 4


def edge_lines(documents: DataFrame, edge: int = EDGE, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, source, lang, line): first and last lines; a line of a short document counts from both ends."""
    lines = documents.select(
        "doc_id", "source", "lang", F.filter(F.transform(F.split("text", "\n"), trim_space), lambda x: x != "").alias("lines")
    ).where(F.size("lines") > 0)
    first = F.slice("lines", 1, edge)
    last = F.slice("lines", F.greatest(F.lit(1), F.size("lines") - (edge - 1)), edge)
    return lines.select("doc_id", "source", "lang", F.explode(F.concat(first, last)).alias("line")).where(F.length("line") <= max_chars)


def q01_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and language: edge lines that repeat, and documents with at least one of them."""
    edges = edge_lines(load(spark, sf_dir, "documents"))
    repeated = edges.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)
    return (
        edges.join(repeated, "line")
        .groupBy("source", "lang")
        .agg(F.count("*").alias("n_lines"), F.countDistinct("line").alias("n_distinct"), F.countDistinct("doc_id").alias("n_docs"))
    )


QUERIES = {"q01_boilerplate_lines": q01_boilerplate_lines}
SQL = {
    "q01_boilerplate_lines": """
WITH l AS (SELECT doc_id, source, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM documents),
e AS (SELECT doc_id, source, lang, unnest(list_concat(lines[1:3], lines[greatest(1, len(lines) - 2):len(lines)])) AS line FROM l WHERE len(lines) > 0),
s AS (SELECT * FROM e WHERE length(line) <= 90),
r AS (SELECT line FROM s GROUP BY line HAVING count(*) >= 4)
SELECT source, lang, count(*) AS n_lines, count(DISTINCT line) AS n_distinct, count(DISTINCT doc_id) AS n_docs
FROM s JOIN r USING (line) GROUP BY source, lang
"""
}
