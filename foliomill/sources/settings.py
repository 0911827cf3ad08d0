"""Settings from JSON files: manifests of cases, size policies, term dictionaries; and reports to JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CASE = "id string, document_class string, input_type string, language string, quick_smoke boolean, release_strict boolean, target string, notes string, size_bytes long"
BUDGET = "warn_bytes long, hard_bytes long, notes string"
TERM = "canonical string, variants array<string>, protected boolean"


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file as one row; what doesn't parse is null throughout, and no file is no row."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception:  # the path doesn't exist
        return spark.createDataFrame([], schema)
    return raw.select(F.from_json("value", schema).alias("j")).where("j IS NOT NULL").select("j.*")


def manifest_cases(spark: SparkSession, path: str, input_type: str | None = None) -> DataFrame:
    """Cases of a manifest, in order; all of one input type where that is asked for."""
    cases = _parsed(spark, path, f"version int, root_dir string, cases array<struct<{CASE.replace(' ', ':')}>>".replace(",:", ", ")).select(F.posexplode("cases").alias("seq", "c")).select("seq", "c.*")
    return cases if input_type is None else cases.where(F.col("input_type") == input_type)


def size_policy(spark: SparkSession, path: str) -> DataFrame:
    """(class, warn_bytes, hard_bytes) with normalised keys."""
    rows = _parsed(spark, path, "version int, document_classes map<string, struct<warn_bytes:bigint, hard_bytes:bigint>>")
    return rows.select(F.explode("document_classes").alias("key", "b")).select(T.class_key(F.col("key")).alias("class"), "b.warn_bytes", "b.hard_bytes")


def term_dictionary(spark: SparkSession, path: str, built_in: list[tuple[str, str]] = ()) -> DataFrame:
    """(variant, canonical): the file's terms over the built-in ones; every term is a variant of itself."""
    rows = _parsed(spark, path, "terms array<struct<canonical:string, variants:array<string>, protected:boolean>>")
    own = rows.select(F.explode("terms").alias("t")).select(F.explode(F.concat(F.array("t.canonical"), F.coalesce("t.variants", F.array().cast("array<string>")))).alias("variant"), F.col("t.canonical").alias("canonical"), F.lit(1).alias("p"))
    base = spark.createDataFrame([(v, c, 0) for v, c in built_in], "variant string, canonical string, p int")
    return own.unionByName(base).groupBy(F.lower("variant").alias("variant")).agg(F.max_by("canonical", F.struct("p", "canonical")).alias("canonical"))


def markdown_table(df: DataFrame, order: list) -> DataFrame:
    """(n, line): the rows as lines of a Markdown table, in order; for reports, which are small."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |"))
    rows = df.select(F.struct(*order).alias("o"), line.alias("line")).groupBy().agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("r"))
    head = "| " + " | ".join(df.columns) + " |"
    lines = F.concat(F.array(F.lit(head), F.lit("|" + "-|" * len(df.columns))), F.transform("r", lambda x: x["line"]))
    return rows.select(F.posexplode(lines).alias("n", "line"))
