"""Helpers that the corpus operators share: tables written to the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only where a local session names none (tests) is one made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="foliomill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and are read as often as needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def keep(self, df: DataFrame, name: str, codec: str = "zstd", **options) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.options(compression=codec, **options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later step reads."""
        path = getattr(df, "scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))


def in_small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of whole texts stay small: at most this many rows and 8 MB, so that long texts don't pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def in_large_batches(spark: SparkSession) -> None:
    """Arrow batches of rows of a few numbers."""
    in_small_batches(spark, 1 << 16)


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns (node, component) from links (a, b): component is the smallest node reachable.

    Alternates the large-star and small-star steps (each node's larger neighbours, then its smaller ones, are linked
    to its least neighbour) until nothing changes.  Nodes without links don't appear.  Minima are combined before the
    shuffle and joins are left to the skew handling, so a node with very many links doesn't sit in one task.  Every
    round is written to the shared folder.
    """
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "star")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(e)
        e = new
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def fold(id_col: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def bounded_sample(rows: DataFrame, by: str, bound: int, id_col: str = "doc_id", max_values: int = 512) -> tuple[DataFrame, dict]:
    """About `bound` rows of each value of `by` (all, where there are fewer), picked by a hash of the id, and of each
    value its rate and how many rows have it.  More than `max_values` values are an error.  No row moves for this."""
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).limit(max_values + 1).collect()}
    if len(counts) > max_values:
        raise ValueError(f"more than {max_values} values of {by}")
    rates = {k: (min(1.0, bound / n), n) for k, n in counts.items()}
    pick = F.lit(False)
    for value, (rate, _) in rates.items():
        pick = pick | ((F.col(by) == F.lit(value)) & (F.pmod(F.xxhash64(F.col(id_col), F.lit(by)), F.lit(1 << 30)) < int(rate * (1 << 30))))
    return rows.where(pick), rates
