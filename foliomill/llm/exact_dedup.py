"""Exact deduplication with heavy hitters split off.

Digests of the texts are written once.  A Misra-Gries summary of every partition, merged, proposes digests that are
frequent; their exact counts are verified and the winners (at most `capacity`, a proven bound) are broadcast, so rows
of frequent texts are settled on the map side.  The remaining digests take an ordinary shuffle, where no group can
hold more than about rows/capacity of the table.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, text_or_empty

#: Counters of a Misra-Gries summary; also the bound on the rows that are broadcast.
CAPACITY = 1024


class MisraGries:
    """Counters for at most `capacity` keys; a key met more than n / (capacity + 1) times among n is kept."""

    def __init__(self, capacity: int):
        self.capacity, self.counts = capacity, Counter()

    def add(self, counts: dict) -> None:
        self.counts.update(counts)
        if len(self.counts) > self.capacity:
            cut = sorted(self.counts.values(), reverse=True)[self.capacity]
            self.counts = Counter({k: v - cut for k, v in self.counts.items() if v > cut})


def _summaries(capacity: int):
    def run(batches):
        found = MisraGries(capacity)
        for b in batches:
            found.add(Counter(b.column(0).to_pylist()))
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(found.counts), pa.string()), "n": pa.array(list(found.counts.values()), pa.int64())})

    return run


def frequent_digests(digests: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """At most `capacity` digests with their exact counts and winning rows, verified: each occurs at least twice."""
    merged = digests.select("digest").mapInArrow(_summaries(capacity), "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    likely = merged.where("n > 1").orderBy(F.desc("n"), "digest").limit(capacity).select("digest")
    return (
        digests.join(F.broadcast(likely), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("winner"))
        .where("group_size > 1")
    )


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; null counts as the empty text.  Of equal texts the row with the
    largest id stays; of rows that repeat that id too, exactly one stays.  A null id loses to any other id.  An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    digests = scratch.keep(
        docs.select(F.col(id_col).alias("id"), F.sha2(text_or_empty(text_col), 256).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests"
    )
    heavy = scratch.keep(frequent_digests(digests, capacity), "frequent")
    on_map_side = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("winner"))
    settled = on_map_side.unionByName(rest.join(groups, "digest"))
    return settled.select(
        F.col("id").alias(id_col),
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, kept: DataFrame, digest: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id and text digest are together in `kept` (id, digest), in docs' own columns.  `digest` makes
    it of docs.  Of rows that repeat both, one is returned."""
    rows = docs.withColumn("__digest", digest)
    same = lambda other: F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col(other))
    found = rows.join(kept.toDF("__id", "__kept").distinct(), same("__kept"), "left_semi")
    repeated = rows.groupBy(F.col(id_col).alias("__id"), F.col("__digest").alias("__twice")).count().where("count > 1").select("__id", "__twice")
    once = found.join(repeated, same("__twice"), "left_anti")
    return once.unionByName(found.join(repeated, same("__twice"), "left_semi").dropDuplicates([id_col, "__digest"])).drop("__digest")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(load(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
