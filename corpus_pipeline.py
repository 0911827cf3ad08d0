"""A corpus pipeline: language, toxicity, exact and near copies, packing.

Each stage takes the documents that its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import exact_dedup, langid, packing, simhash_dedup, toxicity
from foliomill.llm.common import Scratch, in_small_batches, load, text_or_empty

#: Least score of a language that keeps a document; one that is half in one language and half in another has about half
#: of what is left by others, and stays.
SURE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, learned from these documents' own labels, is sure of.

    Null texts and texts without a letter go; without any label all do.  Texts are read whole; rows that repeat are
    judged each; a null id is never learned from; an empty table stays empty; other columns are passed on.
    """
    in_small_batches(spark)
    return langid.kept(docs, langid.Model.fit(langid.learnable(docs)), SURE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below that of toxic ones.

    Null and empty texts stay.  Texts are read whole; rows that repeat are judged each; without usable labels all stay
    or, if all labels are toxic, go; an empty table stays empty; other columns are passed on.
    """
    return toxicity.kept(docs, *toxicity.fit(docs, load(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id.

    Null counts as empty; a null id loses to any other; of rows that repeat id and text one stays; an empty table stays
    empty; other columns are passed on.
    """
    kept = exact_dedup.exact_copies(docs).where("kept").select("doc_id", "text_sha256")
    return exact_dedup.keep_rows(docs, kept, F.sha2(text_or_empty(), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8 or more) the row with the smallest doc_id.

    A null doc_id loses to any other; of rows that repeat a doc_id the one with the least digest stays.  Null and empty
    texts are alike; texts are read whole; an empty table stays empty; other columns are passed on.
    """
    found = simhash_dedup.similar_rows(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first"))
    return exact_dedup.keep_rows(docs, first.select("first.id", "first.digest"), simhash_dedup.digest())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; nulls count as empty texts, repeated rows and null ids are packed each."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxic), ("exact copies", exact), ("near copies", near), ("packing", pack)]

#: No stage's decisions but those of the exact copies can be put in SQL; tests hold language, exact and near copies and
#: packing to plain versions of them, and toxicity to labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Each stage's documents are written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"), "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
