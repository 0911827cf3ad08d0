"""Language identification: known words first, then shorter and shorter character n-grams.

A word that the model knows is scored by its log frequency in each language.  An unseen word is scored by its longest
character n-grams that the model knows: those of order 5, or else 4, down to single characters.  A text's scores are
the sums over its words and a prior.  The model is fitted on a bounded sample of labelled rows and holds of each language
its most frequent words and n-grams.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, fold, in_small_batches, load

#: Labelled rows of each language that the model is fitted on; words, and n-grams of each order, that it holds of each
#: language, the most frequent ones.
SAMPLE_PER_LANGUAGE, MAX_WORDS, MAX_GRAMS = 4_000, 20_000, 8_000
ORDER, ADDED = 5, 0.5
#: Words' worth of evidence that a score, not a prediction, is sure by at most: words of a text depend on one another.
EVIDENCE = 30.0
#: Chunks of text that a worker remembers.
REMEMBERED = 300_000
UNDETERMINED = "und"
#: Signs that words carry at their ends.
EDGES = ".,;:!?\"'()[]*%#$&"
LETTERS = regex.compile(r"\p{L}+")


def grams(word: str, order: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)] if order > 1 else list(word)


def _counted(batches):
    """(lang, kind, item, n): words (kind 0) and n-grams (kind: order) of the sample, summed per block of rows."""
    chunks: dict[str, Counter] = {}

    def flush():
        for lang, found in chunks.items():
            words, by_kind = Counter(), [Counter() for _ in range(ORDER + 1)]
            for chunk, n in found.items():
                for w in LETTERS.findall(chunk):
                    words[w] += n
            for w, n in words.items():
                by_kind[0][w] += n
                for k in range(1, ORDER + 1):
                    for g in grams(w, k):
                        by_kind[k][g] += n
            for kind, counts in enumerate(by_kind):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "kind": pa.array([kind] * len(counts), pa.int32()), "item": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        chunks.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            chunks.setdefault(lang, Counter()).update((text or "").lower().split())
        if sum(map(len, chunks.values())) > REMEMBERED:
            yield from flush()
    yield from flush()


class Model:
    """Languages, their priors, and log frequencies per word and n-gram."""

    def __init__(self, languages: list[str], prior: np.ndarray, rows: dict[str, int], table: np.ndarray):
        self.languages, self.prior, self.rows, self.table = languages, prior, rows, table

    @classmethod
    def fit(cls, rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", bound: int = SAMPLE_PER_LANGUAGE) -> Model:
        rows = rows.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        sample, rates = bounded_sample(rows.where("text is not null"), "lang", bound, "id")
        languages = sorted(rates)
        if not languages:
            return cls([], np.empty(0), {}, np.empty((0, 0)))
        counts = sample.select("lang", "text").mapInArrow(_counted, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
        counts = Scratch(sample.sparkSession, "langid").keep(counts, "counts")
        totals = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")))
        known = ranked.where(F.col("rank") <= F.when(F.col("kind") == 0, MAX_WORDS).otherwise(MAX_GRAMS)).select("kind", "item").distinct()
        per_language = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{k}") for k, lang in enumerate(languages)]
        keys, logs = [], []
        for kind in range(ORDER + 1):
            rows = counts.where(F.col("kind") == kind).join(known, ["kind", "item"], "left_semi").groupBy("item").agg(*per_language).toArrow()
            most = rows.num_rows
            keys += [f"{kind}{item}" for item in rows["item"].to_pylist()]
            size = np.array([totals.get((lang, kind), 0) + ADDED * most for lang in languages])
            n = np.array([rows[f"n{k}"].to_numpy() for k in range(len(languages))], float).T
            logs.append(np.log((n + ADDED) / size))
        n_docs = np.array([rates[lang][1] for lang in languages], float)
        prior = np.log(n_docs / n_docs.sum())
        return cls(languages, prior, {k: i for i, k in enumerate(keys)}, np.concatenate(logs))

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word, or the mean of those of its longest known n-grams; None if it knows neither."""
        row = self.rows.get("0" + word)
        if row is not None:
            return self.table[row]
        for k in range(ORDER, 0, -1):
            found = [i for g in grams(word, k) if (i := self.rows.get(f"{k}{g}")) is not None]
            if found:
                return np.add.reduce(self.table[found]) / len(found)
        return None


class Scorer(dict):
    """Scores texts; as a dict it remembers the row of scores of each chunk between white space."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.scores, self.used = model, np.zeros((1024, len(model.languages) + 1)), 0

    def __missing__(self, chunk: str) -> int:
        core = chunk.strip(EDGES)
        if core != chunk and core.isalpha():
            row = self[chunk] = self[core]
            return row
        row, self.used = self.used, self.used + 1
        if row == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        total, n = 0.0, 0
        for w in LETTERS.findall(chunk):
            v = self.model.word(w)
            if v is not None:
                total, n = total + v, n + 1
        self.scores[row, :-1], self.scores[row, -1] = total, n
        self[chunk] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.model.languages or not text or not LETTERS.search(text):
            return UNDETERMINED, 0.0
        if len(self) > REMEMBERED:
            self.clear()
            self.used = 0
        chunks = text.lower().split()
        total = self.scores[0] * 0
        for i in range(0, len(chunks), 1 << 16):
            rows = list(map(self.__getitem__, chunks[i : i + (1 << 16)]))
            total = total + self.scores[rows].sum(axis=0)
        n = total[-1]
        best = int(np.argmax(total[:-1] + self.model.prior))  # of equal scores the first language in order
        logs = total[:-1] * (min(n, EVIDENCE) / n if n else 0.0) + self.model.prior
        return self.model.languages[best], float(1 / np.exp(logs - logs[best]).sum())


def _predicted(model: Model):
    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            found = [scorer.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, held_out, lang_pred, score.

    Null texts and those without a letter (category L) are `und` with score 0, and so is everything if the model saw no
    language.  Texts of any length are read whole; of equally likely languages the first in order is taken.  A null id
    isn't held out; repeated rows are returned each; an empty table gives no rows; other columns are ignored.
    """
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(fold(id_col, 4) == 2, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_predicted(model), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def _passed(model: Model, text_col: str, sure: float):
    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            found = [scorer.predict(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield b.filter(pa.array([lang != UNDETERMINED and score >= sure for lang, score in found], pa.bool_()))

    return run


def kept(docs: DataFrame, model: Model, sure: float, text_col: str = "text") -> DataFrame:
    """Rows of docs in a language that the model is sure of, all columns as they are."""
    in_small_batches(docs.sparkSession)
    return docs.mapInArrow(_passed(model, text_col, sure), docs.schema)


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that a model may learn from: not those of the fold that is held out."""
    return docs.where(fold(id_col, 4) != 2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    in_small_batches(spark)
    return identify(docs, Model.fit(learnable(docs)))
