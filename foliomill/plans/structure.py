"""Structure of texts: lines, paragraphs, copies, packing of sentences, turns, and what documents look like on average."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import load

#: Lines shorter than this end a paragraph; most characters of a packed chunk and least of a text that is packed.
SHORT, CHUNK, LONG = 60, 190, 320


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): lines with text, in order."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", "pos", T.trim_space(F.col("raw")).alias("line")).where("line <> ''")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, island, n_lines, n_chars): a line belongs to the one before unless that was short or ended a sentence."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.lag("line").over(w)
    begins = F.when(before.isNull() | (F.length(before) < SHORT) | before.rlike(r"[.!?:]$"), 1).otherwise(0)
    marked = lines(docs).withColumn("begins", begins).withColumn("island", F.sum("begins").over(w))
    return marked.groupBy("doc_id", "island").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def q02_paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(load(spark, sf_dir, "documents"))
    return p.groupBy("n_lines").agg(F.count("*").alias("n_paragraphs"), F.countDistinct("doc_id").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def q03_copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts have the same key: letters and digits in lower case."""
    keyed = load(spark, sf_dir, "documents").select("doc_id", F.md5(T.match_key(F.coalesce("text", F.lit("")))).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("n_docs > 1")


def q37_document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and source: documents, median and mean size, farthest from the median, share of many lines."""
    docs = load(spark, sf_dir, "documents").select("lang", "source", "n_chars", F.when(F.col("text").contains("\n"), 1.0).otherwise(0.0).alias("many"))
    mid = docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.median("n_chars").alias("median_chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.avg("many"), 6).alias("many_lines"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    return mid.select("lang", "source", "n_docs", "median_chars", "mean_chars", "many_lines", F.greatest(F.col("hi") - F.col("median_chars"), F.col("median_chars") - F.col("lo")).alias("farthest"))


def q38_turn_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one role: how many runs of each length, and characters in them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = load(spark, sf_dir, "conversations").withColumn("new", F.when(F.col("role").eqNullSafe(F.lag("role").over(w)), 0).otherwise(1))
    runs = turns.withColumn("run", F.sum("new").over(w)).groupBy("conv_id", "run", "role").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))
    return runs.groupBy("role", "n_turns").agg(F.count("*").alias("n_runs"), F.sum("n_chars").alias("n_chars"))


def q42_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts of four sentences or more packed greedily into chunks of at most 190 characters, in order.

    A fold over the sentences' lengths inside the row: each joins the last chunk if it fits and opens a new one
    otherwise.
    """
    docs = load(spark, sf_dir, "documents").where(F.length("text") >= LONG)
    parts = F.filter(F.split(T.squeeze(F.col("text")), r"(?<=[.!?]) "), lambda s: s != "")
    rows = docs.select("doc_id", F.transform(parts, F.length).alias("sizes")).where(F.size("sizes") >= 4)
    state = lambda n, last, longest: F.struct(n.cast("int").alias("n"), last.cast("int").alias("last"), longest.cast("int").alias("longest"))

    def place(at, size):
        joined = at["last"] + 1 + size
        fits = (at["n"] > 0) & (joined <= CHUNK)
        last = F.when(fits, joined).otherwise(size)
        return state(F.when(fits, at["n"]).otherwise(at["n"] + 1), last, F.greatest(at["longest"], last))

    packed = rows.select("doc_id", F.size("sizes").alias("n_sentences"), F.aggregate("sizes", state(F.lit(0), F.lit(0), F.lit(0)), place).alias("at"))
    return packed.select("doc_id", "n_sentences", F.col("at.n").alias("n_chunks"), F.col("at.longest").alias("longest"))


def q45_contained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that documents hold word for word.

    Runs of eight words meet in an equi-join, so that no passage is compared with every document; a passage counts as
    held if all its runs are.  The passages' side is aggregated first and hashed to 64 bits, the documents' side keeps
    only runs that occur in a passage.
    """
    run = 8

    def runs(df: DataFrame, key: str) -> DataFrame:
        w = T.words(F.lower(F.coalesce("text", F.lit(""))))
        rows = df.select(key, w.alias("w")).where(F.size("w") >= run)
        at = F.explode(F.sequence(F.lit(1), F.size("w") - (run - 1)))
        return rows.select(key, "w", at.alias("k")).select(key, F.xxhash64(F.array_join(F.slice("w", F.col("k"), F.lit(run)), " ")).alias("run"))

    items = runs(load(spark, sf_dir, "benchmark"), "item_id").distinct()
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n_runs"))
    hits = runs(load(spark, sf_dir, "documents"), "doc_id").join(items, "run").select("doc_id", "item_id", "run").distinct()
    return hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n")).join(sizes, "item_id").where("n = n_runs").select("doc_id", "item_id", "n_runs")


QUERIES = {q.__name__: q for q in (q02_paragraph_islands, q03_copy_groups, q37_document_stats, q38_turn_islands, q42_sentence_chunks, q45_contained_passages)}
SQL = {
    "q42_sentence_chunks": rf"""WITH p AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''), lambda s: {{'n': 1, 'last': length(s), 'longest': length(s)}}) AS s FROM documents WHERE length(text) >= {LONG}),
f AS (SELECT doc_id, len(s)::int AS n_sentences, list_reduce(s, lambda a, b: CASE WHEN a.last + 1 + b.last <= {CHUNK} THEN {{'n': a.n, 'last': a.last + 1 + b.last, 'longest': greatest(a.longest, a.last + 1 + b.last)}} ELSE {{'n': a.n + 1, 'last': b.last, 'longest': greatest(a.longest, b.last)}} END) AS k FROM p WHERE len(s) >= 4)
SELECT doc_id, n_sentences, k.n AS n_chunks, k.longest::int AS longest FROM f""",
    "q02_paragraph_islands": r"""
WITH l AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos, trim(unnest(parts), ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l WHERE line <> ''),
i AS (SELECT doc_id, line, sum(CASE WHEN before IS NULL OR length(before) < 60 OR regexp_matches(before, '[.!?:]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM k),
p AS (SELECT doc_id, island, count(*) AS n_lines, sum(length(line)) AS n_chars FROM i GROUP BY ALL)
SELECT n_lines, count(*) AS n_paragraphs, count(DISTINCT doc_id) AS n_docs, sum(n_chars)::bigint AS n_chars FROM p GROUP BY n_lines""",
    "q03_copy_groups": r"""
WITH k AS (SELECT doc_id, md5(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', '', 'g')) AS key FROM documents)
SELECT key, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM k GROUP BY key HAVING count(*) > 1""",
    "q37_document_stats": """
SELECT lang, source, count(*) AS n_docs, median(n_chars) AS median_chars, round(avg(n_chars), 4) AS mean_chars, round(avg(CASE WHEN contains(text, chr(10)) THEN 1.0 ELSE 0.0 END), 6) AS many_lines,
  greatest(max(n_chars) - median(n_chars), median(n_chars) - min(n_chars)) AS farthest FROM documents GROUP BY lang, source""",
    "q38_turn_islands": """
WITH t AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, role, text, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t),
g AS (SELECT conv_id, run, role, count(*) AS n_turns, sum(length(text)) AS n_chars FROM r GROUP BY ALL)
SELECT role, n_turns, count(*) AS n_runs, sum(n_chars)::bigint AS n_chars FROM g GROUP BY role, n_turns""",
    "q45_contained_passages": r"""
WITH w AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\r\n]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
r AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 7], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS k FROM w WHERE len(w) >= 8)),
d AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\r\n]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
h AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 7], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
s AS (SELECT item_id, count(*) AS n_runs FROM r GROUP BY item_id)
SELECT doc_id, item_id, n_runs FROM (SELECT doc_id, item_id, count(*) AS n FROM h JOIN r USING (run) GROUP BY ALL) JOIN s USING (item_id) WHERE n = n_runs""",
}
