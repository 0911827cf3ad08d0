"""Word frequencies of the corpus, and what is decided with them: unknown and runtime terms, language, split words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import load

#: Words per thousand million that a zipf of 9 stands for; the zipf at which a word is fully known.
SCALE, FULL = 1e9, 6.0
#: Common words that vote for a language (this engine's own lists).
MARKERS = {
    "de": ("der", "die", "und", "das", "ist", "ein", "nicht", "mit"),
    "en": ("the", "and", "of", "is", "to", "in", "that", "with"),
    "es": ("el", "los", "del", "que", "por", "una", "con", "para"),
    "fr": ("le", "les", "des", "est", "dans", "une", "pour", "qui"),
}
#: Votes by which a language must lead.
LEAD = 2
#: Uses at which a runtime term is accepted: often; in headings; as an acronym; in mixed case.
OFTEN, IN_HEADINGS, AS_ACRONYM, MIXED = 12, 2, 3, 2


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, token): every word of letters, as written."""
    return docs.select("doc_id", "lang", F.explode(T.letters_only(F.coalesce("text", F.lit("")))).alias("token"))


def frequencies(docs: DataFrame) -> DataFrame:
    """(lang, token, n): lower-case words; partial counts are made before anything moves."""
    return tokens(docs).groupBy("lang", F.lower("token").alias("token")).agg(F.count("*").alias("n"))


def with_zipf(freq: DataFrame) -> DataFrame:
    total = freq.groupBy("lang").agg(F.sum("n").alias("total"))
    return freq.join(F.broadcast(total), "lang").withColumn("zipf", F.log10(F.col("n") / F.col("total") * F.lit(SCALE)))


def known_score(zipf: Column) -> Column:
    """0 to 1: how well known a word is."""
    return F.least(F.lit(1.0), F.coalesce(zipf, F.lit(0.0)) / FULL)


def q09_corpus_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least five uses with their zipf and score."""
    return with_zipf(frequencies(load(spark, sf_dir, "documents"))).where("n >= 5").select("lang", "token", "n", F.round("zipf", 6).alias("zipf"), F.round(known_score(F.col("zipf")), 6).alias("score"))


def q10_unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most used words that the lexicon hardly knows: over four letters, not all capitals, rare per document."""
    docs = load(spark, sf_dir, "documents")
    words = tokens(docs).where((F.length("token") > 4) & (F.col("token") != F.upper("token"))).groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return words.where("n_docs <= 3").orderBy(F.desc("n"), "token").limit(100).select("token", "n", "n_docs")


def q11_runtime_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that the corpus itself vouches for: body words and, once more, words of page headings, by four thresholds."""
    body = tokens(load(spark, sf_dir, "documents")).select("token", F.lit(0).alias("heading"))
    h1 = F.regexp_extract("html", r"<h1>([^<]*)", 1)
    heads = load(spark, sf_dir, "pages").select(F.explode(T.letters_only(h1)).alias("token"), F.lit(1).alias("heading"))
    lower = F.lower("token")
    rows = body.unionByName(heads).where(F.length("token") >= 3)
    found = rows.groupBy(lower.alias("term")).agg(
        F.count("*").alias("n"), F.sum("heading").alias("n_headings"),
        F.count_if((F.col("token") == F.upper("token")) & (F.length("token") <= 6)).alias("n_acronyms"),
        F.count_if(F.col("token").rlike(r"^\p{Lu}\p{Ll}")).alias("n_capitalised"),
    )
    return found.where(((F.col("n") >= OFTEN) & (F.col("n_headings") >= 1)) | (F.col("n_headings") >= IN_HEADINGS) | (F.col("n_acronyms") >= AS_ACRONYM) | ((F.col("n_capitalised") >= MIXED) & (F.col("n") >= 2 * OFTEN)))


def votes(low: Column) -> list[Column]:
    """Of a column of words in lower case, which is better a table's own: each vote reads it anew."""
    def among(words):
        return lambda w: w.isin(*words)

    return [F.size(F.filter(low, among(m))).alias(lang) for lang, m in MARKERS.items()]


def lower_words(text: Column) -> Column:
    return F.transform(T.letters_only(F.coalesce(text, F.lit(""))), F.lower)


def q12_language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by marker words; mixed unless one leads by two; how often that agrees with the column."""
    v = load(spark, sf_dir, "documents").select("doc_id", "lang", lower_words(F.col("text")).alias("w")).select("doc_id", "lang", *votes(F.col("w")))
    ranked = F.sort_array(F.array(*(F.struct(F.col(x).alias("n"), F.lit(x).alias("l")) for x in MARKERS)), asc=False)
    voted = v.select("doc_id", "lang", ranked.alias("r")).select("lang", F.when(F.col("r")[0]["n"] >= F.col("r")[1]["n"] + LEAD, F.col("r")[0]["l"]).otherwise("mixed").alias("voted"))
    return voted.groupBy("lang", "voted").agg(F.count("*").alias("n_docs"))


#: Cuts up to which `ranked` tells them apart; steps of a double's last places, which sums of the same value differ by.
CUTS, PLACES = 1 << 24, 1 << 12


def ranked(points: Column, cut: Column) -> Column:
    """A long in the order of points, the leftmost cut of equal ones first: millionths, what the double is off them, and
    the cut.  Unlike a struct's, its maximum needs no sort."""
    millionths = F.round(points * 1e6).cast("long")
    off = ((points - millionths / F.lit(1e6)) * F.lit(2.0**56)).cast("long") + PLACES // 2
    return (millionths * PLACES + off) * CUTS + (CUTS - 1 - cut)


def q13_glued_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbouring long words of every line glued and split again where both halves are best known.

    Cut points are exploded and looked up in the lexicon, which every task has, on either half; only pairs of known
    halves move, once.  The best has the greatest sum of zipfs, the leftmost first.  The vocabulary is the words that a
    language has ten times; halves have four letters and more.
    """
    docs = load(spark, sf_dir, "documents").where("text is not null")
    lexicon = with_zipf(frequencies(docs)).where("n >= 10").groupBy("token").agg(F.round(F.max("zipf"), 6).alias("zipf"))
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    long_ = lines.select(F.filter(F.transform(T.letters_only(F.col("line")), F.lower), lambda w: F.length(w) >= 4).alias("w"))
    glued = long_.select(F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat(a, b))).alias("glued")).where("glued IS NOT NULL")
    cuts = glued.select("glued", F.explode(F.sequence(F.lit(4), F.greatest(F.length("glued") - 4, F.lit(4)))).alias("cut"))
    halves = cuts.select("glued", "cut", F.left("glued", F.col("cut")).alias("l"), F.expr("substr(glued, cut + 1)").alias("r"))
    left, right = F.broadcast(lexicon.toDF("l", "zl")), F.broadcast(lexicon.toDF("r", "zr"))
    scored = halves.join(left, "l").join(right, "r").select("glued", ranked(F.col("zl") + F.col("zr"), F.col("cut")).alias("rank"))
    return scored.groupBy("glued").agg(F.max("rank").alias("rank")).select("glued", (CUTS - 1 - F.pmod("rank", F.lit(CUTS))).cast("int").alias("cut"))


QUERIES = {q.__name__: q for q in (q09_corpus_lexicon, q10_unknown_terms, q11_runtime_terms, q12_language_vote, q13_glued_words)}

_TOKENS = r"WITH tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(coalesce(text, ''), '\p{L}+')) AS token FROM documents)"
_VOTE = ", ".join(f"len(list_filter(w, lambda x: x IN {m})) AS {lang}" for lang, m in MARKERS.items())
SQL = {
    "q09_corpus_lexicon": _TOKENS + """, f AS (SELECT lang, lower(token) AS token, count(*) AS n FROM tok GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM f GROUP BY lang)
SELECT lang, token, n, round(log10(n / total::double * 1e9), 6) AS zipf, round(least(1.0, log10(n / total::double * 1e9) / 6.0), 6) AS score FROM f JOIN t USING (lang) WHERE n >= 5""",
    "q10_unknown_terms": _TOKENS + """ SELECT lower(token) AS token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok WHERE length(token) > 4 AND token <> upper(token)
GROUP BY lower(token) HAVING count(DISTINCT doc_id) <= 3 ORDER BY n DESC, lower(token) LIMIT 100""",
    "q11_runtime_terms": _TOKENS + r""", r AS (SELECT token, 0 AS heading FROM tok UNION ALL SELECT unnest(regexp_extract_all(regexp_extract(html, '<h1>([^<]*)', 1), '\p{L}+')), 1 FROM pages)
SELECT lower(token) AS term, count(*) AS n, sum(heading)::bigint AS n_headings, count(*) FILTER (token = upper(token) AND length(token) <= 6) AS n_acronyms, count(*) FILTER (regexp_matches(token, '^\p{Lu}\p{Ll}')) AS n_capitalised
FROM r WHERE length(token) >= 3 GROUP BY lower(token)
HAVING (n >= 12 AND n_headings >= 1) OR n_headings >= 2 OR n_acronyms >= 3 OR (n_capitalised >= 2 AND n >= 24)""",
    "q12_language_vote": r"WITH d AS (SELECT lang, list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}+'), lambda x: lower(x)) AS w FROM documents), v AS (SELECT lang, " + _VOTE.replace(" AS ", " AS v_") + r""" FROM d),
s AS (SELECT lang, list_sort([{'n': v_de, 'l': 'de'}, {'n': v_en, 'l': 'en'}, {'n': v_es, 'l': 'es'}, {'n': v_fr, 'l': 'fr'}], 'DESC') AS r FROM v)
SELECT lang, CASE WHEN r[1].n >= r[2].n + 2 THEN r[1].l ELSE 'mixed' END AS voted, count(*) AS n_docs FROM s GROUP BY ALL""",
    "q13_glued_words": r"""WITH d AS (SELECT lang, text FROM documents WHERE text IS NOT NULL), tok AS (SELECT lang, lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS token FROM d),
f AS (SELECT lang, token, count(*) AS n FROM tok GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM f GROUP BY lang),
lex AS (SELECT token, max(round(log10(n / total::double * 1e9), 6)) AS zipf FROM f JOIN t USING (lang) WHERE n >= 10 AND length(token) >= 4 GROUP BY token),
i AS (SELECT unnest(string_split(text, chr(10))) AS line FROM d),
g AS (SELECT DISTINCT unnest(list_transform(range(1, len(l)), lambda k: l[k] || l[k + 1])) AS glued FROM (SELECT list_filter(list_transform(regexp_extract_all(line, '\p{L}+'), lambda x: lower(x)), lambda x: length(x) >= 4) AS l FROM i)),
c AS (SELECT glued, unnest(range(4, length(glued) - 3)) AS cut FROM g),
s AS (SELECT glued, cut, a.zipf + b.zipf AS points FROM c JOIN lex a ON a.token = left(glued, cut) JOIN lex b ON b.token = substr(glued, cut + 1))
SELECT glued, cut::int AS cut FROM s QUALIFY row_number() OVER (PARTITION BY glued ORDER BY points DESC, cut) = 1""",
}
