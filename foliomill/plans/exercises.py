"""Problems and their solutions, labels and fragments that a scheme repeats, regions of pages, and requests as settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..sources.tables import load
from . import toc

#: Languages that text recognition knows, and what stands in for others, the first that is there.
AVAILABLE = ("eng", "pol", "deu")
#: Occurrences of a label from which further ones are no headings; characters of a fragment, and of what several make.
LABELS, FRAGMENT, MERGED = 2, 28, 90


def exercises(docs: DataFrame) -> DataFrame:
    """(doc_id, i, kind, number, text): blocks with problems and solutions among them: every fifth line carries the
    diagram of a problem, every seventh the entry of a solution, numbered in each document by place; a generic label
    opens a run of solutions, a heading ends it."""
    b = toc.blocks(docs)
    pos = F.floor(F.col("i") / 2)
    kind = F.when(F.col("element").startswith("h") & (F.col("text") == "Overview"), "solutions").when(F.col("element").startswith("h"), "heading").when((F.col("i") % 2 == 1) & (pos % 5 == 2), "problem").when((F.col("i") % 2 == 1) & (pos % 7 == 4), "solution").otherwise("text")
    number = F.when(kind == "problem", F.floor(pos / 5) + 1).when(kind == "solution", F.floor(pos / 7) + 1)
    text = F.when(kind == "solution", F.concat(number.cast("string"), F.lit(". Nf3 e5 13. Bb5 a6 "), F.col("text"))).otherwise(F.col("text"))
    return b.select("doc_id", "i", kind.alias("kind"), number.cast("int").alias("number"), text.alias("text"))


def q108_solution_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems with the solutions of their number in the same document, each pair once; per document those without."""
    rows = exercises(load(spark, sf_dir, "documents"))
    side = lambda kind, c: rows.where(F.col("kind") == kind).groupBy("doc_id", "number").agg(F.min("i").alias(c))
    both = side("problem", "problem").join(side("solution", "solution"), ["doc_id", "number"], "full_outer")
    return both.groupBy("doc_id").agg(F.count_if(F.col("problem").isNotNull() & F.col("solution").isNotNull()).alias("n_linked"), F.count_if(F.col("solution").isNull()).alias("n_unsolved"), F.count_if(F.col("problem").isNull()).alias("n_stray"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("problem").isNotNull() & F.col("solution").isNotNull(), F.struct("problem", "solution")))), lambda p: F.concat(p["problem"].cast("string"), F.lit("-"), p["solution"].cast("string"))), ",")).alias("links"))


def q109_solution_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts inside a run of solutions, which a label opens and any heading or problem ends, and those that are mostly
    notation, per document."""
    w = Window.partitionBy("doc_id").orderBy("i")
    rows = exercises(load(spark, sf_dir, "documents"))
    state = F.last(F.when(F.col("kind").isin("solutions", "heading", "problem"), F.col("kind")), ignorenulls=True).over(w)
    marked = rows.withColumn("inside", F.coalesce(state == "solutions", F.lit(False))).where(F.col("kind").isin("text", "solution"))
    heavy = R.notation_heavy.of(F.col("text"))
    return marked.groupBy("doc_id").agg(F.count_if("inside").alias("n_inside"), F.count_if(F.col("inside") & heavy).alias("n_inside_heavy"), F.count_if(~F.col("inside") & heavy).alias("n_heavy"), F.count("*").alias("n"))


def q110_repeated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic labels that a document repeats, headings no more from the third on; and the short blocks behind its first
    heading, up to four, that make one heading together where two or more do."""
    b = toc.blocks(load(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id").orderBy("i")
    labels = b.where(F.col("element").startswith("h") & F.lower("text").isin(*toc.GENERIC)).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", F.lower("text")).orderBy("i")))
    demoted = labels.groupBy("doc_id").agg(F.count("*").alias("n_labels"), F.count_if(F.col("k") > LABELS).alias("n_demoted"))
    seen = b.withColumn("after", F.sum(F.when(F.col("element").startswith("h"), 1).otherwise(0)).over(w)).where("after > 0").withColumn("n", F.row_number().over(w)).where("n > 1")
    fits = (F.length("text") <= FRAGMENT) & ~(~F.col("element").startswith("h") & F.col("text").rlike(r"[.!?]$")) & ~F.col("text").rlike("^[0-9]")
    stop = F.min(F.when(~fits, F.col("n"))).over(Window.partitionBy("doc_id"))
    run = seen.withColumn("stop", stop).where((F.col("n") < F.coalesce("stop", F.lit(1 << 30))) & (F.col("n") <= 5)).groupBy("doc_id").agg(F.count("*").alias("k"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))
    merged = run.where((F.col("k") >= 2) & (F.length("text") <= MERGED)).select("doc_id", F.col("k").alias("n_merged"), F.col("text").alias("merged"))
    z = lambda c, other: F.coalesce(c, F.lit(other)).alias(c)
    return b.select("doc_id").distinct().join(demoted, "doc_id", "left").join(merged, "doc_id", "left").select("doc_id", z("n_labels", 0), z("n_demoted", 0), z("n_merged", 0), z("merged", ""))


def q111_page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of pages whose boxes round to the same, the first in reading order kept; and texts set so large beside
    their page's mean that they are quotes pulled out."""
    k = F.col("p_partkey")
    rows = load(spark, sf_dir, "part").select(k.alias("region"), F.floor(k / 50).cast("int").alias("page"), F.floor((k * 37 % 400) / 40).cast("int").alias("x"), F.floor((k * 91 % 600) / 60).cast("int").alias("y"), F.col("p_size").alias("size"), F.size(T.words(F.col("p_name"))).alias("n_words"))
    first = rows.groupBy("page", "x", "y").agg(F.min("region").alias("kept"), F.count("*").alias("n"))
    body = rows.groupBy("page").agg(F.avg("size").alias("body"))
    quotes = rows.join(body, "page").where((F.col("n_words").between(2, 45)) & (F.col("size") >= F.greatest(F.col("body") + 4, F.col("body") * 1.55))).groupBy("page").agg(F.count("*").alias("n_quotes"))
    return first.groupBy("page").agg(F.count("*").alias("n_kept"), (F.sum("n") - F.count("*")).alias("n_dropped"), F.min("kept").alias("first")).join(quotes, "page", "left").select("page", "n_kept", "n_dropped", "first", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"))


def q112_request_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as settings of a run: profile, language of recognition that is there, scope of the clean-up, a size that
    is no negative number, the steps of its plan, and whether an older report is out of date."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda n, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (n % len(xs) + 1).cast("int"))
    asked, profile = pick(k, "pl", "EN ", "deu+xyz", "xyz", "", "fra+ita"), pick(k + F.col("o_custkey"), "auto", "magazine_reflow", "preserve-layout", "training")
    size = pick(k, "12", "-3", "x", "", "40.5", "007")
    low = F.lower(F.btrim(asked))
    known = F.filter(F.split(low, r"\+"), lambda p: p.isin(*AVAILABLE))
    language = F.when(low.contains("+") & (F.size(known) > 0), F.array_join(known, "+")).when(low.isin("pl", "pol"), "pol+eng").when(low.isin(*AVAILABLE), low).otherwise("eng")
    scope = F.when(profile == "training", "training-book").when(profile == "magazine_reflow", "magazine").otherwise("book")
    number = F.greatest(F.lit(0), F.coalesce(F.when(size.rlike("^-?[0-9]+$"), size.cast("int")), F.lit(0)))
    steps = F.array_compact(F.array(F.lit("validate"), F.when(profile != "preserve-layout", "text"), F.when(scope == "book", "headings"), F.when(scope == "magazine", "issue"), F.when(low.contains("+"), "ocr"), F.lit("report")))
    stale = F.coalesce(F.col("o_orderdate") < F.date_add(F.lit("1995-01-01").cast("date"), 0), F.lit(False))
    rows = o.select(profile.alias("profile"), language.alias("language"), scope.alias("scope"), number.alias("size"), F.array_join(steps, ">").alias("steps"), stale.alias("stale"), (profile == "preserve-layout").alias("fixed"))
    return rows.groupBy("profile", "language", "scope", "steps", "fixed", "stale").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


QUERIES = {q.__name__: q for q in (q108_solution_links, q109_solution_runs, q110_repeated_labels, q111_page_regions, q112_request_settings)}

_X = toc._REPAIRED + r""", v AS (SELECT *, i // 2 AS q, CASE WHEN starts_with(element, 'h') AND text = 'Overview' THEN 'solutions' WHEN starts_with(element, 'h') THEN 'heading' WHEN i % 2 = 1 AND (i // 2) % 5 = 2 THEN 'problem' WHEN i % 2 = 1 AND (i // 2) % 7 = 4 THEN 'solution' ELSE 'text' END AS kind FROM b),
e AS (SELECT doc_id, i, kind, CASE kind WHEN 'problem' THEN q // 5 + 1 WHEN 'solution' THEN q // 7 + 1 END AS number, CASE WHEN kind = 'solution' THEN (q // 7 + 1) || '. Nf3 e5 13. Bb5 a6 ' || text ELSE text END AS x FROM v)
"""
_GENERIC = ", ".join(map(R.quoted, toc.GENERIC))
_PICK = lambda n, *xs: f"[{', '.join(map(R.quoted, xs))}][({n}) % {len(xs)} + 1]"
SQL = {
    "q108_solution_links": _X + """, p AS (SELECT doc_id, number, min(i) AS problem FROM e WHERE kind = 'problem' GROUP BY ALL), o AS (SELECT doc_id, number, min(i) AS solution FROM e WHERE kind = 'solution' GROUP BY ALL)
SELECT doc_id, count(*) FILTER (problem IS NOT NULL AND solution IS NOT NULL) AS n_linked, count(*) FILTER (solution IS NULL) AS n_unsolved, count(*) FILTER (problem IS NULL) AS n_stray, md5(coalesce(string_agg(CASE WHEN problem IS NOT NULL AND solution IS NOT NULL THEN problem || '-' || solution END, ',' ORDER BY problem), '')) AS links FROM p FULL JOIN o USING (doc_id, number) GROUP BY doc_id""",
    "q109_solution_runs": _X + f""", u AS (SELECT *, last_value(CASE WHEN kind IN ('solutions', 'heading', 'problem') THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS state FROM e),
m AS (SELECT doc_id, coalesce(state = 'solutions', false) AS inside, {R.notation_heavy.sql('x')} AS heavy FROM u WHERE kind IN ('text', 'solution'))
SELECT doc_id, count(*) FILTER (inside) AS n_inside, count(*) FILTER (inside AND heavy) AS n_inside_heavy, count(*) FILTER (NOT inside AND heavy) AS n_heavy, count(*) AS n FROM m GROUP BY doc_id""".replace("m AS (SELECT doc_id, coalesce", "z AS (SELECT doc_id, coalesce").replace("FROM m GROUP", "FROM z GROUP"),
    "q110_repeated_labels": toc._REPAIRED + rf""", k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY i) AS k FROM b WHERE starts_with(element, 'h') AND lower(text) IN ({_GENERIC})), d AS (SELECT doc_id, count(*) AS n_labels, count(*) FILTER (k > {LABELS}) AS n_demoted FROM k GROUP BY doc_id),
u AS (SELECT *, sum(CASE WHEN starts_with(element, 'h') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u WHERE after > 0),
t AS (SELECT *, min(CASE WHEN NOT (length(text) <= {FRAGMENT} AND NOT (NOT starts_with(element, 'h') AND regexp_matches(text, '[.!?]$')) AND NOT regexp_matches(text, '^[0-9]')) THEN n END) OVER (PARTITION BY doc_id) AS stop FROM n WHERE n > 1),
j AS (SELECT doc_id, count(*) AS k, string_agg(text, ' ' ORDER BY n) AS text FROM t WHERE n < coalesce(stop, 1073741824) AND n <= 5 GROUP BY doc_id), o AS (SELECT doc_id, k AS n_merged, text AS merged FROM j WHERE k >= 2 AND length(text) <= {MERGED})
SELECT doc_id, coalesce(n_labels, 0) AS n_labels, coalesce(n_demoted, 0) AS n_demoted, coalesce(n_merged, 0) AS n_merged, coalesce(merged, '') AS merged FROM (SELECT DISTINCT doc_id FROM b) LEFT JOIN d USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "q111_page_regions": """WITH r AS (SELECT p_partkey AS region, (p_partkey // 50)::int AS page, (p_partkey * 37 % 400) // 40 AS x, (p_partkey * 91 % 600) // 60 AS y, p_size AS size, len(list_filter(string_split(trim(p_name), ' '), lambda w: w <> '')) AS n_words FROM part),
f AS (SELECT page, x, y, min(region) AS kept, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT page, avg(size) AS body FROM r GROUP BY page),
q AS (SELECT page, count(*) AS n_quotes FROM r JOIN b USING (page) WHERE n_words BETWEEN 2 AND 45 AND size >= greatest(body + 4, body * 1.55) GROUP BY page)
SELECT page, count(*) AS n_kept, (sum(n) - count(*))::bigint AS n_dropped, min(kept) AS first, coalesce(any_value(n_quotes), 0) AS n_quotes FROM f LEFT JOIN q USING (page) GROUP BY page""",
    "q112_request_settings": f"""WITH a AS (SELECT lower(trim({_PICK('o_orderkey', 'pl', 'EN ', 'deu+xyz', 'xyz', '', 'fra+ita')})) AS low, {_PICK('o_orderkey + o_custkey', 'auto', 'magazine_reflow', 'preserve-layout', 'training')} AS profile, {_PICK('o_orderkey', '12', '-3', 'x', '', '40.5', '007')} AS size, o_orderdate FROM orders),
b AS (SELECT *, list_filter(string_split(low, '+'), lambda p: p IN {AVAILABLE}) AS known, CASE profile WHEN 'training' THEN 'training-book' WHEN 'magazine_reflow' THEN 'magazine' ELSE 'book' END AS scope FROM a),
c AS (SELECT profile, CASE WHEN contains(low, '+') AND len(known) > 0 THEN array_to_string(known, '+') WHEN low IN ('pl', 'pol') THEN 'pol+eng' WHEN low IN {AVAILABLE} THEN low ELSE 'eng' END AS language, scope, greatest(0, coalesce(CASE WHEN regexp_matches(size, '^-?[0-9]+$') THEN size::int END, 0)) AS size,
 array_to_string(list_filter(['validate', CASE WHEN profile <> 'preserve-layout' THEN 'text' END, CASE WHEN scope = 'book' THEN 'headings' END, CASE WHEN scope = 'magazine' THEN 'issue' END, CASE WHEN contains(low, '+') THEN 'ocr' END, 'report'], lambda s: s IS NOT NULL), '>') AS steps, o_orderdate < DATE '1995-01-01' AS stale, profile = 'preserve-layout' AS fixed FROM b)
SELECT profile, language, scope, steps, fixed, stale, count(*) AS n, sum(size)::bigint AS size FROM c GROUP BY ALL""",
}
