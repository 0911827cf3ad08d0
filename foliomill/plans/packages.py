"""Packages: manifests and reading orders, page ranges, boxes on pages, attempts, snapshots, stray files.

A host's pages stand for a package, its urls for the items; what is missing or repeated is made so by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import html
from ..sources.tables import load
from .outline import entries

#: Side of the grid cells that boxes are put in; share of the larger box from which two overlap.
CELL, OVERLAP = 100, 0.5
#: Hours after which a file without a job is removed.
STRAY = 12


def manifest(pages: DataFrame) -> DataFrame:
    """(package, id, path, media)"""
    return pages.select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("package"), F.concat(F.lit("i"), F.col("page_id").cast("string")).alias("id"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"), F.when(F.col("page_id") % 6 == 0, "image/png").otherwise("application/xhtml+xml").alias("media"))


def spine(pages: DataFrame) -> DataFrame:
    """(package, pos, idref): the documents in order; every ninth reference is unknown, every tenth repeats the item
    before it."""
    m = manifest(pages).join(pages.select(F.concat(F.lit("i"), F.col("page_id").cast("string")).alias("id"), "page_id"), "id")
    shift = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string"))).otherwise(F.col("id"))
    rows = m.where("media <> 'image/png'").select("package", F.col("page_id").alias("pos"), shift.alias("idref"))
    again = m.where((F.col("page_id") % 10 == 1) & (F.col("media") != "image/png")).select("package", (F.col("page_id") + 0).alias("pos"), F.col("id").alias("idref"))
    return rows.unionByName(again)


def q60_spine_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per package: references to no item (left anti join), repeated ones, items of the manifest that none refers to."""
    pages = load(spark, sf_dir, "pages")
    m, s = manifest(pages), spine(pages)
    unknown = s.join(m, (s["package"] == m["package"]) & (s["idref"] == m["id"]), "left_anti").groupBy("package").agg(F.count("*").alias("n_unknown"))
    repeated = s.groupBy("package", "idref").agg(F.count("*").alias("n")).where("n > 1").groupBy("package").agg(F.count("*").alias("n_repeated"))
    unused = m.join(s, (s["package"] == m["package"]) & (s["idref"] == m["id"]), "left_anti").groupBy("package").agg(F.count("*").alias("n_unused"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return m.select("package").distinct().join(unknown, "package", "left").join(repeated, "package", "left").join(unused, "package", "left").select("package", z("n_unknown"), z("n_repeated"), z("n_unused"))


def q61_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: links of the navigation looked up in the list of labels, -1 if absent, and whether they only rise."""
    found = html.links(load(spark, sf_dir, "pages"))
    order = found.groupBy("label").agg(F.count("*").alias("n")).where("n >= 3").select("label", F.pmod(F.length("label") * 7, F.lit(50)).alias("at"))
    rows = found.join(order, "label", "left").select("page_id", "ord", F.coalesce("at", F.lit(-1)).alias("at"))
    w = Window.partitionBy("page_id").orderBy("ord")
    known = rows.where("at >= 0").withColumn("before", F.lag("at").over(w))
    rises = known.groupBy("page_id").agg(F.coalesce(F.bool_and(F.col("before").isNull() | (F.col("at") >= F.col("before"))), F.lit(True)).alias("rises"))
    return rows.groupBy("page_id").agg(F.count_if(F.col("at") < 0).alias("n_absent"), F.count("*").alias("n_links")).join(rises, "page_id", "left").select("page_id", "n_absent", "n_links", F.coalesce("rises", F.lit(True)).alias("rises"))


def chapters(e: DataFrame) -> DataFrame:
    """(page_id, chapter, start, stop, title): top entries and the pages up to the next; what comes before the first is
    front matter; an outline without top entries is one chapter."""
    w = Window.partitionBy("page_id").orderBy("page", "ord")
    top = e.where("level = 1").withColumn("next", F.lead("page").over(w)).withColumn("chapter", F.row_number().over(w))
    last = e.groupBy("page_id").agg(F.max("page").alias("last"))
    ranged = top.join(last, "page_id").select("page_id", "chapter", F.col("page").alias("start"), F.greatest("page", F.coalesce(F.col("next") - 1, F.col("last"))).alias("stop"), "title")
    begins = top.groupBy("page_id").agg(F.min("page").alias("first"))
    front = last.join(begins, "page_id", "left").where("first IS NULL OR first > 0").select("page_id", F.lit(0).alias("chapter"), F.lit(0).alias("start"), F.coalesce(F.col("first") - 1, F.col("last")).alias("stop"), F.when(F.col("first").isNull(), "Content").otherwise("Front Matter").alias("title"))
    return ranged.unionByName(front)


def q62_chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges written out into pages and joined to what each page holds, by key and not by range."""
    e = entries(load(spark, sf_dir, "pages")).where("ord > 0")
    per_page = e.groupBy("page_id", "page").agg(F.count("*").alias("n"))
    pages = chapters(e).select("page_id", "chapter", "title", F.explode(F.sequence("start", "stop")).alias("page"))
    return pages.join(per_page, ["page_id", "page"], "left").groupBy("page_id", "chapter", "title").agg(F.count("*").alias("n_pages"), F.sum(F.coalesce("n", F.lit(0))).alias("n_entries"))


def boxes(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(k.alias("box"), F.floor(k / 50).cast("int").alias("page"), (k * 37 % 160).cast("int").alias("x0"), (k * 91 % 170).cast("int").alias("y0"), (F.lit(20) + F.col("p_size") * 2).alias("w"), (F.lit(20) + F.col("p_size")).alias("h"))


def q63_overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of a page whose overlap is half of the larger one.  Boxes meet in the grid cells that they touch,
    so no page's boxes are all compared; a pair counts in the cell of the overlap's corner alone."""
    b = boxes(load(spark, sf_dir, "part"))
    cells = lambda at, size: F.explode(F.sequence((F.col(at) / CELL).cast("int"), ((F.col(at) + F.col(size)) / CELL).cast("int")))
    put = b.select("*", cells("x0", "w").alias("cx")).select("*", cells("y0", "h").alias("cy"))
    other = put.select("page", "cx", "cy", *(F.col(c).alias(c + "2") for c in ("box", "x0", "y0", "w", "h")))
    left, top = F.greatest("x0", "x02"), F.greatest("y0", "y02")
    across, down = F.least(F.col("x0") + F.col("w"), F.col("x02") + F.col("w2")) - left, F.least(F.col("y0") + F.col("h"), F.col("y02") + F.col("h2")) - top
    pairs = put.join(other, ["page", "cx", "cy"]).where("box < box2").where((across > 0) & (down > 0) & ((left / CELL).cast("int") == F.col("cx")) & ((top / CELL).cast("int") == F.col("cy")))
    share = across * down / F.greatest(F.col("w") * F.col("h"), F.col("w2") * F.col("h2"))
    return pairs.where(share >= OVERLAP).select("page", "box", "box2", F.round(share, 6).alias("overlap"))


def q64_best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's three attempts at a size; the best passes the better gate, and of those is the smallest."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    tries = F.explode(F.array(*(F.struct(F.lit(name).alias("attempt"), F.lit(by).alias("by")) for name, by in (("primary", 10), ("fallback", 6), ("smallest", 3)))))
    rows = docs.select("doc_id", "n", tries.alias("t")).select("doc_id", "t.attempt", (F.col("n") * F.col("t.by")).alias("bytes"))
    rank = F.when(F.col("bytes") > 20000, 0).when(F.col("bytes") > 12000, 1).otherwise(2)
    best = rows.groupBy("doc_id").agg(F.max(F.struct(rank.alias("gate"), (-F.col("bytes")).alias("b"), "attempt")).alias("m"))
    return best.groupBy(F.col("m.attempt").alias("attempt"), F.col("m.gate").alias("gate")).agg(F.count("*").alias("n_docs"), F.sum(-F.col("m.b")).alias("bytes"))


def q65_largest_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest documents of each source, as one list.  The top is cut per task before anything is gathered."""
    docs = load(spark, sf_dir, "documents").select("source", F.length(F.coalesce("text", F.lit(""))).alias("n"), "doc_id")
    w = Window.partitionBy("source").orderBy(F.desc("n"), "doc_id")
    top = docs.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    return top.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("largest"), F.sum("n").alias("n_chars"))


def q66_heading_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that look like headings: runs of two or more are demoted, three to fourteen words in two or three
    lines are merged."""
    docs = load(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", "pos", T.squeeze(F.col("raw")).alias("line")).where("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.select("doc_id", "pos", "line", T.looks_like_heading(F.col("line")).alias("h")).withColumn("run", F.sum(F.when(F.col("h"), 0).otherwise(1)).over(w)).where("h")
    runs = marked.groupBy("doc_id", "run").agg(F.count("*").alias("k"), F.sum(F.size(T.words(F.col("line")))).alias("n_words"))
    action = F.when(F.col("k") == 1, "keep").when(F.col("k").between(2, 3) & F.col("n_words").between(3, 14), "merge").otherwise("demote")
    return runs.groupBy(action.alias("action")).agg(F.count("*").alias("n_runs"), F.sum("k").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


def q67_heading_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each heading of a page to the next one of its level or above, in headings; open ones end at -1."""
    w = Window.partitionBy("page_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    h = html.headings(load(spark, sf_dir, "pages"))
    end = F.lit(None).cast("int")
    for level in range(4):
        end = F.when(F.col("level") == level, F.min(F.when(F.col("level") <= level, F.col("ord"))).over(w)).otherwise(end)
    return h.select("page_id", "ord", "level", F.coalesce(end, F.lit(-1)).alias("end"))


def q68_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of each user's events, the first and second half of its time, and what changed between them."""
    e = load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").cast("int").alias("bad"))
    mid = e.groupBy("user_id").agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b"))
    rows = e.join(mid, "user_id").withColumn("phase", F.when(F.unix_micros("ts") * 2 <= F.col("a") + F.col("b"), "before").otherwise("after"))
    s = rows.groupBy("user_id", "phase").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    b, a = (s.where(F.col("phase") == p).select("user_id", F.col("n").alias(f"n_{p}"), F.col("bad").alias(f"bad_{p}")) for p in ("before", "after"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return b.join(a, "user_id", "full_outer").select("user_id", (z("n_after") - z("n_before")).alias("n_delta"), (z("bad_after") - z("bad_before")).alias("bad_delta"), F.when(z("bad_after") > z("bad_before"), "worse").otherwise("not_worse").alias("verdict"))


def q69_stray_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of orders that no job keeps, older than twelve hours before the last: anti join, then by priority."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    kept = load(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    now = o.agg(F.max("o_orderdate").alias("now"))
    old = o.join(F.broadcast(now), F.lit(True)).where(F.col("o_orderdate") < F.col("now") - F.expr(f"INTERVAL {STRAY} HOURS"))
    return old.join(kept, "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n_files"), F.min("o_orderkey").alias("first_file"))


def q70_case_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in which any wanted token occurs, in language, source or text, and where."""
    tokens = ("es", "src3", "licen")
    hay = {"lang": F.lower(F.coalesce("lang", F.lit(""))), "source": F.lower(F.coalesce("source", F.lit(""))), "text": F.lower(F.coalesce("text", F.lit("")))}
    hit = {k: sum(((F.contains(x, F.lit(t))).cast("int") for t in tokens), F.lit(0)) > 0 for k, x in hay.items()}
    rows = load(spark, sf_dir, "documents").select("doc_id", *(v.alias(k) for k, v in hit.items())).where("lang OR source OR text")
    return rows.groupBy("lang", "source", "text").agg(F.count("*").alias("n_cases"), F.min("doc_id").alias("first_doc"))


def q71_event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the events' JSON, how often each occurs and of how many kinds its values are."""
    props = load(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"), "props")
    value = F.expr("get_json_object(props, concat('$.', key))")
    return props.select("key", value.alias("v")).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_values"))


QUERIES = {q.__name__: q for q in (q60_spine_check, q61_reading_order, q62_chapter_pages, q63_overlapping_boxes, q64_best_attempts, q65_largest_assets, q66_heading_clusters, q67_heading_scopes, q68_snapshots, q69_stray_files, q70_case_filters, q71_event_properties)}

_L = r"""WITH l AS (SELECT page_id, (generate_subscripts(r, 1) - 1)::int AS ord, trim(regexp_extract(unnest(r), '>(.*)$', 1)) AS label FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a href="[^"]*">[^<]*') AS r FROM pages))
"""
SQL = {
    "q60_spine_check": r"""WITH m AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS package, 'i' || page_id AS id, page_id, CASE WHEN page_id % 6 = 0 THEN 'image/png' ELSE 'x' END AS media FROM pages),
s AS (SELECT package, CASE WHEN page_id % 9 = 0 THEN 'x' || page_id ELSE id END AS idref FROM m WHERE media = 'x' UNION ALL SELECT package, id FROM m WHERE page_id % 10 = 1 AND media = 'x'),
u AS (SELECT package, count(*) AS n FROM s WHERE (package, idref) NOT IN (SELECT package, id FROM m) GROUP BY package),
r AS (SELECT package, count(*) AS n FROM (SELECT package, idref FROM s GROUP BY ALL HAVING count(*) > 1) GROUP BY package),
x AS (SELECT package, count(*) AS n FROM m WHERE (package, id) NOT IN (SELECT package, idref FROM s) GROUP BY package)
SELECT p.package, coalesce(u.n, 0) AS n_unknown, coalesce(r.n, 0) AS n_repeated, coalesce(x.n, 0) AS n_unused FROM (SELECT DISTINCT package FROM m) p LEFT JOIN u USING (package) LEFT JOIN r USING (package) LEFT JOIN x USING (package)""",
    "q61_reading_order": _L + """, o AS (SELECT label, (length(label) * 7) % 50 AS p FROM l GROUP BY label HAVING count(*) >= 3), r AS (SELECT page_id, ord, coalesce(p, -1) AS p FROM l LEFT JOIN o USING (label)),
k AS (SELECT *, lag(p) OVER (PARTITION BY page_id ORDER BY ord) AS before FROM r WHERE p >= 0), b AS (SELECT page_id, bool_and(before IS NULL OR p >= before) AS rises FROM k GROUP BY page_id)
SELECT page_id, count(*) FILTER (p < 0) AS n_absent, count(*) AS n_links, coalesce(any_value(rises), true) AS rises FROM r LEFT JOIN b USING (page_id) GROUP BY page_id""",
    "q62_chapter_pages": _L + """, e AS (SELECT page_id, ord, CASE WHEN ord % 3 = 0 THEN 1 ELSE 2 END AS level, label AS title, (ord // 2)::int AS page FROM l WHERE label <> '' AND ord > 0),
t AS (SELECT *, lead(page) OVER w AS next, row_number() OVER w AS chapter FROM e WHERE level = 1 WINDOW w AS (PARTITION BY page_id ORDER BY page, ord)), z AS (SELECT page_id, max(page) AS last FROM e GROUP BY page_id),
c AS (SELECT page_id, chapter, page AS start, greatest(page, coalesce(next - 1, last)) AS stop, title FROM t JOIN z USING (page_id)
 UNION ALL SELECT page_id, 0, 0, coalesce(first - 1, last), CASE WHEN first IS NULL THEN 'Content' ELSE 'Front Matter' END FROM z LEFT JOIN (SELECT page_id, min(page) AS first FROM t GROUP BY page_id) USING (page_id) WHERE first IS NULL OR first > 0),
p AS (SELECT page_id, chapter, title, unnest(range(start, stop + 1)) AS page FROM c), n AS (SELECT page_id, page, count(*) AS n FROM e GROUP BY ALL)
SELECT page_id, chapter, title, count(*) AS n_pages, sum(coalesce(n, 0))::bigint AS n_entries FROM p LEFT JOIN n USING (page_id, page) GROUP BY ALL""",
    "q63_overlapping_boxes": """WITH b AS (SELECT p_partkey AS box, (p_partkey // 50)::int AS page, p_partkey * 37 % 160 AS x0, p_partkey * 91 % 170 AS y0, 20 + p_size * 2 AS w, 20 + p_size AS h FROM part),
o AS (SELECT a.page, a.box, c.box AS box2, least(a.x0 + a.w, c.x0 + c.w) - greatest(a.x0, c.x0) AS dx, least(a.y0 + a.h, c.y0 + c.h) - greatest(a.y0, c.y0) AS dy, greatest(a.w * a.h, c.w * c.h) AS most FROM b a JOIN b c ON a.page = c.page AND a.box < c.box)
SELECT page, box, box2, round(dx * dy / most::double, 6) AS overlap FROM o WHERE dx > 0 AND dy > 0 AND dx * dy / most::double >= 0.5""",
    "q64_best_attempts": """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), r AS (SELECT doc_id, attempt, n * k AS bytes FROM d, (VALUES ('primary', 10), ('fallback', 6), ('smallest', 3)) t(attempt, k)),
g AS (SELECT *, CASE WHEN bytes > 20000 THEN 0 WHEN bytes > 12000 THEN 1 ELSE 2 END AS gate FROM r), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY gate DESC, bytes, attempt DESC) = 1)
SELECT attempt, gate, count(*) AS n_docs, sum(bytes)::bigint AS bytes FROM b GROUP BY ALL""",
    "q65_largest_assets": """WITH t AS (SELECT source, doc_id, length(coalesce(text, '')) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) <= 5)
SELECT source, string_agg(doc_id::varchar, ',' ORDER BY n DESC, doc_id) AS largest, sum(n)::bigint AS n_chars FROM t GROUP BY source""",
    "q66_heading_clusters": r"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, trim(regexp_replace(unnest(p), '[ \t\r\n]+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
w AS (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l WHERE line <> ''),
h AS (SELECT *, length(line) <= 90 AND len(ws) <= 12 AND NOT regexp_matches(line, '[.!?;:,]$') AND coalesce(len(list_filter(ws, lambda x: regexp_matches(x, '^\p{Lu}'))) / nullif(len(ws), 0)::double, 0) >= 0.55 AS h FROM w),
r AS (SELECT *, sum(CASE WHEN h THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM h), g AS (SELECT doc_id, run, count(*) AS k, sum(len(ws)) AS n FROM r WHERE h GROUP BY ALL)
SELECT CASE WHEN k = 1 THEN 'keep' WHEN k BETWEEN 2 AND 3 AND n BETWEEN 3 AND 14 THEN 'merge' ELSE 'demote' END AS action, count(*) AS n_runs, sum(k)::bigint AS n_lines, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY 1""",
    "q67_heading_scopes": r"""WITH h AS (SELECT page_id, (generate_subscripts(r, 1) - 1)::int AS ord, unnest(r) AS raw FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<(?:title|h[1-3])>[^<]*') AS r FROM pages)),
k AS (SELECT page_id, ord, CASE WHEN starts_with(raw, '<title') THEN 0 ELSE try_cast(substr(raw, 3, 1) AS int) END AS level FROM h)
SELECT page_id, ord, level, coalesce((SELECT min(b.ord) FROM k b WHERE b.page_id = k.page_id AND b.ord > k.ord AND b.level <= k.level), -1) AS "end" FROM k""",
    "q68_snapshots": """WITH m AS (SELECT user_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY user_id),
s AS (SELECT user_id, epoch_us(ts) * 2 <= a + b AS early, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events JOIN m USING (user_id) GROUP BY ALL),
d AS (SELECT user_id, (sum(CASE WHEN early THEN -n ELSE n END))::bigint AS n_delta, (sum(CASE WHEN early THEN -bad ELSE bad END))::bigint AS bad_delta FROM s GROUP BY user_id)
SELECT *, CASE WHEN bad_delta > 0 THEN 'worse' ELSE 'not_worse' END AS verdict FROM d""",
    "q69_stray_files": """SELECT o_orderpriority, count(*) AS n_files, min(o_orderkey) AS first_file FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 12 HOURS
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) GROUP BY o_orderpriority""",
    "q70_case_filters": """WITH h AS (SELECT doc_id, lower(coalesce(lang, '')) AS l, lower(coalesce(source, '')) AS s, lower(coalesce(text, '')) AS t FROM documents),
f AS (SELECT doc_id, contains(l, 'es') OR contains(l, 'src3') OR contains(l, 'licen') AS lang, contains(s, 'es') OR contains(s, 'src3') OR contains(s, 'licen') AS source, contains(t, 'es') OR contains(t, 'src3') OR contains(t, 'licen') AS text FROM h)
SELECT lang, source, text, count(*) AS n_cases, min(doc_id) AS first_doc FROM f WHERE lang OR source OR text GROUP BY ALL""",
    "q71_event_properties": "WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events) SELECT key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || key)) AS n_values FROM k GROUP BY key",
}
