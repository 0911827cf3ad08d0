"""Fragments of markup and front matter: texts outside tags normalised and linked, terms of a dictionary, authors and
subtitles, orders of files, estimates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rules as R
from ..functions import text as T
from ..sources.tables import load
from . import cleanup, normalise, outline, toc
from .lexicon import MARKERS, known_score, lower_words, votes
from .packages import manifest

LINK = r"(https?://[^ <]*[^ <.,;:)])"


@dataclass(frozen=True)
class CleanupSettings:
    """What a clean-up does: terms are words that a document uses often; texts of these kinds of places are left alone;
    scores from which a repair is made and from which it is looked at."""

    least_uses: int = 10
    least_length: int = 5
    safe: float = cleanup.SAFE
    review: float = cleanup.REVIEW
    protected: tuple[str, ...] = ("table", "code", "pre", "script", "style")


def q102_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in markup: what stands outside tags and links is normalised, links in it are marked up, and a link whose end
    ran on behind its tag is put together."""
    rows = normalise.spoiled(load(spark, sf_dir, "documents"))
    x = F.concat(F.lit("<p>"), F.replace(F.replace("x", F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")")), F.lit('</p><p>and <a href="https://a.example.com/p">https://a.example.com/p</a>/rest of it</p>'))
    parts = rows.select("doc_id", F.regexp_extract_all(x, F.lit("<[^>]*>|[^<]+"), 0).alias("s"))
    marked = lambda t: F.regexp_replace(normalise.normalize(t), LINK, '<a href="$1">$1</a>')
    in_link = lambda i: (i > 0) & F.coalesce(F.try_element_at("s", i).startswith("<a "), F.lit(False))
    done = F.array_join(F.transform("s", lambda t, i: F.when(t.startswith("<") | in_link(i), t).when(F.startswith(t, F.lit("/")), t).otherwise(marked(t))), "")
    joined = F.regexp_replace(done, r'<a href="([^"]*)">([^<]*)</a>(/[^ <]+)', '<a href="$1$3">$2$3</a>')
    return parts.select("doc_id", joined.alias("x")).select("doc_id", T.count(F.col("x"), "<a href=").alias("n_links"), F.length("x").cast("long").alias("n_chars"), F.md5("x").alias("digest"))


def q103_term_variants(spark: SparkSession, sf_dir: str, settings: CleanupSettings = CleanupSettings()) -> DataFrame:
    """Words that are a term's variant by a dictionary, its letters folded, and what is done about them: the score by how
    well the term is known, how it fits the text's language, and the place.

    The dictionary is made of the words that the corpus uses often; a variant differs in its diacritics alone.  Every
    task has the variants, so that of the words only those move.
    """
    docs = load(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = docs.select("doc_id", F.explode(F.transform(T.letters_only(F.col("text")), F.lower)).alias("word")).where(F.length("word") >= settings.least_length)
    uses = words.groupBy("word").agg(F.count("*").alias("n"))
    folded = uses.withColumn("key", T.fold_diacritics(F.col("word")))
    terms = folded.where(F.col("n") >= settings.least_uses).groupBy("key").agg(F.max(F.struct("n", "word")).alias("t")).select("key", F.col("t.word").alias("term"), F.col("t.n").alias("uses"))
    variants = folded.where(F.col("n") < settings.least_uses).join(terms, "key").where("word <> term").select("word", "term", "uses")
    v = docs.select("doc_id", cleanup.place_of(docs).alias("place"), lower_words(F.col("text")).alias("w")).select("doc_id", "place", *votes(F.col("w")))
    ranked = F.sort_array(F.array(*(F.col(m) for m in MARKERS)), asc=False)
    mixed = F.when(ranked[0] >= ranked[1] + 2, 0).otherwise(1)
    found = words.join(F.broadcast(variants), "word").groupBy("doc_id", "word", "term", "uses").agg(F.count("*").alias("n")).join(v.select("doc_id", "place", mixed.alias("mixed")), "doc_id")
    lexical = known_score(F.log10("uses") + 3)
    fit = F.when(F.col("mixed") == 1, 0.78).otherwise(F.greatest(F.lit(0.45), lexical))
    dom = F.when(F.col("place") == "heading", 0.6).otherwise(1.0)
    points = F.when(F.col("place").isin(*settings.protected), 0.0).otherwise(cleanup.LEXICAL * lexical + cleanup.CONTEXT * 0.9 + cleanup.LANGUAGE * fit + cleanup.DOM * dom + cleanup.BONUS)
    status = F.when(points >= settings.safe, "safe_auto_fix").when(points >= settings.review, "review_needed").otherwise("blocked")
    return found.select("doc_id", "word", "term", "n", F.round(points, 6).alias("score"), status.alias("status"))


def q104_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the first author's line and the first subtitle of the three paragraphs behind its first heading, its
    promotional headings, and the heading that would make the best title."""
    b = toc.blocks(load(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id").orderBy("i")
    x, heading = F.col("text"), F.col("element").startswith("h")
    seen = b.withColumn("after", F.sum(F.when(heading, 1).otherwise(0)).over(w)).withColumn("p", F.sum(F.when(~heading & (F.col("after") > 0), 1).otherwise(0)).over(w))
    near = ~heading & (F.col("after") > 0) & (F.col("p") <= 3)
    author = near & P.author_line(x)
    first = seen.groupBy("doc_id").agg(F.min(F.when(author, F.col("i"))).alias("author"), F.count_if(heading & R.promotional.of(x)).alias("n_promotional"))
    subtitle = seen.join(first, "doc_id").where(near & P.subtitle_line(x) & ~F.col("i").eqNullSafe(F.col("author"))).groupBy("doc_id").agg(F.min("i").alias("subtitle"))
    n = F.size(T.words(x))
    fine = heading & (n <= 22) & (F.length(x) >= 6) & ~R.page_number.of(x) & ~R.photo_credit.of(x) & ~R.contents_entry.of(x)
    points = (4 - F.substring("element", 2, 1).cast("int")) * 7 + F.least(n, F.lit(12)) + F.when(x.rlike(r"\p{Ll}"), 4).otherwise(0) - F.when(~x.rlike(r"\p{Ll}") & (n <= 5), 6).otherwise(0) - F.when(R.synthetic.of(x), 10).otherwise(0)
    title = b.where(fine & (points >= 12)).groupBy("doc_id").agg(F.max(F.struct(points.alias("points"), (-F.col("i")).alias("i"))).alias("t"))
    z = lambda c: F.coalesce(c, F.lit(-1)).cast("int")
    return first.join(subtitle, "doc_id", "left").join(title, "doc_id", "left").select("doc_id", z("author").alias("author"), z("subtitle").alias("subtitle"), "n_promotional", z(-F.col("t.i")).alias("title"), z("t.points").alias("points"))


def q105_spine_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's items put in order: the cover first, those that a list names as it names them, the others as they
    were, navigation last.

    The list names every second item from the last to the first; the first item of a package is its cover, the last its
    navigation.
    """
    m = manifest(load(spark, sf_dir, "pages")).select("package", F.regexp_extract("id", "([0-9]+)", 1).cast("long").alias("at"))
    ends = m.groupBy("package").agg(F.min("at").alias("cover"), F.max("at").alias("nav"), F.count("*").alias("n_items"))
    rows = m.join(ends, "package")
    kind = F.when(F.col("at") == F.col("cover"), 0).when(F.col("at") == F.col("nav"), 3).when(F.col("at") % 2 == 0, 1).otherwise(2)
    keyed = rows.select("package", "at", "n_items", kind.alias("kind"), F.when(kind == 1, -F.col("at")).otherwise(F.col("at")).alias("order"))
    before = keyed.groupBy("package", "kind").agg(F.min(F.struct("order", "at")).alias("first"), F.max(F.struct("order", "at")).alias("last"), F.count("*").alias("n"))
    return before.select("package", "kind", F.col("first.at").alias("first"), F.col("last.at").alias("last"), "n")


def q106_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that an outline lets expect, against those that a page has, and the warnings that follow.

    Four entries at the top count alone; else those of two levels, forty at most; else all.
    """
    e = outline.entries(load(spark, sf_dir, "pages"))
    n = e.groupBy("page_id").agg(F.count_if(F.col("level") == 1).alias("top"), F.count_if(F.col("level") <= 2).alias("major"), F.count("*").alias("n_entries"), F.count_if(R.weak_title.of(F.col("title"))).alias("n_weak"))
    expected = F.when(F.col("top") >= 4, F.col("top")).when(F.col("major") > 0, F.least(F.col("major"), F.lit(40))).otherwise(F.col("n_entries"))
    h = load(spark, sf_dir, "pages").select("page_id", T.count(F.coalesce("html", F.lit("")), "<p>").alias("n_sections"), T.count(F.coalesce("html", F.lit("")), "<p></p>").alias("n_empty"))
    rows = h.join(n.select("page_id", expected.alias("n_expected"), "n_weak"), "page_id", "left").select("page_id", "n_sections", F.coalesce("n_expected", F.lit(0)).alias("n_expected"), "n_empty", F.coalesce("n_weak", F.lit(0)).alias("n_weak"))
    warnings = F.array_compact(F.array(F.when((F.col("n_expected") > 0) & (F.col("n_sections") > 2 * F.col("n_expected")), "too-many-sections"), F.when(F.col("n_empty") > 0, "empty-sections"), F.when(F.col("n_weak") > 0, "weak-titles")))
    return rows.withColumn("warnings", F.array_join(warnings, ","))


def q107_feature_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an outline that no title of the contents has taken: those before the first taken one stand in front,
    extras and continuations apart, all others are additional; and how they are ordered, by page and then title.

    Every third entry is taken.
    """
    e = outline.entries(load(spark, sf_dir, "pages")).withColumn("taken", F.col("ord") % 3 == 1)
    first = e.where("taken").groupBy("page_id").agg(F.min("ord").alias("first"))
    rows = e.join(first, "page_id", "left").where("NOT taken")
    x = F.col("title")
    bucket = F.when(F.lower(x).rlike("(ciąg dalszy|continued)"), "continued").when(R.sponsored.of(x) | R.short_fragment.of(x) & (F.length(x) <= 3), "extra").when(F.col("first").isNull() | (F.col("ord") < F.col("first")), "front").otherwise("additional")
    w = Window.partitionBy("page_id", "bucket").orderBy("page", F.lower(x), "ord")
    return rows.withColumn("bucket", bucket).withColumn("place", F.row_number().over(w)).select("page_id", "ord", "bucket", "place")


QUERIES = {q.__name__: q for q in (q102_fragments, q103_term_variants, q104_front_matter, q105_spine_order, q106_estimates, q107_feature_buckets)}

_MARK = f"regexp_replace({normalise._sql_normal('t')}, '{LINK}', '<a href=\"\\1\">\\1</a>', 'g')"
_VOTES = ", ".join(f"len(list_filter(w, lambda x: x IN {m}))" for m in MARKERS.values())
_ENTRIES = outline._E
_AUTHOR, _SUBTITLE = (P.SQL_FORMS[n].replace("len(ws)", "len(ws)") for n in ("author_line", "subtitle_line"))
_POINTS = rf"((4 - substr(element, 2, 1)::int) * 7 + least(len(ws), 12) + CASE WHEN regexp_matches(x, '\p{{Ll}}') THEN 4 ELSE 0 END - CASE WHEN NOT regexp_matches(x, '\p{{Ll}}') AND len(ws) <= 5 THEN 6 ELSE 0 END - CASE WHEN {R.synthetic.sql('x')} THEN 10 ELSE 0 END)"
SQL = {
    "q102_fragments": normalise._SPOILED + rf""", p AS (SELECT doc_id, regexp_extract_all('<p>' || replace(replace(x, '<', '('), '>', ')') || '</p><p>and <a href="https://a.example.com/p">https://a.example.com/p</a>/rest of it</p>', '<[^>]*>|[^<]+') AS s FROM s),
e AS (SELECT doc_id, k, s[k] AS t, coalesce(starts_with(CASE WHEN k > 1 THEN s[k - 1] END, '<a '), false) AS inside FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM p)),
d AS (SELECT doc_id, string_agg(CASE WHEN starts_with(t, '<') OR inside OR starts_with(t, '/') THEN t ELSE {_MARK} END, '' ORDER BY k) AS d FROM e GROUP BY doc_id),
j AS (SELECT doc_id, regexp_replace(d, '<a href="([^"]*)">([^<]*)</a>(/[^ <]+)', '<a href="\1\3">\2\3</a>', 'g') AS x FROM d)
SELECT doc_id, len(regexp_extract_all(x, '<a href=')) AS n_links, length(x) AS n_chars, md5(x) AS digest FROM j""",
    "q103_term_variants": rf"""WITH d AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL), w AS (SELECT * FROM (SELECT doc_id, unnest(w) AS word FROM d) WHERE length(word) >= 5),
u AS (SELECT word, count(*) AS n, translate(word, '{T.FOLD_FROM}', '{T.FOLD_TO}') AS key FROM w GROUP BY word), t AS (SELECT key, arg_max(word, (n, word)) AS term, max(n) AS uses FROM u WHERE n >= 10 GROUP BY key),
v AS (SELECT word, term, uses FROM u JOIN t USING (key) WHERE n < 10 AND word <> term),
p AS (SELECT doc_id, CASE WHEN NOT contains(text, chr(10)) AND length(text) <= 90 THEN 'heading' WHEN NOT contains(text, chr(10)) AND length(text) > 2000 THEN 'table' ELSE 'body' END AS place, list_reverse_sort([{_VOTES}]) AS r FROM d),
f AS (SELECT doc_id, word, term, uses, count(*) AS n FROM w JOIN v USING (word) GROUP BY ALL), l AS (SELECT f.*, place, r[1] < r[2] + 2 AS mixed, least(1.0, (log10(uses) + 3) / 6.0) AS lexical FROM f JOIN p USING (doc_id)),
s AS (SELECT *, CASE WHEN place = 'table' THEN 0.0 ELSE 0.35 * lexical + 0.25 * 0.9 + 0.15 * CASE WHEN mixed THEN 0.78 ELSE greatest(0.45, lexical) END + 0.15 * CASE WHEN place = 'heading' THEN 0.6 ELSE 1.0 END + 0.1 END AS points FROM l)
SELECT doc_id, word, term, n, round(points::double, 6) AS score, CASE WHEN points >= 0.85 THEN 'safe_auto_fix' WHEN points >= 0.65 THEN 'review_needed' ELSE 'blocked' END AS status FROM s""",
    "q104_front_matter": toc._REPAIRED + rf""", y AS (SELECT doc_id, i, element, text AS x, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws, sum(CASE WHEN starts_with(element, 'h') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM b),
z AS (SELECT *, sum(CASE WHEN NOT starts_with(element, 'h') AND after > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM y),
q AS (SELECT *, NOT starts_with(element, 'h') AND after > 0 AND p <= 3 AS near FROM z),
c AS (SELECT doc_id, min(i) FILTER (near AND {_AUTHOR}) AS author, count(*) FILTER (starts_with(element, 'h') AND {R.promotional.sql('x')}) AS n_promotional FROM q GROUP BY doc_id),
t AS (SELECT q.doc_id, min(i) AS subtitle FROM q JOIN c ON q.doc_id = c.doc_id WHERE near AND {_SUBTITLE} AND i IS DISTINCT FROM author GROUP BY q.doc_id),
o AS (SELECT doc_id, i, {_POINTS} AS points FROM y WHERE starts_with(element, 'h') AND len(ws) <= 22 AND length(x) >= 6 AND NOT {R.page_number.sql('x')} AND NOT {R.photo_credit.sql('x')} AND NOT {R.contents_entry.sql('x')}),
k AS (SELECT doc_id, arg_max(i, points * 1000000 - i) AS title, max(points) AS points FROM o WHERE points >= 12 GROUP BY doc_id)
SELECT doc_id, coalesce(author, -1)::int AS author, coalesce(subtitle, -1)::int AS subtitle, n_promotional, coalesce(title, -1)::int AS title, coalesce(points, -1)::int AS points FROM c LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "q105_spine_order": r"""WITH m AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS package, page_id AS pid FROM pages), e AS (SELECT *, min(pid) OVER (PARTITION BY package) AS cover, max(pid) OVER (PARTITION BY package) AS nav FROM m),
k AS (SELECT package, pid, CASE WHEN pid = cover THEN 0 WHEN pid = nav THEN 3 WHEN pid % 2 = 0 THEN 1 ELSE 2 END AS kind FROM e)
SELECT package, kind, CASE WHEN kind = 1 THEN max(pid) ELSE min(pid) END AS first, CASE WHEN kind = 1 THEN min(pid) ELSE max(pid) END AS last, count(*) AS n FROM k GROUP BY package, kind""",
    "q106_estimates": _ENTRIES + rf""", n AS (SELECT page_id, count(*) FILTER (level = 1) AS top, count(*) FILTER (level <= 2) AS major, count(*) AS n_entries, count(*) FILTER ({R.weak_title.sql('title')}) AS n_weak FROM e GROUP BY page_id),
h AS (SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '<p>')) AS n_sections, len(regexp_extract_all(coalesce(html, ''), '<p></p>')) AS n_empty FROM pages),
r AS (SELECT page_id, n_sections, coalesce(CASE WHEN top >= 4 THEN top WHEN major > 0 THEN least(major, 40) ELSE n_entries END, 0) AS n_expected, n_empty, coalesce(n_weak, 0) AS n_weak FROM h LEFT JOIN n USING (page_id))
SELECT *, coalesce(array_to_string(list_filter([CASE WHEN n_expected > 0 AND n_sections > 2 * n_expected THEN 'too-many-sections' END, CASE WHEN n_empty > 0 THEN 'empty-sections' END, CASE WHEN n_weak > 0 THEN 'weak-titles' END], lambda x: x IS NOT NULL), ','), '') AS warnings FROM r""",
    "q107_feature_buckets": _ENTRIES + rf""", f AS (SELECT page_id, min(ord) AS first FROM e WHERE ord % 3 = 1 GROUP BY page_id),
b AS (SELECT e.page_id, ord, page, title, CASE WHEN regexp_matches(lower(title), '(ciąg dalszy|continued)') THEN 'continued' WHEN {R.sponsored.sql('title')} OR ({R.short_fragment.sql('title')} AND length(title) <= 3) THEN 'extra' WHEN first IS NULL OR ord < first THEN 'front' ELSE 'additional' END AS bucket FROM e LEFT JOIN f USING (page_id) WHERE ord % 3 <> 1)
SELECT page_id, ord, bucket, row_number() OVER (PARTITION BY page_id, bucket ORDER BY page, lower(title), ord) AS place FROM b""",
}
