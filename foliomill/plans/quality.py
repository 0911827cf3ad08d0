"""Quality of a corpus: budgets, rules and grades, status roll-ups, review queues, before and after, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import text as T
from ..sources.tables import load

#: Factors of proposed budgets and the step that they are rounded up to.
WARN, HARD, STEP = 1.2, 1.4, 8192
#: Pages from which each class of render budget holds.
LADDER = ((360, "fixed_layout_extreme"), (240, "fixed_layout_aggressive"), (120, "fixed_layout_dense"), (60, "fixed_layout_balanced"), (0, "fixed_layout_safe"))
#: Characters that count as one page, and bytes of an oversized upload.
PAGE, OVERSIZED = 300, 12_000
#: Flags of a risk audit and their weights; scores from which it is high and medium.
RISKS = (("no_heading", 2), ("short_body", 1), ("noisy_title", 2), ("many_links", 1))
HIGH, MEDIUM = 3, 2


def cases(docs: DataFrame) -> DataFrame:
    """Documents as cases of a corpus: class from the source, bytes of the text, order."""
    return docs.select("doc_id", "lang", "source", T.class_key(F.concat(F.lit("Class "), F.col("source"))).alias("class"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), "text")


def proposals(docs: DataFrame) -> DataFrame:
    """Per class: cases, largest, and budgets above it in whole steps."""
    up = lambda x: (F.ceil(x / STEP) * STEP).cast("long")
    return cases(docs).groupBy("class").agg(F.count("*").alias("n_cases"), F.max("bytes").alias("max_bytes")).select("class", "n_cases", "max_bytes", up(F.col("max_bytes") * WARN).alias("warn_bytes"), up(F.col("max_bytes") * HARD).alias("hard_bytes"))


def budgets(docs: DataFrame) -> DataFrame:
    """Budgets to check against: half of what would be proposed, and none for one class in five."""
    p = proposals(docs).select("class", (F.col("warn_bytes") / 4).cast("long").alias("warn_bytes"), (F.col("hard_bytes") / 2).cast("long").alias("hard_bytes"))
    return p.where(F.length("class") % 5 != 4)


def over_budget(size: Column, warn: Column, hard: Column) -> Column:
    """Strictly above is over; no budget is a failure."""
    return F.when(hard.isNull(), "failed").when(size > hard, "failed").when(size > warn, "passed_with_warnings").otherwise("passed")


def q28_size_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    rows = cases(docs).join(budgets(docs), "class", "left").withColumn("status", over_budget(F.col("bytes"), F.col("warn_bytes"), F.col("hard_bytes")))
    return rows.groupBy("class", "status").agg(F.count("*").alias("n_cases"), F.max("bytes").alias("max_bytes"))


def q29_budget_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals(load(spark, sf_dir, "documents"))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, class, strict, blockers, warnings, grade): rules over each case; lenient cases are spared some codes."""
    rows = cases(docs).join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left").withColumn("strict", F.col("doc_id") % 4 != 0)
    t = F.coalesce(F.col("text"), F.lit(""))
    rule = lambda when, code: F.when(when, F.lit(code))
    blockers = F.array_compact(F.array(rule(F.col("toxic") == 1, "toxic"), rule(T.has_email(t), "visible_address"), rule(F.length(t) < 20, "placeholder_title")))
    warnings = F.array_compact(F.array(rule(F.col("quality") == 0, "low_quality"), rule(F.col("bytes") > OVERSIZED, "oversized"), rule(~F.col("lang").isin("en", "de"), "unexpected_language"), rule(~t.contains("\n"), "heading_manual_review")))
    spared = lambda xs, code: F.when(F.col("strict"), xs).otherwise(F.array_remove(xs, code))
    out = rows.select("doc_id", "class", "strict", spared(blockers, "placeholder_title").alias("blockers"), spared(warnings, "heading_manual_review").alias("warnings"))
    return out.withColumn("grade", F.when(F.size("blockers") > 0, "fail").when(F.size("warnings") > 0, "pass_with_review").otherwise("pass"))


def q30_case_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return g.select("doc_id", "strict", F.array_join("blockers", ",").alias("blockers"), F.array_join("warnings", ",").alias("warnings"), "grade")


def q31_corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class: cases, grades, findings, the last case's grade, the worst status."""
    g = graded(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    count = lambda grade: F.count_if(F.col("grade") == grade)
    return g.groupBy("class").agg(
        F.count("*").alias("n_cases"), count("fail").alias("n_fail"), count("pass_with_review").alias("n_review"), count("pass").alias("n_pass"),
        F.sum(F.size("blockers")).alias("n_blockers"), F.sum(F.size("warnings")).alias("n_warnings"), F.max_by("grade", "doc_id").alias("class_grade"), S.worst(S.report_status(F.col("grade"))).alias("status"),
    )


def q32_status_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same raw words under the three maps, and the worst of each source."""
    raw = F.element_at(F.array(*map(F.lit, ("Pass", "warning", "unavailable", "skipped", "", "error", "pass_with_review"))), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = load(spark, sf_dir, "documents").select("source", raw.alias("raw"))
    return rows.groupBy("raw").agg(F.count("*").alias("n"), F.first(S.report_status(F.col("raw"))).alias("report"), F.first(S.state_status(F.col("raw"))).alias("state"), F.first(S.project_status(F.col("raw"))).alias("project"))


def signals(text: Column) -> list[Column]:
    return [T.count(text, r"[ ]+[,.;:!?]").alias("spaced"), T.count(text, r"\p{Ll}[.!?]\p{Lu}").alias("joined"), T.count_emails(text).alias("emails"), F.length(text).cast("long").alias("chars")]


def q33_signal_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals before and after the repairs, per source, stacked as (signal, before, after, delta)."""
    docs = load(spark, sf_dir, "documents").where("text is not null").select("source", F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit(","), F.lit(" ,"))).otherwise(F.col("text")).alias("b"))
    both = docs.select("source", "b", T.strip_emails(T.close_up_punctuation(F.col("b"))).alias("a"))
    names = ("spaced", "joined", "emails", "chars")
    wide = both.select("source", F.struct(*signals(F.col("b"))).alias("before"), F.struct(*signals(F.col("a"))).alias("after"))
    sums = wide.groupBy("source").agg(*(F.sum(f"{side}.{n}").alias(f"{side}_{n}") for side in ("before", "after") for n in names))
    stacked = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(f"before_{n}").alias("before"), F.col(f"after_{n}").alias("after")) for n in names)))
    return sums.select("source", stacked.alias("s")).select("source", "s.*").withColumn("delta", F.col("after") - F.col("before"))


def q34_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as review items, one per (kind, class, reason), the first case's; counted by kind."""
    g = graded(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    kinds = F.array(F.struct(F.lit("blocker").alias("kind"), F.col("blockers").alias("codes")), F.struct(F.lit("warning").alias("kind"), F.col("warnings").alias("codes")))
    items = g.select("doc_id", "class", F.explode(kinds).alias("k")).select("doc_id", "class", "k.kind", F.explode("k.codes").alias("reason"))
    first = items.groupBy("kind", "class", "reason").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    return first.groupBy("kind", "reason").agg(F.count("*").alias("n_items"), F.sum("n").alias("n_findings"), F.min("first_doc").alias("first_doc"))


def q35_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English cases dealt to four shards in order; each shard's size, ends and whether it covers all cases.

    The place in order is a two-step rank: within a range of ids and, by the ranges' counts, before it.
    """
    docs = load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.floor(F.col("doc_id") / 4096).alias("range"))
    counts = docs.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = docs.join(before, "range").select("doc_id", (F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy("doc_id")) - 1).alias("pos"))
    total = counts.agg(F.sum("n").alias("total"))
    shards = placed.groupBy((F.col("pos") % 4).cast("int").alias("shard")).agg(F.count("*").alias("n_cases"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return shards.join(F.broadcast(total), F.lit(True)).withColumn("coverage", F.when(F.col("n_cases") == F.col("total"), "complete").otherwise("partial")).drop("total")


def q36_render_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render class by pages, profile by what a document holds, and confidence."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    pages = F.ceil(F.length("text") / PAGE)
    ladder = F.lit(None).cast("string")
    for least, name in reversed(LADDER):
        ladder = F.when(F.col("pages") >= least, F.lit(name)).otherwise(ladder)
    rows = docs.select("doc_id", pages.alias("pages"), F.col("text").contains("\n").alias("toc"), T.count(F.col("text"), r"[0-9]+").alias("numbers"), T.count(F.col("text"), r"[*%#$&]{3}").alias("noise"))
    profile = F.when(F.col("noise") > 20, "scanned_reflow").when((F.col("numbers") >= 3) & F.col("toc"), "technical_study").when(F.col("toc"), "book_reflow").otherwise("fixed_layout_fallback")
    sure = F.lit(0.5) + F.when(F.col("toc"), 0.14).otherwise(0.0) + F.when(F.col("numbers") >= 3, 0.05).otherwise(0.0) - F.least(F.lit(1.0), F.col("noise") / 100.0) * 0.25
    rows = rows.select(ladder.alias("render_class"), profile.alias("profile"), F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.97), sure)), 4).alias("confidence"))
    return rows.groupBy("render_class", "profile").agg(F.count("*").alias("n_docs"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


def q43_page_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each page, their weighted score and what it means."""
    html = F.coalesce(F.col("html"), F.lit(""))
    title = F.regexp_extract(html, r"<title>([^<]*)", 1)
    flags = {"no_heading": ~html.contains("<h1>"), "short_body": F.length(html) < 1500, "noisy_title": title.rlike(r"[*%#$]{3}|&amp;&amp;"), "many_links": T.count(html, "<a href=") > 8}
    rows = load(spark, sf_dir, "pages").select("page_id", F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in flags.items()))).alias("flags"))
    weights = F.create_map(*(x for name, w in RISKS for x in (F.lit(name), F.lit(w))))
    score = F.aggregate("flags", F.lit(0), lambda acc, f: acc + weights[f])
    return rows.select("page_id", F.array_join("flags", ",").alias("flags"), score.alias("score")).withColumn("risk", F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low"))


def q44_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic of each document by weighted patterns, two points or more; the best, and of equals the first in order."""
    topics = {"licence": ((r"(?i)licen[cs]e", 2), (r"(?i)copyright", 2)), "contact": ((T.EMAIL, 2), (r"\+?[0-9]{3}[ -][0-9]{3}", 1)), "dialogue": ((r"\?", 1), (r"!", 1)), "noise": ((r"[*%#$&]{3}", 2),)}
    points = [F.struct(sum((F.when(F.col("t").rlike(p), w).otherwise(0) for p, w in rules), F.lit(0)).alias("n"), F.lit(-k).alias("o"), F.lit(name).alias("topic")) for k, (name, rules) in enumerate(topics.items())]
    rows = load(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("t")).select("source", F.array_max(F.array(*points)).alias("best"))
    return rows.select("source", F.when(F.col("best.n") >= 2, F.col("best.topic")).otherwise("general").alias("topic")).groupBy("source", "topic").agg(F.count("*").alias("n_docs"))


QUERIES = {q.__name__: q for q in (q28_size_budgets, q29_budget_proposals, q30_case_grades, q31_corpus_rollup, q32_status_maps, q33_signal_deltas, q34_review_queue, q35_shards, q36_render_profiles, q43_page_risks, q44_topics)}

_EMAIL = T.EMAIL
_K = r"""WITH c AS (SELECT doc_id, lang, source, text, 'class_' || trim(regexp_replace(lower(source), '[ \-/\\_]+', '_', 'g'), '_') AS class, strlen(coalesce(text, '')) AS bytes FROM documents),
p AS (SELECT class, count(*) AS n_cases, max(bytes) AS max_bytes, (ceil(max(bytes) * 1.2 / 8192) * 8192)::bigint AS warn_bytes, (ceil(max(bytes) * 1.4 / 8192) * 8192)::bigint AS hard_bytes FROM c GROUP BY class)
"""
_G = _K + rf""", r AS (SELECT c.*, quality, toxic, doc_id % 4 <> 0 AS strict, coalesce(text, '') AS t FROM c LEFT JOIN labels USING (doc_id)),
f AS (SELECT doc_id, class, strict, list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN regexp_matches(t, '{_EMAIL}') THEN 'visible_address' END, CASE WHEN length(t) < 20 AND strict THEN 'placeholder_title' END], lambda x: x IS NOT NULL) AS b,
 list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN bytes > 12000 THEN 'oversized' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'unexpected_language' END, CASE WHEN NOT contains(t, chr(10)) AND strict THEN 'heading_manual_review' END], lambda x: x IS NOT NULL) AS w FROM r),
g AS (SELECT *, CASE WHEN len(b) > 0 THEN 'fail' WHEN len(w) > 0 THEN 'pass_with_review' ELSE 'pass' END AS grade FROM f)
"""
SQL = {
    "q28_size_budgets": _K + """, b AS (SELECT class, trunc(warn_bytes / 4.0)::bigint AS warn_bytes, trunc(hard_bytes / 2.0)::bigint AS hard_bytes FROM p WHERE length(class) % 5 <> 4),
s AS (SELECT class, bytes, CASE WHEN hard_bytes IS NULL OR bytes > hard_bytes THEN 'failed' WHEN bytes > warn_bytes THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM c LEFT JOIN b USING (class))
SELECT class, status, count(*) AS n_cases, max(bytes) AS max_bytes FROM s GROUP BY class, status""",
    "q29_budget_proposals": _K + "SELECT class, n_cases, max_bytes, warn_bytes, hard_bytes FROM p",
    "q30_case_grades": _G + "SELECT doc_id, strict, coalesce(array_to_string(b, ','), '') AS blockers, coalesce(array_to_string(w, ','), '') AS warnings, grade FROM g",
    "q31_corpus_rollup": _G + """SELECT class, count(*) AS n_cases, count(*) FILTER (grade = 'fail') AS n_fail, count(*) FILTER (grade = 'pass_with_review') AS n_review, count(*) FILTER (grade = 'pass') AS n_pass,
 sum(len(b))::bigint AS n_blockers, sum(len(w))::bigint AS n_warnings, max_by(grade, doc_id) AS class_grade, CASE WHEN bool_or(grade = 'fail') THEN 'failed' WHEN bool_or(grade = 'pass_with_review') THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM g GROUP BY class""",
    "q32_status_maps": """WITH r AS (SELECT ['Pass', 'warning', 'unavailable', 'skipped', '', 'error', 'pass_with_review'][doc_id % 7 + 1] AS raw FROM documents)
SELECT raw, count(*) AS n, CASE raw WHEN 'Pass' THEN 'passed' WHEN 'warning' THEN 'passed_with_warnings' WHEN 'unavailable' THEN 'passed_with_warnings' WHEN 'pass_with_review' THEN 'passed_with_warnings' ELSE 'failed' END AS report,
 CASE raw WHEN 'Pass' THEN 'passed' WHEN 'warning' THEN 'passed_with_warnings' WHEN 'pass_with_review' THEN 'passed_with_warnings' WHEN 'error' THEN 'failed' ELSE 'unavailable' END AS state,
 CASE raw WHEN 'Pass' THEN 'passed' WHEN 'warning' THEN 'passed_with_warnings' WHEN 'pass_with_review' THEN 'passed_with_warnings' WHEN 'error' THEN 'failed' ELSE 'unavailable' END AS project FROM r GROUP BY raw""",
    "q33_signal_deltas": rf"""WITH d AS (SELECT source, CASE WHEN doc_id % 2 = 1 THEN replace(text, ',', ' ,') ELSE text END AS b FROM documents WHERE text IS NOT NULL),
x AS (SELECT source, b, trim(regexp_replace(regexp_replace(regexp_replace(b, '[ ]+([,.;:!?])', '\1', 'g'), '{_EMAIL}', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS a FROM d),
s AS (SELECT source, 'spaced' AS signal, sum(len(regexp_extract_all(b, '[ ]+[,.;:!?]')))::bigint AS before, sum(len(regexp_extract_all(a, '[ ]+[,.;:!?]')))::bigint AS after FROM x GROUP BY source
 UNION ALL SELECT source, 'joined', sum(len(regexp_extract_all(b, '\p{{Ll}}[.!?]\p{{Lu}}')))::bigint, sum(len(regexp_extract_all(a, '\p{{Ll}}[.!?]\p{{Lu}}')))::bigint FROM x GROUP BY source
 UNION ALL SELECT source, 'emails', sum(len(regexp_extract_all(b, '{_EMAIL}')))::bigint, sum(len(regexp_extract_all(a, '{_EMAIL}')))::bigint FROM x GROUP BY source
 UNION ALL SELECT source, 'chars', sum(length(b))::bigint, sum(length(a))::bigint FROM x GROUP BY source)
SELECT *, after - before AS delta FROM s""",
    "q34_review_queue": _G + """, i AS (SELECT doc_id, class, 'blocker' AS kind, unnest(b) AS reason FROM g UNION ALL SELECT doc_id, class, 'warning', unnest(w) FROM g),
q AS (SELECT kind, class, reason, min(doc_id) AS first_doc, count(*) AS n FROM i GROUP BY ALL)
SELECT kind, reason, count(*) AS n_items, sum(n)::bigint AS n_findings, min(first_doc) AS first_doc FROM q GROUP BY kind, reason""",
    "q35_shards": """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE lang = 'en')
SELECT (pos % 4)::int AS shard, count(*) AS n_cases, min(doc_id) AS first_doc, max(doc_id) AS last_doc, CASE WHEN count(*) = (SELECT count(*) FROM p) THEN 'complete' ELSE 'partial' END AS coverage FROM p GROUP BY 1""",
    "q36_render_profiles": r"""WITH d AS (SELECT ceil(length(text) / 300.0) AS pages, contains(text, chr(10)) AS toc, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '[*%#$&]{3}')) AS noise FROM documents WHERE text IS NOT NULL),
r AS (SELECT CASE WHEN pages >= 360 THEN 'fixed_layout_extreme' WHEN pages >= 240 THEN 'fixed_layout_aggressive' WHEN pages >= 120 THEN 'fixed_layout_dense' WHEN pages >= 60 THEN 'fixed_layout_balanced' ELSE 'fixed_layout_safe' END AS render_class,
 CASE WHEN noise > 20 THEN 'scanned_reflow' WHEN numbers >= 3 AND toc THEN 'technical_study' WHEN toc THEN 'book_reflow' ELSE 'fixed_layout_fallback' END AS profile,
 round(greatest(0.35::double, least(0.97::double, 0.5::double + CASE WHEN toc THEN 0.14::double ELSE 0 END + CASE WHEN numbers >= 3 THEN 0.05::double ELSE 0 END - least(1.0::double, noise / 100.0::double) * 0.25::double)), 4) AS confidence FROM d)
SELECT render_class, profile, count(*) AS n_docs, min(confidence) AS least, max(confidence) AS most FROM r GROUP BY ALL""",
    "q43_page_risks": r"""WITH h AS (SELECT page_id, coalesce(html, '') AS html, regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1) AS title FROM pages),
f AS (SELECT page_id, NOT contains(html, '<h1>') AS a, length(html) < 1500 AS b, regexp_matches(title, '[*%#$]{3}|&amp;&amp;') AS c, len(regexp_extract_all(html, '<a href=')) > 8 AS d FROM h),
s AS (SELECT page_id, coalesce(array_to_string(list_filter([CASE WHEN a THEN 'no_heading' END, CASE WHEN b THEN 'short_body' END, CASE WHEN c THEN 'noisy_title' END, CASE WHEN d THEN 'many_links' END], lambda x: x IS NOT NULL), ','), '') AS flags,
 (2 * a::int + b::int + 2 * c::int + d::int)::int AS score FROM f)
SELECT *, CASE WHEN score >= 3 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS risk FROM s""",
    "q44_topics": rf"""WITH d AS (SELECT source, coalesce(text, '') AS t FROM documents),
p AS (SELECT source, 2 * regexp_matches(t, '(?i)licen[cs]e')::int + 2 * regexp_matches(t, '(?i)copyright')::int AS a, 2 * regexp_matches(t, '{_EMAIL}')::int + regexp_matches(t, '\+?[0-9]{{3}}[ -][0-9]{{3}}')::int AS b, regexp_matches(t, '\?')::int + regexp_matches(t, '!')::int AS c, 2 * regexp_matches(t, '[*%#$&]{{3}}')::int AS e FROM d)
SELECT source, CASE WHEN greatest(a, b, c, e) < 2 THEN 'general' WHEN a = greatest(a, b, c, e) THEN 'licence' WHEN b = greatest(a, b, c, e) THEN 'contact' WHEN c = greatest(a, b, c, e) THEN 'dialogue' ELSE 'noise' END AS topic, count(*) AS n_docs FROM p GROUP BY ALL""",
}
