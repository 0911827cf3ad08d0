"""Checks of packages: what their files, order, links and ids must satisfy, and reports of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import epub
from ..sources.settings import markdown_table
from ..sources.tables import load
from . import quality

#: Pages that are packed together.
PER_PACKAGE = 20


def packages(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.concat(F.lit("p"), F.floor(F.col("page_id") / PER_PACKAGE).cast("string")).alias("package"), F.col("page_id").alias("ord"), F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".xhtml")).alias("name"), "html")
    return epub.pack(rows)


def bad_external(url: Column) -> Column:
    """Why an external link is wrong, null if it isn't: scheme, host, white space, a broken escape."""
    host = F.regexp_extract(url, r"^(?:[a-z]+:)?//([^/?#]*)", 1)
    return (
        F.when(url.rlike(r"[ \t\n]"), "white space").when(url.rlike(r"%([^0-9A-Fa-f]|.?$|.[^0-9A-Fa-f])"), "broken escape").when(~url.rlike("^(https?:)?//"), F.when(~url.rlike("^(mailto|tel|data):"), "scheme"))
        .when(host == "", "no host").when(~host.contains(".") & (host != "localhost"), "host without a dot")
    )


def findings(rows: DataFrame) -> DataFrame:
    """(package, severity, code, path, detail): anti joins of what is named against what there is."""
    of = lambda kind, *cols: rows.where(F.col("kind") == kind).select("package", *cols)
    named = lambda df, severity, code, path, detail: df.select("package", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(path).alias("path"), F.col(detail).alias("detail"))
    members, manifest, spine, refs, ids = of("member", "path"), of("manifest", "path", "name"), of("spine", "path", "name"), of("ref", "path", "name", "value"), of("id", "path", "name")
    broken = named(rows.where("kind = 'error'"), "error", "archive", "path", "value")
    missing = named(manifest.join(members, ["package", "path"], "left_anti"), "error", "missing_item", "path", "name")
    unknown = named(spine.join(manifest.select("package", "name"), ["package", "name"], "left_anti"), "error", "unknown_idref", "path", "name")
    twice = named(spine.groupBy("package", "path", "name").count().where("count > 1"), "warning", "repeated_idref", "path", "name")
    same_id = named(ids.groupBy("package", "path", "name").count().where("count > 1"), "error", "repeated_id", "path", "name")
    target = members.select("package", F.col("path").alias("name"))
    no_file = named(refs.join(target, ["package", "name"], "left_anti"), "error", "missing_target", "path", "name")
    anchor = ids.select("package", F.col("path").alias("name"), F.col("name").alias("value"))
    no_anchor = named(refs.where("value <> ''").join(target, ["package", "name"], "left_semi").join(anchor, ["package", "name", "value"], "left_anti"), "error", "missing_anchor", "path", "value")
    outside = rows.where("kind = 'external'").withColumn("why", bad_external(F.col("value"))).where("why IS NOT NULL")
    out = broken
    for part in (missing, unknown, twice, same_id, no_file, no_anchor, named(outside, "warning", "external_link", "path", "why")):
        out = out.unionByName(part)
    return out


def gate(found: DataFrame, all_packages: DataFrame) -> DataFrame:
    """(package, status, n_errors, n_warnings): errors fail, warnings need review, nothing passes."""
    n = found.groupBy("package").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = all_packages.select("package").distinct().join(n, "package", "left").select("package", z("n_errors"), z("n_warnings"))
    return rows.withColumn("status", F.when(F.col("n_errors") > 0, "fail").when(F.col("n_warnings") > 0, "pass_with_review").otherwise("pass"))


def q80_package_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed into archives, read back and checked: members, headings, links and findings per package."""
    rows = epub.read(packages(load(spark, sf_dir, "pages")))
    counts = rows.groupBy("package").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("member", "spine", "ref", "heading")))
    return counts.join(gate(findings(rows), rows), "package")


def q81_markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus roll-up as a Markdown table, worst classes first."""
    g = quality.q31_corpus_rollup(spark, sf_dir).select("class", "status", "n_cases", "n_fail", "n_review", "n_pass")
    return markdown_table(g, [-F.col("n_fail"), F.col("class")])


QUERIES = {q.__name__: q for q in (q80_package_check, q81_markdown_report)}
SQL = {
    "q80_package_check": r"""WITH p AS (SELECT 'p' || (page_id // 20) AS package, len(regexp_extract_all(html, '(?:href|src)="[^"]*"')) AS n_ref, len(regexp_extract_all(html, '<(?:title|h[1-6])>[^<]')) AS n_heading FROM pages),
g AS (SELECT package, count(*) + 4 AS n_member, count(*) AS n_spine, (sum(n_ref) + count(*))::bigint AS n_ref, sum(n_heading)::bigint AS n_heading, sum(n_ref)::bigint AS n_errors FROM p GROUP BY package)
SELECT package, n_member, n_spine, n_ref, n_heading, n_errors, 0 AS n_warnings, CASE WHEN n_errors > 0 THEN 'fail' ELSE 'pass' END AS status FROM g""",
    "q81_markdown_report": quality._G + r""", s AS (SELECT class, CASE WHEN bool_or(grade = 'fail') THEN 'failed' WHEN bool_or(grade = 'pass_with_review') THEN 'passed_with_warnings' ELSE 'passed' END AS status, count(*) AS n_cases, count(*) FILTER (grade = 'fail') AS n_fail,
 count(*) FILTER (grade = 'pass_with_review') AS n_review, count(*) FILTER (grade = 'pass') AS n_pass FROM g GROUP BY class),
lined AS (SELECT (row_number() OVER (ORDER BY n_fail DESC, class) + 1)::int AS n, '| ' || concat_ws(' | ', class, status, n_cases, n_fail, n_review, n_pass) || ' |' AS line FROM s)
SELECT * FROM lined UNION ALL VALUES (0, '| class | status | n_cases | n_fail | n_review | n_pass |'), (1, '|-|-|-|-|-|-|')""",
}
