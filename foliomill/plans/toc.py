"""Repair of headings in a run of blocks, the table of contents made of what is left, and how its entries hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..sources import html
from ..sources.tables import load
from .blocks import LINES, lines_of
from .titles import HEADINGS, canonical, canonical_sql, fragments_match, fragments_sql

#: Labels that stand inline before a text, and labels that say little by themselves.
PREFIXES = ("Co to jest", "Jak działa", "Jak dziala", "Implikacje biznesowe", "Przykład", "Przyklad", "Wniosek", "Ryzyka", "Rekomendacje", "Architektura", "Zależności systemowe", "Zaleznosci systemowe")
GENERIC = ("approach", "assessment", "benefits", "business", "definition", "delivery", "description", "elements", "enterprise", "evaluation", "guidelines and tools", "guidelines/tools", "impact", "implementation", "information", "input", "inputs",
    "limitations", "measures", "needs", "output", "outputs", "overview", "potential value", "process", "project", "purpose", "rationale", "requirements", "solution", "stakeholder", "stakeholders", "summary", "tasks using this output", "techniques", "usage considerations")
#: Characters of a block that supports a heading; files, candidates and headings from which a publication
#: is dense; second-level entries of a file there; third-level headings from which they are bounded, and the bounds.
SUPPORT, DENSE_FILES, DENSE_CANDIDATES, DENSE_HEADINGS, MOST_H2, MANY_H3, MOST_H3, MOST_H3_DENSE = 24, 40, 220, 180, 4, 24, 3, 1
LABEL = "^(" + "|".join(PREFIXES) + ")"


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, i, element, text): every line as a paragraph, some behind a heading that its first words make.

    The line's place picks the heading: a real one, a caption, one marked up as a paragraph, a generic label, a numbered
    one, a page's number or a title that breaks off; some paragraphs begin with an inline label.
    """
    x, k = F.col("x"), (F.col("doc_id") + F.col("pos")) % 12
    first = T.capitalise(F.regexp_extract("x", r"^((?:[^ ]+ ){0,2}[^ ]+)", 1))
    head = lambda element, text: F.struct(F.lit(0).alias("at"), F.lit(element).alias("element"), text.alias("text"))
    heads = F.when(F.col("pos") == 0, head("h1", first)).when(k == 0, head("h2", first)).when(k == 1, head("h3", F.concat(F.lit("Figure 3 "), T.fold_diacritics(first)))).when(k == 2, head("p", F.regexp_replace(first, r"[.,;:!?]", "")))
    heads = heads.when(k == 3, head("h2", F.lit("Overview"))).when(k == 4, head("h3", F.concat(F.lit("1.2 "), first))).when(k == 6, head("h2", F.concat(F.lit("page "), F.col("pos").cast("string")))).when(k == 7, head("h3", F.concat(first, F.lit(" of the"))))
    body = F.struct(F.lit(1).alias("at"), F.lit("p").alias("element"), F.when(k == 5, F.concat(F.lit("Przykład: "), x)).otherwise(x).alias("text"))
    rows = lines_of(docs).select("doc_id", "pos", F.explode(F.filter(F.array(heads, body), lambda b: b.isNotNull())).alias("b"))
    return rows.select("doc_id", (2 * F.col("pos") + F.col("b.at")).alias("i"), "b.element", "b.text")


def repaired(b: DataFrame) -> DataFrame:
    """Blocks with what happens to each, `action`, and the element it becomes, `fixed`.

    A heading that is noise goes down to a paragraph.  A paragraph that reads like a heading and stands before a block
    that supports it goes up, to the level under the heading before it.  An inline label is split from its text.
    """
    w = Window.partitionBy("doc_id").orderBy("i")
    x, is_heading = F.col("text"), F.col("element").startswith("h")
    following, long = F.lead("element").over(w), F.length(F.lead("text").over(w))
    supported = F.coalesce(~following.startswith("h") & (long >= SUPPORT), F.lit(False))
    noise = R.bullet.of(x) | F.lower(x).rlike("(page|strona) ") | R.promotional.of(x) | R.figure_caption.of(x) | R.table_header.of(x) | R.synthetic.of(x) | (R.truncated.of(x) & ~supported)
    rest = F.btrim(F.regexp_replace(x, LABEL, ""), F.lit(" :-–—"))
    label = x.rlike(LABEL) & (F.size(T.words(rest)) >= 3) & (F.length(rest) >= SUPPORT)
    pseudo = R.heading_text.of(x) & (F.size(T.words(x)) <= 12) & ~R.person.of(x) & ~R.layout_artifact.of(x) & supported
    action = F.when(is_heading & noise, "demoted").when(is_heading, "kept").when(label, "split").when(pseudo, "promoted").otherwise("text")
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    marked = b.withColumn("action", action).withColumn("own", F.when(is_heading, F.expr("try_cast(substr(element, 2, 1) AS int)")))
    last = F.last(F.when(F.col("action") == "kept", F.col("own")), ignorenulls=True).over(before)
    level = F.when(F.col("action") == "kept", F.col("own")).when(F.col("action") == "promoted", F.when(last.isNull(), 1).when(last <= 1, 2).otherwise(F.least(last, F.lit(3))))
    return marked.withColumn("level", level).drop("own")


def q85_heading_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to every block, and its level; 0: no heading."""
    return repaired(blocks(load(spark, sf_dir, "documents"))).select("doc_id", "i", "action", F.coalesce("level", F.lit(0)).alias("level"))


def q86_heading_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: real headings and candidates before, headings after, each action, and whether it needs review: no
    first-level heading, several, or a level left out."""
    rows = repaired(blocks(load(spark, sf_dir, "documents")))
    n = lambda what: F.count_if(F.col("action") == what)
    counts = rows.groupBy("doc_id").agg(F.count_if(F.col("element").startswith("h")).alias("n_real"), n("promoted").alias("n_promoted"), n("demoted").alias("n_demoted"), n("split").alias("n_split"), F.count("level").alias("n_after"), F.count_if(F.col("level") == 1).alias("n_h1"), F.count_if(F.col("level") == 2).alias("n_h2"), F.count_if(F.col("level") == 3).alias("n_h3"))
    return counts.withColumn("review", (F.col("n_h1") != 1) | ((F.col("n_h3") > 0) & (F.col("n_h2") == 0)))


def contents(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, doc_id, i, level, text): entries of a table of contents for each source, whose files are documents.

    Entries are headings of three levels that belong there.  A dense source leaves out labels that repeat too often and
    keeps few second-level entries of a file, numbered ones aside; where third-level ones are many, few of a file stay.
    A label that an earlier entry has is left out below the first level.
    """
    sources = docs.select("doc_id", "source")
    candidates = rows.join(sources, "doc_id")
    size = candidates.groupBy("source").agg(F.countDistinct("doc_id").alias("files"), F.count_if(F.col("element").startswith("h") | F.col("level").isNotNull()).alias("n"), F.count("level").alias("headings"), F.count_if(F.col("level") == 3).alias("h3"))
    dense = (F.col("files") >= DENSE_FILES) | (F.col("n") >= DENSE_CANDIDATES) | (F.col("headings") >= DENSE_HEADINGS)
    size = size.select("source", dense.alias("dense"), "h3")
    x = F.col("text")
    entries = candidates.where(F.col("level").between(1, 3) & R.in_contents.of(x)).select("source", "doc_id", "i", "level", "text", F.lower(x).alias("key")).join(size, "source")
    repeats = entries.groupBy("source", "key").agg(F.count("*").alias("times"))
    entries = entries.join(repeats, ["source", "key"])
    n_words = F.size(T.words(x))
    tired = ~R.numbered.of(x) & (((F.col("level") >= 3) & (F.col("times") >= 3)) | ((F.col("times") >= 8) & (n_words <= 4)) | ((F.col("times") >= 5) & ((n_words <= 3) | F.col("key").isin(*GENERIC))))
    entries = entries.where(~(F.col("dense") & tired))
    w = Window.partitionBy("doc_id", "level").orderBy("i")
    entries = entries.withColumn("rn", F.row_number().over(w))
    bounded = ((F.col("level") == 2) & F.col("dense") & (F.col("rn") > MOST_H2) & ~R.numbered.of(x)) | ((F.col("level") == 3) & (F.col("h3") > MANY_H3) & (F.col("rn") > F.when(F.col("dense"), MOST_H3_DENSE).otherwise(MOST_H3)))
    entries = entries.where(~bounded)
    first = entries.groupBy("source", "key").agg(F.min(F.struct("doc_id", "i")).alias("first"))
    return entries.join(first, ["source", "key"]).where((F.col("level") == 1) | (F.struct("doc_id", "i") == F.col("first"))).select("source", "doc_id", "i", "level", "text")


def q87_contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return contents(docs, repaired(blocks(docs)))


def path_of(x: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(x, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1), "/+$", "")


def contents_map(pages: DataFrame) -> DataFrame:
    """(page_id, ord, label, path, heading_text, issues): every link as an entry of a table of contents.

    Every third link points to its own page, so that some targets are there.  A target's heading is that of the first
    page of its path.
    """
    h1 = html.headings(pages).where("level = 1").groupBy("page_id").agg(F.min_by("text", "ord").alias("h1"))
    targets = pages.select("page_id", path_of(F.col("url")).alias("path")).where("path <> ''").join(h1, "page_id", "left").groupBy("path").agg(F.min_by("h1", "page_id").alias("heading_text"), F.lit(1).alias("there"))
    own = pages.select("page_id", path_of(F.col("url")).alias("own"))
    found = html.links(pages).join(own, "page_id").select("page_id", "ord", "label", F.when(F.col("ord") % 3 == 0, F.col("own")).otherwise(path_of(F.col("href"))).alias("path"))
    w = Window.partitionBy("page_id", "path").orderBy("ord")
    at = found.withColumn("rn", F.row_number().over(w)).join(targets, "path", "left")
    heading = F.coalesce("heading_text", F.lit(""))
    mismatch = (heading != "") & ~fragments_match(canonical(F.col("label")), canonical(heading))
    issues = F.array_compact(F.array(F.when(F.col("there").isNull(), "missing-file"), F.when(F.col("rn") > 1, "duplicate-target"), F.when(mismatch, "label-heading-mismatch")))
    return at.select("page_id", "ord", "label", "path", heading.alias("heading_text"), issues.alias("issues"))


def q88_contents_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its issues: fails but for a mere mismatch of label and heading."""
    status = F.when(F.size("issues") == 0, "pass").when((F.size("issues") == 1) & (F.col("issues")[0] == "label-heading-mismatch"), "warning").otherwise("fail")
    return contents_map(load(spark, sf_dir, "pages")).select("page_id", "ord", F.array_join("issues", " / ").alias("issues"), status.alias("status"), "heading_text")


def q89_reviews_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of review that a repair leaves: those of the table of contents whose reason still holds on their page.

    The repair finds the targets of labels of more than four characters and makes repeated ones unique.
    """
    before = contents_map(load(spark, sf_dir, "pages")).select("page_id", "ord", "label", F.explode("issues").alias("reason"))
    after = before.where((F.col("reason") == "label-heading-mismatch") | ((F.col("reason") == "missing-file") & (F.length("label") <= 4))).select("page_id", "reason").distinct()
    left = before.join(after, ["page_id", "reason"], "left_semi")
    sure = F.when(F.col("reason") == "label-heading-mismatch", 0.7).otherwise(0.95)
    return left.groupBy("page_id", "reason").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max(sure).alias("confidence"))


QUERIES = {q.__name__: q for q in (q85_heading_repair, q86_heading_inventory, q87_contents_entries, q88_contents_map, q89_reviews_left)}

_W3 = r"upper(left(regexp_extract(x, '^((?:[^ ]+ ){0,2}[^ ]+)', 1), 1)) || substr(regexp_extract(x, '^((?:[^ ]+ ){0,2}[^ ]+)', 1), 2)"
_N = "length(trim(regexp_replace(text, '" + LABEL + "', ''), ' :-–—'))"
_NW = R.words_sql("trim(regexp_replace(text, '" + LABEL + "', ''), ' :-–—')")
_NOISE = " OR ".join([R.bullet.sql("text"), "regexp_matches(lower(text), '(page|strona) ')", *(r.sql("text") for r in (R.promotional, R.figure_caption, R.table_header, R.synthetic)), f"({R.truncated.sql('text')} AND NOT supported)"])
_REPAIRED = LINES + rf""", m AS (SELECT *, (doc_id + pos) % 12 AS k, {_W3} AS w3 FROM f),
b AS (SELECT doc_id, 2 * pos AS i, CASE WHEN pos = 0 THEN 'h1' WHEN k IN (0, 3, 6) THEN 'h2' WHEN k IN (1, 4, 7) THEN 'h3' ELSE 'p' END AS element,
  CASE WHEN pos = 0 OR k = 0 THEN w3 WHEN k = 1 THEN 'Figure 3 ' || translate(w3, '{T.FOLD_FROM}', '{T.FOLD_TO}') WHEN k = 2 THEN regexp_replace(w3, '[.,;:!?]', '', 'g') WHEN k = 3 THEN 'Overview' WHEN k = 4 THEN '1.2 ' || w3 WHEN k = 6 THEN 'page ' || pos ELSE w3 || ' of the' END AS text
  FROM m WHERE pos = 0 OR k IN (0, 1, 2, 3, 4, 6, 7) UNION ALL SELECT doc_id, 2 * pos + 1, 'p', CASE WHEN k = 5 THEN 'Przykład: ' || x ELSE x END FROM m),
s AS (SELECT *, coalesce(NOT starts_with(lead(element) OVER w, 'h') AND length(lead(text) OVER w) >= {SUPPORT}, false) AS supported FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT *, CASE WHEN starts_with(element, 'h') AND ({_NOISE}) THEN 'demoted' WHEN starts_with(element, 'h') THEN 'kept' WHEN regexp_matches(text, '{LABEL}') AND {_NW} >= 3 AND {_N} >= {SUPPORT} THEN 'split'
  WHEN {R.heading_text.sql('text')} AND {R.words_sql('text')} <= 12 AND NOT {R.person.sql('text')} AND NOT {R.layout_artifact.sql('text')} AND supported THEN 'promoted' ELSE 'text' END AS action FROM s),
g AS (SELECT *, last_value(CASE WHEN action = 'kept' THEN substr(element, 2, 1)::int END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a),
r AS (SELECT doc_id, i, element, text, action, CASE WHEN action = 'kept' THEN substr(element, 2, 1)::int WHEN action = 'promoted' THEN CASE WHEN last IS NULL THEN 1 WHEN last <= 1 THEN 2 ELSE least(last, 3) END END AS level FROM g)
"""
_PATH = r"regexp_replace(regexp_extract({x}, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1), '/+$', '')"
_MAP = HEADINGS + rf""", h1 AS (SELECT page_id, min_by(text, ord) AS h1 FROM h WHERE level = 1 GROUP BY page_id), o AS (SELECT page_id, {_PATH.format(x='url')} AS own FROM pages),
t AS (SELECT own AS path, min_by(h1, page_id) AS heading_text, true AS there FROM o LEFT JOIN h1 USING (page_id) WHERE own <> '' GROUP BY own),
e AS (SELECT page_id, ord, label, CASE WHEN ord % 3 = 0 THEN own ELSE {_PATH.format(x='href')} END AS path FROM l JOIN o USING (page_id)),
d AS (SELECT e.*, row_number() OVER (PARTITION BY page_id, e.path ORDER BY ord) AS rn, there, coalesce(heading_text, '') AS heading_text FROM e LEFT JOIN t ON e.path = t.path),
c AS (SELECT *, {canonical_sql('label')} AS ca, {canonical_sql('heading_text')} AS cb FROM d),
i AS (SELECT page_id, ord, label, heading_text, list_filter([CASE WHEN there IS NULL THEN 'missing-file' END, CASE WHEN rn > 1 THEN 'duplicate-target' END, CASE WHEN heading_text <> '' AND NOT {fragments_sql('ca', 'cb')} THEN 'label-heading-mismatch' END], lambda x: x IS NOT NULL) AS issues FROM c)
"""
SQL = {
    "q85_heading_repair": _REPAIRED + "SELECT doc_id, i, action, coalesce(level, 0) AS level FROM r",
    "q86_heading_inventory": _REPAIRED + """, c AS (SELECT doc_id, count(*) FILTER (starts_with(element, 'h')) AS n_real, count(*) FILTER (action = 'promoted') AS n_promoted, count(*) FILTER (action = 'demoted') AS n_demoted, count(*) FILTER (action = 'split') AS n_split,
 count(level) AS n_after, count(*) FILTER (level = 1) AS n_h1, count(*) FILTER (level = 2) AS n_h2, count(*) FILTER (level = 3) AS n_h3 FROM r GROUP BY doc_id)
SELECT *, n_h1 <> 1 OR (n_h3 > 0 AND n_h2 = 0) AS review FROM c""",
    "q87_contents_entries": _REPAIRED + f""", j AS (SELECT r.*, source FROM r JOIN documents USING (doc_id)),
z AS (SELECT source, count(DISTINCT doc_id) >= {DENSE_FILES} OR count(*) FILTER (starts_with(element, 'h') OR level IS NOT NULL) >= {DENSE_CANDIDATES} OR count(level) >= {DENSE_HEADINGS} AS dense, count(*) FILTER (level = 3) AS h3 FROM j GROUP BY source),
e AS (SELECT j.source, doc_id, i, level, text, lower(text) AS key, dense, h3, count(*) OVER (PARTITION BY j.source, lower(text)) AS times FROM j JOIN z ON j.source = z.source WHERE level BETWEEN 1 AND 3 AND {R.in_contents.sql('text')}),
t AS (SELECT * FROM e WHERE NOT (dense AND NOT {R.numbered.sql('text')} AND ((level >= 3 AND times >= 3) OR (times >= 8 AND {R.words_sql('text')} <= 4) OR (times >= 5 AND ({R.words_sql('text')} <= 3 OR key IN {GENERIC}))))),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY i) AS rn FROM t),
k AS (SELECT * FROM n WHERE NOT ((level = 2 AND dense AND rn > {MOST_H2} AND NOT {R.numbered.sql('text')}) OR (level = 3 AND h3 > {MANY_H3} AND rn > CASE WHEN dense THEN {MOST_H3_DENSE} ELSE {MOST_H3} END)))
SELECT source, doc_id, i, level, text FROM k QUALIFY level = 1 OR row_number() OVER (PARTITION BY source, key ORDER BY doc_id, i) = 1""",
    "q88_contents_map": _MAP + "SELECT page_id, ord, array_to_string(issues, ' / ') AS issues, CASE WHEN len(issues) = 0 THEN 'pass' WHEN issues = ['label-heading-mismatch'] THEN 'warning' ELSE 'fail' END AS status, heading_text FROM i",
    "q89_reviews_left": _MAP + """, b AS (SELECT page_id, ord, label, unnest(issues) AS reason FROM i), a AS (SELECT DISTINCT page_id, reason FROM b WHERE reason = 'label-heading-mismatch' OR (reason = 'missing-file' AND length(label) <= 4))
SELECT page_id, reason, count(*) AS n, min(ord) AS first, max(CASE WHEN reason = 'label-heading-mismatch' THEN 0.7 ELSE 0.95 END)::double AS confidence FROM b SEMI JOIN a USING (page_id, reason) GROUP BY ALL""",
}
