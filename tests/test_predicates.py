"""Predicates, labels and kinds of lines that meet every case, against their SQL; ids that collide."""

import duckdb
from oracle import rows_of

from foliomill.functions import predicates as P
from foliomill.functions import rules as R
from foliomill.plans import blocks, titles

WORDS = "alpha Beta gamma Delta epsilon zeta Eta theta iota kappa Lambda mu nu xi omicron".split()
FRAMES = (
    "{} {} {}", "{}.", "Figure 3. {} {}", "• {} {} {}", "12) {} {} {} {}", "chapter 7", "{} {} of the", "Name / Value / {} / Long Header / {} Total", "Subscribe {} {}", "Anna Maria Nowak",
    "Kraków, 12.03.2021 {}", "Bibliography", "{} – {}; {} – {}; it means {}", "{}, 12; {} 14-16, {} 200", "Untitled", "{} {} {} {} {} {} {} {} {} {} {} {} {} {} end.", "https://www/{}", "http://{}.example.com/x",
    "page 12", "{} 3. {} 4. {}", "export_{}.pdf", "doi:{}", "References and {}", "Index", "Copyright {}", "2021-03-12 {}", "{} | {} | {}", "a{}###$$$", "Editor {}", "title", "One Two Three Four", "red; green; blue", 
)
RULED = (
    "reklama", "Copyright 2020 by us", "co to jest", "12. Nf3 Nc6 13. Bb5 a6 1-0", "[12] Smith J. a book of things. https://example.org/x retrieved", "7 / Openings", "a b c d e f g h 1", "Strona 12", "1.2.3 Methods", "The end of",
    "Rozdział 4 Plan", "ACME", "name@example.com", "FOT. Jan", "continued from before", "• first", "Name Value Level Long Header Total", "A very long line that ends like a sentence does and isn't a heading at all, or is it one after all then, who knows.",
)
LINES = [f.format(*WORDS) for f in FRAMES] + list(RULED)


def tables(spark):
    text = "\n".join(LINES)
    rows = [(0, text, "s", "en"), (1, None, "s", "en"), (2, " \n\t", None, None), (3, "A\na 2\nA\nA\na-2\n!\n?\na 4\nA", "s", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    c = duckdb.connect()
    c.register("documents", frame.toPandas())
    return frame, c


def written(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_lines_of_every_kind_agree_with_sql(spark, tmp_path):
    frame, c = tables(spark)
    folder = written(spark, frame, tmp_path)
    for name in ("q51_line_predicates", "q52_line_labels", "q53_block_kinds", "q55_unique_ids", "q56_package_ids"):
        found, expected = blocks.QUERIES[name](spark, folder).toPandas(), c.execute(blocks.SQL[name]).df()
        assert rows_of(found) == rows_of(expected), name
    found = blocks.q51_line_predicates(spark, folder).where("doc_id = 0").toPandas()
    assert all(found[name].any() and not found[name].all() for name in P.BOOLEAN)
    kinds = {r["kind"] for r in blocks.q53_block_kinds(spark, folder).collect()}
    assert kinds == {"table", "definitions", "ordered", "bullet", "semicolons", "index", "caption", "references", "heading", "paragraph"}


def test_rules_agree_with_sql(spark, tmp_path):
    frame, c = tables(spark)
    folder = written(spark, frame, tmp_path)
    found, expected = titles.q82_line_rules(spark, folder).toPandas(), c.execute(titles.SQL["q82_line_rules"]).df()
    assert rows_of(found) == rows_of(expected)
    own = found[found.doc_id == 0]
    assert [n for n in [*R.LINES, "junk"] if not own[n].any() or own[n].all()] == []


def test_ids_are_unique_beside_slugs_that_look_numbered(spark, tmp_path):
    frame, _ = tables(spark)
    rows = blocks.q55_unique_ids(spark, written(spark, frame, tmp_path)).where("doc_id = 3").orderBy("pos").collect()
    assert [r["id"] for r in rows] == ["a", "a-2", "a-3", "a-5", "a-2-2", "section", "section-2", "a-4", "a-6"]
