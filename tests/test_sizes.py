"""What larger tables showed: rare letters, and what is moved."""

import duckdb
import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from foliomill import catalog
from foliomill.functions import text as T
from foliomill.plans import lexicon

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def both(spark, folder, name, rows):
    """Rows of a query over these documents (doc_id, text, source, lang), and of its SQL."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    frame.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    c = duckdb.connect()
    c.register("documents", frame.toPandas())
    return rows_of(QUERIES[name](spark, str(folder)).toPandas()), rows_of(c.execute(SQL[name]).df())


@pytest.mark.parametrize("name", ["q104_front_matter", "q87_contents_entries", "q97_articles"])
def test_headings_that_begin_with_a_letter_whose_capital_is_two(name, spark, tmp_path):
    lines = [f"{first} {'ab'[k:]}{'x' * n}" for k, first in enumerate(("ß", "ßeit", "ŉ b", "ᾳ bc", "ﬁne", "éa")) for n in range(5)]
    lines = [f"{line}\na line of words behind it, of some length {n}" for n, line in enumerate(lines)]
    rows = [(k, "\n".join(lines[k:] + lines[:k]), f"s{k % 3}", "de") for k in range(len(lines))]
    found, expected = both(spark, tmp_path, name, rows)
    assert found == expected


def joins(spark, sf_dir, name):
    """Lines of the plan that join, where no table is small by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [line for line in plan.split("\n") if "Join" in line]


def test_cuts_of_glued_words_do_not_move(spark, sf_dir):
    found = joins(spark, sf_dir, "q13_glued_words")
    assert found and all("BroadcastHashJoin" in line for line in found)


def test_cuts_rank_as_their_points_the_leftmost_first(spark):
    sums = [(4.1 + 4.3, 7), (4.2 + 4.2, 5), (4.2 + 4.2, 9), (4.1 + 4.300001, 4), (0.1 + 0.2, 4), (0.3, 4), (0.15 + 0.15, 5), (-0.5, 6), (17.9, 1 << 20)]
    rows = spark.createDataFrame([(p, c) for p, c in sums], "p double, cut int").select("p", "cut", lexicon.ranked(F.col("p"), F.col("cut")).alias("rank")).collect()
    assert sorted(rows, key=lambda r: r["rank"]) == sorted(rows, key=lambda r: (r["p"], -r["cut"]))
    assert all(lexicon.CUTS - 1 - r["rank"] % lexicon.CUTS == r["cut"] for r in rows)


def test_words_to_join_are_found_where_they_are(spark, sf_dir):
    found = joins(spark, sf_dir, "q74_joined_words")
    assert found and all("BroadcastHashJoin" in line for line in found)


def test_variants_are_found_where_they_are(spark, sf_dir):
    assert any("BroadcastHashJoin [word" in line for line in joins(spark, sf_dir, "q103_term_variants"))


def test_normalising_reads_a_text_few_times(spark, sf_dir):
    plan = QUERIES["q72_normalised_texts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 11


def test_percentages_and_white_space_in_one_pass(spark):
    x, cases = F.col("x"), {" a \t\n b\n\nc  ": "a b c", "\n": "", "1, 2, 3 % of 12   % and 4. 55%": "1, 2,3% of 12% and 4.55%", "so.Él und No.b": "so. Él und No.b"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["y"] for r in rows.select("x", T.space_sentences(T.close_up_percent(T.squeeze(x))).alias("y")).collect()} == cases
