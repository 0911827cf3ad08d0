"""Archives, settings and reports on files made for each case."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from foliomill.plans import epub as checks
from foliomill.sources import epub, settings


def found(spark, archives):
    frame = spark.createDataFrame(archives, "package string, archive binary")
    rows = epub.read(frame)
    return {(r["package"], r["code"], r["path"], r["detail"]) for r in checks.findings(rows).collect()}, {r["package"]: r["status"] for r in checks.gate(checks.findings(rows), rows).collect()}


def test_round_trip_of_a_sound_package(spark):
    data = epub.pack_archive("T & <t>", [("a.xhtml", '<html><title>A</title><h1 id="x">Head</h1><a href="b.xhtml#y">b</a></html>'), ("b.xhtml", '<p id="y">B <a href="#y">self</a> <a href="https://example.com/">out</a></p>')])
    assert zipfile.ZipFile(io.BytesIO(data)).namelist()[0] == "mimetype"
    assert found(spark, [("p", data)]) == (set(), {"p": "pass"})


def test_findings(spark):
    bad = epub.pack_archive("T", [("a.xhtml", '<p id="x"><p id="x"><a href="no.xhtml">1</a><a href="a.xhtml#z">2</a><a href="http://bare/">3</a>')])
    got, status = found(spark, [("p", bad), ("q", b"no zip"), ("r", None)])
    assert got == {
        ("p", "repeated_id", "EPUB/a.xhtml", "x"), ("p", "missing_target", "EPUB/a.xhtml", "EPUB/no.xhtml"), ("p", "missing_anchor", "EPUB/a.xhtml", "z"), ("p", "external_link", "EPUB/a.xhtml", "host without a dot"),
        ("q", "archive", "", "not a zip archive"), ("r", "archive", "", "not a zip archive"),
    }
    assert status == {"p": "fail", "q": "fail", "r": "fail"}


def test_spine_and_manifest(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", epub.CONTAINER)
        z.writestr("EPUB/content.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="a"/><itemref idref="b"/></spine></package>')
    codes = {c for _, c, _, _ in found(spark, [("p", out.getvalue())])[0]}
    assert codes == {"archive", "missing_item", "unknown_idref", "repeated_idref"}


def test_files(spark, tmp_path):
    (tmp_path / "one.epub").write_bytes(epub.pack_archive("T", [("a.xhtml", "<h1>x</h1>")]))
    rows = epub.read(epub.from_files(spark, str(tmp_path)))
    assert rows.where("kind = 'heading'").first()["value"] == "x"


def test_settings(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "cases": [{"id": "a", "input_type": "pdf", "size_bytes": 3}, {"id": "b", "input_type": "epub"}]}))
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "p.json").write_text(json.dumps({"document_classes": {"Dense Guide": {"warn_bytes": 1, "hard_bytes": 2}}}))
    (tmp_path / "d.json").write_text(json.dumps({"terms": [{"canonical": "Spark", "variants": ["spar k", "SPARK"]}]}))
    assert [(r["seq"], r["id"]) for r in settings.manifest_cases(spark, f"{tmp_path}/m.json", "pdf").collect()] == [(0, "a")]
    assert settings.manifest_cases(spark, f"{tmp_path}/bad.json").count() == 0
    assert settings.manifest_cases(spark, f"{tmp_path}/none.json").count() == 0
    assert settings.size_policy(spark, f"{tmp_path}/p.json").first().asDict() == {"class": "dense_guide", "warn_bytes": 1, "hard_bytes": 2}
    terms = {r["variant"]: r["canonical"] for r in settings.term_dictionary(spark, f"{tmp_path}/d.json", [("spark", "old"), ("hive", "Hive")]).collect()}
    assert terms == {"spark": "Spark", "spar k": "Spark", "hive": "Hive"}


def test_markdown(spark):
    frame = spark.createDataFrame([("a", 1), ("b", None)], "x string, y int")
    assert [r["line"] for r in settings.markdown_table(frame, [F.col("x")]).orderBy("n").collect()] == ["| x | y |", "|-|-|", "| a | 1 |", "| b |  |"]
