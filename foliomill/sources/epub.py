"""EPUB packages as tables: packing documents into archives, reading archives back, and the rows that checks need."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .html import _Reader

MIMETYPE = "application/epub+zip"
CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
ROWS = "package string, kind string, path string, name string, value string, ord int"
_TAG = re.compile(r"<[a-zA-Z][^>]*>")
_ATTRIBUTE = re.compile(r"""\b(id|href|src)\s*=\s*["']([^"']*)["']""")


def pack_archive(title: str, documents: list[tuple[str, str]]) -> bytes:
    """An archive of documents (name, html) with the type stored first, a package file and a navigation document."""
    items = "".join(f'<item id="c{k}" href={quoteattr(name)} media-type="application/xhtml+xml"/>' for k, (name, _) in enumerate(documents))
    order = "".join(f'<itemref idref="c{k}"/>' for k in range(len(documents)))
    links = "".join(f"<li><a href={quoteattr(name)}>{k + 1}</a></li>" for k, (name, _) in enumerate(documents))
    opf = f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>{order}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), MIMETYPE, zipfile.ZIP_STORED)
        for name, text in (("META-INF/container.xml", CONTAINER), ("EPUB/content.opf", opf), ("EPUB/nav.xhtml", f"<html><body><nav><ol>{links}</ol></nav></body></html>"), *((f"EPUB/{n}", t) for n, t in documents)):
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def pack(documents: DataFrame) -> DataFrame:
    """(package, archive) from (package, ord, name, html).  A package's documents are packed in one task, so packages are
    what bounds it."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        return pd.DataFrame({"package": [key[0]], "archive": [pack_archive(str(key[0]), [(n, h or "") for n, h in zip(pdf["name"], pdf["html"])])]})

    return documents.groupBy("package").applyInPandas(run, "package string, archive binary")


def archive_rows(package: str, archive: bytes | None) -> list[tuple]:
    """Rows (package, kind, path, name, value, ord): members, manifest items, the reading order, ids, references,
    headings, and what is wrong with the archive itself."""
    rows: list[tuple] = []
    add = lambda kind, path="", name="", value="", ord_=0: rows.append((package, kind, path, name, value, ord_))
    try:
        z = zipfile.ZipFile(io.BytesIO(archive or b""))
    except zipfile.BadZipFile:
        add("error", name="archive", value="not a zip archive")
        return rows
    infos = z.infolist()
    for k, i in enumerate(infos):
        add("member", i.filename, value=str(i.file_size), ord_=k)
    if not infos or infos[0].filename != "mimetype" or infos[0].compress_type != zipfile.ZIP_STORED or z.read("mimetype").decode("latin-1") != MIMETYPE:
        add("error", "mimetype", "mimetype", "must come first, stored, and name the type")
    names = {i.filename for i in infos}
    if "META-INF/container.xml" not in names:
        add("error", "META-INF/container.xml", "container", "missing")
        return rows
    try:
        root = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
        tree = ElementTree.fromstring(z.read(root))
    except (StopIteration, KeyError, ElementTree.ParseError) as e:
        add("error", "META-INF/container.xml", "package", type(e).__name__)
        return rows
    base, documents = posixpath.dirname(root), []
    for k, e in enumerate(x for x in tree.iter() if x.tag.endswith("}item")):
        target = posixpath.normpath(posixpath.join(base, e.get("href", "")))
        add("manifest", target, e.get("id", ""), e.get("media-type", ""), k)
        if e.get("media-type") == "application/xhtml+xml" and target in names:
            documents.append(target)
    for k, e in enumerate(x for x in tree.iter() if x.tag.endswith("}itemref")):
        add("spine", root, e.get("idref", ""), ord_=k)
    for path in documents:
        text = z.read(path).decode("utf-8", "replace")
        for k, (name, value) in enumerate(m.groups() for tag in _TAG.finditer(text) for m in _ATTRIBUTE.finditer(tag[0])):
            if name == "id":
                add("id", path, value, ord_=k)
            elif re.match(r"[a-z][a-z0-9+.-]*:|//", value):
                add("external", path, name, value, k)
            else:
                target, _, fragment = value.partition("#")
                target = posixpath.normpath(posixpath.join(posixpath.dirname(path), target.partition("?")[0])) if target else path
                add("ref", path, target, fragment, k)
        reader = _Reader()
        reader.feed(text)
        reader.flush()
        for k, (block, level, words, *_) in enumerate(reader.rows):
            if level or block == "title":
                add("heading", path, block, words, k)
    return rows


def read(archives: DataFrame) -> DataFrame:
    """The rows of all archives (package, archive), one archive at a time."""

    def run(frames):
        for pdf in frames:
            for package, archive in zip(pdf["package"], pdf["archive"]):
                yield pd.DataFrame(archive_rows(package, archive), columns=[c.split(" ")[0] for c in ROWS.split(", ")])

    archives.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return archives.select("package", "archive").mapInPandas(run, ROWS)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(package, archive) of the EPUB files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).selectExpr("path AS package", "content AS archive")
