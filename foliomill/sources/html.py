"""Pages as tables: titles, headings, links and ids.

Two readers: patterns, which suffice for regular pages and stay inside Spark's expressions, and a table function over
the standard library's parser for pages that aren't regular.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Elements whose text is no prose.
SKIPPED = {"script", "style", "code", "pre", "kbd", "samp", "math"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, ord, element, level, text) for title and h1 to h3."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"<(?:title|h[1-3])>[^<]*"), 0)
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "raw"))
    element = F.regexp_extract("raw", r"^<([a-z0-9]+)>", 1)
    return rows.select(
        "page_id", "ord", element.alias("element"), F.when(element == "title", 0).otherwise(F.expr("try_cast(substr(regexp_extract(raw, '^<([a-z0-9]+)>', 1), 2) AS int)")).alias("level"),
        F.btrim(F.regexp_replace(F.regexp_replace("raw", r"^<[a-z0-9]+>", ""), r"[ \t\r\n]+", " ")).alias("text"),
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, href, label) of anchors."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a href="[^"]*">[^<]*'), 0)
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "raw"))
    return rows.select("page_id", "ord", F.regexp_extract("raw", r'^<a href="([^"]*)">', 1).alias("href"), F.btrim(F.regexp_extract("raw", r">(.*)$", 1)).alias("label"))


@udtf(returnType="ord int, block string, level int, text string, dom_id string, href string, ancestors array<string>", useArrow=True)
class Slots:
    """Blocks of a page in document order, with the id and link that came with each and the elements around it."""

    def eval(self, html: str):
        reader = _Reader()
        reader.feed(html or "")
        reader.close()
        reader.flush()
        yield from ((k, *row) for k, row in enumerate(reader.rows))


class _Reader(HTMLParser):
    BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "title", "td", "th", "blockquote", "figcaption", "div", "footer", "article", "nav"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.block, self.id, self.href = "", None, None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in self.BLOCKS:
            self.flush()
            self.block, self.id = tag, given.get("id")
        if tag == "a":
            self.href = given.get("href")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        if not SKIPPED & set(self.open):
            self.text.append(data)

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            level = int(self.block[1]) if len(self.block) == 2 and self.block[0] == "h" and self.block[1].isdigit() else None
            self.rows.append((self.block or "text", level, text, self.id, self.href, list(self.open)))
        self.text, self.id, self.href = [], None, None


def slots(pages: DataFrame) -> DataFrame:
    """(page_id, ord, block, level, text, dom_id, href, ancestors) by the parser."""
    found = pages.select("page_id", "html").lateralJoin(Slots(F.col("html").outer()))
    return found.drop("html")
