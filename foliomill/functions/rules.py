"""Rules about a text that are stated once and read as a Column and as SQL.

A text has single white space.  Patterns are those that Java and RE2 read alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@dataclass(frozen=True)
class Rule:
    """What holds of a text; `|`, `&` and `~` combine rules."""

    def of(self, x: Column) -> Column:
        raise NotImplementedError

    def sql(self, x: str) -> str:
        raise NotImplementedError

    def __and__(self, other: Rule) -> Rule:
        return Both(self, other)

    def __or__(self, other: Rule) -> Rule:
        return Either(self, other)

    def __invert__(self) -> Rule:
        return Never(self)


@dataclass(frozen=True)
class Both(Rule):
    a: Rule
    b: Rule

    def of(self, x):
        return self.a.of(x) & self.b.of(x)

    def sql(self, x):
        return f"({self.a.sql(x)} AND {self.b.sql(x)})"


@dataclass(frozen=True)
class Either(Rule):
    a: Rule
    b: Rule

    def of(self, x):
        return self.a.of(x) | self.b.of(x)

    def sql(self, x):
        return f"({self.a.sql(x)} OR {self.b.sql(x)})"


@dataclass(frozen=True)
class Never(Rule):
    a: Rule

    def of(self, x):
        return ~self.a.of(x)

    def sql(self, x):
        return f"(NOT {self.a.sql(x)})"


@dataclass(frozen=True)
class Has(Rule):
    """A pattern is found, `times` times or more."""

    pattern: str
    times: int = 1

    def of(self, x):
        return x.rlike(self.pattern) if self.times == 1 else T.count(x, self.pattern) >= self.times

    def sql(self, x):
        return f"regexp_matches({x}, {quoted(self.pattern)})" if self.times == 1 else f"(len(regexp_extract_all({x}, {quoted(self.pattern)})) >= {self.times})"


@dataclass(frozen=True)
class Long(Rule):
    """Characters within bounds."""

    least: int = 0
    most: int = 1 << 30

    def of(self, x):
        return F.length(x).between(self.least, self.most)

    def sql(self, x):
        return f"(length({x}) BETWEEN {self.least} AND {self.most})"


@dataclass(frozen=True)
class Words(Rule):
    """Words within bounds."""

    least: int = 0
    most: int = 1 << 30

    def of(self, x):
        return F.size(T.words(x)).between(self.least, self.most)

    def sql(self, x):
        return f"({words_sql(x)} BETWEEN {self.least} AND {self.most})"


@dataclass(frozen=True)
class Capitals(Rule):
    """Least share of words, of those that begin with a letter, that begin with a capital; or all but `but` of them."""

    share: float = 0.0
    but: int | None = None

    def of(self, x):
        of = lambda p: F.size(F.filter(T.words(x), lambda w: w.rlike(p)))
        return of(r"^\p{Lu}") >= F.greatest(F.lit(1), F.size(T.words(x)) - self.but) if self.but is not None else (of(r"^\p{L}") > 0) & (of(r"^\p{Lu}") >= self.share * of(r"^\p{L}"))

    def sql(self, x):
        of = lambda p: f"len(list_filter(string_split({x}, ' '), lambda w: regexp_matches(w, '{p}')))"
        upper, letter = of(r"^\p{Lu}"), of(r"^\p{L}")
        return f"({upper} >= greatest(1, {words_sql(x)} - {self.but}))" if self.but is not None else f"({letter} > 0 AND {upper} >= {self.share} * {letter})"


@dataclass(frozen=True)
class Among(Rule):
    """The whole text, in lower case, is one of these."""

    texts: tuple[str, ...]

    def of(self, x):
        return F.lower(x).isin(*self.texts)

    def sql(self, x):
        return f"(lower({x}) IN ({', '.join(map(quoted, self.texts))}))"


def words_sql(x: str) -> str:
    return f"len(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


#: Small words that don't count in titles, labels that a repeated scheme brings, terms of imprints.
MINOR = ("a", "an", "and", "as", "at", "by", "for", "if", "in", "is", "of", "on", "or", "the", "to", "with", "w", "z", "i", "na", "do", "od", "o", "u", "oraz", "ale")
SCHEMA = ("co to jest", "jak dziala", "jak działa", "implikacje biznesowe", "przyklad", "przykład")
IMPRINT = r"(?i)copyright|all rights reserved|first edition|isbn|phone|distributed|printed|published|typeset by|proofreading by|edited by|cover design|picture credit|www\.|@"
SPONSORED = r"(?i)\b(reklama|material sponsorowany|materiał sponsorowany|advertorial)\b"

page_number = Has(r"^[0-9]{1,4}$")
bullet = Has("^[•·▪◦]")
figure_caption = Has(r"^(?i:figure|table|diagram|chart|exhibit|photo|tabela|wykres|rys\.|rysunek) [A-Za-z0-9.: -]{1,120}$")
synthetic = Has(r"^(?i:chapter|section|part|appendix|page|node|item|chapter[_ -]?page)[_ -]?[0-9]+[a-z]?$")
numbered = Has(r"^[0-9]+(\.[0-9]+){0,3}\b")
truncated = Long(1, 120) & (Has(r"[/&(–—-]$") | (Words(2, 8) & Has(r"(?i)(^| )(" + "|".join(MINOR) + r")[.,;:!?]?$")))
table_header = Long(24) & Words(5) & Capitals(but=1) & Has(r"[^ ]{4,}", 4) & ~Has(r"[.!?]$")
promotional = Has(r"(?i)^(subscribe|advertis|order now|special offer|only today)")
sponsored = Has(SPONSORED)
imprint = Has(IMPRINT)
layout_artifact = figure_caption | sponsored | imprint
heading_text = Long(1, 90) & ~bullet & ~figure_caption & ~page_number & ~Has(r"\([0-9]{4}\)$") & ~Has(r"^\p{Ll}") & ~Has(r"\b[0-9]{1,4}(, *[0-9]{1,4}){2,}\b") & ~imprint & ~(Has(r"[.?!]$") & Words(5)) & Capitals(0.55)
schema_label = Among(SCHEMA)
notation_heavy = Has(r"\b(?:[0-9]+\.(?:\.\.)?|O-O(?:-O)?|[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?[+#]?|1-0|0-1|1/2-1/2)(?: |$)", 3) | Has(r"^[0-9]+\.(\.\.)? *[^ ]")
contents_title = Has(r"(?i)^(front cover|title|copyright|contents|table of contents|general introduction|resources)$|^(part|chapter|appendix)\b|^solutions to\b|^(name|opening) index\b")
in_contents = Long(1) & ~synthetic & ~truncated & ~bullet & ~Has(r"^\.[0-9]+\b") & ~schema_label & ~table_header & ~Has(r"(?i)\b(ciąg dalszy|wprowadzenie|continued)\b") & ~sponsored & (contents_title | (Long(2, 160) & ~Has(r"^[0-9. •·–—-]+$") & Has(r"\p{L}") & ~(Has(r"\.$") & Long(81))))
not_scanned_heading = page_number | imprint | Has(r"^[0-9., ]+$") | Has(r"^(?i:figure|table) [0-9]")
scanned_heading = Long(1, 120) & ~not_scanned_heading & ~Has(r"[.!?;:]$") & (Has(r"(?i)^(chapter|rozdział|appendix|dodatek)\b") | Has(r"^[0-9]+(\.[0-9]+)* [A-Z]") | (Words(1, 8) & Has(r"^\p{Lu}") & Capitals(but=1)))
noise_title = ~Long(1) | Has(r"^(?i:[a-h]( [a-h]){7}( [0-9]+)?)$") | Has(r"^[0-9]+$")
weak_title = noise_title | Has(r"^(?i:strona|page|sekcja|section) [0-9]+[A-Za-z-]*$")
board_title = Has(r"(?i)\b(chapter|appendix|foreword|introduction|contents)\b|\bkey to\b") | Has(r"^[0-9]+(\.[0-9]+)+ [\p{L}\p{N}]") | Words(0, 8)
signature_meta = Long(1, 60) & ~Has(r"[.!?]$") & Words(1, 5) & Has(r"^[\p{L}\p{N}_][\p{L}\p{N}_&/().-]+( [\p{L}\p{N}_][\p{L}\p{N}_&/().-]+){0,4}$") & ~Has(r"[0-9]{1,2}[./ ][0-9]{1,2}[./ ][0-9]{4}")
link_token = Has(r"(?:https?://|www\.)[^ ]+|10\.[0-9]{4,9}/[^ ]+")
entry_id = Has(r"^(\[ *[A-Za-z0-9][A-Za-z0-9, -]{0,31} *\]|[0-9]{1,3}[.)]|[A-Z]{1,6}-?[0-9]+[A-Za-z0-9-]*) +[^ ]")
reference_entry = Long(1, 320) & ~heading_text & ~figure_caption & link_token & (entry_id | Words(0, 26) | Has(r"(?i)\b(doi|retrieved|accessed|available|www\.)"))
contents_entry = Has(r"^[0-9]{1,3} */ +[^ ]")
person = Words(2, 4) & Capitals(1.0) & ~Has(r"[^\p{L}. -]")
small_capitals = Long(1, 32) & ~Has(r"\p{Ll}") & Has(r"\p{L}")
photo_credit = Has(r"^(?i:fot\.?|zdjęcia|zdjecia|photo)\b")
junk_anywhere = Has(T.EMAIL) | page_number
junk_at_margin = small_capitals | Has(r"(?i)\b(cena|vat|indeks|issn|numer|nr|wydanie|press)\b") | Has(r"^(?:https?://|www\.)[^ ]+$")
short_fragment = truncated | Words(0, 2)

#: Rules that a line is judged by.
LINES = {
    "bullet": bullet, "caption": figure_caption, "synthetic": synthetic, "numbered": numbered, "truncated": truncated, "table_header": table_header, "promotional": promotional, "sponsored": sponsored,
    "artifact": layout_artifact, "heading_text": heading_text, "schema_label": schema_label, "notation_heavy": notation_heavy, "in_contents": in_contents, "scanned_heading": scanned_heading,
    "noise_title": noise_title, "weak_title": weak_title, "board_title": board_title, "signature_meta": signature_meta, "reference_entry": reference_entry, "contents_entry": contents_entry, "person": person,
    "short_fragment": short_fragment,
}
