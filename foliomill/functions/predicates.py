"""Predicates and labels of single lines, titles and links.

Each stands beside its SQL in SQL_FORMS, over a column named `x`; patterns are read alike by Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Words that lines of each kind begin or end with.
MINOR = ("the", "of", "and", "a", "in", "to", "for", "der", "de", "la")
ROLES = r"(?i)\b(editor|author|redaktor|chief|director|translator)\b"
CAPTION = r"^(?i:fig\.|figure|table|photo|rys\.|fot\.|diagram) ?[0-9]*"
PROMO = r"^(?i:subscribe|advertis|order now|special offer|only today)"
DATE = r"[0-9]{1,2}[./ ][0-9]{1,2}[./ ][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}"
SYNTHETIC = r"^(?i:chapter|section|part|appendix|page|node|item)[_ -]?[0-9]+[a-z]?$"
REFERENCES = ("references", "bibliography", "further reading", "sources", "works cited", "literature")
PLACEHOLDERS = ("", "untitled", "unknown", "document", "title", "no title")
TECHNICAL = r"(?i)(generated|converter|calibre|export|\.pdf|\.docx|[0-9a-f]{12,})"
SOURCES = ("pdf", "docx", "epub")


def _n_words(x) -> Column:
    return F.size(T.words(x))


def _capitals(x) -> Column:
    return F.size(F.filter(T.words(x), lambda w: w.rlike(r"^\p{Lu}")))


def external(x) -> Column:
    return F.lower(x).rlike("^https?://")


def page_number(x) -> Column:
    return x.rlike(r"^(?i:(page|strona|seite) )?[0-9]{1,4}$")


def figure_caption(x) -> Column:
    return x.rlike(CAPTION)


def bullet_item(x) -> Column:
    return x.rlike(r"^[•*-] +\S")


def ordered_item(x) -> Column:
    body = F.regexp_extract(x, r"^\(?[0-9]{1,3}[.)] +(.+)$", 1)
    return (F.length(body) >= 4) & (F.length(body) <= 240)


def synthetic_label(x) -> Column:
    return x.rlike(SYNTHETIC)


def truncated_heading(x) -> Column:
    last = F.lower(F.try_element_at(T.words(x), F.lit(-1)))
    return (F.length(x) <= 120) & (x.rlike(r"[/&(–—-]$") | (_n_words(x).between(2, 8) & F.coalesce(last.isin(*MINOR), F.lit(False))))


def table_header(x) -> Column:
    long_ = F.size(F.filter(T.words(x), lambda w: F.length(w) >= 4))
    return (F.length(x) >= 24) & (_n_words(x) >= 5) & (_capitals(x) >= F.when(x.contains("/"), 3).otherwise(4)) & (long_ >= 4)


def promotional(x) -> Column:
    return x.rlike(PROMO)


def author_line(x) -> Column:
    return (F.length(x) <= 90) & (x.rlike(ROLES) | (_n_words(x).between(2, 4) & (_capitals(x) == _n_words(x)) & ~x.rlike(r"[^\p{L}. '-]")))


def date_line(x) -> Column:
    return (F.length(x) <= 64) & x.rlike(DATE)


def subtitle_line(x) -> Column:
    return F.length(x).between(16, 170) & (_n_words(x) >= 3) & ~figure_caption(x) & ~x.rlike(r"\.$")


def reference_title(x) -> Column:
    low = F.lower(F.btrim(x))
    return low.isin(*REFERENCES) | low.rlike("^(" + "|".join(REFERENCES) + ")|(" + "|".join(REFERENCES) + ")$")


def definition(x) -> Column:
    return (T.count(x, r"\p{L}+ (?:–|-|:) \p{L}+") >= 2) | ((T.count(x, ";") >= 2) & x.rlike(r"\b(is|means|denotes)\b"))


def index_entry(x) -> Column:
    return T.count(x, r"\p{L}+,? [0-9]{1,4}(?:[,-] ?[0-9]{1,4})*") >= 3


def placeholder_title(x) -> Column:
    return F.lower(F.btrim(F.coalesce(x, F.lit("")))).isin(*PLACEHOLDERS) | F.coalesce(x.rlike(TECHNICAL), F.lit(False))


def narrative_tail(x) -> Column:
    return ~x.rlike(T.URL) & (_n_words(x) >= 14) & x.rlike(r"\.$") & ~((_n_words(x) <= 18) & x.rlike(r" - | / |: "))


def ambiguous_href(x) -> Column:
    host = F.lower(F.regexp_extract(x, r"^[a-z]+://([^/?#]*)", 1))
    return (F.coalesce(x, F.lit("")) == "") | (x.contains("doi") & ~x.contains("10.")) | (x.rlike("^[a-z]+://") & (~host.contains(".") | host.isin("the", "www") | host.rlike(r"\.[a-z]?$")))


def title_quality(x) -> Column:
    odd = F.length(F.regexp_replace(x, r"[\p{L}\p{N} .,:;!?'()-]", "")) / F.greatest(F.length(x), F.lit(1))
    last = F.lower(F.try_element_at(T.words(x), F.lit(-1)))
    return (
        F.when(F.coalesce(F.btrim(x), F.lit("")) == "", "missing").when(x.rlike(TECHNICAL), "technical").when(odd >= 0.04, "broken")
        .when((F.length(x) < 8) | F.coalesce(last.isin(*MINOR), F.lit(False)) | x.rlike(SYNTHETIC), "weak").otherwise("strong")
    )


def section_context(x) -> Column:
    low = F.lower(x)
    out = F.lit("body")
    for name, words in (("appendix", "appendix"), ("references", "references|bibliography|sources"), ("contents", "contents"), ("glossary", "glossary|definitions"), ("index", "index")):
        out = F.when(low.rlike(words), F.lit(name)).otherwise(out)
    return out


def toc_bucket(x) -> Column:
    low = F.lower(x)
    return F.when(low.rlike("^(cover|title|copyright|preface|foreword|contents)"), "front").when(low.rlike("(index|appendix|references|bibliography|glossary)$"), "back").otherwise("body")


def source_type(x) -> Column:
    ext = F.lower(F.regexp_extract(x, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*SOURCES), ext)


BOOLEAN = {f.__name__: f for f in (external, page_number, figure_caption, bullet_item, ordered_item, synthetic_label, truncated_heading, table_header, promotional, author_line, date_line, subtitle_line, reference_title, definition, index_entry, placeholder_title, narrative_tail, ambiguous_href)}
LABELS = {f.__name__: f for f in (title_quality, section_context, toc_bucket, source_type)}

_N = "len(ws)"
_CAPS = r"len(list_filter(ws, lambda w: regexp_matches(w, '^\p{Lu}')))"
_LAST = f"lower(ws[-1]) IN {MINOR}"
_REF = "|".join(REFERENCES)
#: The same in SQL, over columns x and ws, its words.
SQL_FORMS = {
    "external": "regexp_matches(lower(x), '^https?://')",
    "page_number": "regexp_matches(x, '^(?i:(page|strona|seite) )?[0-9]{1,4}$')",
    "figure_caption": f"regexp_matches(x, '{CAPTION}')",
    "bullet_item": r"regexp_matches(x, '^[•*-] +\S')",
    "ordered_item": r"length(regexp_extract(x, '^\(?[0-9]{1,3}[.)] +(.+)$', 1)) BETWEEN 4 AND 240",
    "synthetic_label": f"regexp_matches(x, '{SYNTHETIC}')",
    "truncated_heading": f"length(x) <= 120 AND (regexp_matches(x, '[/&(–—-]$') OR ({_N} BETWEEN 2 AND 8 AND coalesce({_LAST}, false)))",
    "table_header": f"length(x) >= 24 AND {_N} >= 5 AND {_CAPS} >= CASE WHEN contains(x, '/') THEN 3 ELSE 4 END AND len(list_filter(ws, lambda w: length(w) >= 4)) >= 4",
    "promotional": f"regexp_matches(x, '{PROMO}')",
    "author_line": rf"length(x) <= 90 AND (regexp_matches(x, '{ROLES}') OR ({_N} BETWEEN 2 AND 4 AND {_CAPS} = {_N} AND NOT regexp_matches(x, '[^\p{{L}}. ''-]')))",
    "date_line": f"length(x) <= 64 AND regexp_matches(x, '{DATE}')",
    "subtitle_line": rf"length(x) BETWEEN 16 AND 170 AND {_N} >= 3 AND NOT regexp_matches(x, '{CAPTION}') AND NOT regexp_matches(x, '\.$')",
    "reference_title": f"lower(trim(x)) IN {REFERENCES} OR regexp_matches(lower(trim(x)), '^({_REF})|({_REF})$')",
    "definition": r"len(regexp_extract_all(x, '\p{L}+ (?:–|-|:) \p{L}+')) >= 2 OR (len(regexp_extract_all(x, ';')) >= 2 AND regexp_matches(x, '\b(is|means|denotes)\b'))",
    "index_entry": r"len(regexp_extract_all(x, '\p{L}+,? [0-9]{1,4}(?:[,-] ?[0-9]{1,4})*')) >= 3",
    "placeholder_title": f"lower(trim(coalesce(x, ''))) IN {PLACEHOLDERS} OR coalesce(regexp_matches(x, '{TECHNICAL}'), false)",
    "narrative_tail": rf"NOT regexp_matches(x, '{T.URL}') AND {_N} >= 14 AND regexp_matches(x, '\.$') AND NOT ({_N} <= 18 AND regexp_matches(x, ' - | / |: '))",
    "ambiguous_href": r"coalesce(x, '') = '' OR (contains(x, 'doi') AND NOT contains(x, '10.')) OR (regexp_matches(x, '^[a-z]+://') AND (NOT contains(lower(regexp_extract(x, '^[a-z]+://([^/?#]*)', 1)), '.') OR lower(regexp_extract(x, '^[a-z]+://([^/?#]*)', 1)) IN ('the', 'www') OR regexp_matches(lower(regexp_extract(x, '^[a-z]+://([^/?#]*)', 1)), '\.[a-z]?$')))",
    "title_quality": rf"CASE WHEN coalesce(trim(x), '') = '' THEN 'missing' WHEN regexp_matches(x, '{TECHNICAL}') THEN 'technical' WHEN length(regexp_replace(x, '[\p{{L}}\p{{N}} .,:;!?''()-]', '', 'g')) / greatest(length(x), 1)::double >= 0.04 THEN 'broken' WHEN length(x) < 8 OR coalesce({_LAST}, false) OR regexp_matches(x, '{SYNTHETIC}') THEN 'weak' ELSE 'strong' END",
    "section_context": "CASE WHEN regexp_matches(lower(x), 'index') THEN 'index' WHEN regexp_matches(lower(x), 'glossary|definitions') THEN 'glossary' WHEN regexp_matches(lower(x), 'contents') THEN 'contents' WHEN regexp_matches(lower(x), 'references|bibliography|sources') THEN 'references' WHEN regexp_matches(lower(x), 'appendix') THEN 'appendix' ELSE 'body' END",
    "toc_bucket": "CASE WHEN regexp_matches(lower(x), '^(cover|title|copyright|preface|foreword|contents)') THEN 'front' WHEN regexp_matches(lower(x), '(index|appendix|references|bibliography|glossary)$') THEN 'back' ELSE 'body' END",
    "source_type": f"CASE WHEN lower(regexp_extract(x, '\\.([A-Za-z0-9]+)$', 1)) IN {SOURCES} THEN lower(regexp_extract(x, '\\.([A-Za-z0-9]+)$', 1)) END",
}
