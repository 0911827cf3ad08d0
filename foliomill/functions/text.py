"""Text functions, Column to Column.

Patterns keep to classes that Java and RE2 read alike, so that each has an SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of tokens that stand for a source of their own kind and are never rewritten.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
VERSION = r"[vV]?[0-9]+\.[0-9]+\.[0-9]+"
URL = r"(?:https?://|www\.)[^ \n\t<>]+"
DOI = r"10\.[0-9]{4,9}/[^ \n\t]+"
PUNCTUATION = ",.;:!?"
UNITS = ("kg", "cm", "mm", "km", "ml", "GB", "MB")
#: Letters with diacritics and what they fold to.
FOLD_FROM, FOLD_TO = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿąćęńśźż", "aaaaaaceeeeiiiinooooouuuuyyacenszz"
#: Letters whose capital is one letter although Java writes two.
ONE_FROM, ONE_TO = "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ"


def trim_space(x) -> Column:
    """Without spaces, tabs and carriage returns at either end."""
    return F.btrim(x, F.lit(" \t\r"))


def squeeze(x) -> Column:
    """White space as single spaces, none at the ends.  Single spaces are left alone, which are most of it."""
    return F.btrim(F.regexp_replace(x, r"[ \t\r\n](?:(?<! )[ \t\r\n]*|[ \t\r\n]+)", " "))


def words(x) -> Column:
    return F.filter(F.split(squeeze(x), " "), lambda w: w != "")


def capitalise(x) -> Column:
    """The first character as a capital, one for one as in SQL: one without a single capital stays."""
    first, up = F.substring(x, 1, 1), F.upper(F.substring(x, 1, 1))
    return F.concat(F.when(F.length(up) == 1, up).otherwise(F.translate(first, ONE_FROM, ONE_TO)), F.substr(x, F.lit(2)))


def letters_only(x) -> Column:
    """Words of letters, as they are."""
    return F.regexp_extract_all(x, F.lit(r"\p{L}+"), 0)


def fold_diacritics(x) -> Column:
    return F.translate(x, FOLD_FROM, FOLD_TO)


def match_key(x) -> Column:
    """Key for comparing titles: lower case, everything but letters and digits gone."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def slug(x) -> Column:
    """Lower case, folded, runs of other characters as one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(fold_diacritics(F.lower(x)), r"[^a-z0-9]+", "-"), F.lit("-"))


def class_key(x) -> Column:
    """Key of a document class: spaces, hyphens and slashes as single underscores."""
    return F.btrim(F.regexp_replace(F.lower(F.btrim(F.coalesce(x, F.lit("")))), r"[ \-/\\_]+", "_"), F.lit("_"))


def count(x, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(pattern), 0)).cast("long")


def close_up_punctuation(x) -> Column:
    """No space before a punctuation mark."""
    return F.regexp_replace(x, r"[ ]+([,.;:!?])", "$1")


def space_sentences(x) -> Column:
    """A space after a sentence's end that runs into the next capital."""
    return F.regexp_replace(x, r"[.!?](?<=\p{Ll}.)(?=\p{Lu})", "$0 ")


def close_up_percent(x) -> Column:
    """`12 %` as `12%`, and a decimal split from its fraction, `3, 5%`, as `3,5%`."""
    return F.regexp_replace(x, r"([0-9])(?:([,.]) ([0-9]+) ?| +)%", "$1$2$3%")


def close_up_units(x) -> Column:
    return F.regexp_replace(x, r"([0-9]) +(" + "|".join(UNITS) + r")\b", "$1$2")


def join_hyphenated(x) -> Column:
    """A word that a line's end broke, put together."""
    return F.regexp_replace(x, r"(\p{Ll})- (\p{Ll})", "$1$2")


def split_camel(x) -> Column:
    """A space where a lower-case letter runs into a capital."""
    return F.regexp_replace(x, r"(\p{Ll})(\p{Lu})", "$1 $2")


def has_email(x) -> Column:
    """The pattern begins with an open class and is slow to fail, so the sign is looked for first."""
    return F.contains(x, F.lit("@")) & x.rlike(EMAIL)


def count_emails(x) -> Column:
    return F.when(F.contains(x, F.lit("@")), count(x, EMAIL)).when(x.isNotNull(), F.lit(0).cast("long"))


def strip_emails(x) -> Column:
    return squeeze(F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, EMAIL, "")).otherwise(x))


def capital_share(x) -> Column:
    """Share of words that begin with a capital; null without words."""
    return F.size(F.filter(words(x), lambda w: w.rlike(r"^\p{Lu}"))) / F.nullif(F.size(words(x)), F.lit(0))


def looks_like_heading(x) -> Column:
    """Short, no sentence's end, mostly capitalised words."""
    return (F.length(x) <= 90) & (F.size(words(x)) <= 12) & ~x.rlike(r"[.!?;:,]$") & (F.coalesce(capital_share(x), F.lit(0.0)) >= 0.55)
