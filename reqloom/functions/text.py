"""Native column functions on text: trimming, word lists, identifiers and escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqloom.functions import vocab

#: White space in the Unicode sense, and what counts as part of a word, for use inside a character class.
SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"


def alternatives(markers) -> str:
    """Alternation of literal markers, longest first."""
    return "|".join(re.sub(r"([.\\+*?()|\[\]{}^$])", r"\\\1", m) for m in sorted(markers, key=len, reverse=True))


def marker_pattern(markers) -> str | None:
    """Markers as whole words, whatever their case; None without any."""
    return rf"(?i)(?<![{WORD}'])({alternatives(markers)})(?![{WORD}'])" if markers else None


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(rf"[^{SPACE}]")


def normal_words(c: Column, stop=vocab.SET_STOP) -> Column:
    """Words (a-z, 0-9) of the lower-cased text without stop words, in order."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stop))


def normal_text(c: Column, stop=vocab.SET_STOP) -> Column:
    return F.array_join(normal_words(c, stop), " ")


def normal_req_id(c: Column) -> Column:
    """Requirement ids for comparison: upper case without white space and underscores."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), rf"[{SPACE}_]+", "")


def safe_name(c: Column, prefix: str = "n_", empty: str = "n") -> Column:
    """Letters, digits and underscores only; prefixed where it would start with a digit, ``empty`` where nothing is left."""
    s = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.when(s == "", F.lit(empty)).when(s.rlike("^[0-9]"), F.concat(F.lit(prefix), s)).otherwise(s)


def column_name(name: str) -> str:
    """Normalised name of an input column."""
    return re.sub(r"[\s\-]+", "_", name.strip().lower())


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_turtle(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_dot(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_mermaid(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" ")))


def shorten(c: Column, most: int, tail: str) -> Column:
    """At most ``most`` characters, the last ones replaced by ``tail`` where it is longer."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit(tail))).otherwise(c)
