"""Column functions over headings and page text. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sized

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII, for classes that mean the same in every engine.
WIDE = "\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
NOT_WORD = f"[^\\p{{L}}\\p{{N}}_\\s{WIDE}]"
OUTER = f"^[\\s{WIDE}]+|[\\s{WIDE}]+$"
# Characters that the evaluation drops from headings; fixed values.
DROPPED = '/“”’)("\''


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_control(x: Column | str) -> Column:
    """Drops code points of the Unicode categories C*."""
    return F.regexp_replace(_col(x), "\\p{C}", "")


def trim_chain(x: Column | str) -> Column:
    """Quotes, then line ends, then spaces are cut from both ends, in that order."""
    return F.btrim(F.btrim(F.btrim(_col(x), F.lit('"')), F.lit("\r\n")), F.lit(" "))


def not_stopword(x: Column | str, words: list[str]) -> Column:
    return ~F.lower(_col(x)).isin([w.lower() for w in words]) if words else F.lit(True)


def heading_clean(x: Column | str) -> Column:
    """The form in which headings are scored: no outer line ends, none of DROPPED; case and spaces stay."""
    return F.translate(F.btrim(_col(x), F.lit("\r\n")), DROPPED, "")


def trimmed(x: Column | str) -> Column:
    """Without outer white space, Unicode's included."""
    return F.regexp_replace(_col(x), OUTER, "")


def key_exact(x: Column | str) -> Column:
    return F.replace(F.lower(trimmed(x)), F.lit(" "), F.lit(""))


def key_loose(x: Column | str) -> Column:
    """Word characters and inner white space only, in small letters."""
    return F.lower(trimmed(F.regexp_replace(_col(x), NOT_WORD, "")))


def matches_exact(text: Column, heading: Column) -> Column:
    return F.coalesce(key_exact(text) == key_exact(heading), F.lit(False))


def keys_contain(text_key: Column, heading_key: Column, *, both_ways: bool = True) -> Column:
    """Whether one loose key contains the other. An empty text contains and matches nothing but an empty heading."""
    found = F.contains(text_key, heading_key)
    if both_ways:
        found = found | ((F.length(text_key) > 0) & F.contains(heading_key, text_key))
    return F.coalesce(found, F.lit(False))


def matches_fuzzy(text: Column, heading: Column, *, both_ways: bool = True) -> Column:
    return keys_contain(key_loose(text), key_loose(heading), both_ways=both_ways)


def safe_int(x: Column | str) -> Column:
    return trimmed(x).try_cast("int")


def within_one(a: Column, b: Column) -> Column:
    """Edit distance 0 or 1; the banded form gives -1 beyond."""
    return F.levenshtein(a, b, 1).between(0, 1)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def token_count(x: Column | str, tokenizer: Callable[[str], Sized] | None = None) -> Column:
    """Tokens of a model's tokenizer (a function that can be pickled), or words between white space without one. Null has no count with a tokenizer."""
    if tokenizer:
        return F.pandas_udf(lambda t: t.map(lambda v: None if v is None else len(tokenizer(v))).astype("Int64"), "bigint")(_col(x))
    t = trimmed(x)
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, f"[\\s{WIDE}]+")))


def squeezed(x: Column | str) -> Column:
    return F.replace(_col(x), F.lit(" "), F.lit(""))


def slug_trimmed(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(x), "[0-9]+$", ""), "_+$", "")


def slug_with_tool_quirk(x: Column | str) -> Column:
    """A file name as the converting tool's script left it: the characters . p d f cut from both ends, suffix or not."""
    return F.btrim(_col(x), F.lit(".pdf"))
