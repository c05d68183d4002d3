"""Text column functions.  All are native Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# White space of every script; ``\s`` alone is ASCII only.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: The same characters, one by one.
SPACES = "".join(map(chr, [*range(0x9, 0xe), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))


def squeeze(col: Column) -> Column:
    """Collapse every run of white space to one space and strip both ends."""
    return F.trim(F.regexp_replace(col, f"{SPACE}+", " "))


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` alone removes only spaces).

    Only the ends are looked at: a pattern would be tried at every run of white space of a text.
    """
    return F.trim(col, F.lit(SPACES))


def clean_words(col: Column, keep_underscore: bool = False) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9_']+)" if keep_underscore else "([a-z0-9']+)"), F.lit(1))


def basic_clean(col: Column, keep_underscore: bool = False) -> Column:
    """Lower-case; everything but ASCII letters, digits and apostrophes separates words, which are joined by one space."""
    return F.array_join(clean_words(col, keep_underscore), " ")


def raw_tokens(col: Column) -> Column:
    """The text as it is; the tokeniser lower-cases it later."""
    return col.cast("string")


def repeat_text(col: Column, times: int) -> Column:
    """The stripped text ``times`` times, space separated; blank and ``nan`` give an empty string."""
    text = strip(F.coalesce(col, F.lit("")))
    return F.when((text == "") | (F.lower(text) == "nan"), F.lit("")).otherwise(
        F.array_join(F.array_repeat(text, times), " "))


def has_any(text: Column, terms: list[str]) -> Column:
    """True when any term occurs in the text as a substring (``cat`` hits ``education``)."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))


def has_all(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(t)) for t in terms], F.lit(True))


def paragraphs(col: Column) -> Column:
    """Split on blank lines, strip each paragraph, drop the empty ones."""
    parts = F.split(F.coalesce(col, F.lit("")), r"\n\s*\n+")
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) > 0)


def word_tokens(col: Column) -> Column:
    """Lower-case runs of at least two word characters of any script."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"({WORD_PATTERN})"), F.lit(1))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All word n-grams with ``low`` to ``high`` words, joined by one space.

    Each length is built from the one below by zipping two whole arrays; picking
    words one position at a time would copy the array for every position.
    """
    grams, found = tokens, []
    for n in range(1, high + 1):
        if n > 1:
            count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
            grams = F.zip_with(F.slice(grams, F.lit(1), count), F.slice(tokens, F.lit(n), count),
                               lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= low:
            found.append(grams)
    return F.concat(*found)


# Text preparations that need nothing but the row.  Stemming and lemmatising go
# through operators.features.normalize_tokens, which joins a token table.
PREPROCESSORS = {"raw_tokens": raw_tokens, "basic_clean": basic_clean}
