"""Column functions over product names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions import fixed_values as fixed
from reviewlens.functions.text import basic_clean, squeeze, strip

LINE_BREAKS = r"[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _first_part(parts: Column) -> Column:
    return F.try_element_at(F.filter(parts, lambda p: F.length(p) > 0), F.lit(1))


def grouping_name(name: Column) -> Column:
    """Name used to group reviews: the first non-empty piece of a pasted-together name."""
    text = F.coalesce(name, F.lit(""))
    lines = F.replace(F.replace(text, F.lit("\\r"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    first = _first_part(F.transform(F.split(lines, ',,,|\n|"'), lambda p: F.btrim(p, F.lit(" ,"))))
    cleaned = F.btrim(squeeze(F.regexp_replace(first, r"(?i)\bAmazon\s*-\s*Amazon\b", "Amazon")), F.lit(" ,"))
    return F.coalesce(cleaned, strip(text))


def canonical_name(name: Column) -> Column:
    """Name without variants: brand phrases, sizes, colours and screen inches removed."""
    text = F.regexp_replace(basic_clean(name, keep_underscore=True), r"\bamazon\s+amazon\b", "amazon")
    text = reduce(lambda t, phrase: F.replace(t, F.lit(phrase), F.lit(" ")), fixed.CANONICAL_PHRASES, text)
    text = reduce(lambda t, pattern: F.regexp_replace(t, pattern, " "), fixed.CANONICAL_PATTERNS, text)
    return squeeze(text)


def display_name(name: Column) -> Column:
    """Name shown on cards and used for image matching."""
    text = F.coalesce(name, F.lit(""))
    lines = F.split(F.replace(F.replace(text, F.lit(",,,"), F.lit("\n")), F.lit("|"), F.lit("\n")), LINE_BREAKS)
    first = _first_part(F.transform(lines, lambda p: F.btrim(squeeze(p), F.lit(' ,-"'))))
    shown = F.coalesce(first, strip(text))
    shown = F.regexp_replace(shown, r"(?i)^amazon\s*-\s*amazon\s+", "Amazon ")
    shown = F.regexp_replace(shown, r"(?i)^amazon\s+amazon\s+", "Amazon ")
    shown = F.regexp_replace(shown, r"(?i)^amazon\s*-\s*(kindle|fire|echo)", "Amazon $1")
    shown = F.btrim(squeeze(shown), F.lit(' ,-"'))
    shown = F.replace(shown, F.lit(" Fire Hd "), F.lit(" Fire HD "))
    return F.replace(shown, F.lit(" Hd "), F.lit(" HD "))


def slug(text: Column) -> Column:
    """File-safe key of at most 80 characters."""
    runs = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.substring(runs, 1, 80), F.lit("")), F.lit("product"))


def card_key(category: Column, name: Column) -> Column:
    """Identity of a card: lower-case category and lower-case display name."""
    return F.struct(F.lower(strip(F.coalesce(category, F.lit("")))).alias("category"),
                    F.lower(display_name(name)).alias("name"))


def image_key(name: Column) -> Column:
    """Name reduced to what identifies a picture."""
    text = F.lower(display_name(name))
    text = reduce(lambda t, pattern: F.regexp_replace(t, "(?U)" + pattern, " "), fixed.IMAGE_NOISE_PATTERNS, text)
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def image_tokens(text: Column) -> Column:
    """Distinct meaningful tokens of a name for loose image matching."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(fixed.IMAGE_STOP_TOKENS)))


def style_angle(name: Column, rank: Column) -> Column:
    """Sentence picked by the sum of the code points of ``name-rank``."""
    text = F.concat(name, F.lit("-"), rank.cast("int").cast("string"))
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))))
    total = F.aggregate(codes, F.lit(0), lambda a, c: a + c)
    angles = F.array(*[F.lit(a) for a in fixed.STYLE_ANGLES])
    return F.element_at(angles, total % len(fixed.STYLE_ANGLES) + 1)
