"""Numeric column functions with the rounding rules the reports rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions.fixed_values import CLASSES


def coerce_number(col: Column) -> Column:
    """Number of a text column; anything that is not a plain decimal number gives null."""
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def weak_label(rating: Column) -> Column:
    """Sentiment class of a rating: up to 2 negative, exactly 3 neutral, all else positive."""
    return F.when(rating <= 2, "negative").when(rating == 3, "neutral").otherwise("positive")


def label_id(label: Column) -> Column:
    """Fixed class number; unknown labels give null."""
    mapping = F.create_map(*[x for i, c in enumerate(CLASSES) for x in (F.lit(c), F.lit(float(i)))])
    return F.try_element_at(mapping, label)


def id_label(col: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in CLASSES]), col.cast("int") + 1)


def clip01(col: Column) -> Column:
    """Clip to [0, 1]; null stays null (least and greatest alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col)))


def round_even(col: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the array-library rounding."""
    scale = float(10 ** digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def fixed(col: Column, digits: int, grouping: bool = False) -> Column:
    """Text with a fixed number of decimals, rounded half to even on the exact value."""
    text = F.format_number(col.cast("double"), digits)
    return text if grouping else F.regexp_replace(text, ",", "")


def round_exact(col: Column, digits: int) -> Column:
    """Round half to even on the exact decimal value of the double: the language rounding."""
    return fixed(col, digits).cast("double")


def grouped(col: Column) -> Column:
    """Integer with thousands separators."""
    return F.format_number(col.cast("bigint"), 0)


def log_count(col: Column) -> Column:
    return F.log(col + F.lit(1.0))


def evidence_strength(count: Column) -> Column:
    return F.when(count >= 100, "High").when(count >= 30, "Medium").otherwise("Low")


def evidence_tier(strength: Column) -> Column:
    return F.when(strength == "High", 3).when(strength == "Medium", 2).when(strength == "Low", 1).otherwise(0)


def pick_label(rank: Column) -> Column:
    return (F.when(rank == 1, "Top pick").when(rank == 2, "Runner-up").when(rank == 3, "Also consider")
            .otherwise(F.concat(F.lit("Rank "), rank.cast("int").cast("string"))))
