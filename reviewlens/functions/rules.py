"""Ordered rule tables compiled to native ``when`` chains and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions import fixed_values as fixed
from reviewlens.functions.lists import first_items, or_default, text_array
from reviewlens.functions.text import has_any, repeat_text


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first rule whose condition holds."""
    condition, value = rules[0]
    chain = F.when(condition, value)
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def _lower(col: Column) -> Column:
    return F.lower(F.coalesce(col, F.lit("")))


def _hit(text: Column, terms: list[str], excluded: list[str]) -> Column:
    hit = has_any(text, terms)
    return hit & ~has_any(text, excluded) if excluded else hit


def product_family(name: Column) -> Column:
    text = _lower(name)
    return first_match([(_hit(text, terms, excluded), F.lit(family))
                        for terms, excluded, family in fixed.FAMILY_RULES], F.lit(fixed.FAMILY_DEFAULT))


def structured_tokens(name: Column) -> Column:
    """Family token followed by the helper tokens whose word is in the name, each once."""
    text = _lower(name)
    tokens = [F.when(F.contains(text, F.lit(word)), F.lit(token)) for word, token in fixed.WORD_TOKENS]
    return F.array_join(F.array_distinct(F.array_compact(F.array(product_family(name), *tokens))), " ")


def identity_text(family: Column, tokens: Column) -> Column:
    """Text that describes a product by its name only, family weighted over tokens."""
    return F.concat_ws(" ", repeat_text(family, 100), repeat_text(tokens, 20))


def taxonomy(name: Column, category: Column, cluster_id: Column) -> Column:
    """Struct (corrected_category, correction_reason) of the first taxonomy rule that fits."""
    name_text = _lower(name)
    both = F.concat(name_text, F.lit(" "), _lower(category))
    texts = {"name": name_text, "both": both}

    def outcome(label: Column, reason: str) -> Column:
        return F.struct(label.alias("corrected_category"), F.lit(reason).alias("correction_reason"))

    return first_match(
        [(_hit(texts[where], terms, excluded), outcome(F.lit(label), reason))
         for where, terms, excluded, label, reason in fixed.TAXONOMY_RULES],
        outcome(F.concat(F.lit("Cluster "), cluster_id.cast("string")), fixed.TAXONOMY_DEFAULT_REASON))


def product_type(category: Column, name: Column) -> Column:
    texts = {"category": _lower(category),
             "both": F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(name, F.lit(""))))}
    return first_match([(has_any(texts[where], terms), F.lit(kind))
                        for where, terms, kind in fixed.PRODUCT_TYPE_RULES], F.lit(fixed.PRODUCT_TYPE_DEFAULT))


def fitting_strengths(name: Column, kind: Column, strengths: Column) -> Column:
    """At most four strengths that make sense for the product."""
    text = _lower(name)
    listed = or_default(strengths, fixed.NO_STRENGTHS)
    no_screen = (kind == "smart speaker product") & ~has_any(text, fixed.SCREEN_NAME_WORDS)
    battery = F.filter(listed, lambda s: s.isin(fixed.BATTERY_STRENGTHS))
    accessory = F.filter(listed, lambda s: ~has_any(F.lower(s), fixed.ACCESSORY_BLOCKED_STRENGTHS))
    other = F.filter(listed, lambda s: ~(no_screen & has_any(F.lower(s), fixed.SCREEN_THEME_WORDS)))
    return first_items(
        F.when(has_any(text, fixed.BATTERY_WORDS), or_default(battery, fixed.NO_BATTERY_STRENGTHS))
        .when(kind == "electronic accessory", or_default(accessory, fixed.NO_ACCESSORY_STRENGTHS))
        .otherwise(or_default(other, fixed.NO_STRENGTHS)), 4)


def fitting_concerns(name: Column, kind: Column, concerns: Column) -> Column:
    """At most four concerns that make sense for the product."""
    text = _lower(name)
    listed = or_default(concerns, fixed.NO_CONCERNS)
    battery = F.filter(listed, lambda s: s.isin(fixed.BATTERY_CONCERNS))
    accessory = F.filter(listed, lambda s: ~has_any(F.lower(s), fixed.ACCESSORY_BLOCKED_CONCERNS))
    return first_items(
        F.when(has_any(text, fixed.BATTERY_WORDS), or_default(battery, fixed.NO_BATTERY_CONCERNS))
        .when(kind == "electronic accessory", or_default(accessory, fixed.NO_ACCESSORY_CONCERNS))
        .otherwise(listed), 4)


def theme_hits(text: Column, themes: dict[str, list[str]]) -> list[tuple[str, Column]]:
    """(theme, text mentions it) for every theme, in rule order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return [(theme, has_any(lowered, words)) for theme, words in themes.items()]


def themes_from_flags(flags: list[tuple[str, Column]], limit: int = 4) -> Column:
    """The first ``limit`` themes whose flag is true, in rule order."""
    named = [F.when(flag, F.lit(theme)) for theme, flag in flags]
    return first_items(F.array_compact(F.array(*named)), limit)


def comparison_notes(review_count: Column, average_rating: Column, negative_share: Column,
                     mid_count: Column, mid_rating: Column, mid_negative: Column) -> Column:
    """Three sentences that place a product against the medians of its category."""
    def note(kind: str, condition: Column) -> Column:
        yes, no = fixed.COMPARISON_NOTES[kind]
        return F.when(condition, F.lit(yes)).otherwise(F.lit(no))

    return F.array(note("volume", review_count >= mid_count),
                   note("rating", average_rating >= mid_rating),
                   note("risk", negative_share >= mid_negative))


__all__ = ["first_match", "product_family", "structured_tokens", "identity_text", "taxonomy", "product_type",
           "fitting_strengths", "fitting_concerns", "theme_hits", "themes_from_flags", "comparison_notes",
           "text_array"]
