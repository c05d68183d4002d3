"""Product cards: prompt, completion, parsing, template fallback and assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions import fixed_values as fixed
from reviewlens.functions import names, rules
from reviewlens.functions.lists import first_items, pretty_json, safe_list
from reviewlens.functions.numbers import fixed as fixed_digits
from reviewlens.functions.numbers import grouped, round_exact
from reviewlens.functions.text import has_any, strip
from reviewlens.operators.evidence import with_comparison_notes
from reviewlens.operators.ordering import ranked, top_per_group

FAILED = "generation failed"

# Our own wording: one style example per product type and the instructions around it.
STYLE_EXAMPLES = {
    "smart speaker product": (
        "HEADLINE: A Speaker That Fits Right In\n\nSUMMARY:\nThree short paragraphs: who it suits and the review "
        "numbers; what owners like about sound and setup; what they complain about and a careful verdict.\n\n"
        "BEST_FOR: Homes that want a simple voice speaker.\n\nPROS:\n- Quick setup\n\nCONS:\n- Connection trouble"),
    "tablet": (
        "HEADLINE: A Plain Tablet For Every Day\n\nSUMMARY:\nThree short paragraphs: who it suits and the review "
        "numbers; what owners like about screen and ease; what they complain about and a careful verdict.\n\n"
        "BEST_FOR: Families that need one easy tablet.\n\nPROS:\n- Clear screen\n\nCONS:\n- Limited apps"),
    "e-reader": (
        "HEADLINE: A Quiet Companion For Readers\n\nSUMMARY:\nThree short paragraphs: who it suits and the review "
        "numbers; what owners like about reading on it; what they complain about and a careful verdict.\n\n"
        "BEST_FOR: Readers who want nothing but books.\n\nPROS:\n- Light to hold\n\nCONS:\n- Battery worries"),
    "other": (
        "HEADLINE: A Handy Thing To Have Around\n\nSUMMARY:\nThree short paragraphs: who it suits and the review "
        "numbers; what owners use it for; what they complain about and a careful verdict.\n\n"
        "BEST_FOR: Buyers who need a basic helper.\n\nPROS:\n- Does its job\n\nCONS:\n- Some faulty units"),
}
PROMPT_PARTS = (
    "Write a friendly product review for shoppers from the evidence below. Use only the evidence.\n"
    "Answer with these labels and nothing else: HEADLINE, SUMMARY (three paragraphs), BEST_FOR, "
    "PROS (up to three bullets), CONS (up to three bullets). State the review numbers once, with the "
    "required sentence, in the first paragraph. When the evidence strength is Low, say so.",
    "Style example, not content:",
    "Required sentence:",
    "Evidence:",
)


def card_facts(products: DataFrame, medians_of: DataFrame | None = None) -> DataFrame:
    """Add display name, product type, fitting strengths and concerns, and comparison notes."""
    named = (products
             .withColumn("display_name", names.display_name(F.col("product_name")))
             .withColumn("product_type", rules.product_type(F.col("corrected_category"), F.col("display_name"))))
    name, kind = F.col("display_name"), F.col("product_type")
    fitted = (named
              .withColumn("main_strengths", rules.fitting_strengths(name, kind, F.col("strengths")))
              .withColumn("main_concerns", rules.fitting_concerns(name, kind, F.col("concerns"))))
    return with_comparison_notes(fitted, medians_of if medians_of is not None else products)


def fill(pattern: str, *parts: Column) -> Column:
    """Text of a ``%s`` pattern; ``%%`` is a percent sign."""
    pieces = [p.replace("%%", "%") for p in pattern.split("%s")]
    columns = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:], strict=True):
        columns += [part, F.lit(piece)]
    return F.concat(*columns)


def evidence_sentence() -> Column:
    return fill(fixed.EVIDENCE_SENTENCE, grouped(F.col("review_count")), fixed_digits(F.col("average_rating"), 2),
                fixed_digits(F.col("positive_share"), 1))


def compact_evidence() -> Column:
    """Struct of the thirteen facts a card may state."""
    return F.struct(
        F.col("display_name").alias("product_name"),
        F.col("corrected_category").alias("category"),
        F.col("product_type"),
        grouped(F.col("review_count")).alias("review_count"),
        F.concat(fixed_digits(F.col("average_rating"), 2), F.lit("/5")).alias("average_rating"),
        F.concat(fixed_digits(F.col("positive_share"), 1), F.lit("%")).alias("positive_review_share"),
        F.concat(fixed_digits(F.col("negative_share"), 1), F.lit("%")).alias("negative_review_share"),
        F.col("evidence_strength"),
        first_items(F.col("main_strengths"), 4).alias("main_strengths"),
        first_items(F.col("main_concerns"), 4).alias("main_concerns"),
        F.col("comparison_notes"),
        F.lit(fixed.RECOMMENDATION).alias("recommendation"),
        names.style_angle(F.col("display_name"), F.col("rank")).alias("style_angle"))


def style_example(kind: Column) -> Column:
    chain = F.lit(STYLE_EXAMPLES["other"])
    for name, text in STYLE_EXAMPLES.items():
        chain = F.when(kind == name, F.lit(text)).otherwise(chain) if name != "other" else chain
    return chain


def prompt_file() -> Column:
    return F.concat(names.slug(F.col("corrected_category")), F.lit("_"), names.slug(F.col("display_name")),
                    F.lit("_prompt.txt"))


def with_prompts(facts: DataFrame) -> DataFrame:
    """Add the prompt text and its file key."""
    task, style, sentence, evidence = PROMPT_PARTS
    prompt = F.concat_ws("\n\n", F.lit(task), F.lit(style), style_example(F.col("product_type")),
                         F.lit(sentence), evidence_sentence(), F.lit(evidence), pretty_json(compact_evidence()))
    return facts.withColumn("prompt", prompt).withColumn("prompt_file", prompt_file())


def complete(prompted: DataFrame, generate: Callable[[pd.Series], pd.Series], id_cols: list[str],
             prompt: str = "prompt", out: str = "completion") -> DataFrame:
    """Text completion of every prompt by a caller's function, one Arrow batch at a time.

    ``generate`` gets a batch of prompts and returns one text each.  When a batch raises, its prompts are
    tried one by one; an exception then becomes that prompt's text, which starts like a failure, so that
    card assembly falls back.
    """
    chosen = prompted.select(*id_cols, prompt)

    def one(single: pd.Series) -> str:
        try:
            return list(generate(single))[0]
        except Exception as error:
            return f"{FAILED}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                texts = list(generate(batch[prompt]))
            except Exception:  # the service is the caller's: find the prompts that fail, do not fail the job
                texts = [one(batch[prompt].iloc[i:i + 1]) for i in range(len(batch))]
            yield batch[id_cols].assign(**{out: texts})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name in id_cols]
                       + [f"`{out}` string"])
    return chosen.mapInPandas(run, schema)


def parse_cards(completions: DataFrame, id_col: str, text_col: str = "completion") -> DataFrame:
    """Labelled text to card fields.

    The label of a line carries on to the lines below it, until the next label.
    All lines of one text stay together; the state never spans two texts.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), names.LINE_BREAKS.replace("[", "\r\n|[", 1))
    rows = completions.select(id_col, F.posexplode(lines).alias("pos", "line")).withColumn("bare", strip(F.col("line")))
    own = F.lit(None).cast("string")
    for label in ["CONS", "PROS", "BEST_FOR", "SUMMARY", "HEADLINE"]:
        own = F.when(F.startswith("bare", F.lit(f"{label}:")), F.lit(label)).otherwise(own)
    above = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("own", own).withColumn("label", F.last("own", ignorenulls=True).over(above))
    content, bullet = F.col("own").isNull(), F.startswith("bare", F.lit("-"))

    def last_of(label: str) -> Column:
        value = strip(F.replace(F.col("bare"), F.lit(f"{label}:"), F.lit("")))
        return F.coalesce(F.max_by(value, F.when(F.col("own") == label, F.col("pos"))), F.lit(""))

    def ordered(condition: Column, value: Column) -> Column:
        items = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", value.alias("x")))))
        return F.transform(items, lambda i: i["x"])

    def bullets(label: str) -> Column:
        item = strip(F.expr("substring(bare, 2)"))
        return F.slice(ordered(content & bullet & (F.col("label") == label), item), 1, 3)

    summary = F.array_join(ordered(content & (F.col("label") == "SUMMARY"), F.col("line")), "\n")
    return marked.groupBy(id_col).agg(
        last_of("HEADLINE").alias("headline"), strip(summary).alias("summary"), last_of("BEST_FOR").alias("best_for"),
        bullets("PROS").alias("pros"), bullets("CONS").alias("cons"))


def _listed(col: Column) -> Column:
    return F.array_join(first_items(col, 3), ", ")


def template_card() -> Column:
    """Struct of a card written from the facts alone."""
    card = fixed.TEMPLATE_CARD
    summary = fill(card["summary"], F.col("display_name"), F.col("product_type"), F.col("corrected_category"),
                   grouped(F.col("review_count")), fixed_digits(F.col("average_rating"), 2),
                   fixed_digits(F.col("positive_share"), 1), _listed(F.col("main_strengths")),
                   _listed(F.col("main_concerns")), F.array_join("comparison_notes", "; "))
    return F.struct(F.lit(card["headline"]).alias("headline"), summary.alias("summary"),
                    F.lit(card["best_for"]).alias("best_for"),
                    first_items(F.col("main_strengths"), 3).alias("pros"),
                    first_items(F.col("main_concerns"), 3).alias("cons"),
                    F.lit(card["source"]).alias("source"))


def choose_card(facts: DataFrame, parsed: DataFrame | None, id_col: str, source: str = "generated",
                text_col: str = "completion") -> DataFrame:
    """Add the struct ``card``: the parsed one, or the template when it has no summary or failed.

    ``parsed`` has the parsed fields and the completion per ``id_col``; products
    without a completion get the template.
    """
    if parsed is None:
        return facts.withColumn("card", template_card()).withColumn("llm_error", F.lit(None).cast("string"))
    fields = ["headline", "summary", "best_for", "pros", "cons"]
    joined = facts.join(parsed.select(id_col, *[F.col(c).alias(f"_{c}") for c in fields],
                                      F.col(text_col).alias("_raw")), id_col, "left")
    usable = F.coalesce((F.length("_summary") > 0) & ~F.startswith("_raw", F.lit(FAILED)), F.lit(False))
    own = F.struct(*[F.col(f"_{c}").alias(c) for c in fields], F.lit(source).alias("source"))
    return (joined.withColumn("card", F.when(usable, own).otherwise(template_card()))
            .withColumn("llm_error", F.when(~usable, F.col("_raw")))
            .drop("_raw", *[f"_{c}" for c in fields]))


def assemble_cards(chosen: DataFrame) -> DataFrame:
    """Card fields and the seventeen evidence columns with their fixed rounding."""
    rounded = {"average_rating": 3, "positive_share": 1, "negative_share": 1, "trust_score": 1, "rating_score": 3,
               "review_volume_score": 3, "positive_sentiment_score": 3, "risk_control_score": 3}
    return chosen.select(
        "card.headline", "card.summary", "card.best_for", "card.pros", "card.cons", "card.source", "llm_error",
        F.col("corrected_category").alias("category"), "rank", F.col("display_name").alias("name"),
        F.col("product_name").alias("raw_product_name"), "review_count",
        *[round_exact(F.col(c), d).alias(c) for c, d in rounded.items()],
        "evidence_strength", "cluster_id", F.coalesce("product_family", F.lit("")).alias("product_family"),
        prompt_file().alias("prompt_file"))


def strongest_per_name(products: DataFrame) -> DataFrame:
    """One product per category and display name, the one with the best score, then most reviews."""
    named = products.withColumn("display_name", names.display_name(F.col("product_name")))
    return top_per_group(named, ["corrected_category", "display_name"],
                         [F.col("rank_score").desc(), F.col("review_count").desc(), F.col("product_name").asc()], 1)


def missing_cards(products: DataFrame, cards: DataFrame) -> DataFrame:
    """Products whose (category, display name) has no card yet."""
    have = cards.select(names.card_key(F.col("category"), F.col("name")).alias("_key")).distinct()
    wanted = products.withColumn("_key", names.card_key(F.col("corrected_category"), F.col("product_name")))
    return wanted.join(have, "_key", "left_anti").drop("_key")


def select_products(products: DataFrame, sample: int | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Products to write cards for: de-duplicated, ranked again, limited, without existing cards."""
    order = [F.col("rank_score").desc(), F.col("display_name").asc()]
    chosen = ranked(strongest_per_name(products).drop("rank"), ["corrected_category"], order)
    if sample:
        chosen = chosen.orderBy("corrected_category", "rank").limit(sample)
    return missing_cards(chosen, existing) if existing is not None else chosen


def append_cards(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def build_cards(products: DataFrame, generate: Callable[[pd.Series], pd.Series] | None = None,
                sample: int | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Evidence table to finished cards; medians come from all products, cards from the selected ones."""
    facts = card_facts(select_products(products, sample, existing), products)
    if generate is None:
        return assemble_cards(choose_card(facts, None, "product_name"))
    texts = complete(with_prompts(facts), generate, ["product_name"])
    parsed = parse_cards(texts, "product_name").join(texts, "product_name")
    return assemble_cards(choose_card(facts, parsed, "product_name"))


def review_text() -> Column:
    """Summary shown for a card, or a plain sentence when it is too short or holds page markup."""
    summary = strip(F.coalesce(F.col("summary"), F.lit("")))

    def listed(column: str, default: str) -> Column:
        return F.when(F.size(safe_list(F.col(column))) > 0, _listed(F.col(column))).otherwise(F.lit(default))

    fallback = fill(
        fixed.FALLBACK_REVIEW, names.display_name(F.col("name")), grouped(F.col("review_count")),
        fixed_digits(F.col("average_rating"), 2), fixed_digits(F.col("positive_share"), 1),
        listed("pros", fixed.FALLBACK_PROS), listed("cons", fixed.FALLBACK_CONS))
    broken = (F.length(summary) < 40) | has_any(summary, fixed.BROKEN_SUMMARY_MARKS)
    return F.when(broken, fallback).otherwise(summary)
