"""Products: aggregation of reviews, evidence, trust score and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import fixed_values as fixed
from reviewlens.functions import names, rules
from reviewlens.functions.numbers import clip01, evidence_strength, log_count, round_even
from reviewlens.functions.text import has_any
from reviewlens.operators.ordering import exact_quantiles, ranked
from reviewlens.runtime import materialise


def share(condition: Column) -> Column:
    """Percentage of the rows that fulfil a condition; 0 when none does."""
    return F.lit(100.0) * F.count_if(condition) / F.count("*")


def product_table(reviews: DataFrame, order: Column) -> DataFrame:
    """One row per product name with its identity text.

    ``category`` and ``original_product_name`` are the first non-null ones in
    ``order``.  Review texts are not joined into one string per product; their
    terms are counted in long form instead (operators.features.term_counts).
    """
    def first(column: str) -> Column:
        return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), order))

    grouped = reviews.groupBy("product_name").agg(
        first("category_text").alias("category"),
        first("original_product_name").alias("original_product_name"),
        F.count("*").alias("review_rows"))
    return with_identity(grouped)


def with_identity(products: DataFrame) -> DataFrame:
    """Add canonical name, family, helper tokens and identity text."""
    name = F.col("product_name")
    return (products
            .withColumn("canonical_product_name", names.canonical_name(name))
            .withColumn("product_family", rules.product_family(name))
            .withColumn("structured_tokens", rules.structured_tokens(name))
            .withColumn("after_text", rules.identity_text(F.col("product_family"), F.col("structured_tokens"))))


def noisy_text(nan_literal: bool = False) -> Column:
    """Name, category, title and text of a review in one string.

    ``nan_literal`` writes missing parts as the word ``nan``.
    """
    missing = F.lit("nan" if nan_literal else "")
    return F.concat_ws(" ", *[F.coalesce(F.col(c), missing)
                              for c in ["product_name", "category_text", "review_title", "review_text"]])


def review_evidence(reviews: DataFrame) -> DataFrame:
    """Counts, rating, sentiment shares and themes of every product in one aggregate.

    Every measure is a count, sum or boolean maximum, so the rows of a popular
    product are combined inside each task and no text is ever collected.
    """
    sentiment, label = F.col("predicted_sentiment"), F.col("label")
    plans = {"strengths": ("positive", fixed.STRENGTH_THEMES), "concerns": ("negative", fixed.CONCERN_THEMES)}
    flags, finished = [], {}
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    for column, (wanted, themes) in plans.items():
        named = []
        for number, (theme, words) in enumerate(themes.items()):
            flag = f"_{column}_{number}"
            flags.append(F.bool_or((sentiment == wanted) & has_any(text, words)).alias(flag))
            named.append((theme, F.col(flag)))
        finished[column] = rules.themes_from_flags(named)

    measured = reviews.groupBy("product_name").agg(
        F.count("*").alias("review_count"),
        F.avg("rating").alias("average_rating"),
        share(sentiment == "positive").alias("positive_share"),
        share(sentiment == "neutral").alias("neutral_share"),
        share(sentiment == "negative").alias("negative_share"),
        share(label == "positive").alias("rating_positive_share"),
        *flags)
    return measured.select(
        "product_name", "review_count", "average_rating", "positive_share", "neutral_share", "negative_share",
        "rating_positive_share", *[expr.alias(c) for c, expr in finished.items()])


#: Place of a row in the files of a taxonomy.
TAXONOMY_ORDER = "taxonomy_ord"


def join_taxonomy(evidence: DataFrame, taxonomy: DataFrame, join_key: str = "raw", order: str | None = None) -> DataFrame:
    """Keep the products with a taxonomy row; the first row per name in column ``order`` counts.

    A table has no first row of its own: without ``order`` the smallest row is taken.
    ``raw`` joins on the name as written, ``clean`` on the grouping name.  Both
    sides hold products, not reviews; the join strategy is chosen from run-time sizes.
    """
    columns = ["cluster_id", "corrected_category", "product_family", "correction_reason"]
    row = F.struct("cluster_id", "corrected_category", "product_family", "correction_reason")
    unique = taxonomy.groupBy("product_name").agg(
        (F.min(row) if order is None else F.min_by(row, order)).alias("t")).select(
        F.col("product_name").alias("_name"), *[F.col(f"t.{c}") for c in columns])
    key = F.col("product_name") if join_key == "raw" else names.grouping_name(F.col("product_name"))
    return evidence.withColumn("_key", key).join(unique, F.col("_key") == F.col("_name")).drop("_key", "_name")


def trust_score(products: DataFrame) -> DataFrame:
    """Evidence strength, four component scores and the weighted trust score.

    Volume is scaled between the smallest and largest log count of all rows; the
    limits are one scalar subquery, not a join and not a one-partition window.
    """
    volume = log_count(F.col("review_count"))
    limits = products.agg(F.struct(F.min(volume).alias("low"), F.max(volume).alias("high"))).scalar()
    low, high = F.col("_limits.low"), F.col("_limits.high")
    scored = (products
              .withColumn("evidence_strength", evidence_strength(F.col("review_count")))
              .withColumn("_limits", limits)
              .withColumn("review_volume_score",
                          F.when(high > low, (volume - low) / (high - low)).otherwise(1.0))
              .drop("_limits")
              .withColumn("rating_score", clip01(F.col("average_rating") / 5))
              .withColumn("positive_sentiment_score", clip01(F.col("positive_share") / 100))
              .withColumn("risk_control_score", clip01(1 - F.col("negative_share") / 100)))
    total = (40 * F.col("rating_score") + 30 * F.col("review_volume_score")
             + 20 * F.col("positive_sentiment_score") + 10 * F.col("risk_control_score"))
    return scored.withColumn("trust_score", round_even(total, 1)).withColumn("rank_score", F.col("trust_score"))


def rank_in_category(products: DataFrame) -> DataFrame:
    """Number the products of each category by score; the name settles ties."""
    return ranked(products, ["corrected_category"], [F.col("rank_score").desc(), F.col("product_name").asc()])


def product_evidence(reviews: DataFrame, taxonomy: DataFrame, join_key: str = "raw", order: str | None = None) -> DataFrame:
    """Scored reviews and taxonomy to the ranked evidence table.

    Of several taxonomy rows with one name the first in column ``order`` counts; a taxonomy read back
    from files brings that column (``taxonomy_ord``) and needs no other.
    The aggregated products are written once, so the reviews are scanned once
    although score limits, ranks and rows all read the products.
    """
    if order is None and TAXONOMY_ORDER in taxonomy.columns:
        order = TAXONOMY_ORDER
    products = materialise(join_taxonomy(review_evidence(reviews), taxonomy, join_key, order))
    return rank_in_category(trust_score(products))


def category_medians(products: DataFrame) -> DataFrame:
    """Exact medians per category of the three compared measures."""
    return exact_quantiles(products, ["corrected_category"],
                           ["review_count", "average_rating", "negative_share"], {"median": 0.5})


def with_comparison_notes(products: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Add ``comparison_notes`` against the category medians of ``of`` (default: the same table)."""
    medians = category_medians(of if of is not None else products)
    notes = rules.comparison_notes(
        F.col("review_count"), F.col("average_rating"), F.col("negative_share"),
        F.col("review_count_median"), F.col("average_rating_median"), F.col("negative_share_median"))
    return products.join(medians, "corrected_category").withColumn("comparison_notes", notes).drop(
        "review_count_median", "average_rating_median", "negative_share_median")
