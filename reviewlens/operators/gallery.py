"""Gallery: one row per shown product, filtered, ordered and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import names
from reviewlens.functions.numbers import clip01, evidence_tier, pick_label, round_exact
from reviewlens.operators.images import product_images
from reviewlens.operators.ordering import ranked, top_per_group

ORDERS = {
    "recommended": [("trust_score_for_app", False), ("evidence_tier_for_app", False), ("review_count", False)],
    "highest_rating": [("average_rating", False), ("evidence_tier_for_app", False), ("review_count", False)],
    "most_reviews": [("review_count", False), ("evidence_tier_for_app", False), ("trust_score_for_app", False)],
    "lowest_risk": [("negative_share", True), ("evidence_tier_for_app", False), ("trust_score_for_app", False)],
}
EVIDENCE_FILTERS = {"all": None, "medium": ["Medium", "High"], "high": ["High"]}


def shown_score(cards: DataFrame) -> Column:
    """Stored trust score; older cards without one get it recomputed, with volume 0.5 when that is missing too."""
    def part(column: str, default: float) -> Column:
        return F.coalesce(F.col(column), F.lit(default)) if column in cards.columns else F.lit(default)

    score = (40 * clip01(part("average_rating", 0.0) / 5) + 30 * clip01(part("review_volume_score", 0.5))
             + 20 * clip01(part("positive_share", 0.0) / 100) + 10 * clip01(1 - part("negative_share", 0.0) / 100))
    computed = round_exact(score, 1)
    return F.coalesce(F.col("trust_score"), computed) if "trust_score" in cards.columns else computed


def gallery_table(cards: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Cards with display name, score, tier and image; the strongest card per category and name."""
    shown = (cards.withColumn("display_name", names.display_name(F.col("name")))
             .withColumn("trust_score_for_app", shown_score(cards))
             .withColumn("evidence_tier_for_app", evidence_tier(F.col("evidence_strength"))))
    kept = top_per_group(shown, ["category", "display_name"],
                         [F.col("trust_score_for_app").desc(), F.col("review_count").desc(),
                          F.col("raw_product_name").asc()], 1)
    if lookup is None:
        return kept
    keyed = kept.withColumn("_card", F.sha2(F.concat_ws("|", "category", "display_name"), 256))
    return product_images(keyed, lookup, "_card").drop("_card")


def gallery(table: DataFrame, category: str | None = None, evidence: str = "all", sort: str = "recommended",
            top_n: int | None = None) -> DataFrame:
    """Filter by category and evidence, order, take the first ``top_n``, number and label them.

    An empty selection gives an empty table with the same columns.
    """
    out = table
    if category is not None:
        out = out.filter(F.col("category") == category)
    if EVIDENCE_FILTERS[evidence]:
        out = out.filter(F.col("evidence_strength").isin(EVIDENCE_FILTERS[evidence]))
    order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in ORDERS[sort]]
    order += [F.col("category").asc(), F.col("display_name").asc()]
    if top_n is not None:
        out = out.orderBy(*order).limit(top_n)
    numbered = ranked(out.drop("rank"), [], order)
    return numbered.withColumn("pick", pick_label(F.col("rank")))


DETAIL_COLUMNS = ["rank", "category", "name", "display_name", "trust_score_for_app", "evidence_strength",
                  "average_rating", "review_count", "positive_share", "negative_share", "cluster_id",
                  "product_family"]
DETAIL_NAMES = {"display_name": "clean_product_name", "trust_score_for_app": "product_score",
                "positive_share": "text_positive_rate", "negative_share": "text_negative_rate"}


def ranking_table(shown: DataFrame) -> DataFrame:
    """Detail columns that exist, under their report names."""
    return shown.select(*[c for c in DETAIL_COLUMNS if c in shown.columns]).withColumnsRenamed(DETAIL_NAMES)
