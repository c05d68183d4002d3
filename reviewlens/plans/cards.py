"""Scored reviews and taxonomy to evidence, cards and the gallery."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from reviewlens.operators import cards, evidence, sentiment
from reviewlens.operators.features import TextVectorizer, preprocess
from reviewlens.operators.gallery import gallery_table
from reviewlens.operators.images import add_aliases, image_lookup
from reviewlens.runtime import materialise
from reviewlens.sources import reports
from reviewlens.sources.tables import load_or_build, read_cards, write_json, write_lines, write_table

PRODUCTION = sentiment.Settings(kind="Linear SVM", c=1.0, balanced=True,
                                vectorizer=TextVectorizer(low=1, high=2, min_df=1, max_features=50000))


def production_scores(reviews: DataFrame, id_col: str, lemmas: DataFrame | None = None,
                      model_path: str | None = None, settings: sentiment.Settings = PRODUCTION,
                      in_sample: bool = True, folds: int = 3) -> DataFrame:
    """Reviews with predicted sentiment.

    ``in_sample`` trains on all rows and scores the same rows; otherwise every row is
    scored by a model that has not seen its fold.
    """
    prepared = materialise(preprocess(reviews, "lemmatization", id_col, table=lemmas))
    if not in_sample:
        parts = None
        folded = materialise(sentiment.stratified_folds(prepared, "label", id_col, folds))
        for fold in range(folds):
            model = sentiment.train(folded.filter(f"fold <> {fold}"), settings)
            part = sentiment.score_reviews(folded.filter(f"fold = {fold}"), model).drop("fold")
            parts = part if parts is None else parts.unionByName(part)
        return parts
    model = sentiment.train(prepared, settings)
    if model_path:
        model.save(reviews.sparkSession, model_path)
    return sentiment.score_reviews(prepared, model)


def run(spark: SparkSession, reviews: DataFrame, taxonomy: DataFrame, out: str, id_col: str = "review_id",
        lemmas: DataFrame | None = None, images: DataFrame | None = None,
        generate: Callable[[pd.Series], pd.Series] | None = None, sample: int | None = None,
        only_missing: bool = False, rebuild: bool = False, in_sample: bool = True,
        settings: sentiment.Settings = PRODUCTION) -> dict[str, DataFrame]:
    """Evidence (saved and reused), cards, and the gallery table, written below ``out``."""
    def build() -> DataFrame:
        scored = production_scores(reviews, id_col, lemmas, f"{out}/model", settings, in_sample)
        return evidence.product_evidence(scored, taxonomy)

    products = load_or_build(spark, f"{out}/evidence", build, rebuild)
    existing = read_cards(spark, f"{out}/cards", missing_ok=True) if only_missing else None
    made = cards.build_cards(products, generate, sample, existing)
    write_json(made, f"{out}/cards", append=only_missing)
    every = read_cards(spark, f"{out}/cards")
    lookup = add_aliases(image_lookup(images)) if images is not None else None
    shown = gallery_table(every, lookup)
    write_table(shown, f"{out}/gallery")
    write_lines(reports.card_lines(every), ["category", "rank", "name"], f"{out}/cards_report")
    return {"evidence": products, "cards": every, "gallery": shown}
