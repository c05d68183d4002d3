"""Reviews to classifiers, metric tables and rating-text contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators import metrics, sentiment
from reviewlens.operators.features import preprocess
from reviewlens.operators.reviews import contradiction_examples, contradiction_table
from reviewlens.runtime import materialise
from reviewlens.sources import reports
from reviewlens.sources.tables import write_lines, write_table


def run(spark: SparkSession, reviews: DataFrame, out: str, id_col: str = "review_id",
        preprocessing: tuple[str, ...] = ("raw_tokens", "basic_clean", "stemming", "lemmatization"),
        models: tuple[str, ...] = tuple(sentiment.MODELS), search: int = 24, tuned_setups: int = 3,
        tables: dict[str, DataFrame] | None = None, settings: dict | None = None) -> dict[str, DataFrame]:
    """Compare models, tune the best preparations, and write every result table below ``out``.

    ``reviews`` has a unique id, text and label.  ``settings`` overrides training settings of all models.
    """
    train_rows, test_rows = map(materialise, sentiment.split_with_folds(materialise(reviews), id_col))
    candidates = [sentiment.Settings(kind=m, **(settings or {})) for m in models]
    compared = sentiment.compare_models(train_rows, test_rows, list(preprocessing), candidates, id_col, tables)
    write_table(compared, f"{out}/baseline_results")

    tuned, best, searched = [], None, None
    for row in metrics.leaderboard(compared, tuned_setups).collect():
        method = row["preprocessing"]
        table = (tables or {}).get(method)
        prepared = materialise(preprocess(train_rows, method, id_col, table=table))
        held = materialise(preprocess(test_rows, method, id_col, table=table))
        model, setting, values, found = sentiment.tune(prepared, held, sentiment.sample_settings(n=search))
        found = found.withColumn("preprocessing", F.lit(method))
        searched = found if searched is None else searched.unionByName(found)
        tuned.append({"preprocessing": method, "model": setting.kind, **setting.parameters(), **values})
        if best is None or values["cv_macro_f1"] > best[0]:
            best = (values["cv_macro_f1"], model, setting, prepared, held)
    tuned_table = spark.createDataFrame(tuned)
    write_table(tuned_table, f"{out}/tuned_results")
    write_table(searched, f"{out}/search_results")

    _, model, setting, prepared, held = best
    model.save(spark, f"{out}/model")
    scored = materialise(sentiment.score_reviews(held, model))
    results = {
        "class_report": metrics.class_report(scored, prediction="predicted_sentiment"),
        "confusion": metrics.confusion_percent(scored, prediction="predicted_sentiment"),
        "experiments": sentiment.extra_experiments(prepared, held, setting, id_col),
        "contradictions": contradiction_table(scored, (id_col,)),
    }
    for name, table in results.items():
        write_table(table, f"{out}/{name}")
    examples = contradiction_examples(scored, [F.col(id_col)])
    write_lines(reports.contradiction_report(examples), reports.REPORT_KEY, f"{out}/examples_report")
    write_lines(reports.model_report(compared, tuned_table, results["class_report"]), reports.REPORT_KEY, f"{out}/model_report")
    return {**results, "baseline": compared}
