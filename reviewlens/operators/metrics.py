"""Classification metrics from any table with a label and a prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.fixed_values import CLASSES
from reviewlens.functions.numbers import fixed


def _cells(pairs: DataFrame, label: str, prediction: str, classes: list[str]) -> DataFrame:
    """One row per (label, prediction) of all classes, zero where nothing was counted."""
    counted = pairs.select(*[
        F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"_{i}_{j}")
        for i, a in enumerate(classes) for j, p in enumerate(classes)])
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("class_order"), F.lit(a).alias("label"), F.lit(p).alias("prediction"),
                 F.col(f"_{i}_{j}").alias("n"))
        for i, a in enumerate(classes) for j, p in enumerate(classes)]))
    return counted.select(cells.alias("c")).select("c.*")


def confusion_matrix(pairs: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes: list[str] = CLASSES) -> DataFrame:
    """One row per label, one count column per predicted class."""
    cells = _cells(pairs, label, prediction, classes)
    return cells.groupBy("label").agg(*[
        F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0)).alias(f"predicted_{c}") for c in classes])


def confusion_percent(pairs: DataFrame, label: str = "label", prediction: str = "prediction",
                      classes: list[str] = CLASSES) -> DataFrame:
    """Long form with count, row percentage and the text of the cell."""
    row_total = F.sum("n").over(Window.partitionBy("label"))
    percent = F.when(row_total > 0, F.col("n") * 100.0 / row_total)
    return _cells(pairs, label, prediction, classes).select(
        "label", "prediction", "n", percent.alias("row_percent"),
        F.concat(F.format_number("n", 0), F.lit("\n"), fixed(percent, 1), F.lit("%")).alias("cell_text"))


def class_report(pairs: DataFrame, label: str = "label", prediction: str = "prediction",
                 classes: list[str] = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a ratio is undefined."""
    cells = _cells(pairs, label, prediction, classes)
    both = F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.lit("actual").alias("side")),
        F.struct(F.col("prediction").alias("c"), F.lit("predicted").alias("side"))))
    sums = (cells.select("*", both.alias("b")).groupBy(F.col("b.c").alias("class")).agg(
        F.sum(F.when((F.col("b.side") == "actual") & (F.col("label") == F.col("prediction")), F.col("n"))
              .otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("b.side") == "actual", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("b.side") == "predicted", F.col("n")).otherwise(0)).alias("predicted")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision = ratio(F.col("hits").cast("double"), F.col("predicted"))
    recall = ratio(F.col("hits").cast("double"), F.col("support"))
    f1 = ratio(F.col("hits") * 2.0, F.col("predicted") + F.col("support"))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def overall_metrics(pairs: DataFrame, label: str = "label", prediction: str = "prediction",
                    classes: list[str] = CLASSES) -> DataFrame:
    """One row: accuracy and plain and support-weighted averages over the classes."""
    report = class_report(pairs, label, prediction, classes)
    support = F.sum("support")

    def weighted(column: str):
        return (F.sum(F.col(column) * F.col("support")) / support).alias(f"weighted_{column}")

    return report.agg(
        (F.sum(F.col("recall") * F.col("support")) / support).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        weighted("precision"), weighted("recall"), weighted("f1"), support.alias("support"))


def result_columns(pairs: DataFrame, label: str = "label", prediction: str = "prediction",
                   classes: list[str] = CLASSES) -> DataFrame:
    """One row with the overall metrics and precision, recall and F1 of every class."""
    report = class_report(pairs, label, prediction, classes)
    per_class = [F.max(F.when(F.col("class") == c, F.col(m))).alias(f"{c}_{m}")
                 for c in classes for m in ["precision", "recall", "f1"]]
    support = F.sum("support")
    return report.agg(
        (F.sum(F.col("recall") * F.col("support")) / support).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / support).alias("weighted_f1"), *per_class)


def fold_means(scores: DataFrame, keys: list[str], score: str = "macro_f1", name: str = "cv_macro_f1") -> DataFrame:
    """Mean score over the folds of every setup."""
    return scores.groupBy(*keys).agg(F.avg(score).alias(name))


def leaderboard(results: DataFrame, n: int = 3, score: str = "cv_macro_f1",
                ties: tuple[str, ...] = ("preprocessing", "model")) -> DataFrame:
    """The ``n`` best setups."""
    return results.orderBy(F.col(score).desc(), *ties).limit(n)


def best_setup(results: DataFrame, score: str = "cv_macro_f1", order: str = "setup_rank") -> DataFrame:
    """The setup with the highest score; the earliest wins ties."""
    row = F.struct(*[F.col(c) for c in results.columns])
    return results.agg(F.max_by(row, F.struct(F.col(score), -F.col(order))).alias("r")).select("r.*")
