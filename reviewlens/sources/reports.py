"""Markdown report lines as tables: one ``line`` per row plus the columns that order it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.fixed_values import CLASSES
from reviewlens.functions.numbers import fixed


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def product_group_lines(products: DataFrame, group: str) -> DataFrame:
    """One heading per group and one line per product below it, biggest products first.

    Order of the report: group, part, review_rows descending, product_name.
    """
    family = F.when(F.length("product_family") > 0, _text(" | family: ", F.col("product_family"))).otherwise("")
    name = F.col(group).cast("string")
    items = products.select(
        name.alias("group"), F.lit(1).alias("part"), "review_rows", "product_name",
        _text("- ", F.col("product_name"), " (", F.col("review_rows").cast("string"), " review rows", family, ")")
        .alias("line"))
    headings = products.groupBy(name.alias("group")).agg(F.count("*").alias("n")).select(
        "group", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("review_rows"), F.lit("").alias("product_name"),
        _text(f"### {group}: ", F.col("group"), " (", F.col("n").cast("string"), " products)").alias("line"))
    return headings.unionByName(items)


def group_order() -> list[Column]:
    return [F.col("group"), F.col("part"), F.col("review_rows").desc(), F.col("product_name")]


def card_lines(cards: DataFrame) -> DataFrame:
    """Markdown text of each card; ordered by category and rank."""
    def bullets(column: str) -> Column:
        return F.array_join(F.transform(column, lambda x: F.concat(F.lit("- "), x)), "\n")

    text = F.concat_ws("\n", _text("## ", F.col("category"), " | #", F.col("rank").cast("string"), " | ",
                                   F.col("name"), "\n"),
                       _text("**", F.col("headline"), "**\n"), F.col("summary"), F.lit(""),
                       _text("**Best for:** ", F.col("best_for")), F.lit(""), F.lit("**Pros:**"), bullets("pros"),
                       F.lit(""), F.lit("**Cons:**"), bullets("cons"), F.lit("\n---\n"))
    return cards.select("category", "rank", "name", text.alias("line"))


def contradiction_lines(examples: DataFrame) -> DataFrame:
    """One line per contradiction example; ordered by type and example."""
    line = _text("- Rating ", F.col("rating").cast("string"), ", predicted ", F.col("predicted_sentiment"), ": ",
                 F.col("review_title"))
    return examples.select("contradiction_type", "example", line.alias("line"))


def model_lines(results: DataFrame, score: str = "cv_macro_f1") -> DataFrame:
    """Leaderboard rows of the model report; ordered by score."""
    cells = [F.col("preprocessing"), F.col("model"), fixed(F.col(score), 3), fixed(F.col("macro_f1"), 3)]
    return results.select(F.col(score).alias("order_score"), "preprocessing", "model",
                          _text("| ", F.concat_ws(" | ", *cells), " |").alias("line"))


def class_report_lines(report: DataFrame) -> DataFrame:
    """One table row per class with precision, recall and F1 to three digits."""
    cells = [F.col("class"), *[fixed(F.col(c), 3) for c in ["precision", "recall", "f1"]]]
    return report.select("class", _text("| ", F.concat_ws(" | ", *cells), " |").alias("line"))


# --- documents of keyed sections ---------------------------------------------------------------

#: A report is one table of lines with a key over all of it, so that its many parts are one ordered write.
REPORT_KEY = ["section", "place", "name", "part"]


def section(rows: DataFrame, number: int, lines: list[Column | str], place: Column | None = None,
            name: Column | None = None) -> DataFrame:
    """Each row as some lines of section ``number``, rows by ``place``, then ``name``; null lines are left out."""
    listed = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    return rows.select(
        F.lit(number).alias("section"), (F.lit(0.0) if place is None else place.cast("double")).alias("place"),
        (F.lit("") if name is None else name).alias("name"), F.posexplode(listed).alias("part", "line")).where("line is not null")


def heading(rows: DataFrame, number: int, *lines: str) -> DataFrame:
    """Fixed lines before the rows of a section; ``rows`` only names the session."""
    return section(rows.sparkSession.range(1), number, list(lines), F.lit(float("-inf")))


def document(*sections: DataFrame) -> DataFrame:
    """The sections as one table; write it with ``write_lines(…, REPORT_KEY, …)``."""
    return reduce(DataFrame.unionByName, sections)


CLASS_TABLE = ["| Class | Precision | Recall | F1 |", "|---|---:|---:|---:|"]


def _scores(names: dict[str, str]) -> list[Column]:
    return [_text(f"- {title}: ", fixed(F.col(column), 3)) for title, column in names.items()]


def _classes() -> list[Column]:
    return [_text(f"| {c} | ", F.concat_ws(" | ", *[fixed(F.col(f"{c}_{m}"), 3) for m in ("precision", "recall", "f1")]), " |")
            for c in CLASSES]


def _setup() -> Column:
    return F.concat_ws(" + ", "preprocessing", F.lit("tfidf"), "model")


def _numbered(rows: DataFrame) -> DataFrame:
    """Setups with their place by score; there are as many rows as setups were tried."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(
        F.desc("cv_macro_f1"), "preprocessing", "model")))


_TEST = {"Cross-validated macro-F1": "cv_macro_f1", "Test accuracy": "accuracy", "Test macro-F1": "macro_f1",
         "Test weighted F1": "weighted_f1"}
_CHOSEN = ["ngram_high", "min_df", "max_features", "c", "balanced"]


def model_report(results: DataFrame, tuned: DataFrame, best_classes: DataFrame) -> DataFrame:
    """Every setup with its scores and its classes, the tuned setups, and the best one with its parameters and classes.

    ``results`` and ``tuned`` hold a setup a row with the columns of ``result_columns``, ``tuned`` also the searched
    parameters; ``best_classes`` is the class report of the best tuned setup.
    """
    placed = _numbered(tuned)
    best = placed.where("position = 1")
    per_class = F.concat_ws(" | ", "class", *[fixed(F.col(c), 3) for c in ("precision", "recall", "f1")], F.col("support").cast("string"))
    return document(
        heading(results, 0, "# Models by cross-validated macro-F1", ""),
        section(results, 1, [_text("## ", _setup()), "", *_scores(_TEST), "", *CLASS_TABLE, *_classes(), ""], -F.col("cv_macro_f1"), _setup()),
        heading(results, 2, "# Tuned setups", "", "| Rank | Preprocessing | Model | Cross-validated | Test |", "|---:|---|---|---:|---:|"),
        section(placed, 2, [_text("| ", F.concat_ws(" | ", F.col("position").cast("string"), "preprocessing", "model",
                                                    fixed(F.col("cv_macro_f1"), 3), fixed(F.col("macro_f1"), 3)), " |")], F.col("position")),
        heading(results, 3, "", "# Best setup", ""),
        section(best, 4, [_text("## ", _setup()), "", *[_text(f"- {c}: ", F.col(c).cast("string")) for c in _CHOSEN if c in tuned.columns],
                          "", *_scores(_TEST), ""]),
        heading(results, 5, "| Class | Precision | Recall | F1 | Rows |", "|---|---:|---:|---:|---:|"),
        section(best_classes, 5, [_text("| ", per_class, " |")], name=F.col("class")))


def contradiction_report(examples: DataFrame) -> DataFrame:
    """A heading per kind of contradiction with its examples below."""
    kind = F.col("contradiction_type")
    line = F.concat(F.lit("- Rating "), F.col("rating").cast("string"), F.lit(", predicted "), F.col("predicted_sentiment"), F.lit(": "),
                    F.col("review_title"))
    items = examples.select(F.lit(1).alias("section"), F.lit(0.0).alias("place"), kind.alias("name"), F.col("example").alias("part"), line.alias("line"))
    heads = examples.groupBy(kind.alias("name")).agg(F.lit(0).alias("part")).select(
        F.lit(1).alias("section"), F.lit(0.0).alias("place"), "name", "part", F.concat(F.lit("## "), F.col("name")).alias("line"))
    return document(heading(examples, 0, "# Ratings that contradict their texts", ""), heads, items)
