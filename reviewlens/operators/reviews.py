"""Review table: projection, filters, labels, de-duplication and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.numbers import coerce_number, weak_label
from reviewlens.functions.text import strip
from reviewlens.operators.ordering import top_per_group

REVIEW_KEYS = ["product_name", "review_title", "review_text", "rating"]
PRODUCT_REVIEW_KEYS = ["product_name", "category_text", "review_title", "review_text"]


def raw_column(raw: DataFrame, name: str, default: str | None = "") -> Column:
    """Column of a raw table, or a constant when the table does not have it."""
    return F.col(f"`{name}`").cast("string") if name in raw.columns else F.lit(default).cast("string")


def category_column(raw: DataFrame, fallback: str = "column") -> Column:
    """``categories``, else ``primaryCategories``.

    ``column`` falls back when the whole column is absent, ``value`` for every row without a value.
    """
    if fallback == "value":
        return F.coalesce(raw_column(raw, "categories", None), raw_column(raw, "primaryCategories", None))
    if "categories" in raw.columns:
        return raw_column(raw, "categories")
    return raw_column(raw, "primaryCategories")


def to_reviews(raw: DataFrame, category_fallback: str = "column", keep: tuple[str, ...] = (),
               fill_name: bool = True) -> DataFrame:
    """Project raw rows to the review table; missing texts become empty, names only with ``fill_name``."""
    empty = F.lit("")
    name = raw_column(raw, "name")
    title = F.coalesce(raw_column(raw, "reviews.title"), empty)
    text = F.coalesce(raw_column(raw, "reviews.text"), empty)
    return raw.select(
        *keep,
        (F.coalesce(name, empty) if fill_name else name).alias("product_name"),
        F.coalesce(category_column(raw, category_fallback), empty).alias("category_text"),
        title.alias("review_title"),
        text.alias("review_text"),
        coerce_number(raw_column(raw, "reviews.rating", None)).alias("rating"),
        strip(F.concat(title, F.lit(" "), text)).alias("text"))


def valid_reviews(reviews: DataFrame, require_name: bool = False) -> DataFrame:
    """Rows with a rating and a text, and on request with a product name."""
    out = reviews.filter(F.col("rating").isNotNull() & (F.length("text") > 0))
    return out.filter(F.length("product_name") > 0) if require_name else out


def label_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("label", weak_label(F.col("rating")))


def key_digest(keys: list[str]) -> Column:
    """Digest of several columns; null equals null and differs from the empty string."""
    parts = [F.coalesce(F.sha2(F.col(k).cast("string"), 256), F.lit("-")) for k in keys]
    return F.sha2(F.concat_ws("|", *parts), 256)


def dedupe_reviews(reviews: DataFrame, keys: list[str] = REVIEW_KEYS, *, order: Column) -> DataFrame:
    """Keep exactly one row per key, the first in ``order``.

    ``order`` is any column that can be sorted.  A missing value comes last, and rows of one key that tie are told apart by
    a hash of all their columns, so an ordinal that repeats loses no key and leaves no copy.  The input is scanned
    once and shuffled once; every task first reduces its own rows to one per key, so a text copied into a third of all
    rows leaves each task once.
    """
    hashed = [f"`{f.name}`" for f in reviews.schema if "map<" not in f.dataType.simpleString()]
    keyed = reviews.withColumns({"_digest": key_digest(keys), "_order": order, "_tie": F.xxhash64(*hashed)})
    first = top_per_group(keyed, ["_digest"], [F.col("_order").asc_nulls_last(), F.col("_tie")], 1)
    return first.drop("_digest", "_order", "_tie")


def dedupe_audit(reviews: DataFrame, keys: list[str] = REVIEW_KEYS) -> DataFrame:
    """One row: rows before, after and removed by the exact de-duplication."""
    groups = reviews.groupBy(key_digest(keys)).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("rows_before"), F.count("*").alias("rows_after"),
                      (F.sum("n") - F.count("*")).alias("rows_removed"))


def review_table(raw: DataFrame, require_name: bool = True, keep: tuple[str, ...] = (),
                 *, order: Column, category_fallback: str = "column") -> DataFrame:
    """Raw rows to labelled, filtered, de-duplicated reviews; ``order`` (a kept column) says which copy stays.

    Without ``require_name`` a missing name stays missing, as a key of its own.
    """
    reviews = valid_reviews(to_reviews(raw, category_fallback, keep, require_name), require_name)
    return label_reviews(dedupe_reviews(reviews, REVIEW_KEYS, order=order))


def contradictions(scored: DataFrame) -> DataFrame:
    """Reviews whose predicted sentiment contradicts their rating, with the kind of contradiction."""
    rating, predicted = F.col("rating"), F.col("predicted_sentiment")
    kind = (F.when((rating <= 2) & (predicted == "positive"), "low_rating_positive_text")
            .when((rating >= 4) & (predicted == "negative"), "high_rating_negative_text")
            .when((rating == 3) & (predicted == "positive"), "neutral_rating_positive_text")
            .when((rating == 3) & (predicted == "negative"), "neutral_rating_negative_text"))
    return scored.withColumn("contradiction_type", kind).filter(F.col("contradiction_type").isNotNull())


def contradiction_table(scored: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The seven report columns of the contradiction list."""
    return contradictions(scored).select(
        *keep, "product_name", "review_title", "review_text", "rating",
        F.col("label").alias("true_label_from_rating"), "predicted_sentiment", "contradiction_type")


def contradiction_examples(scored: DataFrame, order: list[Column], n: int = 3) -> DataFrame:
    """The first ``n`` contradictions of every kind."""
    return top_per_group(contradictions(scored), ["contradiction_type"], order, n, "example")


def consistent_rows(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows whose predicted class is their own class."""
    return scored.filter(F.col(prediction) == F.col(label))


def frequency_table(df: DataFrame, *columns: str, name: str = "count") -> DataFrame:
    """Rows per distinct value, most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias(name)).orderBy(F.desc(name), *columns)


def null_profile(df: DataFrame) -> DataFrame:
    """Column name, row count and missing count of every column, from one scan."""
    sums = df.agg(F.count("*").alias("_rows"), *[
        F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("row_count"),
                 F.col(f"_{i}").alias("missing_count")) for i, c in enumerate(df.columns)]))
    return sums.select(rows.alias("r")).select("r.*")


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row with the number of distinct values of each column, and the row count."""
    def per(column: str) -> Column:
        return F.approx_count_distinct(column) if approximate else F.count_distinct(F.col(column))

    return df.agg(F.count("*").alias("row_count"), *[per(c).alias(f"distinct_{c}") for c in columns])


def file_shapes(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of every source."""
    parts = [df.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("source_file"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"))
        for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)
