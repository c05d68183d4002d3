"""Taxonomy correction of clusters and readable cluster names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions import rules
from reviewlens.operators.ordering import top_per_group
from reviewlens.operators.reviews import frequency_table


def attach_clusters(products: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add ``cluster_id`` by product name."""
    return products.join(clusters.select("product_name", "cluster_id"), "product_name")


def apply_taxonomy(products: DataFrame) -> DataFrame:
    """Add original cluster id, corrected category and the reason of the correction."""
    rule = rules.taxonomy(F.col("product_name"), F.col("category"), F.col("cluster_id"))
    return (products.withColumn("original_cluster_id", F.col("cluster_id")).withColumn("_rule", rule)
            .select("*", "_rule.corrected_category", "_rule.correction_reason").drop("_rule"))


def taxonomy_corrections(corrected: DataFrame) -> DataFrame:
    """Products whose category is no longer just their cluster number."""
    number = F.concat(F.lit("Cluster "), F.col("original_cluster_id").cast("string"))
    return corrected.filter(F.col("corrected_category") != number).select(
        "product_name", "original_cluster_id", "corrected_category", "correction_reason")


def category_counts(corrected: DataFrame) -> DataFrame:
    return frequency_table(corrected, "corrected_category")


def cluster_sizes(products: DataFrame) -> DataFrame:
    return products.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))


def dominant_categories(corrected: DataFrame) -> DataFrame:
    """Most frequent category of every cluster; the smaller name wins ties."""
    counts = corrected.groupBy("cluster_id", "corrected_category").agg(F.count("*").alias("n"))
    return counts.groupBy("cluster_id").agg(
        F.min_by("corrected_category", F.struct(-F.col("n"), F.col("corrected_category"))).alias("category"))


def cluster_names(corrected: DataFrame) -> DataFrame:
    """Readable name per cluster; A, B, C … tell clusters of the same category apart.

    Works on one row per cluster, so the windows are small whatever the product count.
    """
    same = Window.partitionBy("category")
    letter = F.char(F.lit(64) + F.row_number().over(same.orderBy("cluster_id")))
    return dominant_categories(corrected).select(
        "cluster_id",
        F.when(F.count("*").over(same) > 1, F.concat(F.col("category"), F.lit(" "), letter))
        .otherwise(F.col("category")).alias("cluster_name"))


def plain_cluster_names(products: DataFrame) -> DataFrame:
    return products.select("cluster_id").distinct().withColumn(
        "cluster_name", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))


def display_groups(products: DataFrame, corrected: bool) -> DataFrame:
    """Group shown for every product: its cluster number, or its category after correction."""
    if corrected:
        return apply_taxonomy(products).withColumn("display_group", F.col("corrected_category"))
    return products.withColumn("display_group", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))


def cluster_examples(products: DataFrame, order: list[Column] | None = None, n: int = 5) -> DataFrame:
    """The first ``n`` product names of every cluster, joined by `` | ``."""
    first = top_per_group(products.select("cluster_id", "product_name"), ["cluster_id"],
                          order or [F.col("product_name").asc()], n, "_position")
    listed = F.array_sort(F.collect_list(F.struct("_position", "product_name")))
    return first.groupBy("cluster_id").agg(
        F.array_join(F.transform(listed, lambda x: x["product_name"]), " | ").alias("example_products"))
