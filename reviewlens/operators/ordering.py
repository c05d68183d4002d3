"""Ranks, running totals and exact quantiles that survive one huge group.

A plain window function puts a whole partition group into one task.  Here the
rows are range-partitioned by group *and* order, so a group that holds a third
of all rows is spread over many tasks; each task numbers its own slice and adds
the total of the slices before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.runtime import materialise


def running_total(df: DataFrame, partition: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """Add ``name``: running sum of ``weight`` inside ``partition`` in ``order``.

    ``order`` must end with a unique key, so that a slice border never cuts a tie.
    The slice number is materialised once; both readers below see the same one.
    """
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = materialise(
        df.withColumn("_weight", weight)
        .repartitionByRange(slices, *[F.col(p) for p in partition], *order)
        .withColumn("_slice", F.spark_partition_id()))

    groups = [*partition, "_slice"]
    totals = sliced.groupBy(*groups).agg(F.sum("_weight").alias("_total"))
    # One row per group and slice: a group has at most ``slices`` of them.
    earlier = Window.partitionBy(*(partition or [F.lit(0)])).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_key_{g}") for g in groups],
                            F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))

    within = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_key_{g}")) for g in groups])
    return (sliced.join(offsets, same)
            .withColumn(name, F.col("_offset") + F.sum("_weight").over(within))
            .drop("_offset", "_weight", "_slice", *[f"_key_{g}" for g in groups]))


def ranked(df: DataFrame, partition: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add ``name``: 1, 2, 3 … inside ``partition`` in ``order``, for groups of any size."""
    out = running_total(df, partition, order, F.lit(1), name)
    return out.withColumn(name, F.col(name).cast("int"))


def top_per_group(df: DataFrame, partition: list[str], order: list[Column], n: int,
                  name: str | None = None) -> DataFrame:
    """The first ``n`` rows of every group.

    The filter on ``row_number`` lets Spark keep only ``n`` rows per group in every
    task *before* the shuffle, so a hot group moves at most ``n`` rows per task.
    """
    window = Window.partitionBy(*partition).orderBy(*order)
    number = name or "_number"
    out = df.withColumn(number, F.row_number().over(window)).filter(F.col(number) <= n)
    return out if name else out.drop(number)


def exact_quantiles(df: DataFrame, keys: list[str], columns: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of several columns per group.

    Output columns are ``<column>_<name>`` for every name in ``probabilities``.
    Equal values are counted before the shuffle, and the sorted value counts of a
    group are spread over tasks, so no group has to fit into one.
    """
    measures = F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = (df.select(*keys, measures.alias("m")).select(*keys, "m.measure", "m.value")
              .filter(F.col("value").isNotNull())
              .groupBy(*keys, "measure", "value").agg(F.count("*").alias("n")))
    group = [*keys, "measure"]
    placed = running_total(counts, group, [F.col("value").asc()], F.col("n"), "upto")
    sizes = placed.groupBy(*group).agg(F.max("upto").alias("size"))

    same = reduce(lambda a, b: a & b, [F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group])
    joined = placed.alias("p").join(sizes.alias("s"), same).select(
        *[F.col(f"p.{g}").alias(g) for g in group], "p.value", "p.n", "p.upto", "s.size")

    def at(position: Column, measure: str) -> Column:
        hit = ((F.col("measure") == measure) & (F.col("upto") - F.col("n") <= position)
               & (position < F.col("upto")))
        return F.max(F.when(hit, F.col("value")))

    outputs = []
    for column in columns:
        for name, p in probabilities.items():
            exact = (F.col("size") - 1) * F.lit(float(p))
            low, high = at(F.floor(exact), column), at(F.ceil(exact), column)
            part = F.max(F.when(F.col("measure") == column, exact - F.floor(exact)))
            value = F.when(part == 0.5, (low + high) / 2).otherwise(low + (high - low) * part)
            outputs.append(value.alias(f"{column}_{name}"))
    return joined.groupBy(*keys).agg(*outputs)
