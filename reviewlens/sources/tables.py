"""Result tables: writing, reading back and read-through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.lists import parse_list
from reviewlens.operators.evidence import TAXONOMY_ORDER

CARD_SCHEMA = (
    "headline string, summary string, best_for string, pros array<string>, cons array<string>, source string, "
    "llm_error string, category string, rank int, name string, raw_product_name string, review_count bigint, "
    "average_rating double, positive_share double, negative_share double, trust_score double, rating_score double, "
    "review_volume_score double, positive_sentiment_score double, risk_control_score double, "
    "evidence_strength string, cluster_id int, product_family string, prompt_file string")
TAXONOMY_SCHEMA = ("product_name string, cluster_id int, corrected_category string, product_family string, "
                   "correction_reason string")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write as parquet, csv (lists become JSON text) or json, replacing what is there."""
    if fmt == "csv":
        df = df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name)
                         if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`")
                         for f in df.schema])
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """Write rows as JSON; ``append`` adds them to a table that may be read by the same plan."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_lines(lines: DataFrame, order: list, path: str) -> None:
    """Write the ``line`` column as text files whose sequence follows ``order``."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def read_cards(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Saved cards; with ``missing_ok`` no cards where nothing has been saved yet."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], CARD_SCHEMA)
    return spark.read.schema(CARD_SCHEMA).json(path)


def read_taxonomy(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Saved taxonomy with ``taxonomy_ord``, which orders rows by file name and by place in the file."""
    reader = spark.read.option("header", True).option("escape", '"')
    raw = reader.csv(path) if fmt == "csv" else spark.read.parquet(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(TAXONOMY_SCHEMA)],
                      place.alias(TAXONOMY_ORDER))


def read_evidence_csv(spark: SparkSession, path: str) -> DataFrame:
    """Evidence table saved as CSV; list columns are decoded, bad lists become empty."""
    raw = spark.read.option("header", True).option("escape", '"').option("inferSchema", True).csv(path)
    for column in ["strengths", "concerns"]:
        if column in raw.columns:
            raw = raw.withColumn(column, parse_list(F.col(column)))
    return raw


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The saved parquet table, or the freshly built and saved one."""
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    write_table(build(), path)
    return spark.read.parquet(path)
