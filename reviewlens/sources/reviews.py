"""Review files of differing column sets to one table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.fixed_values import MISSING_TEXTS
from reviewlens.operators.ordering import running_total
from reviewlens.runtime import materialise


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Sorted paths of the matching files; only names are read."""
    return sorted(r["path"] for r in _listing(spark, folder, pattern).collect())


def _listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path as readers take it, and file_path as rows of a file name it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.col("_metadata.file_path").alias("file_path"))


def _reader(spark: SparkSession, multi_line: bool):
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')


def _first_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from islice((b for b in batches if b.num_rows), 1)


def header_shapes(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by their header, shapes and files in order of name.

    One job reads the first line of all files, a file to a task that stops after it; then one file of each
    distinct header line tells its columns.  Files without a line have no shape.
    """
    if not files:
        return {}
    own = spark.newSession()  # settings of its own: one file per task, one row per batch
    for name, value in {"spark.sql.files.maxPartitionBytes": "1t", "spark.sql.files.openCostInBytes": "1t",
                        "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}.items():
        own.conf.set(name, value)
    lines = own.read.text(files).select(F.col("_metadata.file_path").alias("file_path"), "value")
    first = {r["file_path"]: r["value"] for r in lines.mapInArrow(_first_row, "file_path string, value string").collect()}
    names = {r["file_path"]: r["path"] for r in own.read.format("binaryFile").load(files).select(
        "path", F.col("_metadata.file_path").alias("file_path")).collect()}
    by_line: dict[str, list[str]] = {}
    for file_path, line in first.items():
        by_line.setdefault(line, []).append(names[file_path])
    shapes: dict[tuple[str, ...], list[str]] = {}
    for group in sorted(map(sorted, by_line.values())):
        shapes.setdefault(tuple(_reader(spark, False).csv(group[0]).columns), []).extend(group)
    return {header: sorted(group) for header, group in shapes.items()}


def _present(column: str) -> Column:
    return F.when(~F.col(f"`{column}`").isin(MISSING_TEXTS), F.col(f"`{column}`")).alias(column)


def with_row_numbers(rows: DataFrame, name: str) -> DataFrame:
    """Number written rows from 0 without gaps by file, then by place in the file.

    ``rows`` is a written table with _file, _block (start of the split) and _row (rising within a split).  Only the
    counts of the splits are ordered and summed up; the rows are not sorted.
    """
    splits = materialise(rows.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_row").alias("first")))
    placed = running_total(splits, [], [F.col("_file"), F.col("_block")], F.col("n"), "upto").select(
        "_file", "_block", (F.col("upto") - F.col("n") - F.col("first")).alias("_shift"))
    return rows.join(placed, ["_file", "_block"]).withColumn(name, (F.col("_shift") + F.col("_row")).cast("long")).drop(
        "_file", "_block", "_row", "_shift")


def read_reviews(spark: SparkSession, folder: str, multi_line: bool = True, pattern: str = "*.csv") -> DataFrame:
    """All review files of a folder as text columns, with ``source_file`` and ``review_ord``.

    Files with the same header are read together and the shapes are united by
    column name; one reader over differing headers would shift columns silently.
    ``review_ord`` is a whole number that counts rows from 0 by file name and by place in the file.  The files are
    parsed once, into a written table.  ``multi_line`` keeps line breaks inside quoted texts, at the price of one
    task per file.
    """
    files = list_files(spark, folder, pattern)
    if not files:
        raise FileNotFoundError(f"no {pattern} files in {folder}")
    frames = []
    for header, group in header_shapes(spark, files).items():
        frames.append(_reader(spark, multi_line).csv(group).select(
            *map(_present, header), F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row")))
    if not frames:
        raise ValueError(f"no header in the files of {folder}")
    return with_row_numbers(materialise(union_reviews(frames)), "review_ord")


def union_reviews(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; columns a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_image_rows(spark: SparkSession, folders: list[str], pattern: str = "*.csv") -> DataFrame:
    """(source_rank, row_ord, name, imageURLs) of all files that have both columns.

    ``source_rank`` numbers the files by folder, then by name.  Files are read by header shape, whatever their
    number, and take their rank from a table of files.  Only the two columns are scanned.
    """
    ranked, names = [], {}
    for folder in folders:
        for r in sorted(_listing(spark, folder, pattern).collect()):
            names[r["path"]] = None
            ranked.append((r["file_path"], len(ranked)))
    frames = []
    for header, group in header_shapes(spark, list(names)).items():
        if {"name", "imageURLs"} <= set(header):
            frames.append(_reader(spark, True).csv(group).select(
                F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("row_ord"),
                _present("name"), _present("imageURLs")))
    if not frames:
        return spark.createDataFrame([], "source_rank int, row_ord long, name string, imageURLs string")
    ranks = spark.createDataFrame(ranked, "_file string, source_rank int")
    return union_reviews(frames).join(ranks, "_file").select("source_rank", "row_ord", "name", "imageURLs")


def image_rows(raw: DataFrame, source_rank: int, row_ord: str) -> DataFrame | None:
    """The same projection of a table already read; nothing when a column is missing."""
    if not {"name", "imageURLs"} <= set(raw.columns):
        return None
    return raw.select(F.lit(source_rank).alias("source_rank"), F.col(row_ord).alias("row_ord"), "name", "imageURLs")
