"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import (bpe, fingerprints, language, licenses, lines, mixing, ordered_minhash, packing, periods, pivots,
                            search, suffixes, toxicity)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fold(parts: int):
    """Remainder by which rows are held out; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_pivot_permutations(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.link_vectors(read(spark, folder, "embeddings"))


def op2_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return ordered_minhash.near_copies(read(spark, folder, "documents"))


def op3_hierarchical_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixing_report(read(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = language.train(docs.where(F.coalesce(fold(4) != 2, F.lit(True))))
    found = language.predict(docs, model)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), *found.columns[1:])


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = toxicity.train(docs, labels.where(fold(5) != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), *found.columns[1:])


def op6_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare(read(spark, folder, "documents"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, folder, "documents")).select(
        "doc_id", "n_bytes", F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"]),
                                        F.lit(0)).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(read(spark, folder, "documents"))


def op11_length_strata(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op12_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.find_runs(read(spark, folder, "documents"), periods.periodic_tail, texts_too=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (
    op1_pivot_permutations, op2_order_minhash, op3_hierarchical_mix, op4_language_id, op5_toxicity, op6_bpe_round_trip,
    op7_license_scan, op8_fingerprints, op9_suffix_dedup, op10_line_dedup,
    op11_length_strata, op12_period_runs, op13_slack_packing)}
ORACLES = {"op3_hierarchical_mix": mixing.ORACLE, "op7_license_scan": licenses.oracle(), "op10_line_dedup": lines.ORACLE,
           "op11_length_strata": search.ORACLE}
