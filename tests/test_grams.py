"""N-gram counts and vectors made from whole texts, against the plain forms on arrays of terms."""

import math

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import text
from reviewlens.operators import features

ROWS = [(1, 0, "The red fox, the RED fox; a fox"), (2, 1, "red fox jumps é ünïcode_9 日本 語"), (2, 1, "red the fox jumps"),
        (None, 0, "fox fox fox fox"), (None, 1, "red fox"), (3, None, ""), (4, 0, None), (5, 1, "the and of"), (6, 0, "solo")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, fold int, text string").repartition(3)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(params=[1 << 22, 1])
def chunk(request, monkeypatch):
    monkeypatch.setattr(features, "CHUNK_BYTES", request.param)


@pytest.mark.parametrize("low, high, stop", [(1, 2, None), (1, 3, ["the", "of"]), (2, 3, None)])
def test_counts_equal_those_of_arrays(docs, chunk, low, high, stop):
    termed = features.with_terms(docs.fillna({"text": ""}), "text", "terms", low, high, stop)
    assert rows_of(features.gram_stats(docs, "text", low, high, stop)) == rows_of(features.stats_from_rows(termed))
    assert rows_of(features.gram_counts(docs, "id", "text", low, high, stop)) == rows_of(features.term_counts(termed, "id"))
    assert rows_of(features.keyed_stats(docs, "id", "text", low, high, stop)) == rows_of(
        features.stats_from_counts(features.term_counts(termed, "id")))
    some = features.gram_counts(docs, "id", "text", low, high, stop, ["red fox", "fox", "absent"])
    assert rows_of(some) == rows_of(features.term_counts(termed, "id").where("term IN ('red fox', 'fox', 'absent')"))


def test_counts_per_fold(docs, chunk):
    cube = features.gram_stats(docs, "text", 1, 2, None, [0, 1])
    for f in (0, 1):
        own = cube.where(f"df_{f} > 0").select("term", f"df_{f}", f"total_{f}")
        termed = features.with_terms(docs.where(f"fold = {f}"), "text")
        assert rows_of(own) == rows_of(features.stats_from_rows(termed))


def test_vectors(docs, chunk):
    terms, idf = ["fox", "red", "red fox"], [1.0, 2.0, 0.5]
    got = features.gram_vectors(docs.where("id = 1"), "text", "v", terms, 2, None, True, idf).first()["v"]
    raw = [(1 + math.log(3)) * 1.0, (1 + math.log(2)) * 2.0, (1 + math.log(2)) * 0.5]
    norm = math.sqrt(sum(x * x for x in raw))
    assert got.size == 3 and list(got.indices) == [0, 1, 2]
    assert list(got.values) == pytest.approx([x / norm for x in raw])
    plain = features.gram_vectors(docs, "text", "v", terms, 2, None, False).select("text", "v").collect()
    assert {r["text"]: dict(zip(map(int, r["v"].indices), r["v"].values)) for r in plain}["fox fox fox fox"] == {0: 4.0}
    assert all(len(r["v"].indices) == 0 for r in plain if not r["text"])


def test_tasks_hold_a_bounded_part_of_the_texts(spark, monkeypatch):
    """All texts in one file used to be counted by one task, which held all their different n-grams."""
    monkeypatch.setattr(features, "TASK_BYTES", 1000)
    one = spark.range(200).select("id", F.repeat(F.lit("word "), 20).alias("text")).coalesce(1)
    spread = features.spread(one, "text")
    sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 4000


def test_strip_and_clean_words(spark):
    odd = " \t  x 　y \n\u0085"
    row = spark.createDataFrame([(odd, "", None)], "a string, b string, c string").select(
        text.strip(F.col("a")), text.strip(F.col("b")), text.strip(F.col("c")), text.basic_clean(F.lit("  -- É'a_b C  ")),
        text.basic_clean(F.lit("--")), text.basic_clean(F.col("c"))).first()
    assert tuple(row) == ("x 　y", "", None, "'a b c", "", None)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_tokens_are_replaced_by_either_way(spark, monkeypatch, chunk, limit):
    monkeypatch.setattr(features, "TABLE_BYTES", limit)
    table = spark.createDataFrame([("cats", "cat"), ("cats", "cats"), ("dogs", "dog"), ("same", "same")], "token string, normal string")
    df = spark.createDataFrame([(1, "Cats, dogs & cats"), (2, None), (3, "--"), (4, "same birds")], "id long, text string")
    got = features.normalize_tokens(df, "id", "text", table, "out")
    assert {r["id"]: r["out"] for r in got.collect()} == {1: "cat dog cat", 2: "", 3: "", 4: "same birds"}
