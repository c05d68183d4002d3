"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct words, pairs of neighbours and pairs with one word between them,
each hashed to one of 2**FEATURE_BITS coordinates.  FTRL keeps a learning rate per coordinate and
drives most weights to exactly zero, so the model is a short list of coordinates and weights that is
small enough to send to every task whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import texts
from reviewlens.runtime import materialise, release

FEATURE_BITS = 20
#: Bound of the training sample, in labelled rows.
SAMPLE_ROWS = 16384
#: Bound of the coordinates of the training sample, four bytes each.
SAMPLE_BYTES = 48 << 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
EPOCHS = 3


@dataclass
class Model:
    """Coordinates with a weight other than zero, their weights, and the intercept."""

    coordinates: np.ndarray
    weights: np.ndarray
    intercept: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, pairs and skip pairs of all rows, and the row of each."""
    starts, ends, first = texts.word_spans(data, offsets)
    word = texts.span_hashes(texts.rolling(data), starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, rows = [word], [row]
    for step, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = row[step:] == row[:-step]
        found.append(texts.mix(word[:-step][same] * np.uint64(3) + word[step:][same] * np.uint64(5) + np.uint64(salt)))
        rows.append(row[step:][same])
    return ((np.concatenate(found) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), np.concatenate(rows))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in texts.chunks(batches):
        keys, rows = features(*texts.utf8(texts.lowered(part.column("text"))))
        own = np.unique(rows << FEATURE_BITS | keys)
        cut = np.searchsorted(own, np.arange(part.num_rows + 1) << FEATURE_BITS)
        own = (own & ((1 << FEATURE_BITS) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [part.column("place"), part.column("toxic"),
             pa.array([own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["place", "toxic", "keys"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on ``labels`` (doc_id, toxic 0/1) of ``docs``; null labels are left out.

    At most ``sample_rows`` labels are drawn by a hash of doc_id, which bounds what is broadcast.  Of their different
    texts (a doc_id may repeat) the first ``sample_rows`` in hash order are used, as far as their coordinates fit in
    ``sample_bytes``, which bounds what is collected.  Without both classes the model is an intercept only.
    """
    place = F.xxhash64(F.col("doc_id"))
    drawn = (labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic in (0, 1)")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", place)
             .orderBy("place", "doc_id").limit(sample_rows))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id")
    made = materialise(rows.select("place", "toxic", "text").mapInArrow(_distinct, "place long, toxic int, keys binary").withColumn(
        "own", F.xxhash64("keys")))
    order = ["place", "own", "toxic"]
    sizes = made.select(*order, F.length("keys").alias("size")).distinct().orderBy(*order).limit(sample_rows).collect()
    total, last = 0, None
    for r in sizes:
        total += r["size"]
        if total > sample_bytes and last is not None:
            break
        last = r
    if last is None:
        release(made)
        return fit([])
    cut = F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(made.schema[c].dataType).alias(c) for c in order])
    table = made.where(cut).dropDuplicates(order).select(*order, "keys").toArrow().sort_by([(c, "ascending") for c in order])
    keys = table.column("keys").combine_chunks()
    try:
        return fit([(np.frombuffer(k.as_buffer(), np.int32), y) for k, y in zip(keys, table.column("toxic").to_pylist())])
    finally:
        del table, keys
        release(made)
        pa.default_memory_pool().release_unused()


def fit(sample: list[tuple[np.ndarray, int]]) -> Model:
    """FTRL-proximal over (coordinates, label) in the given order, several times."""
    positive = sum(y for _, y in sample)
    if not 0 < positive < len(sample):
        chance = (positive + 0.5) / (len(sample) + 1) if sample else 0.25
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(chance / (1 - chance))))
    size = 1 << FEATURE_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, L1)
    penalty[size] = 0.0  # the intercept

    def weights(at):
        return np.where(np.abs(z[at]) <= penalty[at], 0.0,
                        (np.sign(z[at]) * penalty[at] - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for keys, y in sample:
            at = np.append(keys, size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    kept = np.flatnonzero(w[:size])
    return Model(kept, w[kept], float(w[size]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row.

    A null, empty or wordless text has no feature and gets the intercept's score.  Repeated rows get equal
    scores; an empty table gives no rows; only doc_id and text are read.
    """
    return _scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        table = np.zeros(1 << FEATURE_BITS)
        table[known.coordinates] = known.weights
        for part in texts.chunks(batches):
            keys, row = features(*texts.utf8(texts.lowered(part.column("text"))))
            hit = table[keys] != 0
            hit = np.unique(row[hit] << FEATURE_BITS | keys[hit])
            sums = np.bincount(hit >> FEATURE_BITS, table[hit & ((1 << FEATURE_BITS) - 1)], part.num_rows)
            chance = 1 / (1 + np.exp(-np.clip(sums + known.intercept, -35, 35)))
            kept = [part.column(c) for c in names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))],
                                             [*(c for c in names if c != "text"), "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "text")
    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns they had.  Null and empty texts stay
    unless the intercept alone rejects them."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        table = np.zeros(1 << FEATURE_BITS)
        table[known.coordinates] = known.weights
        for part in texts.chunks(batches):
            keys, row = features(*texts.utf8(texts.lowered(part.column("text"))))
            hit = table[keys] != 0
            hit = np.unique(row[hit] << FEATURE_BITS | keys[hit])
            sums = np.bincount(hit >> FEATURE_BITS, table[hit & ((1 << FEATURE_BITS) - 1)], part.num_rows)
            yield part.filter(pa.array(sums + known.intercept < 0))

    return docs.mapInArrow(run, docs.schema)
