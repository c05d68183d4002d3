"""Homomorphic multiset hash of paragraphs.

A paragraph (non-empty line) hashes to a wide vector of 16-bit lanes; a text's fingerprint is
the sum of its paragraphs' vectors modulo 2**16.  The sum does not depend on the order, and a
paragraph is inserted or deleted by adding or subtracting its vector (``add``, ``subtract``).

The first ``EXACT_LANES`` lanes come from an extendable-output hash of the paragraph: equal
multisets have equal lanes, different ones practically never.  The ``SKETCH_LANES`` after them
count the paragraph's word pairs, each with a hashed sign in a hashed lane.  They add up in the
same way, and their cosine estimates how much of two texts agrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import texts

EXACT_LANES = 128
SKETCH_LANES = 256
SLICES = 4096


def vectors(strings: list[str]) -> np.ndarray:
    """One row of lanes per text."""
    column = pa.array(strings, pa.large_string())
    data, offsets = texts.utf8(column)
    out = np.zeros((len(strings), EXACT_LANES + SKETCH_LANES), np.uint16)
    for row, text in enumerate(strings):
        for paragraph in text.split("\n"):
            if paragraph:
                digest = hashlib.shake_128(paragraph.encode()).digest(2 * EXACT_LANES)
                out[row, :EXACT_LANES] += np.frombuffer(digest, "<u2")
    line = texts.WORD.copy()
    line[:] = True
    line[10] = False
    starts, ends, first = texts.word_spans(data, offsets)
    if len(starts):
        # a word's own paragraph: words pair up within it only
        paragraphs, _, _ = texts.word_spans(data, offsets, line)
        own = np.searchsorted(paragraphs, starts, "right")
        hashed = texts.span_hashes(texts.rolling(data), starts, ends)
        pair = hashed.copy()
        same = own[1:] == own[:-1]
        pair[1:][same] = texts.mix(hashed[1:][same] + hashed[:-1][same] * np.uint64(3))
        rows = np.repeat(np.arange(len(strings)), np.diff(first))
        lane = rows * SKETCH_LANES + (pair % np.uint64(SKETCH_LANES)).astype(np.int64)
        sign = 1 - 2 * ((pair >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
        sums = np.bincount(lane, sign, len(strings) * SKETCH_LANES).astype(np.int64)
        out[:, EXACT_LANES:] = (sums & 0xFFFF).astype(np.uint16).reshape(len(strings), SKETCH_LANES)
    return out


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of both multisets together."""
    return (a + b).astype(np.uint16)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint after taking ``b``'s paragraphs out of ``a``."""
    return (a - b).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, else the cosine of the sketch lanes within 0 to 1."""
    x, y = (v[:, EXACT_LANES:].astype(np.int16).astype(float) for v in (a, b))
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), norm, out=np.zeros(len(a)), where=norm > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cosine, 0.0, 1.0))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _hex(rows: np.ndarray) -> list[str]:
    return [row.astype("<u2").tobytes().hex() for row in rows]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row; a null text is empty, and an empty text sums to zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts.chunks(batches):
            strings = [t or "" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_hex(vectors(strings)))],
                                             ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in slices of descending doc_id, each slice ending with the row that opens the following one.

    Columns: slice, doc_id, text, ghost.  A ghost row is only looked at as the next text.  Ids are cut
    at quantiles of a bounded sketch, so the text is shuffled once and no task gets more than a slice.
    Rows of one doc_id stay together in the order of their texts; a null doc_id comes last.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    n = min(SLICES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    # slice 0 has the largest ids
    place = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))])
        place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(bounds, lambda c: c > F.col("doc_id"))))
    rows = rows.withColumn("slice", place)
    heads = sorted((r["slice"], r["head"], r["n"]) for r in rows.groupBy("slice").agg(
        F.max("doc_id").alias("head"), F.count("*").alias("n")).collect())
    # The first row of each slice also closes the slice before it; the very first closes the last.
    opening, closes = [None] * (len(cuts) + 2), [None] * (len(cuts) + 2)
    for i, (at, head, _) in enumerate(heads):
        opening[at], closes[at] = head, heads[i - 1][0]
    row_of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("slice"))
    opens = F.when(F.col("doc_id").eqNullSafe(row_of(opening, "long")), row_of(closes, "int"))
    return (rows.withColumn("opens", opens)
            .select(F.explode(F.array(F.struct(F.col("slice"), F.lit(False).alias("ghost")),
                                      F.struct(F.col("opens").alias("slice"), F.lit(True).alias("ghost")))).alias("at"),
                    "doc_id", "text")
            .select("at.slice", "at.ghost", "doc_id", "text").where("slice is not null")
            .repartition(n, "slice").sortWithinPartitions("slice", "ghost", F.col("doc_id").desc_nulls_last(), "text"))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to it and to the next text.

    One row per input row.  A null text is empty; equal texts have equal fingerprints; a single row
    is its own next; repeated doc_ids follow each other in the order of their texts.  An empty table
    gives no rows.  Only doc_id and text are read.
    """
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def work(ids, strings, following):
        edited = [edited_text(a, b) for a, b in zip(strings, following)]
        own, other, nxt = vectors(strings), vectors(edited), vectors(following)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in strings], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
             pa.array(_hex(own)), pa.array(_hex(other)), pa.array(likeness(own, other)), pa.array(likeness(own, nxt))],
            [x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (slice, doc_id, text) that waits for its next row
        for part in texts.chunks(batches):
            ids, strings, following = [], [], []
            for at, ghost, key, text in zip(*(part.column(c).to_pylist() for c in ("slice", "ghost", "doc_id", "text"))):
                text = text or ""
                if last is not None and last[0] == at:
                    ids.append(last[1])
                    strings.append(last[2])
                    following.append(text)
                # after its first ghost a slice is over: more ghosts are rows that share the opening doc_id
                last = None if ghost else (at, key, text)
            if ids:
                yield work(ids, strings, following)

    return with_next(docs).mapInArrow(run, schema)
