"""Language identification: averaged hashed subword embeddings with a linear softmax.

A subword is a run of 3 or 4 bytes of a lower-cased word with one border mark on either side; it
hashes to a row of an embedding table.  A text is the mean of its subwords' embeddings, and a linear
softmax over it gives the languages.  Both tables are trained by stochastic gradient descent in numpy
on a bounded sample of labelled rows; a part of the sample that the descent does not see sets the
softmax temperature and the score below which a text counts as rejected.

The embedding table times the softmax table is one small table (subword rows x languages), which is
what tasks get; its size does not depend on the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import texts

BUCKET_BITS = 15
DIMENSIONS = 16
#: Bound of the training sample: so many rows at most, languages as evenly as they come.
SAMPLE_ROWS = 4096
EPOCHS = 8
RATE = 2.0
#: Share of the right answers on rows kept aside that may be rejected.
REJECTED_SHARE = 0.01
UNDETERMINED = "und"
_MIX = np.uint32(2654435769)


@dataclass
class Model:
    """languages in order, table (subword rows x languages) of logits, temperature, least accepted score."""

    languages: list[str]
    table: np.ndarray
    temperature: float
    least: float


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of all rows, and each row's first one."""
    letter = texts.LETTER[data]
    # every row gets a border before and after it
    n, rows = len(data), len(offsets) - 1
    at = np.arange(n) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))
    padded = np.zeros(n + rows + 1, np.uint32)
    padded[at] = np.where(letter, data, 0)
    starts = offsets + np.arange(rows + 1)
    inner = padded > 0
    found, where = [], []
    for size in (3, 4):
        if len(padded) < size:
            continue
        last = len(padded) - size + 1
        code = np.zeros(last, np.uint32)
        keep = np.ones(last, bool)
        for i in range(size):
            code |= padded[i:i + last] << np.uint32(8 * i)
            if 0 < i < size - 1:
                keep &= inner[i:i + last]
        position = np.flatnonzero(keep)
        code = code[position] * _MIX ^ np.uint32(size)
        found.append((code * _MIX) >> np.uint32(32 - BUCKET_BITS))
        where.append(position)
    if not found:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    row = np.concatenate([np.searchsorted(starts, p, "right") - 1 for p in where])
    order = np.argsort(row, kind="stable")
    first = np.searchsorted(row[order], np.arange(rows + 1))
    return np.concatenate(found)[order].astype(np.int64), first


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct subwords of each row with their shares, as bytes."""
    for part in texts.chunks(batches):
        grams, first = subwords(*texts.utf8(texts.lowered(part.column("text"))))
        keys, shares = [], []
        for low, high in zip(first[:-1], first[1:]):
            k, c = np.unique(grams[low:high], return_counts=True)
            keys.append(k.astype(np.int32).tobytes())
            shares.append((c / max(1, c.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(keys, pa.binary()),
                                          pa.array(shares, pa.binary())], ["lang", "keys", "shares"])


def _enough(counts: list[int], rows: int) -> float:
    """The place below which about ``rows`` rows lie, as each language's places are spread evenly up to its count."""
    low, left = 0.0, float(rows)
    counts = sorted(counts)
    for i, count in enumerate(counts):
        step = (count - low) * (len(counts) - i)
        if step >= left:
            return low + left / (len(counts) - i)
        low, left = float(count), left - step
    return math.inf


def _sample(rows: DataFrame, size: int):
    """(lang, subwords, shares) of a bounded sample.  A row's place in the draw is a hash spread over its
    language's count, so that a rare language is taken whole before a frequent one is."""
    rows = rows.select(F.col("lang").cast("string"), F.col("text").cast("string"), "doc_id").where(
        "lang is not null and text is not null")
    counts = rows.groupBy("lang").count().collect()  # one row per language
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    by_language = rows.sparkSession.createDataFrame(counts, "lang string, count long")
    # no task hands over more than its share of about twice the sample, however many tasks there are
    drawn = (rows.join(F.broadcast(by_language), "lang").withColumn("place", spread * F.col("count"))
             .where(F.col("place") <= _enough([r["count"] for r in counts], 2 * size))
             .orderBy("place", "lang", "text").limit(size).select("lang", "text"))
    made = drawn.mapInArrow(_features, "lang string, keys binary, shares binary").collect()
    return sorted((r["lang"], bytes(r["keys"]), bytes(r["shares"])) for r in made if len(r["keys"]))


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """Fit on labelled rows (doc_id, text, lang).  Null labels or texts and texts without letters are left out;
    without any row the model knows no language and answers ``und``."""
    sample = _sample(rows, sample_rows)
    languages = sorted({lang for lang, _, _ in sample})
    rng = np.random.default_rng(seed)
    buckets = 1 << BUCKET_BITS
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), 1.0, 0.0)
    number = {lang: i for i, lang in enumerate(languages)}
    order = rng.permutation(len(sample))
    aside, used = order[:len(sample) // 5], order[len(sample) // 5:]
    embed = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (buckets, DIMENSIONS)).astype(np.float32)
    soft = np.zeros((DIMENSIONS, len(languages)), np.float32)
    parsed = [(number[lang], np.frombuffer(k, np.int32), np.frombuffer(s, np.float32)) for lang, k, s in sample]
    steps, done = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            target, keys, shares = parsed[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = shares @ embed[keys]
            odds = np.exp(hidden @ soft - (hidden @ soft).max())
            slope = odds / odds.sum()
            slope[target] -= 1
            back = soft @ slope
            soft -= rate * 0.5 * np.outer(hidden, slope)
            # the mean's gradient, scaled up as each subword carries but a small share of it
            embed[keys] -= (rate * 10) * shares[:, None] * back
    table = embed @ soft
    aside = aside if len(aside) else used
    logits = np.array([s @ table[k] for _, k, s in (parsed[i] for i in aside)])
    truth = np.array([parsed[i][0] for i in aside])
    temperature = min((2.0 ** e for e in range(-6, 7)), key=lambda t: _loss(logits / t, truth))
    chance = _softmax(logits / temperature)
    right = chance.max(1)[chance.argmax(1) == truth]
    least = float(np.quantile(right, REJECTED_SHARE)) if len(right) else 0.0
    return Model(languages, table.astype(np.float32), temperature, least)


def _softmax(x: np.ndarray) -> np.ndarray:
    odds = np.exp(x - x.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    return float(-np.log(_softmax(logits)[np.arange(len(truth)), truth] + 1e-12).mean())


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row.

    ``und`` with score 0 and rejected for a null text and for one without a letter; else a learned
    language, its calibrated probability, and whether that is below the accepted score.  Repeated rows
    get equal answers, an empty table gives no rows, and only doc_id and text are read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for part in texts.chunks(batches):
            column = part.column("text")
            data, offsets = texts.utf8(texts.lowered(column))
            plain = np.zeros(256, bool)
            plain[97:123] = True
            letters = texts.row_sums(plain[data].astype(np.int64), offsets) > 0
            for i in np.flatnonzero(~letters):
                letters[i] = _has_letter(column[i].as_py())
            if not known.languages:
                letters[:] = False
            best, score = np.zeros(part.num_rows, int), np.zeros(part.num_rows)
            if known.languages:
                grams, first = subwords(data, offsets)
                sums = np.stack([texts.row_sums(known.table[grams, c].astype(np.float64), first)
                                 for c in range(len(known.languages))], axis=1)
                chance = _softmax(sums / np.maximum(1, np.diff(first))[:, None] / known.temperature)
                best, score = chance.argmax(1), chance.max(1)
            names = [known.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
            score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names), pa.array(score), pa.array(~letters | (score < known.least))],
                ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")
