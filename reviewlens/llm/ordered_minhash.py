"""Near copies among texts by order MinHash, verified by banded alignment.

A text is its sequence of word 5-shingles, each labelled with its occurrence number, so that labelled shingles
are unique within a text.  A sketch takes the ``TAKEN`` labelled shingles of least hash and keeps them in text order;
two texts agree in a sketch only if they have the same least shingles in the same order, which makes sketches
sensitive to edit similarity.  There are ``SKETCHES`` of them; texts that agree in one are a candidate pair.

Verification aligns the labelled shingles of both texts within a band: two texts are near copies when the longest
common sequence m has m / (a + b - m) >= 0.8.  Then at most (a + b) / 9 shingles of both lie outside the alignment, so
aligned positions differ by no more; that is the band.  Labelled shingles are unique, so the alignment is a
longest increasing sequence of positions.

At 0.8 a pair misses one sketch with a chance of about 1 - 0.8**3 and all 20 with less than 1e-6.

Large groups: texts of equal words are one entry.  Entries of a bucket are first compared with one head, and what
matches it is joined; only members that are still in different components are compared with further heads.  What is
left after that meets in blocks of ``BLOCK`` members: a task compares two blocks by the parity signatures of their
shingles (2048 bits; the distance of two signatures is at most the number of shingles that only one text has, so a
larger distance rules a pair out) and returns only pairs that may still match.  So a group of thousands of copies
costs a comparison each, pairs that cannot match never become rows, and no candidate pair is left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import texts
from reviewlens.llm.components import connected_components
from reviewlens.runtime import materialise

SHINGLE = 5
TAKEN = 3
SKETCHES = 20
LEAST = 0.8
STAR_ROUNDS = 3
BLOCK = 1024
PARITY_BITS = 2048
_SEEDS = texts.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash of each lower-cased word of all rows, and each row's first word."""
    data, offsets = texts.utf8(texts.lowered(part.column("text")))
    starts, ends, first = texts.word_spans(data, offsets)
    return (texts.span_hashes(texts.rolling(data), starts, ends) >> np.uint64(32)).astype(np.uint32), first


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hash of each shingle with its occurrence number, in text order.  Fewer words than a shingle make one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    wide = words.astype(np.uint64)
    size = min(SHINGLE, len(wide))
    code = np.zeros(len(wide) - size + 1, np.uint64)
    for i in range(size):
        code = texts.mix(code + wide[i:i + len(code)])
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    new = np.ones(len(code), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if new.all():
        return code
    at = np.arange(len(code))
    label = np.empty(len(code), np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(label > 0, texts.mix(code + label * _ODD), code)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the least labelled shingles in text order."""
    taken = min(TAKEN, len(shingles))
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, 400_000 // len(shingles))
    for low in range(0, SKETCHES, step):
        drawn = (shingles[None, :] ^ _SEEDS[low:low + step, None]) * _ODD
        drawn ^= drawn >> np.uint64(29)
        least = np.sort(np.argpartition(drawn, taken - 1, axis=1)[:, :taken], axis=1)
        code = _SEEDS[low:low + step].copy()
        for i in range(taken):
            code = texts.mix(code + shingles[least[:, i]])
        out[low:low + step] = code
    return out


def parity(shingles: np.ndarray) -> bytes:
    """PARITY_BITS bits, each the parity of the number of labelled shingles that hash to it."""
    odd = np.bincount((shingles >> np.uint64(20) & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common sequence of two labelled shingle sequences within the band that LEAST allows;
    0 as soon as it cannot reach LEAST."""
    both = len(a) + len(b)
    need = LEAST / (1 + LEAST) * both - 1e-9
    if min(len(a), len(b)) < need:
        return 0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= both / 9
    i, j = i[inside], j[inside]
    if len(i) < need:
        return 0
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        at = bisect_left(tails, x)
        tails[at:at + 1] = [x]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    m = aligned(a, b)
    return m / (len(a) + len(b) - m) if m else 0.0


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in texts.chunks(batches):
        words, first = word_hashes(part)
        contents, made, parities, sizes = [], [], [], []
        for low, high in zip(first[:-1], first[1:]):
            own = words[low:high]
            contents.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            shingles = labelled_shingles(own)
            made.append(sketches(shingles).view(np.int64) if len(own) else None)
            parities.append(parity(shingles))
            sizes.append(len(shingles))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(contents, pa.binary()), pa.array(made, pa.list_(pa.int64())),
             pa.array(parities, pa.binary()), pa.array(sizes, pa.int32())], ["doc_id", "content", "sketches", "parity", "size"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and words of the rows that are the entry asked for."""
    for part in texts.chunks(batches):
        words, first = word_hashes(part)
        rows = [words[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        right = pa.array([hashlib.blake2b(w, digest_size=16).digest() == c for w, c in zip(rows, part.column("content").to_pylist())])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], ["node", "words"]).filter(right)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            for x, y in zip(part.column("words_a").to_pylist(), part.column("words_b").to_pylist()):
                a, b = (labelled_shingles(np.frombuffer(w, np.uint32)) for w in (x, y))
                near.append(similarity(a, b) >= LEAST - 1e-12)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the group of near copies) and kept for every row.

    Groups are what links of similarity 0.8 or more connect.  A null text, an empty one and one without words is
    linked with nothing.  Rows that share a doc_id count as one document.  A row without doc_id takes the class
    of equal texts, null if there is none, and is kept.  An empty table gives no rows; only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = materialise(rows.mapInArrow(
        _describe, "doc_id long, content binary, sketches array<long>, parity binary, size int"))
    entries = described.where("content is not null and doc_id is not null").groupBy("content").agg(
        F.min("doc_id").alias("node"), F.first("sketches").alias("sketches"), F.first("parity").alias("parity"), F.first("size").alias("size"))
    nodes = materialise(entries)
    posted = nodes.select("node", F.explode("sketches").alias("bucket"))
    shared = posted.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    posted = materialise(posted.join(shared.select("bucket"), "bucket").distinct())
    wanted = nodes.join(posted.select("node").distinct(), "node").select(F.col("node").alias("doc_id"), "content")
    words = materialise(rows.join(wanted, "doc_id").mapInArrow(_words, "node long, words binary").dropDuplicates(["node", "words"]))

    edges = described.where("content is not null and doc_id is not null").join(nodes.select("content", "node"), "content").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    found, tested = None, None
    for turn in range(STAR_ROUNDS + 1):
        pairs = _head_pairs(posted, found, turn) if turn < STAR_ROUNDS else _rest_pairs(posted, found, nodes)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        if pairs.isEmpty():
            if tested is None or turn == STAR_ROUNDS:
                break
            continue
        tested = pairs if tested is None else tested.union(pairs)
        near = materialise(
            pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a")
            .join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
            .select("a", "b", "words_a", "words_b").mapInArrow(_verify, "a long, b long"))
        edges = edges.union(near)
        if turn < STAR_ROUNDS:
            found = connected_components(near if found is None else near.union(
                found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    classes = connected_components(edges)
    whole = described.select("doc_id", "content").join(nodes.select("content", "node"), "content", "left").join(classes, "node", "left")
    own = F.coalesce("component", "node", "doc_id")
    return whole.select("doc_id", own.alias("class_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _members(posted: DataFrame, found: DataFrame | None) -> DataFrame:
    """bucket, node and component of the buckets that hold more than one component."""
    if found is None:
        return posted.withColumn("component", F.col("node"))
    members = posted.join(found, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))
    mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return members.join(mixed.select("bucket"), "bucket")


def _head_pairs(posted: DataFrame, found: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (a < b) of this round's head of each bucket with its members of other components."""
    members = _members(posted, found)
    place = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    heads = members.groupBy("bucket").agg(F.min(F.struct(place.alias("place"), F.col("node"), F.col("component"))).alias("head"))
    return members.join(heads, "bucket").where("component <> head.component").select(
        F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()


def _rest_pairs(posted: DataFrame, found: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """Pairs (a < b) of members of different components that the signatures do not rule out."""
    members = materialise(_members(posted, found))
    cuts = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    paired = (members.join(nodes.drop("content"), "node").join(cuts, "bucket")
              .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")))
    return (paired.select("bucket", "low", "high", "own", "node", "component", "sketches", "parity", "size")
            .groupBy("bucket", "low", "high").applyInPandas(_possible, "a long, b long"))


def _possible(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of two blocks (or within one) that may match and whose first common sketch is this bucket."""
    bucket, low, high = (int(group[c].iloc[0]) for c in ("bucket", "low", "high"))
    sides = []
    for block in (low, high):
        side = group[group["own"] == block]
        sides.append((side["node"].to_numpy(), side["component"].to_numpy(), side["size"].to_numpy(),
                      np.frombuffer(b"".join(side["parity"]), np.uint64).reshape(len(side), -1),
                      np.array(side["sketches"].to_list(), np.int64).reshape(len(side), -1)))
    (na, ca, za, pa_, sa), (nb, cb, zb, pb, sb) = sides
    left, right = [], []
    for i in range(len(na)):  # a row against a whole block at a time
        both = za[i] + zb
        near = np.bitwise_count(pa_[i] ^ pb).sum(axis=1) * (1 + LEAST) <= both * (1 - LEAST) + 1e-6
        j = np.flatnonzero(near & (ca[i] != cb) & ((na[i] < nb) if low == high else True))
        if len(j):
            common = sa[i] == sb[j]
            j = j[sb[j, common.argmax(axis=1)] == bucket]
            left.append(np.minimum(na[i], nb[j]))
            right.append(np.maximum(na[i], nb[j]))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pd.DataFrame({"a": join(left), "b": join(right)})


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, its smallest doc_id, and the columns it had.

    Rows that repeat a doc_id and a text are one; rows without doc_id stay.
    """
    dropped = near_copies(docs).where("not kept").select(F.col("doc_id").alias("__dropped")).distinct()
    kept = docs.join(dropped, docs["doc_id"].cast("long") == dropped["__dropped"], "left_anti")
    repeated = materialise(docs.groupBy(docs["doc_id"].cast("long").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1 and __id is not null"))
    if repeated.isEmpty():
        return kept
    same = kept["doc_id"].cast("long") == repeated["__id"]
    return kept.join(repeated, same, "left_anti").union(
        kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
