"""Near copies among vectors through a pivot-permutation index.

Each vector is described by its ``PREFIX`` nearest reference points (pivots), nearest first.  It is
entered in the inverted list of each of them.  Two vectors are a candidate pair when they share at least
``SHARED`` pivots; the pair is then verified by its cosine in double precision.

Lists are cut into blocks of about ``BLOCK`` vectors and blocks meet in pairs, so a list of any length is
many small tasks.  A pair of blocks is compared by a matrix product inside a task and returns, per vector,
how many vectors it links and the least vector of its group there: pairs never become rows.  A pair that
meets in several lists counts in the first pivot that both share.

Equal vectors are one entry with a count.  Pivots are a sample of ``sqrt(vectors)`` entries, at most
``MOST_PIVOTS``, drawn by hash; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.components import connected_components
from reviewlens.runtime import materialise

PREFIX = 8
SHARED = 3
BLOCK = 1024
MOST_PIVOTS = 4096
LEAST_COSINE = 0.98


def _scaled(vector: np.ndarray) -> np.ndarray:
    """The vector times a power of two, so that neither its norm nor a product over- or underflows."""
    return np.ldexp(vector, -int(np.frexp(np.abs(vector).max())[1]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each vector, scaled, in double precision; null for one that may not link."""
    for batch in batches:
        column = batch.column("embedding")
        values = pc.fill_null(pc.list_flatten(column).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) + 0.0
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        some = np.concatenate([[0], np.cumsum(values != 0)])
        keys = [_scaled(values[a:b]).tobytes() if b > a and bad[a] == bad[b] and some[a] < some[b] else None
                for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary())],
                                         ["vec_id", "label", "vector"])


def link_vectors(vectors: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine reaches ``least_cosine``.  A vector that
    is null, empty, zero or holds a null or non-finite component links with nothing, nor does a row without label or
    vec_id, nor vectors of different lengths.  Repeated rows are vectors of their own that link.  Rows that share a
    vec_id share its component and its number of links when their vectors are equal.  An empty table gives no rows;
    other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string")).mapInArrow(
        _keys, "vec_id long, label string, vector binary")
    rows = materialise(rows)
    usable = rows.where("vec_id is not null and label is not null and vector is not null")
    entries = materialise(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    links = materialise(_links(entries, least_cosine))
    parts = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    others = links.groupBy("node", "vector_key").agg(F.sum("links").alias("links"))
    whole = (entries.withColumn("vector_key", F.xxhash64("label", "vector")).join(others, ["node", "vector_key"], "left")
             .join(parts, "node", "left").select("label", "vector", "node", "copies", "links", "component"))
    found = rows.join(whole, ["label", "vector"], "left")
    usable_row = F.col("vec_id").isNotNull() & F.col("node").isNotNull()
    component = F.when(usable_row, F.coalesce("component", "node")).otherwise(F.col("vec_id"))
    return found.select(
        "vec_id", F.when(usable_row, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def pivots_of(entries: DataFrame, count: int) -> list[bytes]:
    """A bounded sample of entries, by hash."""
    drawn = entries.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(count)
    return [bytes(r["vector"]) for r in drawn.collect()]


def _links(entries: DataFrame, least_cosine: float) -> DataFrame:
    """node, root, links: of each entry in each pair of blocks where it links with another."""
    spark = entries.sparkSession
    n = entries.count()
    shipped = spark.sparkContext.broadcast(pivots_of(entries, max(1, min(MOST_PIVOTS, math.isqrt(n) + 1))))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, np.ndarray] = {}
        for raw in shipped.value:
            by_size.setdefault(len(raw), []).append(np.frombuffer(raw))
        points = {k: np.array(v) / np.linalg.norm(v, axis=1)[:, None] for k, v in by_size.items()}
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                nearest = []
                for raw in part.column("vector").to_pylist():
                    # vectors of a length without a pivot share one list
                    near = points.get(len(raw))
                    if near is None:
                        nearest.append([0])
                        continue
                    x = np.frombuffer(raw)
                    cosine = near @ (x / np.linalg.norm(x))
                    k = min(PREFIX, len(cosine))
                    top = np.argpartition(-cosine, k - 1)[:k]
                    nearest.append(top[np.lexsort((top, -cosine[top]))].tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("label", "node", "copies", "vector")] + [pa.array(nearest, pa.list_(pa.int32()))],
                    ["label", "node", "copies", "vector", "pivots"])

    described = entries.mapInArrow(describe, "label string, node long, copies long, vector binary, pivots array<int>")
    posted = materialise(described.withColumn("size", F.length("vector")).withColumn("pivot", F.explode("pivots")))
    cuts = posted.groupBy("label", "size", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    paired = (posted.join(cuts, ["label", "size", "pivot"])
              .withColumn("own", F.pmod(F.xxhash64("node", "vector"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _compare(group, least_cosine)

    return (paired.withColumn("vector_key", F.xxhash64("label", "vector"))
            .select("label", "size", "pivot", "low", "high", "own", "node", "vector_key", "copies", "vector", "pivots")
            .groupBy("label", "size", "pivot", "low", "high")
            .applyInPandas(compare, "node long, vector_key long, root long, links long"))


def _compare(group: pd.DataFrame, least_cosine: float) -> pd.DataFrame:
    """Links between the two blocks of ``group`` (or within its one block) that belong to its pivot."""
    pivot, low, high = (int(group[c].iloc[0]) for c in ("pivot", "low", "high"))
    a = group[group["own"] == low]
    b = a if low == high else group[group["own"] == high]
    if not len(a) or not len(b) or (low == high and len(a) < 2):
        return pd.DataFrame({"node": [], "vector_key": [], "root": [], "links": []})
    names = np.unique(np.concatenate(group["pivots"].to_list()))
    sides = []
    for side in (a, b):
        marks = np.zeros((len(side), len(names)), np.float32)
        lists = side["pivots"].to_list()
        marks[np.repeat(np.arange(len(side)), [len(x) for x in lists]), np.searchsorted(names, np.concatenate(lists))] = 1
        points = np.frombuffer(b"".join(side["vector"]), np.float64).reshape(len(side), -1)
        sides.append((marks, points, np.linalg.norm(points, axis=1)))
    (ma, xa, la), (mb, xb, lb) = sides
    earlier = names < pivot
    need = min(SHARED, len(names))
    candidate = (ma @ mb.T >= need) & (ma[:, earlier] @ mb[:, earlier].T == 0)
    linked = candidate & (xa @ xb.T / np.outer(la, lb) >= least_cosine)
    if low == high:
        np.fill_diagonal(linked, False)
    na, nb = a["node"].to_numpy(), b["node"].to_numpy()
    ra, rb = na.copy(), nb.copy()
    largest = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(ra, np.where(linked, rb[None, :], largest).min(1))
        new_b = new_a if low == high else np.minimum(rb, np.where(linked, new_a[:, None], largest).min(0))
        if (new_a == ra).all() and (new_b == rb).all():
            break
        ra, rb = new_a, new_b
    found = [(a, ra, linked @ b["copies"].to_numpy())]
    if low != high:
        found.append((b, rb, a["copies"].to_numpy() @ linked))
    parts = [pd.DataFrame({"node": side["node"].to_numpy(), "vector_key": side["vector_key"].to_numpy(), "root": root,
                           "links": links})[links > 0] for side, root, links in found]
    return pd.concat(parts)
