"""Clustering of product vectors: k-means, average-linkage merging, scores and summaries."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.fixed_values import CLUSTER_NOTE
from reviewlens.operators.features import canonical_signs
from reviewlens.operators.ordering import exact_quantiles, top_per_group
from reviewlens.operators.taxonomy import cluster_examples, cluster_sizes
from reviewlens.runtime import materialise, release, together

log = logging.getLogger(__name__)
SCAN_SCHEMA = "method string, k int, clusters int, inertia double, elbow_score double, silhouette_score double"


# --- scores of a clustering ------------------------------------------------------

def elbow_score(labelled: DataFrame, vector: str = "vector", cluster: str = "cluster_id") -> DataFrame:
    """One row: squared distance of all rows to the mean of their cluster.

    Sums of values and of squares per cluster and axis give it in one aggregate.
    """
    axes = labelled.select(cluster, F.posexplode(vector).alias("axis", "x"))
    sums = axes.groupBy(cluster, "axis").agg(
        F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return sums.agg(F.coalesce(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")), F.lit(0.0))
                    .alias("elbow_score"))


def silhouette(labelled: DataFrame, vector: str = "vector", cluster: str = "cluster_id") -> float:
    """Mean cosine silhouette, in time linear in the rows."""
    shaped = labelled.select(array_to_vector(F.col(vector)).alias("features"),
                             F.col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="cosine").evaluate(shaped)


def _scan_row(labelled: DataFrame, method: str, k: int, inertia: float | None) -> tuple:
    """One row of a scan.  Rows of zeros have no direction: both methods are scored without them."""
    labelled = labelled.filter(F.col("cluster_id").isNotNull() & F.exists("vector", lambda x: x != 0))
    clusters = labelled.select("cluster_id").distinct().count()
    if clusters < 2:
        return (method, k, clusters, inertia, None, None)
    return (method, k, clusters, inertia, elbow_score(labelled).first()["elbow_score"], silhouette(labelled))


# --- k-means ---------------------------------------------------------------------

#: Passes of a k-means fit at most, and the move of a centre that counts as none.
PASSES, STILL = 20, 1e-4
#: Rows of a task that meet the centres at once.
MEET = 4096


@dataclass
class Clusters:
    """Centres of a k-means fit, and the squared distance of all rows to the centres that its last pass began with."""

    centres: np.ndarray
    cost: float = 0.0

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each row, the first of equally near ones."""
        return ((self.centres ** 2).sum(axis=1) - 2.0 * (x @ self.centres.T)).argmin(axis=1)


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def fit_kmeans(vectors: DataFrame, k: int, vector: str = "vector", restarts: int = 10, seed: int = 42) -> Clusters:
    """Best of several seeded starts by within-cluster cost; starts run at a time.  Cache or write ``vectors`` before."""
    shaped = vectors.select(array_to_vector(F.col(vector)).alias("features")).persist()
    try:
        return _best_starts(shaped, [k], restarts, seed)[k]
    finally:
        shaped.unpersist()


def _best_starts(shaped: DataFrame, ks: list[int], restarts: int, seed: int) -> dict[int, Clusters]:
    """The cheapest model of each k, the earlier start on a tie; the starts of all k share each pass over one cached table."""
    starts = [(k, i) for k in ks for i in range(restarts)]
    # Spark's k-means chooses the first centres (k-means||); its passes, a job each and fit, are left out
    first = together([lambda k=k, i=i: KMeans(k=k, seed=seed + i, featuresCol="features", maxIter=0).fit(shaped).clusterCenters() for k, i in starts])
    models = _settled(shaped.select(vector_to_array("features").alias("x")), [Clusters(np.array(c)) for c in first])
    best: dict[int, Clusters] = {}
    for (k, _), model in zip(starts, models):
        if k not in best or model.cost < best[k].cost:
            best[k] = model
    return best


def _assigned(shipped):
    """Per task and fit: rows and sums of each centre, and the cost, as one value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = shipped.value
        sums = {i: np.zeros((len(m.centres), m.centres.shape[1] + 2)) for i, m in fits.items()}
        met = False
        for batch in batches:
            for low in range(0, batch.num_rows, MEET):
                x, met = _rows_of(batch.column("x").slice(low, MEET)), True
                for i, model in fits.items():
                    own = model.nearest(x)
                    member = (own == np.arange(len(model.centres))[:, None]).astype(float)
                    sums[i][:, 0] += member.sum(axis=1)
                    sums[i][:, 1] += member @ ((x - model.centres[own]) ** 2).sum(axis=1)
                    sums[i][:, 2:] += member @ x
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["fit", "part"])

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p.as_py()) for p in table.column("part"))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["fit", "part"])


def _settled(rows: DataFrame, models: list[Clusters]) -> list[Clusters]:
    """The models after their passes over ``rows`` (x), all of them in step; a fit whose centres stand still has ended."""
    moving = dict(enumerate(models))
    for _ in range(PASSES):
        if not moving:
            break
        shipped = rows.sparkSession.sparkContext.broadcast(moving)
        found = rows.mapInArrow(_assigned(shipped), "fit int, part binary").groupBy("fit").applyInArrow(_added, "fit int, part binary").collect()
        shipped.destroy()
        still = {}
        for r in found:  # one row per fit, as large as its centres
            old = moving[r["fit"]].centres
            sums = np.frombuffer(r["part"]).reshape(len(old), -1)
            new = np.where(sums[:, :1] > 0, sums[:, 2:] / np.maximum(sums[:, :1], 1.0), old)  # a centre without rows stays
            models[r["fit"]] = Clusters(new, float(sums[:, 1].sum()))
            if (((new - old) ** 2).sum(axis=1) > STILL ** 2).any():
                still[r["fit"]] = models[r["fit"]]
        moving = still
    return models


def kmeans_labels(vectors: DataFrame, model: Clusters, vector: str = "vector") -> DataFrame:
    """Add ``cluster_id``, the number of the nearest centre."""
    shipped = vectors.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("int")
    def label(x: pa.Array) -> pa.Array:
        return pa.array(shipped.value.nearest(_rows_of(x)), pa.int32())

    return vectors.withColumn("cluster_id", label(F.col(vector).cast("array<double>")))


def scan_kmeans(vectors: DataFrame, ks: list[int], vector: str = "vector", restarts: int = 10) -> DataFrame:
    """Inertia, elbow score and silhouette, one row for every k; scores are null where there are fewer than two
    clusters or more clusters asked for than there are different rows."""
    different = vectors.select(vector).distinct().count()
    shaped = vectors.select(array_to_vector(F.col(vector)).alias("features")).persist()
    rows = vectors.persist()
    try:
        best = _best_starts(shaped, [k for k in ks if k <= different], restarts, 42)

        def row(k: int) -> tuple:
            if k not in best:
                return ("KMeans", k, different, None, None, None)
            labelled = kmeans_labels(rows, best[k], vector).withColumnRenamed(vector, "vector")
            return _scan_row(labelled, "KMeans", k, best[k].cost)

        scanned = together([lambda k=k: row(k) for k in ks])
    finally:
        shaped.unpersist()
        rows.unpersist()
    return vectors.sparkSession.createDataFrame(scanned, SCAN_SCHEMA)


# --- average linkage ---------------------------------------------------------------

def _nearest_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every cluster of block A the nearest one of block B, by average cosine distance, and with ``both`` the reverse."""
    for batch in batches:
        for i in range(batch.num_rows):
            sides = []
            for side in "ab":
                cid, size, vec = (batch.column(f"{side}_{c}")[i].values.to_numpy(zero_copy_only=False) for c in ("cid", "size", "vec"))
                order = np.argsort(cid, kind="stable")  # in id order: the lowest id wins ties
                sides.append((cid[order], size[order], vec.reshape(len(cid), -1)[order]))
            (a, a_size, a_vec), (b, b_size, b_vec) = sides
            distance = np.round(1.0 - (a_vec @ b_vec.T) / np.outer(a_size, b_size), 12)
            distance[a[:, None] == b[None, :]] = np.inf
            for own, other, d in ((a, b, distance), (b, a, distance.T))[:2 if batch.column("both")[i].as_py() else 1]:
                best = d.argmin(axis=1)
                value = d[np.arange(len(best)), best]
                found = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(own[found]), pa.array(other[best][found]), pa.array(value[found])],
                                                 ["cid", "near", "distance"])


#: Clusters of a block, clusters that one task merges to the end, and how many of them it searches at a time.
BLOCK_ROWS, LAST_ROWS, SEARCHED_ROWS = 2048, 16384, 256
#: Rows of a table that a join of the merging may still send through the driver.
SENT_ROWS = 4096


def _kept_out(table: DataFrame, count: int) -> DataFrame:
    """``table`` for the right side of a join; one of more than ``SENT_ROWS`` rows is shuffled and never passes the driver.

    Rounds are many: tables just small enough to be broadcast in each of them add up at the driver.
    """
    return table.hint("merge") if count > SENT_ROWS else table


def _packed(clusters: DataFrame, blocks: int) -> DataFrame:
    """Blocks of clusters as three flat arrays, written: a few blocks to a file."""
    parts = min(blocks, 4 * clusters.sparkSession.sparkContext.defaultParallelism)
    dealt = clusters.select(F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("block"), F.struct("cid", "size", "vec").alias("item"))
    items = dealt.repartition(parts, "block").groupBy("block").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return materialise(items.select("block", F.col("items.cid").alias("cid"), F.col("items.size").alias("size"), F.flatten("items.vec").alias("vec")))


def nearest_clusters(clusters: DataFrame, block_rows: int, count: int, of: DataFrame | None = None, of_count: int = 0) -> DataFrame:
    """Nearest other cluster of each cluster (cid, vec = sum of unit rows, size), or of those in ``of`` (cid) only; written.

    Clusters are hashed into blocks of about ``block_rows``, which are written once.  Tasks read the files of two slices of
    blocks and reduce each pair of *blocks* to one row per cluster by a matrix product; no block is copied for its
    partners, and pairs of rows never exist as rows.  Without ``of`` a pair of blocks is formed once and gives the nearest
    clusters of both.
    """
    every = _packed(clusters, max(1, -(-count // block_rows)))
    some = every if of is None else _packed(clusters.join(_kept_out(of, of_count), "cid", "left_semi"), max(1, -(-of_count // block_rows)))
    a, b = (t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns]) for t, s in ((some, "a"), (every, "b")))
    met = F.col("a_block") <= F.col("b_block") if of is None else F.lit(True)
    both = (F.col("a_block") != F.col("b_block")) & F.lit(of is None)
    found = a.crossJoin(b.hint("shuffle_replicate_nl")).where(met).select(
        *[f"{s}_{c}" for s in "ab" for c in ("cid", "size", "vec")], both.alias("both")).mapInArrow(
        _nearest_of_blocks, "cid long, near long, distance double")
    best = F.min(F.struct("distance", "near"))
    try:
        return materialise(found.groupBy("cid").agg(best.alias("m")).select("cid", "m.near", "m.distance"))
    finally:
        release(every, some)


def _merge_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All further merges of the last clusters (cid, vec, size, and near and distance where still known), round by round."""
    held = pa.Table.from_batches(list(batches), schema=_REST)
    cid, size = held.column("cid").to_numpy(), held.column("size").to_numpy()
    order = np.argsort(cid, kind="stable")  # in id order: the lowest id wins ties
    vec = held.column("vec").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)[order]
    known, value = held.column("near").combine_chunks().fill_null(-1).to_numpy()[order], held.column("distance").to_numpy()[order]
    unknown = held.column("near").combine_chunks().is_null().to_numpy(zero_copy_only=False)[order]
    cid, size = cid[order], size[order]
    near = np.where(unknown, -1, np.searchsorted(cid, known))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(cid) > 1:
        searched = np.flatnonzero(near < 0)
        for low in range(0, len(searched), SEARCHED_ROWS):
            again = searched[low:low + SEARCHED_ROWS]
            distance = np.round(1.0 - (vec[again] @ vec.T) / np.outer(size[again], size), 12)
            distance[np.arange(len(again)), again] = np.inf
            near[again] = distance.argmin(axis=1)
            value[again] = distance[np.arange(len(again)), near[again]]
        at = np.arange(len(cid))
        finite = np.isfinite(value)
        one = np.flatnonzero(finite & (near[near] == at) & (at < near))
        if not len(one):  # only possible through floating-point noise: merge the closest pair
            one = np.lexsort((at, np.where(finite, value, np.inf)))[:1]
            if not finite[one[0]]:
                break
        low, high = np.minimum(one, near[one]), np.maximum(one, near[one])
        out.append((cid[high], cid[low], value[one]))
        vec[low] += vec[high]
        size[low] += size[high]
        stays, changed = np.ones(len(cid), bool), np.zeros(len(cid), bool)
        stays[high] = False
        changed[low] = changed[high] = True
        near[(near < 0) | changed | changed[near]] = -1
        place = np.cumsum(stays) - 1
        near = np.where(near < 0, -1, place[near])[stays]
        cid, size, vec, value = cid[stays], size[stays], vec[stays], value[stays]
    for child, parent, height in out:
        yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent), pa.array(height)], ["child", "parent", "height"])


_REST = pa.schema([("cid", pa.int64()), ("vec", pa.list_(pa.float64())), ("size", pa.int64()), ("near", pa.int64()), ("distance", pa.float64())])


def _sum_arrays(arrays: Column) -> Column:
    return F.aggregate(F.slice(arrays, 2, F.size(arrays)), arrays[0],
                       lambda a, b: F.zip_with(a, b, lambda x, y: x + y))


def merge_average_linkage(vectors: DataFrame, id_col: str, vector: str = "vector",
                          block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Full average-linkage merge history under cosine distance.

    Returns ``(members, merges)``: ``members`` (id, cid) maps every row to its
    starting cluster, ``merges`` (child, parent, height) has one row per merge.

    For unit rows the average distance of two clusters is 1 - sumA·sumB/(nA nB), so
    a cluster is its vector sum and size.  All pairs that are each other's nearest
    merge in the same round; average linkage is reducible, so the heights equal
    those of one-at-a-time merging.  Equal rows start as one cluster (height 0);
    all-zero rows, which have no direction, have a null cid.  Rounds are short jobs: once
    ``LAST_ROWS`` clusters are left, or no more than a smaller block, one task makes the rest of them.
    """
    last_rows = LAST_ROWS if block_rows >= BLOCK_ROWS else block_rows
    rounded = F.transform(vector, lambda x: F.round(x, 12) + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), rounded.alias("vec"))
    groups = materialise(rows.filter(F.exists("vec", lambda x: x != 0)).groupBy("vec").agg(F.min("id").alias("cid"), F.count("*").alias("size")))
    count = groups.count()
    members = materialise(rows.join(_kept_out(groups, count), "vec", "left").select("id", "cid"))
    clusters = groups.select("cid", F.transform("vec", lambda x: x * F.col("size")).alias("vec"), "size")
    history: list[DataFrame] = []
    near, read = None, [groups]  # tables that the clusters and their neighbours are read from
    while count > 1:
        if near is not None:
            # Average linkage is reducible: a merged cluster is never nearer than the nearer of its parts, so that only
            # clusters that are new, or whose neighbour is no more what it was, have to be searched again.
            gone = merged.select(F.col("child").alias("cid")).union(merged.select(F.col("parent").alias("cid")))
            kept = near.join(_kept_out(gone, before), "cid", "left_anti").join(
                _kept_out(gone.select(F.col("cid").alias("near")), before), "near", "left_anti")
        if count <= last_rows:
            log.info("merged the last %d clusters", count)
            found = clusters.select("cid", F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("distance")) if near is None else kept
            rest = clusters.join(_kept_out(found, count), "cid", "left").select("cid", "vec", F.col("size").cast("long").alias("size"), "near", "distance")
            history.append(materialise(rest.coalesce(1).mapInArrow(_merge_rest, "child long, parent long, height double")))
            break
        if near is None:
            log.info("searched %d of %d clusters", count, count)
            near = nearest_clusters(clusters, block_rows, count)
        else:
            again = materialise(clusters.select("cid").join(_kept_out(kept, before), "cid", "left_anti"))
            open_count = again.count()
            log.info("searched %d of %d clusters", open_count, count)
            found = nearest_clusters(clusters, block_rows, count, again, open_count)
            old, near = near, materialise(kept.select("cid", "near", "distance").union(found))
            release(old, again, found)
        back = near.select(F.col("cid").alias("near"), F.col("near").alias("cid"))
        pairs = near.join(_kept_out(back, count), ["cid", "near"]).filter(F.col("cid") < F.col("near"))
        if pairs.isEmpty():  # only possible through floating-point noise: merge the closest pair
            pairs = near.orderBy("distance", "cid", "near").limit(1)
        merged = pairs.select(F.greatest("cid", "near").alias("child"), F.least("cid", "near").alias("parent"),
                              F.col("distance").alias("height"))
        merged = materialise(merged)
        history.append(merged)
        target = F.coalesce("parent", "cid")
        clusters = materialise(
            clusters.join(_kept_out(merged, count), F.col("cid") == F.col("child"), "left")
            .groupBy(target.alias("cid"))
            .agg(_sum_arrays(F.collect_list("vec")).alias("vec"), F.sum("size").alias("size")))
        release(*read)
        read = [clusters]
        before, count = count, clusters.count()
    empty = vectors.sparkSession.createDataFrame([], "child long, parent long, height double")
    merges = materialise(reduce(DataFrame.unionByName, history, empty))
    release(*read, *history, *[near] * (near is not None))
    return members, merges


def _cut_roots(members: DataFrame, merges: DataFrame, ks: list[int]) -> tuple[DataFrame, int, list[tuple[int, int, int]]]:
    """The root (cid, root) of each starting cluster for the largest k, rows of ``merges``, and (k, root, cluster) for all k.

    Every merge is an edge child -> parent.  Removing the max(k)-1 highest edges
    leaves the clusters for the largest k; their roots are found by pointer jumping
    (log of the depth joins).  Smaller k only join some of these few roots again.
    """
    most = max(ks)
    top = merges.orderBy(F.col("height").desc(), F.col("child").desc()).limit(most - 1).collect()  # < max(k) rows
    removed = [r["child"] for r in top]
    kept = merges.filter(~F.col("child").isin(removed)) if removed else merges
    nodes = members.select("cid").filter("cid IS NOT NULL").distinct()
    count = merges.count()
    roots = materialise(nodes.join(_kept_out(kept.select(F.col("child").alias("cid"), "parent"), count), "cid", "left").select(
        "cid", F.coalesce("parent", "cid").alias("root")))
    while True:
        up = roots.select(F.col("cid").alias("root"), F.col("root").alias("next"))
        stepped = materialise(roots.join(_kept_out(up, count), "root").select("cid", F.col("next").alias("root"), (F.col("next") != F.col("root"))
                                                            .alias("moved")))
        release(roots)
        roots = stepped
        if stepped.filter("moved").isEmpty():
            break
    base = sorted(r["root"] for r in roots.select("root").distinct().collect())  # at most max(k) roots
    ends = {r["parent"] for r in top}
    root_of = {r["cid"]: r["root"] for r in roots.filter(F.col("cid").isin(sorted(ends))).collect()} if ends else {}
    mapping = []
    for k in ks:
        owner = {r: r for r in base}

        def find(x: int) -> int:
            while owner[x] != x:
                x = owner[x]
            return x

        for r in top[k - 1:]:  # rejoin all removed edges but the k - 1 highest; a removed child is a root
            owner[find(r["child"])] = find(root_of[r["parent"]])
        numbered = {root: i for i, root in enumerate(sorted({find(x) for x in base}))}
        mapping += [(k, x, numbered[find(x)]) for x in base]
    return roots.select("cid", "root"), count, mapping  # max(k) rows per k


def cut_merges(members: DataFrame, merges: DataFrame, ks: list[int]) -> DataFrame:
    """Labels (id, k, cluster_id) for every wanted number of clusters, from one merge history.

    Rows without a starting cluster have a null cluster for every k.
    """
    roots, count, mapping = _cut_roots(members, merges, ks)
    table = members.sparkSession.createDataFrame(mapping, "k int, root long, cluster_id int")
    labelled = members.join(_kept_out(roots, count), "cid").join(F.broadcast(table), "root").select("id", "k", "cluster_id")
    return labelled.unionByName(members.filter("cid IS NULL").select(
        "id", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"), F.lit(None).cast("int").alias("cluster_id")))


def scan_hierarchical(vectors: DataFrame, id_col: str, ks: list[int], vector: str = "vector",
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Elbow score and silhouette for every k of average-linkage clustering."""
    members, merges = merge_average_linkage(vectors, id_col, vector, block_rows)
    roots, count, mapping = _cut_roots(members, merges, ks)
    own: dict[int, dict[int, int]] = {}
    for k, root, cluster in mapping:
        own.setdefault(root, {})[k] = cluster
    table = members.sparkSession.createDataFrame([(root, [of[k] for k in ks]) for root, of in own.items()], "root long, labels array<int>")
    chosen = members.join(_kept_out(roots, count), "cid", "left").join(F.broadcast(table), "root", "left").select(F.col("id").alias(id_col), "labels")
    # written once, with the clusters of all k: the scores of each k read it several times
    labelled = materialise(vectors.select(id_col, F.col(vector).alias("vector")).join(_kept_out(chosen, members.count()), id_col))
    scanned = together([lambda i=i, k=k: _scan_row(labelled.select(id_col, "vector", F.col("labels")[i].alias("cluster_id")), "Hierarchical", k, None)
                        for i, k in enumerate(ks)])
    release(labelled, members, merges)
    return vectors.sparkSession.createDataFrame(scanned, SCAN_SCHEMA)


def best_k(scan: DataFrame) -> DataFrame:
    """Per method (and scenario, when present) the k with the highest silhouette; the smaller k wins ties."""
    keys = [c for c in ["scenario", "method"] if c in scan.columns]
    best = F.max_by(F.struct("k", "inertia", "silhouette_score"), F.struct("silhouette_score", -F.col("k")))
    return scan.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


# --- summaries ---------------------------------------------------------------------

def pca_coordinates(vectors: DataFrame, id_col: str, vector: str = "vector", components: int = 5) -> tuple[DataFrame, DataFrame]:
    """Centred PCA coordinates per row and the explained share per component; the largest loading of an axis is positive."""
    shaped = vectors.select(id_col, array_to_vector(F.col(vector)).alias("raw"))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(shaped)
    k = min(components, scaler.mean.size)
    centred = scaler.transform(shaped)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred)
    axes = model.pc.toArray()
    signs = F.array(*[F.lit(float(x)) for x in np.sign((axes * canonical_signs(axes)).sum(axis=0))])
    turned = F.zip_with(vector_to_array("pc"), signs, lambda x, s: x * s)
    coordinates = model.transform(centred).select(id_col, turned.alias("coordinates"))
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    return coordinates, vectors.sparkSession.createDataFrame(shares, "component int, explained_share double")


def component_pairs(shares: DataFrame) -> DataFrame:
    """Every pair of components with its axis titles (at most ten rows)."""
    def title(side: str) -> Column:
        return F.concat(F.lit("PC"), F.col(f"{side}.component").cast("string"), F.lit(" ("),
                        F.format_number(F.col(f"{side}.explained_share") * 100, 1), F.lit("%)"))

    return shares.alias("a").join(shares.alias("b"), F.col("a.component") < F.col("b.component")).select(
        F.col("a.component").alias("first"), F.col("b.component").alias("second"),
        title("a").alias("x_title"), title("b").alias("y_title"))


def cluster_extent(labelled: DataFrame, axes: list[str], cluster: str = "cluster_id") -> DataFrame:
    """10 %, 50 % and 90 % quantile of every axis inside every cluster."""
    return exact_quantiles(labelled, [cluster], axes, {"p10": 0.1, "median": 0.5, "p90": 0.9})


def cluster_term_weights(weights: DataFrame, clusters: DataFrame, key: str = "product_name") -> DataFrame:
    """Mean weight of every term in every cluster; documents without the term count as zero."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    sums = weights.join(clusters.select(key, "cluster_id"), key).groupBy("cluster_id", "term").agg(
        F.sum("weight").alias("total"))
    return sums.join(sizes, "cluster_id").select(
        "cluster_id", "term", (F.col("total") / F.col("cluster_size")).alias("mean_weight"))


def cluster_keywords(weights: DataFrame, clusters: DataFrame, key: str = "product_name", n: int = 10) -> DataFrame:
    """The ``n`` heaviest terms of every cluster, heaviest first."""
    means = cluster_term_weights(weights, clusters, key).withColumn("mean_weight", F.round("mean_weight", 12))
    return top_per_group(means, ["cluster_id"], [F.col("mean_weight").desc(), F.col("term").asc()], n, "position")


def cluster_summary(products: DataFrame, weights: DataFrame, names: DataFrame,
                    key: str = "product_name") -> DataFrame:
    """Id, name, size, five examples, ten keywords and a note per cluster."""
    words = cluster_keywords(weights, products, key).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "term"))).alias("t")).select(
        "cluster_id", F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("top_keywords"))
    return (cluster_sizes(products).join(names, "cluster_id")
            .join(cluster_examples(products), "cluster_id").join(words, "cluster_id", "left")
            .select("cluster_id", "cluster_name", "cluster_size", "example_products", "top_keywords",
                    F.lit(CLUSTER_NOTE).alias("notes")))


def scenario_comparison(scans: list[DataFrame]) -> DataFrame:
    """Best setup of every scenario and method."""
    return best_k(reduce(DataFrame.unionByName, scans)).select(
        "scenario", "method", "k", "inertia", "silhouette_score")
