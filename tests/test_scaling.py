"""What a task or the driver holds stays small: boosted trees' columns, tables of the merging rounds."""

import time
import tracemalloc

import numpy as np

from reviewlens.operators import boosting, clustering


def test_a_split_is_found_without_copying_the_columns():
    """Each split of each earlier tree used to copy all entries of a batch, so that time grew with entries x splits."""
    n, width = 2000, 500
    columns = boosting._Columns(np.tile(np.arange(width, dtype=np.int32), n), np.ones(n * width, np.uint8), np.arange(n + 1) * width)
    tracemalloc.start()
    rows = columns.right(7, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == n and peak < n * width


def test_nodes_follow_the_splits():
    columns = boosting._Columns(np.array([0, 70000, 0, 1, 70000], np.int64), np.array([1, 3, 2, 1, 1], np.uint8), np.array([0, 2, 4, 5, 5]))
    tree = boosting.Tree({1: (0, 2), 2: (70000, 2)})
    assert columns.nodes(tree).tolist() == [5, 3, 4, 4]


def test_merging_sends_no_large_table_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(7)]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<double>")

    def found():
        members, merges = clustering.merge_average_linkage(vectors, "vec_id", block_rows=4)
        labels = clustering.cut_merges(members, merges, [2, 3])
        return sorted(map(tuple, members.collect())), sorted(map(tuple, merges.collect())), sorted(map(tuple, labels.collect())), members

    before = found()
    monkeypatch.setattr(clustering, "SENT_ROWS", 0)
    after = found()
    assert after[:3] == before[:3]
    assert "Broadcast" not in after[3]._jdf.queryExecution().executedPlan().toString()


def test_blocks_meet_without_copies_on_disk(spark, monkeypatch, tmp_path):
    """Every block used to be shuffled once for each of its partners, and rounds left their tables and shuffles behind."""
    from pathlib import Path

    from reviewlens import runtime
    written, materialise = [], runtime.materialise

    def kept(df):
        table = materialise(df)
        written.append((table, runtime._written[table], df._jdf.queryExecution().executedPlan().toString()))
        return table

    monkeypatch.setattr(clustering, "materialise", kept)
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(16)], "vec_id long, vector array<double>")
    before = spark.conf.get(runtime._DELETED)
    members, merges = clustering.merge_average_linkage(vectors, "vec_id", block_rows=6)
    plans = [plan for _, _, plan in written if "CartesianProduct" in plan]
    assert plans and all("Join" not in plan for plan in plans)
    left = [path for _, path, _ in written if Path(path.removeprefix("file:")).exists()]
    assert sorted(left) == sorted([runtime._written[members], runtime._written[merges]]) and spark.conf.get(runtime._DELETED) == before
    written.clear()
    scan = clustering.scan_hierarchical(vectors, "vec_id", [2, 5]).collect()
    assert [(r["k"], r["clusters"]) for r in scan] == [(2, 2), (5, 5)]
    assert sum("vector" in table.columns for table, *_ in written) == 1  # one copy of the vectors for all k


def test_a_write_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from reviewlens.runtime import materialise
    drivers = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: sum(str(f).endswith(".data") for f in iterate(drivers.getAllFiles()))

    def iterate(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    before = shuffles()
    table = materialise(spark.range(1000).repartition(4, F.col("id") % 7))
    end = time.time() + 10
    while shuffles() > before and time.time() < end:
        time.sleep(0.1)
    assert shuffles() <= before and table.count() == 1000


def test_the_last_merges_hold_few_distances_at_a_time(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(8)
    n = 60
    rest = pa.table([pa.array(np.arange(n)), pa.array([v.tolist() for v in rng.normal(size=(n, 4))], pa.list_(pa.float64())), pa.array(np.ones(n, np.int64)),
                     pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())], schema=clustering._REST)
    merges = lambda: [b.to_pylist() for b in clustering._merge_rest(iter(rest.to_batches()))]
    before, outer, held = merges(), np.outer, []
    monkeypatch.setattr(clustering, "SEARCHED_ROWS", 7)
    monkeypatch.setattr(np, "outer", lambda a, b: held.append(len(a)) or outer(a, b))
    after = merges()
    assert max(held) == 7 and sum(map(len, after)) == n - 1
    for a, b in zip(sum(before, []), sum(after, [])):
        assert (a["child"], a["parent"]) == (b["child"], b["parent"]) and abs(a["height"] - b["height"]) < 1e-9


def test_the_driver_keeps_no_vectors_of_passes(spark, monkeypatch):
    """Vectors sent to a pass used to stay with the driver to the end of the session."""
    from reviewlens.operators import linear
    kept, broadcast = [], type(spark.sparkContext).broadcast

    def watched(sc, value):
        kept.append(broadcast(sc, value))
        return kept[-1]

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", watched)
    rows = spark.createDataFrame([(0, int(i % 5 == 0), [i % 5], [1.0 + i % 3]) for i in range(40)], linear.ROW).coalesce(1)
    linear.fit_all(rows, 5, [linear.Fit(None, None, 1.0, False)], 10)
    assert len(kept) > 3 and sum(b._jbroadcast.isValid() for b in kept) <= 1  # the column numbers


def test_vocabularies_share_their_terms():
    from reviewlens.operators import features, sentiment
    v = features.TextVectorizer(high=1)
    found = sentiment._Vocabularies(["a", "b", "c"], {("k", None): (v, *sentiment._by_place(np.array([2, 0]), np.array([0.5, 1.5])))})
    assert found["k", None].terms == ["a", "c"] and found["k", None].idf == [1.5, 0.5] and found["k", None].high == 1
    assert all(isinstance(x, np.ndarray) for x in found.parts["k", None][1:])


def test_levels_send_sums_of_few_tasks(spark, monkeypatch):
    """One task for every 4096 rows sent its sums in every level, so that what a level moves grew with the rows."""
    from reviewlens.operators import linear
    monkeypatch.setattr(boosting, "TASK_ROWS", 1)
    monkeypatch.setattr(boosting, "CORE_TASKS", 0)
    rows = spark.createDataFrame([(0, i % 2, [i % 2], [1.0]) for i in range(64)], linear.ROW).repartition(16)
    table, models = boosting.fit_all(rows, 2, [linear.Fit(None, None, 1.0, False)], 2, rounds=1, depth=1)
    assert table.rdd.getNumPartitions() == 1 and models[0].rounds[0][0].splits
    table.unpersist()
