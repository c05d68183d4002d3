"""Shared fits, boosted trees, count cubes, the file scan and de-duplication against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import boosting, evidence, features, linear, reviews, sentiment
from reviewlens.sources.reviews import header_shapes, list_files, read_image_rows, read_reviews
from reviewlens.sources.tables import read_taxonomy, write_table


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def sparse_rows(spark):
    rng, rows = np.random.default_rng(0), []
    for i in range(240):
        idx = np.sort(rng.choice(30, int(rng.integers(2, 7)), replace=False))
        y = 0 if 5 in idx else 1 if idx[0] < 3 else 2
        rows.append((i % 3, y, [int(a) for a in idx], [float(v) for v in rng.random(len(idx)) + 0.1]))
    return rows, spark.createDataFrame(rows, linear.ROW).repartition(3).cache()


def dense(rows, scale=None):
    x = np.zeros((len(rows), 30))
    for i, (_, _, idx, values) in enumerate(rows):
        x[i, idx] = values
    if scale is not None:
        x = x * scale
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm > 0, norm, 1)
    return np.hstack([x, np.ones((len(rows), 1))])


def objective(w, x, t, cost):
    gap = np.maximum(0, 1 - t * (x @ w))
    return 0.5 * w @ w + (cost * gap * gap).sum(), w - 2 * x.T @ (cost * gap * t)


def test_shared_fits_reach_the_optimum(sparse_rows, monkeypatch):
    monkeypatch.setattr(linear, "TOLERANCE", 1e-6)
    monkeypatch.setattr(linear, "SLICE", 7)
    rows, df = sparse_rows
    scale = np.linspace(0.5, 2, 30)
    scale[[4, 11]] = 0.0
    fits = [linear.Fit(scale, 1, 2.0, True), linear.Fit(scale, None, 0.5, False)]
    found = linear.fit_all(df, 30, fits)
    for fit, weights in zip(fits, found):
        own = [r for r in rows if r[0] != fit.without]
        x, y = dense(own, scale), np.array([r[1] for r in own])
        for c, w in zip(weights.classes, weights.table):
            positive = len(own) / (3 * (y == c).sum()) if fit.balanced else 1.0
            cost = fit.c * np.where(y == c, positive, 1.0)
            value, gradient = objective(w, x, np.where(y == c, 1.0, -1.0), cost)
            start = objective(np.zeros(31), x, np.where(y == c, 1.0, -1.0), cost)[1]
            assert np.linalg.norm(gradient) < 2e-3 * np.linalg.norm(start)
            assert w[4] == w[11] == 0
    confusion = linear.held_out_confusion(df, fits[:1], found[:1])[0]
    held = [r for r in rows if r[0] == 1]
    said = np.array(found[0].classes)[(dense(held, scale) @ found[0].table.T).argmax(axis=1)]
    pairs = [(r[1], int(p)) for r, p in zip(held, said)]
    assert confusion == {pair: pairs.count(pair) for pair in set(pairs)}


def test_minimise_many_functions_in_step():
    centre = np.array([[1.0, -2.0], [3.0, 0.5], [0.0, 0.0]])
    curve = np.array([[1.0, 50.0], [4.0, 0.1], [1.0, 1.0]])

    def evaluate(chosen, w):
        d = w - centre[chosen]
        return (curve[chosen] * d * d).sum(axis=1) / 2, curve[chosen] * d

    assert np.allclose(linear.minimise(evaluate, np.zeros((3, 2)), 200, 1e-9), centre, atol=1e-6)


def test_macro_f1_counts_absent_classes():
    assert linear.macro_f1({(0, 0): 2, (1, 0): 1}, 3) == pytest.approx((2 * 2 / 5) / 3)


def plain_gains(x, g, h, limits):
    """Gain of every split (column, bin)."""
    bins = (1 + (x[:, :, None] > limits[None]).sum(axis=2)) * (x != 0)
    out = {}
    for f in range(x.shape[1]):
        for b in range(1, limits.shape[1] + 2):
            right = bins[:, f] >= b
            if h[right].sum() >= 1 and h[~right].sum() >= 1:
                out[f, b] = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (right, ~right)) - g.sum() ** 2 / (h.sum() + 1)
    return out


def test_boosting_splits_and_loss(sparse_rows, monkeypatch):
    monkeypatch.setattr(boosting, "SLICE", 8)
    monkeypatch.setattr(boosting, "TASK_ROWS", 64)
    rows, df = sparse_rows
    fits, losses = [linear.Fit(None, 2, 1.0, False), linear.Fit(None, None, 1.0, False)], []
    x, y, fold = dense(rows)[:, :-1], np.array([r[1] for r in rows]), np.array([r[0] for r in rows])

    def each(table, ensembles):
        margins = np.zeros((3, len(rows)))
        for trees in ensembles[1]:
            for c, t in enumerate(trees):
                indices = np.concatenate([r[2] for r in rows])
                first = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
                values = np.concatenate([r[3] for r in rows])
                bins = 1 + (values[:, None] > limits[indices]).sum(axis=1)
                end = boosting._Columns(indices, bins.astype(np.uint8), first).nodes(t)
                margins[c] += np.array([t.values[n] for n in end])
        e = np.exp(margins - margins.max(axis=0))
        losses.append(-np.log((e / e.sum(axis=0))[y, np.arange(len(y))]).mean())

    limits = boosting.thresholds(df, 30, fits)[1]
    table, models = boosting.fit_all(df, 30, fits, 3, rounds=6, depth=3, rate=0.4, each=each)
    assert all(b < a for a, b in zip(losses, losses[1:])) and losses[-1] < 0.6
    for i, learns in ((0, fold != 2), (1, fold >= 0)):
        for c in range(3):
            g, h = np.where(y == c, 1 / 3 - 1, 1 / 3)[learns], np.full(int(learns.sum()), 4 / 9)
            gains = plain_gains(x[learns], g, h, models[i].limits)
            assert gains[models[i].rounds[0][c].splits[1]] >= max(gains.values()) - 1e-4
    confusion = boosting.held_out_confusion(table, fits, models)
    assert sum(confusion[0].values()) == 80 and sum(confusion[1].values()) == 240
    assert linear.macro_f1(confusion[1], 3) > 0.9
    assert len(models[0].narrowed(list(range(30))[::-1]).rounds) == 6


def test_count_cube_equals_fits_per_fold(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, ("negative", "neutral", "positive")[i % 3 if rng.random() < 0.8 else 0],
             " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, fold int, label string, prepared string").cache()
    vectorizers = [features.TextVectorizer(high=h, min_df=m, max_features=f) for h, m, f in ((1, 1, 5), (2, 2, 30), (3, 1, 100))]
    table = sentiment.FoldTable(df, vectorizers)
    for v in vectorizers:
        for fold in (0, 1, 2, None):
            expected = features.TextVectorizer(high=v.high, min_df=v.min_df, max_features=v.max_features).fit(
                df if fold is None else df.where(F.col("fold") != fold), "prepared")
            got = table.fitted[table.key(v), fold]
            assert got.terms == expected.terms and got.idf == pytest.approx(expected.idf)
    settings = [sentiment.Settings(c=c, vectorizer=v) for v in vectorizers for c in (0.5, 1.0)]
    found = sentiment.random_search(df, settings).collect()
    assert [r["setup_rank"] for r in found] == list(range(6))
    score, model = table.fit_linear(settings[2], whole=True)
    assert found[2]["cv_macro_f1"] == pytest.approx(score, abs=0.05)
    direct = sentiment.train(df, settings[2])
    agree = model.transform(df).select("id", F.col("prediction").alias("a")).join(direct.transform(df).select("id", "prediction"), "id")
    assert agree.where("a = prediction").count() >= 57


def test_own_models_are_saved(spark, tmp_path):
    words = {"negative": "awful broken bad", "neutral": "okay average plain", "positive": "great lovely good"}
    rows = [(i, c, f"{words[c]} item{i % 5}") for i in range(60) for c in [list(words)[i % 3]]]
    df = spark.createDataFrame(rows, "id int, label string, prepared string").coalesce(1).cache()
    for kind in sentiment.OWN_MODELS:
        model = sentiment.train(df, sentiment.Settings(kind=kind, boost_rounds=2, vectorizer=features.TextVectorizer(high=1)))
        model.save(spark, f"{tmp_path}/{kind}")
        again = sentiment.SentimentModel.load(spark, f"{tmp_path}/{kind}")
        assert reviews.consistent_rows(again.transform(df)).count() == 60


# --- files and de-duplication --------------------------------------------------------------

def write_files(folder, n):
    expected = []
    for i in range(n):
        (folder / f"d {i % 3}").mkdir(exist_ok=True)
        with open(folder / f"d {i % 3}" / f"f{i:03d}.csv", "w") as file:
            if i % 2:
                file.write("name,reviews.title,reviews.text,reviews.rating,imageURLs\n")
                file.writelines(f'P{j % 3},t,"text\nline {j % 4}",{j % 5 + 1},http://i/{i}/{j}.png\n' for j in range(7))
            else:
                file.write("reviews.rating,name,reviews.text\n")
                file.writelines(f"{j % 5 + 1},P{j % 3},text {j}\n" for j in range(5))
        expected.append(7 if i % 2 else 5)
    (folder / "empty.csv").write_text("")
    return expected


def test_many_files_in_a_bounded_number_of_jobs(spark, tmp_path):
    sizes = write_files(tmp_path, 40)
    assert len(header_shapes(spark, list_files(spark, str(tmp_path)))) == 2
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scan", "scan")
    raw = read_reviews(spark, str(tmp_path))
    jobs = len(tracker.getJobIdsForGroup("scan"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 25
    numbers = [r["review_ord"] for r in raw.select("review_ord").collect()]
    assert sorted(numbers) == list(range(sum(sizes)))
    by_file = raw.groupBy("source_file").agg(F.min("review_ord").alias("low"), F.max("review_ord").alias("high"), F.count("*").alias("n"))
    assert all(r["high"] - r["low"] + 1 == r["n"] for r in by_file.collect())
    table = reviews.review_table(raw, keep=("review_ord",), order=raw["review_ord"])
    first = raw.groupBy("name", "`reviews.title`", "`reviews.text`", "`reviews.rating`").agg(F.min("review_ord").alias("o"))
    assert sorted(r["review_ord"] for r in table.collect()) == sorted(r["o"] for r in first.collect())
    images = read_image_rows(spark, [str(tmp_path)])
    assert images.count() == 140 and images.select("source_rank").distinct().count() == 20
    assert plan(images).count("FileScan csv") <= 8


def test_dedupe_with_repeated_and_missing_ordinals(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "b", "x"), (2, "b", "x"), (None, "c", "x"), (None, "c", "y"), (None, "a", "z"), (5, "d", None)]
    df = spark.createDataFrame(rows, "o long, k string, v string")
    got = {r["k"]: r["o"] for r in reviews.dedupe_reviews(df, ["k"], order=F.col("o")).collect()}
    assert got == {"a": 1, "b": 2, "c": None, "d": 5}
    placed = reviews.dedupe_reviews(df.where("o is not null"), ["k"], order=F.struct("o", "v")).collect()
    assert {r["k"]: r["o"] for r in placed} == {"a": 1, "b": 2, "d": 5}
    kept = reviews.dedupe_reviews(df, ["k"], order=F.col("o"))
    assert sorted(r["k"] for r in kept.collect()) == ["a", "b", "c", "d"] and kept.columns == df.columns
    assert reviews.dedupe_reviews(df.limit(0), ["k"], order=F.col("o")).count() == 0


def test_reviews_are_scanned_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "o long, k string")
    write_table(df, f"{tmp_path}/t")
    got = reviews.dedupe_reviews(spark.read.parquet(f"{tmp_path}/t"), ["k"], order=F.col("o"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_saved_taxonomy_keeps_its_first_row(spark, tmp_path):
    rows = [("a", 9, "B", "f", "r"), ("a", 1, "A", "f", "r"), ("b", 2, "C", "f", "r")]
    table = spark.createDataFrame(rows, "product_name string, cluster_id int, corrected_category string, product_family string, "
                                        "correction_reason string").coalesce(1)
    scored = spark.createDataFrame([("a", 5.0, "good", "positive", "positive"), ("b", 1.0, "bad", "negative", "negative")],
                                   "product_name string, rating double, text string, label string, predicted_sentiment string")
    for fmt in ("parquet", "csv"):
        write_table(table, f"{tmp_path}/{fmt}", fmt)
        got = evidence.product_evidence(scored, read_taxonomy(spark, f"{tmp_path}/{fmt}", fmt))
        assert {r["product_name"]: r["cluster_id"] for r in got.collect()} == {"a": 9, "b": 2}


def test_linkage_searches_only_what_changed(spark, caplog):
    from test_operators import sequential_average_linkage

    from reviewlens.operators import clustering
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    with caplog.at_level("INFO"):
        members, merges = clustering.merge_average_linkage(df, "id", block_rows=11)
    searched = [tuple(map(int, r.getMessage().split()[1:4:2])) for r in caplog.records if r.getMessage().startswith("searched")]
    assert searched[0] == (40, 40) and any(a < b for a, b in searched) and all(a <= b for a, b in searched)
    labels = clustering.cut_merges(members, merges, [3, 8]).collect()
    for k in (3, 8):
        found = {}
        for r in labels:
            if r["k"] == k:
                found.setdefault(r["cluster_id"], set()).add(r["id"])
        assert {frozenset(s) for s in found.values()} == sequential_average_linkage(x, k)


def test_linkage_ends_in_one_task_with_the_same_merges(spark, caplog):
    from reviewlens.operators import clustering
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(60, 3)), 1)  # with ties, copies and a row of zeros
    x[5], x[6] = x[4], 0.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))],
                               "id long, vector array<double>")
    found = []
    for block_rows in (9, 2048):
        caplog.clear()
        with caplog.at_level("INFO"):
            _, merges = clustering.merge_average_linkage(df, "id", block_rows=block_rows)
        found.append((sorted((r["child"], r["parent"], round(r["height"], 9)) for r in merges.collect()),
                      sum(r.getMessage().startswith("searched") for r in caplog.records)))
    assert found[0][0] == found[1][0] and len(found[0][0]) == len({tuple(r) for r in x}) - 2
    assert found[0][1] > found[1][1] == 0


def test_kmeans_starts_share_their_passes(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from reviewlens.operators import clustering
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 5))  # no clusters: many passes
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>").repartition(3)
    shaped = df.select(array_to_vector(F.col("vector")).alias("features")).persist()
    shaped.count()
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    at = jobs()
    expected = {(k, i): KMeans(k=k, seed=42 + i, featuresCol="features").fit(shaped) for k in (3, 5, 7) for i in range(3)}
    alone, at = jobs() - at, jobs()
    best = clustering._best_starts(shaped, [3, 5, 7], 3, 42)
    assert jobs() - at < 0.75 * alone
    for k, model in best.items():
        i = min(range(3), key=lambda i: (expected[k, i].summary.trainingCost, i))
        assert abs(model.cost - expected[k, i].summary.trainingCost) < 1e-6 * model.cost
        assert np.allclose(model.centres, np.array(expected[k, i].clusterCenters()))
        said = {r["id"]: r["cluster_id"] for r in clustering.kmeans_labels(df, model).collect()}
        assert said == {r["id"]: r["prediction"] for r in expected[k, i].transform(
            df.withColumn("features", array_to_vector(F.col("vector")))).collect()}
    shaped.unpersist()


def test_report_of_keyed_sections(spark, tmp_path):
    from reviewlens.sources import reports
    from reviewlens.sources.tables import write_lines
    columns = "preprocessing string, model string, cv_macro_f1 double, accuracy double, macro_f1 double, weighted_f1 double, " + ", ".join(
        f"{c}_{m} double" for c in ("negative", "neutral", "positive") for m in ("precision", "recall", "f1"))
    rows = [("stem", "SVM", 0.7, 0.9, 0.71, 0.8, *[0.5] * 9), ("raw", "NB", 0.8, 0.9, 0.72, 0.8, *[0.25] * 9)]
    results = spark.createDataFrame(rows, columns)
    tuned = results.withColumn("c", F.lit(0.5)).withColumn("min_df", F.lit(2))
    classes = spark.createDataFrame([("positive", 0.9, 0.8, 0.85, 10), ("negative", 0.5, 0.4, 0.45, 3)],
                                    "class string, precision double, recall double, f1 double, support long")
    write_lines(reports.model_report(results, tuned, classes), reports.REPORT_KEY, f"{tmp_path}/r")
    text = [r["value"] for r in spark.read.text(f"{tmp_path}/r").collect()]
    assert text[0] == "# Models by cross-validated macro-F1" and text[2] == "## raw + tfidf + NB"
    assert text.index("## raw + tfidf + NB") < text.index("## stem + tfidf + SVM") < text.index("# Tuned setups") < text.index("# Best setup")
    assert "| 1 | raw | NB | 0.800 | 0.720 |" in text and "- min_df: 2" in text and "| neutral | 0.250 | 0.250 | 0.250 |" in text
    assert text[-2:] == ["| negative | 0.500 | 0.400 | 0.450 | 3 |", "| positive | 0.900 | 0.800 | 0.850 | 10 |"]


def test_lookup_join_with_hot_and_missing_keys(spark):
    from reviewlens.operators.joins import lookup_join
    keys = ["hot"] * 500 + ["gone"] * 300 + [f"k{i % 40}" for i in range(200)] + [None] * 20
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    table = spark.createDataFrame([("hot", 1), ("unused", 2), (None, 3), *((f"k{i}", 10 + i) for i in range(0, 40, 2))], "key string, v int")
    expected = {(i, k, v) for i, k in enumerate(keys) for t, v in map(tuple, table.collect()) if t == k and k is not None}
    for frequent in (1, 3, 1000):
        got = lookup_join(rows, table, "key", frequent)
        assert got.columns == ["id", "key", "v"] and sorted(map(tuple, got.collect())) == sorted(expected)


def test_axes_have_one_sign(spark):
    from reviewlens.operators import clustering
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4)) * [5, 3, 2, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    coordinates, shares = clustering.pca_coordinates(df, "id", components=3)
    centred = x - x.mean(axis=0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    axes = features.canonical_signs(axes.T)[:, :3]
    got = np.array([r["coordinates"] for r in coordinates.orderBy("id").collect()])
    assert np.allclose(got, centred @ axes) and np.allclose([r["explained_share"] for r in shares.orderBy("component").collect()],
                                                           (s ** 2 / (s ** 2).sum())[:3])


def test_linear_passes_read_packed_rows_in_few_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i % 3, i % 2, sorted(rng.choice(20, i % 4, replace=False).tolist()), None) for i in range(200)]
    data = [(f, y, at, [float(1 + j + y) for j in range(len(at))]) for f, y, at, _ in data]
    rows = spark.createDataFrame(data, linear.ROW).repartition(16)
    columns = np.where(np.arange(20) % 3 > 0, np.arange(20), -1)
    kept = [(f, y, [i for i in at if i % 3], [v for i, v in zip(at, values) if i % 3]) for f, y, at, values in data]
    got = [(r["fold"], r["y"], np.frombuffer(r["indices"], "<i4").tolist(), np.frombuffer(r["values"], "<f8").tolist())
           for r in linear.packed(rows, columns).collect()]
    assert sorted(got) == sorted(kept)

    monkeypatch.setattr(linear, "TASK_ROWS", 1)
    asked, coalesce = [], type(rows).coalesce
    monkeypatch.setattr(type(rows), "coalesce", lambda df, n: asked.append(n) or coalesce(df, n))
    fits = [linear.Fit(None, None, 1.0, True), linear.Fit(np.arange(20) % 3 * 1.0, 1, 0.5, False)]
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    direct = linear.fit_all(rows, 20, fits, 50)
    assert min(asked) <= linear.CORE_TASKS * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(linear, "SENT_BYTES", 0)
    summed = linear.fit_all(rows, 20, fits, 50)
    for a, b in zip(direct, summed):
        assert a.classes == b.classes and np.allclose(a.table, b.table, atol=1e-6)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_experiments_that_need_no_other_run_at_a_time(spark, monkeypatch):
    import threading

    class Model:
        def transform(self, df):
            return df.withColumn("prediction", F.col("label"))

    both, trained = threading.Barrier(2), []

    def train(rows, setting):
        trained.append(rows.count())
        if len(trained) <= 2:
            both.wait(30)  # the first model and that of the even classes; one after the other they would wait in vain
        return Model()

    monkeypatch.setattr(sentiment, "train", train)
    rows = spark.createDataFrame([(i, "positive" if i % 3 else "negative", "x") for i in range(30)], "review_id long, label string, prepared string")
    monkeypatch.setattr(sentiment, "consistent_rows", lambda df: df.where("review_id < 25"))
    found = {r["experiment"]: r["macro_f1"] for r in sentiment.extra_experiments(rows, rows, sentiment.Settings()).collect()}
    assert set(found) == {"original_tuned", "downsampling", "filtered_label"} and sorted(trained) == [20, 25, 30]


def test_models_are_solved_in_groups_of_bounded_size(sparse_rows, monkeypatch):
    _, df = sparse_rows
    fits = [linear.Fit(None, 1, 1.0, True), linear.Fit(None, None, 0.5, False)]
    together = linear.fit_all(df, 30, fits)
    sizes, minimise = [], linear.minimise
    monkeypatch.setattr(linear, "minimise", lambda evaluate, start, *more: sizes.append(len(start)) or minimise(evaluate, start, *more))
    monkeypatch.setattr(linear, "STATE_BYTES", 2 * 31 * (8 * linear.HISTORY + 64))
    apart = linear.fit_all(df, 30, fits)
    assert sizes == [2, 2, 2]
    for a, b in zip(together, apart):
        assert a.classes == b.classes and np.allclose(a.table, b.table, atol=1e-9)


def test_margins_of_rows_without_entries():
    x = np.array([1, 0, 2]), np.array([1.0, 2.0, 3.0]), np.array([0, 0, 2, 2, 3, 3])
    assert linear._dot(x, np.array([1.0, 10.0, 100.0, 0.5])).tolist() == [0.5, 12.5, 0.5, 300.5, 0.5]
    assert linear._dot((np.zeros(0, int), np.zeros(0), np.array([0, 0])), np.array([1.0, 0.5])).tolist() == [0.5]


def test_a_solver_needs_few_passes():
    """With ten remembered steps it took 114."""
    curve, passes = np.concatenate([np.ones(40), np.logspace(0, 3, 20)])[None], []

    def evaluate(chosen, w):
        passes.append(len(chosen))
        d = w - 1.0
        return (curve[chosen] * d * d).sum(axis=1) / 2, curve[chosen] * d

    found = linear.minimise(evaluate, np.zeros((1, 60)), 500, 1e-5)
    assert np.abs(curve * (found - 1.0)).max() < 0.02 and len(passes) < 90
