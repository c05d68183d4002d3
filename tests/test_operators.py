import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import cards, clustering, evidence, features, images, ordering, reviews, sentiment, splits
from reviewlens.sources.reviews import read_image_rows, read_reviews
from reviewlens.sources.tables import load_or_build, read_cards


def plan(df):
    return df._jdf.queryExecution().toString()


def test_read_files_of_two_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,reviews.rating,reviews.text\nEcho,5,"good\nstuff"\nNA,1,x\n')
    (tmp_path / "b.csv").write_text("reviews.title,name,imageURLs,reviews.rating\nFine,Echo,http://x/i.png,bad\n")
    raw = read_reviews(spark, str(tmp_path))
    got = reviews.to_reviews(raw, keep=("source_file",)).orderBy("source_file", "rating").collect()
    assert [(r["source_file"], r["product_name"], r["rating"], r["text"]) for r in got] == [
        ("a.csv", "", 1.0, "x"), ("a.csv", "Echo", 5.0, "good\nstuff"), ("b.csv", "Echo", None, "Fine")]
    assert [(r["name"], r["source_rank"]) for r in read_image_rows(spark, [str(tmp_path)]).collect()] == [("Echo", 1)]
    with pytest.raises(FileNotFoundError):
        read_reviews(spark, str(tmp_path), pattern="*.none")


def test_projection_works_on_a_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "Echo", "text": "good"}\n')
    stream = spark.readStream.schema("name string, text string").json(str(tmp_path)).withColumnRenamed("text", "reviews.text")
    assert reviews.valid_reviews(reviews.to_reviews(stream)).isStreaming


def test_dedupe_keeps_first_row_and_null_keys(spark):
    rows = [(3, "a", "t", 1.0), (1, "a", "t", 1.0), (2, None, "t", 1.0), (4, None, "t", 1.0), (5, "", "t", 1.0)]
    df = spark.createDataFrame(rows, "id int, product_name string, review_text string, rating double")
    got = reviews.dedupe_reviews(df, ["product_name", "review_text", "rating"], order=F.col("id"))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 5]
    assert reviews.dedupe_audit(df, ["product_name", "review_text", "rating"]).first()["rows_removed"] == 2


def test_all_contradiction_kinds(spark):
    rows = [(1.0, "positive"), (5.0, "negative"), (3.0, "positive"), (3.0, "negative"), (3.5, "negative"), (2.5, "positive")]
    df = spark.createDataFrame(rows, "rating double, predicted_sentiment string")
    assert sorted(r["contradiction_type"] for r in reviews.contradictions(df).collect()) == [
        "high_rating_negative_text", "low_rating_positive_text", "neutral_rating_negative_text",
        "neutral_rating_positive_text"]


def test_rank_and_quantiles_with_one_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("x").alias("g"),
                                  "id", (F.col("id") * 7 % 100).cast("double").alias("v"))
    got = ordering.ranked(df, ["g"], [F.col("v").desc(), F.col("id").asc()]).toPandas()
    for _, group in got.groupby("g", dropna=False):
        expected = group.sort_values(["v", "id"], ascending=[False, True])
        assert list(expected["rank"]) == list(range(1, len(group) + 1))
    exact = {r["g"]: (r["v_median"], r["v_p10"]) for r in ordering.exact_quantiles(
        df, ["g"], ["v"], {"median": 0.5, "p10": 0.1}).collect()}
    builtin = {r["g"]: (r["m"], r["p"]) for r in df.groupBy("g").agg(
        F.median("v").alias("m"), F.percentile("v", F.lit(0.1)).alias("p")).collect()}
    assert exact.keys() == builtin.keys()
    assert all(np.allclose(exact[k], builtin[k]) for k in exact)


def test_top_per_group_limits_before_the_shuffle(spark):
    out = ordering.top_per_group(spark.range(100).withColumn("g", F.col("id") % 2), ["g"], [F.col("id").asc()], 3)
    assert "WindowGroupLimit" in plan(out) and out.count() == 6


def test_splits_are_exact(spark):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") % 50 == 0, "a").otherwise("b"))
    split = splits.stratified_split(df, "label", "id")
    assert {(r["label"], r["is_test"]): r["count"] for r in split.groupBy("label", "is_test").count().collect()} == {
        ("a", True): 4, ("a", False): 16, ("b", True): 196, ("b", False): 784}
    folds = splits.stratified_folds(df, "label", "id").groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in folds) == [6, 7, 7, 326, 327, 327]
    assert {r["label"]: r["count"] for r in splits.downsample(df, "label", "id").groupBy("label").count().collect()} == {
        "a": 20, "b": 20}


def test_trust_score_bounds_and_flat_volume(spark):
    rows = [("p", 30, 5.0, 100.0, 0.0), ("q", 30, 0.0, 0.0, 100.0)]
    df = spark.createDataFrame(rows, "product_name string, review_count long, average_rating double, "
                                     "positive_share double, negative_share double")
    got = {r["product_name"]: (r["trust_score"], r["evidence_strength"]) for r in evidence.trust_score(df).collect()}
    assert got == {"p": (100.0, "Medium"), "q": (30.0, "Medium")}
    text = plan(evidence.trust_score(df))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_vectors_equal_long_weights(spark):
    df = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "")], "id int, text string")
    vectorizer = features.TextVectorizer(low=1, high=2).fit(df, "text")
    vectors = {r["id"]: r["features"] for r in vectorizer.transform(df, "text").collect()}
    counts = features.term_counts(features.with_terms(df, "text"), "id")
    vocab = features.vocabulary(features.stats_from_counts(counts), 3)
    for r in features.tfidf_long(counts, vocab, "id").collect():
        assert abs(vectors[r["id"]][vectorizer.terms.index(r["term"])] - r["weight"]) < 1e-12
    assert vectors[3].numNonzeros() == 0 and abs(vectors[1].norm(2) - 1) < 1e-12


def test_token_normalisation(spark):
    df = spark.createDataFrame([(1, "Cats and dogs!"), (2, "")], "id int, text string")
    table = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "token string, normal string")
    got = features.preprocess(df, "lemmatization", "id", table=table)
    assert {r["id"]: r["prepared"] for r in got.collect()} == {1: "cat and dog", 2: ""}
    tokens = {r["token"] for r in features.distinct_tokens(df, "text").collect()}
    assert tokens == {"cats", "and", "dogs"}


def test_model_roundtrip_on_separable_text(spark, tmp_path):
    words = {"negative": "awful broken bad", "neutral": "okay average plain", "positive": "great lovely good"}
    rows = [(i, c, f"{words[c]} item{i % 5}") for i in range(60) for c in [list(words)[i % 3]]]
    df = spark.createDataFrame(rows, "id int, label string, prepared string").coalesce(1).persist()
    for kind in ["Linear SVM", "Naive Bayes", "Boosted Trees"]:
        settings = sentiment.Settings(kind=kind, iterations=5, boost_rounds=2,
                                      vectorizer=features.TextVectorizer(high=1))
        model = sentiment.train(df, settings)
        assert reviews.consistent_rows(model.transform(df)).count() == 60, kind
    model.save(spark, str(tmp_path / "m"))
    again = sentiment.SentimentModel.load(spark, str(tmp_path / "m"))
    assert reviews.consistent_rows(again.transform(df)).count() == 60


def sequential_average_linkage(x, k):
    clusters = [[i] for i in range(len(x))]
    distance = 1 - x @ x.T
    while len(clusters) > k:
        pairs = [(distance[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters)
                 for j, b in enumerate(clusters) if i < j]
        _, i, j = min(pairs)
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


def test_average_linkage_equals_sequential(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(18, 3))
    x = np.vstack([x, x[:2]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    members, merges = clustering.merge_average_linkage(df, "id", block_rows=7)
    assert merges.count() == 17
    labels = clustering.cut_merges(members, merges, [2, 5, 9]).collect()
    for k in [2, 5, 9]:
        found = {}
        for r in labels:
            if r["k"] == k:
                found.setdefault(r["cluster_id"], set()).add(r["id"])
        assert {frozenset(s) for s in found.values()} == sequential_average_linkage(x, k)


def brute_loose(products, lookup, families):
    out = {}
    for pid, name, category, tokens in products:
        best, best_score = None, 0
        for key, url, toks in lookup:
            score = len(tokens & toks)
            if toks and score > best_score:
                best, best_score = (url, toks), score
        if len(tokens) < 2 or best is None or best_score < 3 or best_score / len(tokens) < 0.45:
            continue
        text = f"{name} {category}".lower()
        rule = next((all(t in best[1] for t in f) for f in families if all(t in text for t in f)), None)
        if rule if rule is not None else best_score / len(tokens) >= 0.65:
            out[pid] = best[0]
    return out


def test_loose_match_equals_brute_force(spark):
    from reviewlens.functions.fixed_values import IMAGE_FAMILY_WORDS, IMAGE_STOP_TOKENS
    rng = random.Random(5)
    words = ["echo", "kindle", "fire", "tablet", "case", "alpha", "beta", "gamma", "delta", "black", "new", "tv"]
    toks = lambda s: {w for w in s.split() if len(w) > 2 and w not in IMAGE_STOP_TOKENS}
    make = lambda: " ".join(rng.sample(words, rng.randint(2, 7)))
    products = [(i, make(), "x") for i in range(60)]
    lookup = [(k, f"u{i}", (0, i, 0)) for i, k in enumerate(dict.fromkeys(make() for _ in range(60)))]
    p = spark.createDataFrame(products, "id int, name string, category string")
    look = spark.createDataFrame(lookup, "key string, url string, ord struct<source_rank:int,row_ord:long,form:int>")
    out = images.loose_matches(p, look, "id")
    expected = brute_loose([(i, n, c, toks(n)) for i, n, c in products], [(k, u, toks(k)) for k, u, _ in lookup],
                           IMAGE_FAMILY_WORDS)
    assert {r["id"]: r["image_url"] for r in out.collect()} == expected and expected
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)


def test_card_parser_and_fallback(spark):
    text = ("noise\nHEADLINE: First\nHEADLINE: Last\r\nSUMMARY: dropped\none\n\ntwo\nBEST_FOR: you\nPROS:\n- a\nx\n-b\n- c\n- d\nCONS:\n- z")
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "id int, completion string")
    got = {r["id"]: tuple(r)[1:] for r in cards.parse_cards(df, "id").collect()}
    assert got[1] == ("Last", "one\n\ntwo", "you", ["a", "b", "c"], ["z"])
    assert got[2] == got[3] == ("", "", "", [], [])

    def broken(prompts):
        raise RuntimeError("down")

    failed = cards.complete(df.select("id", F.lit("p").alias("prompt")), broken, ["id"]).collect()
    assert all(r["completion"] == "generation failed: down" for r in failed)


def test_load_or_build_reuses_the_saved_table(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []
    build = lambda: calls.append(1) or spark.range(3)
    assert load_or_build(spark, path, build).count() == 3
    assert load_or_build(spark, path, build).count() == 3
    assert len(calls) == 1
    load_or_build(spark, path, build, rebuild=True)
    assert len(calls) == 2


def test_first_taxonomy_row_counts(spark):
    products = spark.createDataFrame([("a",), ("b",)], "product_name string")
    rows = [("a", 9, "B", "f", "r", 1), ("a", 1, "A", "f", "r", 2), ("b", 2, "C", "f", "r", 3)]
    taxonomy = spark.createDataFrame(rows, "product_name string, cluster_id int, corrected_category string, "
                                           "product_family string, correction_reason string, ord int")
    got = {r["product_name"]: r["cluster_id"] for r in evidence.join_taxonomy(products, taxonomy, order="ord").collect()}
    assert got == {"a": 9, "b": 2}


def test_dedupe_does_not_sort_texts(spark):
    df = spark.createDataFrame([(1, "a", "long text", "x"), (2, "a", "long text", "y"), (3, "b", "other", "x")],
                               "id long, product_name string, review_text string, category_text string")
    got = reviews.dedupe_reviews(df, ["product_name", "review_text"], order=F.col("id"))
    assert "SortAggregate" not in plan(got)
    assert sorted((r["id"], r["category_text"]) for r in got.collect()) == [(1, "x"), (3, "x")]


def test_one_failing_prompt_fails_alone(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(8)], "id int, prompt string").coalesce(1)

    def generate(prompts):
        if (prompts == "p5").any():
            raise ValueError("no answer")
        return prompts.str.upper()

    got = {r["id"]: r["completion"] for r in cards.complete(df, generate, ["id"]).collect()}
    assert got[5].startswith(cards.FAILED) and all(got[i] == f"P{i}" for i in range(8) if i != 5)


def test_cards_of_a_first_run(spark, tmp_path):
    assert read_cards(spark, f"{tmp_path}/none", missing_ok=True).count() == 0


def test_scan_has_a_row_for_every_k(spark):
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [0.0, 1.0] if i % 3 == 1 else [0.0, 0.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").persist()
    scan = {r["k"]: r for r in clustering.scan_kmeans(df, [2, 3, 4], restarts=2).collect()}
    assert sorted(scan) == [2, 3, 4] and scan[4]["silhouette_score"] is None and scan[3]["clusters"] == 2
    members, merges = clustering.merge_average_linkage(df, "id")
    labels = clustering.cut_merges(members, merges, [2]).collect()
    assert len(labels) == 9 and sum(r["cluster_id"] is None for r in labels) == 3
    assert clustering.scan_hierarchical(df, "id", [2]).first()["silhouette_score"] == pytest.approx(1.0)
    df.unpersist()
