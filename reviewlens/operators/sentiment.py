"""Sentiment classifiers: training, scoring, model comparison and random search."""

from __future__ import annotations

import itertools
import random
import threading
from dataclasses import dataclass, field, replace

import numpy as np

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.fixed_values import CLASSES
from reviewlens.functions.numbers import id_label, label_id
from reviewlens.operators import boosting, linear, metrics
from reviewlens.operators.features import TextVectorizer, count_cube, cube_vocabulary, gram_vectors, preprocess
from reviewlens.operators.reviews import consistent_rows
from reviewlens.operators.splits import balanced_weights, downsample, stratified_folds, stratified_split
from reviewlens.runtime import materialise, together

MULTICLASS = ["Logistic Regression", "Naive Bayes", "Random Forest"]
SVM, BOOSTED = "Linear SVM", "Boosted Trees"
#: Kinds whose models are our own tables; the others are Spark ML pipelines.
OWN_MODELS = {SVM: linear.LinearModel, BOOSTED: boosting.BoostedModel}
MODELS = ["Logistic Regression", "Linear SVM", "Naive Bayes", "Random Forest", "Boosted Trees"]


@dataclass
class SentimentModel:
    """A fitted vectoriser with its classifier stages; saved and loaded as Spark ML models."""

    kind: str
    vectorizer: TextVectorizer
    stages: PipelineModel | linear.LinearModel | boosting.BoostedModel

    def transform(self, df: DataFrame, text_col: str = "prepared") -> DataFrame:
        """Add ``prediction`` (class name)."""
        return self.score(self.vectorizer.transform(df, text_col, "features")).drop("features")

    def score(self, featured: DataFrame) -> DataFrame:
        columns = featured.columns
        scored = self.stages.transform(featured)
        return scored.select(*columns, id_label(F.col("class_number")).alias("prediction"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.vectorizer.save(spark, f"{path}/vectorizer")
        if self.kind in OWN_MODELS:
            self.stages.save(spark, f"{path}/classifier")
        else:
            self.stages.write().overwrite().save(f"{path}/classifier")
        spark.createDataFrame([(self.kind,)], "kind string").write.mode("overwrite").json(f"{path}/kind")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SentimentModel":
        kind = spark.read.json(f"{path}/kind").first()["kind"]
        stages = (OWN_MODELS[kind].load(spark, f"{path}/classifier") if kind in OWN_MODELS
                  else PipelineModel.load(f"{path}/classifier"))
        return cls(kind, TextVectorizer.load(spark, f"{path}/vectorizer"), stages)


@dataclass
class Settings:
    """Training settings.  ``c`` is the inverse regularisation strength of the linear models."""

    kind: str = "Linear SVM"
    c: float = 1.0
    balanced: bool = True
    trees: int = 80
    tree_depth: int = 30
    boost_rounds: int = 80
    boost_depth: int = 4
    boost_rate: float = 0.1
    iterations: int = 1000
    vectorizer: TextVectorizer = field(default_factory=lambda: TextVectorizer(min_df=2, max_features=15000))

    def parameters(self) -> dict:
        """The searched parameters, as they stand in the search table."""
        return {"ngram_high": self.vectorizer.high, "min_df": self.vectorizer.min_df,
                "max_features": self.vectorizer.max_features, "c": self.c, "balanced": self.balanced}


def _class_rows(featured: DataFrame) -> dict[str, tuple[int, float]]:
    rows = balanced_weights(featured, "label").collect()  # one row per class
    return {r["label"]: (r["class_rows"], r["class_weight"]) for r in rows}


def fit_stages(featured: DataFrame, settings: Settings) -> PipelineModel | linear.LinearModel | boosting.BoostedModel:
    """Fit the classifier on (features, label).  Cache ``featured`` before.

    The logistic model minimises mean loss plus regParam/2 |w|², so regParam is 1 / (C x sum of row weights).
    """
    if settings.kind in OWN_MODELS:
        indices, values = linear.entries(F.unwrap_udt("features"))
        rows = featured.select(F.lit(0).alias("fold"), label_id(F.col("label")).cast("int").alias("y"),
                               indices.alias("indices"), values.alias("values"))
        first = featured.select("features").first()
        size = first["features"].size if first else 0
        fit = linear.Fit(None, None, settings.c, settings.balanced)
        if settings.kind == SVM:  # packs and caches the rows itself
            return linear.LinearModel(linear.fit_all(rows, size, [fit], settings.iterations)[0])
        rows = rows.persist()
        try:
            table, models = boosting.fit_all(rows, size, [fit], len(CLASSES), settings.boost_rounds, settings.boost_depth, settings.boost_rate)
            table.unpersist()
            return models[0]
        finally:
            rows.unpersist()
    numbered = featured.withColumn("y", label_id(F.col("label")))
    common = dict(featuresCol="features", labelCol="y", predictionCol="class_number", rawPredictionCol="raw", probabilityCol="probability")
    if settings.kind == "Logistic Regression":
        counts = _class_rows(featured)
        by_class = {c: w for c, (_, w) in counts.items()} if settings.balanced else {}
        mass = sum(n * by_class.get(c, 1.0) for c, (n, _) in counts.items())
        weight = F.lit(1.0)
        for name, value in by_class.items():
            weight = F.when(F.col("label") == name, F.lit(float(value))).otherwise(weight)
        learner = LogisticRegression(family="multinomial", weightCol="w", maxIter=settings.iterations,
                                     regParam=1.0 / (settings.c * mass), standardization=False, **common)
        numbered = numbered.withColumn("w", weight)
    elif settings.kind == "Naive Bayes":
        learner = NaiveBayes(modelType="multinomial", smoothing=1.0, **common)
    else:
        learner = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.tree_depth, seed=42, **common)
    return PipelineModel([learner.fit(numbered)])


def train(df: DataFrame, settings: Settings, text_col: str = "prepared", fitted: TextVectorizer | None = None) -> SentimentModel:
    """Fit vectoriser and classifier on the given rows only; ``fitted`` is a vectoriser already fitted on them."""
    vectorizer = fitted or replace(settings.vectorizer, terms=None, idf=None).fit(df, text_col)
    featured = vectorizer.transform(df, text_col, "features").select("label", "features").persist()
    try:
        return SentimentModel(settings.kind, vectorizer, fit_stages(featured, settings))
    finally:
        featured.unpersist()


def score_reviews(df: DataFrame, model: SentimentModel, text_col: str = "prepared",
                  out: str = "predicted_sentiment") -> DataFrame:
    """Add the predicted sentiment to a review table."""
    return model.transform(df, text_col).withColumnRenamed("prediction", out)


def _by_place(places: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(places)
    return places[order].astype(np.int32), idf[order]


class _Vocabularies:
    """Fitted vectorisers by settings and left-out fold, as places in one list of terms; lists of their own are made when asked for."""

    def __init__(self, terms: list[str], parts: dict[tuple, tuple[TextVectorizer, np.ndarray, np.ndarray]]):
        self.terms, self.parts = terms, parts

    def __getitem__(self, key: tuple) -> TextVectorizer:
        v, places, idf = self.parts[key]
        return replace(v, terms=[self.terms[i] for i in places], idf=idf.tolist())


class FoldTable:
    """Training rows in folds, with the vocabularies of all vectorisers for every left-out fold, from one text scan.

    ``rows`` (written once) holds term counts over the union of all vocabularies, whose size the feature limits
    bound; a vectoriser fitted without a fold is a vector of term weights over it.
    """

    def __init__(self, train_rows: DataFrame, vectorizers: list[TextVectorizer], text_col: str = "prepared"):
        first = vectorizers[0]
        if any((v.low, v.sublinear, v.stop_words) != (1, first.sublinear, first.stop_words) for v in vectorizers):
            raise ValueError("vectorisers that share counts start at single words and agree in scaling and stop words")
        labelled = train_rows.select(F.col("fold").cast("int").alias("fold"), label_id(F.col("label")).cast("int").alias("y"), text_col)
        self.counts = linear.class_counts(labelled)
        self.folds = sorted({f for f, _ in self.counts})
        high = max(v.high for v in vectorizers)
        cube = materialise(count_cube(labelled, text_col, self.folds, high, first.stop_words))
        wanted = {(self.key(v), f): v for v in vectorizers for f in [*self.folds, None]}
        codes, lock = {}, threading.Lock()
        found = together([lambda v=v, f=f: self._fit(cube, v, f, codes, lock) for (_, f), v in wanted.items()])
        self.terms = sorted(codes)
        rank = np.zeros(len(codes), np.int64)
        rank[[codes[t] for t in self.terms]] = np.arange(len(codes))
        self.fitted = _Vocabularies(self.terms, {w: (v, *_by_place(rank[at], idf)) for (w, v), (at, idf) in zip(wanted.items(), found)})
        parts = F.unwrap_udt("_counts")
        counted = gram_vectors(labelled, text_col, "_counts", self.terms, high, first.stop_words, first.sublinear)
        self.rows = materialise(counted.select("fold", "y", parts["indices"].alias("indices"), parts["values"].alias("values")))

    @staticmethod
    def key(v: TextVectorizer) -> tuple:
        return v.high, v.min_df, v.max_df, v.max_features

    def _fit(self, cube: DataFrame, v: TextVectorizer, without: int | None, codes: dict[str, int], lock: threading.Lock
             ) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms in ``codes``, which gets the new ones, and their weights."""
        folds = [f for f in self.folds if f != without]
        n_docs = sum(n for (f, _), n in self.counts.items() if f in folds)
        found = cube_vocabulary(cube, folds, n_docs, v.high, v.min_df, v.max_df, v.max_features) if folds else cube.limit(0).selectExpr("term", "0D idf")
        rows = found.select("term", "idf").collect()  # at most max_features rows
        with lock:
            return np.array([codes.setdefault(r["term"], len(codes)) for r in rows], np.int64), np.array([r["idf"] for r in rows], float)

    def vectorizer(self, settings: Settings, without: int | None) -> TextVectorizer:
        return self.fitted[self.key(settings.vectorizer), without]

    def fit(self, settings: Settings, without: int | None) -> linear.Fit:
        """The settings as a linear fit on ``rows``."""
        scale = np.zeros(len(self.terms))
        _, places, idf = self.fitted.parts[self.key(settings.vectorizer), without]
        scale[places] = idf
        return linear.Fit(scale, without, settings.c, settings.balanced)

    def fit_linear(self, settings: Settings, whole: bool = False) -> tuple[float, SentimentModel | None]:
        """Mean macro-F1 over the folds, all of which are fitted in step; with ``whole`` also the model of all rows."""
        fits = [self.fit(settings, f) for f in [*self.folds, *[None] * whole]]
        found = linear.fit_all(self.rows, len(self.terms), fits, settings.iterations, self.counts)
        confusion = linear.held_out_confusion(self.rows, fits[:len(self.folds)], found[:len(self.folds)])
        score = sum(linear.macro_f1(c, len(CLASSES)) for c in confusion.values()) / len(self.folds)
        if not whole:
            return score, None
        v, weights = self.vectorizer(settings, None), found[-1]
        own = [*self._own(settings), len(self.terms)]
        return score, SentimentModel(SVM, v, linear.LinearModel(linear.Weights(weights.classes, weights.table[:, own])))

    def fit_boosted(self, settings: Settings, whole: bool = False) -> tuple[float, SentimentModel | None]:
        """The same for boosted trees: folds and the model of all rows are chains of jobs that run at a time."""
        def one(without: int | None) -> tuple[dict, boosting.BoostedModel]:
            fits = [self.fit(settings, without)]
            table, models = boosting.fit_all(self.rows, len(self.terms), fits, len(CLASSES), settings.boost_rounds,
                                             settings.boost_depth, settings.boost_rate)
            confusion = boosting.held_out_confusion(table, fits, models)[0]
            table.unpersist()
            return confusion, models[0]

        found = together([lambda f=f: one(f) for f in [*self.folds, *[None] * whole]])
        score = sum(linear.macro_f1(c, len(CLASSES)) for c, _ in found[:len(self.folds)]) / len(self.folds)
        if not whole:
            return score, None
        v = self.vectorizer(settings, None)
        return score, SentimentModel(BOOSTED, v, found[-1][1].narrowed(self._own(settings)))

    def _own(self, settings: Settings) -> list[int]:
        """Columns of the terms of the vectoriser of all rows, in its order."""
        return self.fitted.parts[self.key(settings.vectorizer), None][1].tolist()


def cross_validate(df: DataFrame, settings: Settings, text_col: str = "prepared", table: FoldTable | None = None) -> float:
    """Mean macro-F1 over the folds in column ``fold``; vocabularies are fitted per fold, and folds train at a time."""
    table = table or FoldTable(df, [settings.vectorizer], text_col)
    if settings.kind in OWN_MODELS:
        return (table.fit_linear if settings.kind == SVM else table.fit_boosted)(settings)[0]

    def score(fold: int) -> float:
        model = train(df.filter(F.col("fold") != fold), settings, text_col, table.vectorizer(settings, fold))
        held = model.transform(df.filter(F.col("fold") == fold), text_col)
        return metrics.overall_metrics(held).first()["macro_f1"]

    scores = together([lambda f=f: score(f) for f in table.folds])
    return sum(scores) / len(scores)


def split_with_folds(reviews: DataFrame, id_col: str = "review_id", folds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Stratified 80/20 split; the training part carries its fold number."""
    split = stratified_split(reviews, "label", id_col)
    train_rows = stratified_folds(split.filter("NOT is_test").drop("is_test"), "label", id_col, folds)
    return train_rows, split.filter("is_test").drop("is_test")


def compare_models(train_rows: DataFrame, test_rows: DataFrame, preprocessing: list[str], settings: list[Settings],
                   id_col: str = "review_id", tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cross-validated and test metrics of every preparation and model.

    Texts are prepared and counted once per preparation; its models train at a time.
    """
    spark, rows = train_rows.sparkSession, []

    def measure(method: str, prepared: DataFrame, held: DataFrame, shared: FoldTable, setting: Settings) -> dict:
        if setting.kind in OWN_MODELS:
            cv, model = (shared.fit_linear if setting.kind == SVM else shared.fit_boosted)(setting, whole=True)
        else:
            cv = cross_validate(prepared, setting, table=shared)
            model = train(prepared, setting, fitted=shared.vectorizer(setting, None))
        values = metrics.result_columns(model.transform(held)).first().asDict()
        return {"preprocessing": method, "vectorizer": "tfidf", "model": setting.kind, "cv_macro_f1": cv, **values}

    def prepare(method: str) -> list[dict]:
        table = (tables or {}).get(method)
        prepared = materialise(preprocess(train_rows, method, id_col, table=table))
        held = materialise(preprocess(test_rows, method, id_col, table=table))
        shared = FoldTable(prepared, [s.vectorizer for s in settings])
        return together([lambda s=s: measure(method, prepared, held, shared, s) for s in settings])

    for found in together([lambda m=m: prepare(m) for m in preprocessing]):
        rows += found
    return spark.createDataFrame(rows).orderBy(F.col("cv_macro_f1").desc(), "preprocessing", "model")


SEARCH_SPACE = {
    "high": [1, 2, 3],
    "min_df": [1, 2, 3],
    "max_features": [15000, 30000, 50000],
    "c": [0.1, 0.5, 1.0, 2.0],
    "balanced": [False, True],
}


def sample_settings(space: dict[str, list] = SEARCH_SPACE, n: int = 24, seed: int = 42) -> list[Settings]:
    """``n`` different combinations of the space, the same ones for the same seed."""
    grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    chosen = random.Random(seed).sample(grid, min(n, len(grid)))
    return [Settings(c=g["c"], balanced=g["balanced"],
                     vectorizer=TextVectorizer(high=g["high"], min_df=g["min_df"], max_features=g["max_features"]))
            for g in chosen]


def random_search(train_rows: DataFrame, candidates: list[Settings]) -> DataFrame:
    """Cross-validated macro-F1 of every sampled setting, one row each, in sampling order.

    All settings and folds share one scan of the texts and one table of term counts.
    """
    if not candidates:
        raise ValueError("no candidates")
    table = FoldTable(train_rows, [s.vectorizer for s in candidates])
    scores = together([lambda s=s: cross_validate(train_rows, s, table=table) for s in candidates])
    rows = [(i, s.vectorizer.high, s.vectorizer.min_df, s.vectorizer.max_features, s.c, s.balanced, score)
            for i, (s, score) in enumerate(zip(candidates, scores))]
    return train_rows.sparkSession.createDataFrame(
        rows, "setup_rank int, ngram_high int, min_df int, max_features int, c double, balanced boolean, "
              "cv_macro_f1 double")


def tune(train_rows: DataFrame, test_rows: DataFrame, candidates: list[Settings]
         ) -> tuple[SentimentModel, Settings, dict, DataFrame]:
    """Search, refit the best setting on all training rows and measure it on the test rows; also the search table."""
    searched = random_search(train_rows, candidates)
    best = metrics.best_setup(searched).first()
    setting = candidates[best["setup_rank"]]
    model = train(train_rows, setting)
    measured = metrics.result_columns(model.transform(test_rows)).first().asDict()
    return model, setting, {"cv_macro_f1": best["cv_macro_f1"], **measured}, searched


def extra_experiments(train_rows: DataFrame, test_rows: DataFrame, setting: Settings,
                      id_col: str = "review_id") -> DataFrame:
    """Macro-F1 of the setting as it is, on equally large classes, and on self-consistent rows."""
    spark = train_rows.sparkSession

    def score(rows: DataFrame) -> tuple[SentimentModel, float]:
        model = train(rows, setting)
        return model, metrics.overall_metrics(model.transform(test_rows)).first()["macro_f1"]

    def filtered() -> tuple[float, float]:
        original, base = score(train_rows)
        consistent = consistent_rows(original.transform(train_rows)).drop("prediction").persist()
        try:
            return base, score(consistent)[1]
        finally:
            consistent.unpersist()

    def evened() -> float:
        even = downsample(train_rows, "label", id_col).persist()
        try:
            return score(even)[1]
        finally:
            even.unpersist()

    # the rows of equally large classes do not wait for the first model
    (base, filtered_f1), down = together([filtered, evened])
    return spark.createDataFrame([("original_tuned", base), ("downsampling", down), ("filtered_label", filtered_f1)],
                                 "experiment string, macro_f1 double")
