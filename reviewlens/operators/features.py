"""Text features: token normalisation, n-grams, TF-IDF (long and vector form) and SVD."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.text import basic_clean, clean_words, ngrams, raw_tokens, word_tokens
from reviewlens.operators.joins import lookup_join
from reviewlens.runtime import materialise


# --- token normalisation (stemming, lemmatising) ------------------------------

def normalize_tokens(df: DataFrame, id_col: str, text_col: str, table: DataFrame, out: str,
                     keep_underscore: bool = False) -> DataFrame:
    """Replace every token of the cleaned text by its normal form from ``table`` (token, normal).

    Tokens without an entry stay.  The table is written once and restricted to tokens that change.  One of up to
    ``TABLE_BYTES`` goes to every task, and texts are changed where they are.  A larger one is joined: tokens that
    stand in many texts are looked up without a shuffle, and only changes come back to the texts, per document a
    map from position to normal form.
    """
    unique = materialise(table.groupBy("token").agg(F.min("normal").alias("normal")).filter("token <> normal"))
    size = unique.agg(F.sum(F.octet_length("token") + F.octet_length("normal"))).first()[0] or 0
    if size <= TABLE_BYTES:
        return df.withColumn(out, F.coalesce(_replaced(unique, basic_clean(F.col(text_col), keep_underscore)), F.lit("")))
    tokens = F.split(basic_clean(F.col(text_col), keep_underscore), " ")
    exploded = df.select(id_col, F.posexplode(tokens).alias("pos", "token"))
    changes = lookup_join(exploded, unique, "token").groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "normal"))).alias("_changes"))
    changed = F.transform(tokens, lambda t, i: F.coalesce(F.col("_changes")[i], t))
    joined = df.join(changes, id_col, "left")
    text = F.array_join(F.when(F.col("_changes").isNull(), tokens).otherwise(changed), " ")
    return joined.withColumn(out, F.coalesce(text, F.lit(""))).drop("_changes")


#: Size of a token table that is sent to every task.
TABLE_BYTES = 16 << 20


def _replaced(table: DataFrame, texts: Column) -> Column:
    """Cleaned texts with their tokens replaced; only different tokens of a chunk are looked up."""
    rows = table.select("token", "normal").collect()  # at most TABLE_BYTES
    shipped = table.sparkSession.sparkContext.broadcast(([r["token"] for r in rows], [r["normal"] for r in rows]))

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        tokens, normals = (pa.array(x, pa.string()) for x in shipped.value)
        done = [pa.array([], pa.string())]
        for a, b in _chunks(texts):
            lists = pc.split_pattern(pc.fill_null(texts.slice(a, b - a), ""), " ")
            words = lists.flatten().dictionary_encode()
            changed = pc.coalesce(normals.take(pc.index_in(words.dictionary, value_set=tokens)), words.dictionary)
            done.append(pc.binary_join(pa.ListArray.from_arrays(lists.offsets, changed.take(words.indices)), " "))
        return pa.concat_arrays(done)

    return replaced(texts)


def distinct_tokens(df: DataFrame, text_col: str) -> DataFrame:
    """Every distinct token of the cleaned texts: the rows a stemmer has to look at."""
    return df.select(F.explode(F.array_distinct(clean_words(F.col(text_col)))).alias("token")).distinct()


def plural_lemmas(tokens: DataFrame) -> DataFrame:
    """Lemma table learned from the vocabulary: a plural whose singular also occurs maps to it."""
    tokens = materialise(tokens)  # read twice, and much smaller than the texts
    singular = tokens.select(F.col("token").alias("normal"))
    plural = tokens.filter((F.length("token") > 3) & F.col("token").endswith("s")).select(
        "token", F.expr("substring(token, 1, length(token) - 1)").alias("normal"))
    return plural.join(singular, "normal", "left_semi").select("token", "normal")


def preprocess(df: DataFrame, method: str, id_col: str, text_col: str = "text", out: str = "prepared",
               table: DataFrame | None = None) -> DataFrame:
    """Prepare the text by name: raw_tokens, basic_clean, stemming or lemmatization.

    Stemming and lemmatisation need a token table; without one they leave the cleaned text.
    """
    if method in ("stemming", "lemmatization"):
        if table is None:
            return df.withColumn(out, basic_clean(F.col(text_col)))
        return normalize_tokens(df, id_col, text_col, table, out)
    columns = {"raw_tokens": raw_tokens, "basic_clean": basic_clean}
    return df.withColumn(out, columns[method](F.col(text_col)))


# --- terms ---------------------------------------------------------------------

def with_terms(df: DataFrame, text_col: str, out: str = "terms", low: int = 1, high: int = 2,
               stop_words: list[str] | None = None) -> DataFrame:
    """Add the array of word n-grams of a text; stop words go before n-grams are built."""
    tokens = df.withColumn("_tokens", word_tokens(F.col(text_col)))
    if stop_words:
        remover = StopWordsRemover(inputCol="_tokens", outputCol="_kept", stopWords=stop_words, caseSensitive=True)
        tokens = remover.transform(tokens).drop("_tokens").withColumnRenamed("_kept", "_tokens")
    return tokens.withColumn(out, ngrams(F.col("_tokens"), low, high)).drop("_tokens")


def default_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def term_counts(df: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """Long table (key, term, tf); the terms of many rows with the same key add up."""
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(term_stats: DataFrame, n_docs: Column | int, min_df: int = 1, max_df: float = 1.0,
               max_features: int | None = None) -> DataFrame:
    """Vocabulary from (term, df, total): document-frequency limits, then the most frequent terms.

    Equal totals are settled by the term, so the vocabulary is the same on every run.
    """
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    kept = term_stats.withColumn("n_docs", n).filter(
        (F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * F.lit(max_df)))
    if max_features is not None:
        kept = kept.orderBy(F.col("total").desc(), F.col("term")).limit(max_features)
    found = kept.withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).drop("n_docs")
    return found if max_features is None else F.broadcast(found)  # at most max_features rows


def stats_from_counts(counts: DataFrame) -> DataFrame:
    """Document frequency and total of every term of a long table."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def stats_from_rows(df: DataFrame, terms: str = "terms") -> DataFrame:
    """The same from one row per document, without grouping by document first.

    Each row emits its terms for the total and its distinct terms for the document
    frequency; both are summed in one aggregate that combines inside each task.
    """
    marked = F.concat(
        F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("t"))),
        F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"),
                                                                F.lit(0).alias("t"))))
    return (df.select(F.explode(marked).alias("m")).groupBy(F.col("m.term").alias("term"))
            .agg(F.sum("m.d").alias("df"), F.sum("m.t").alias("total")))


# --- counts of n-grams straight from texts ----------------------------------------

#: Bytes of text whose n-grams a task counts at a time, and in all: what a task holds does not grow with the input.
CHUNK_BYTES, TASK_BYTES = 4 << 20, 16 << 20


def joined_words(text: Column) -> Column:
    """The words of a text, joined by one space."""
    return F.array_join(word_tokens(text), " ")


def spread(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` in tasks of at most about ``TASK_BYTES`` of text, however its files are cut."""
    return df.repartition(text_tasks(df, text_col), F.xxhash64(*df.columns))


def text_tasks(df: DataFrame, text_col: str) -> int:
    """Tasks that hold the texts: their number grows with the input."""
    return 1 + (df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // TASK_BYTES


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``CHUNK_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK_BYTES, "right")))
        yield low, high
        low = high


def _grams(texts: pa.Array, high: int, stop_words: list[str] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """For n = 1 to ``high``: n, the text and the number of every n-gram of joined words, and the n-grams by number."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    words = lists.flatten().dictionary_encode()
    names, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    dropped = pc.is_in(names, value_set=pa.array(["", *(stop_words or [])], names.type)).to_numpy(zero_copy_only=False)
    kept = ~dropped[code]
    doc, code = doc[kept], code[kept]
    number, strings = code, names
    yield 1, doc, number, strings
    for n in range(2, high + 1):
        at = np.flatnonzero(doc[:len(doc) - n + 1] == doc[n - 1:]) if len(doc) >= n else np.zeros(0, np.int64)
        keys = pa.array(number[at] * len(names) + code[at + n - 1], pa.int64()).dictionary_encode()
        pairs = keys.dictionary.to_numpy(zero_copy_only=False)
        strings = pc.binary_join_element_wise(strings.take(pa.array(pairs // len(names))), names.take(pa.array(pairs % len(names))), " ")
        number = np.full(len(doc), -1, np.int64)
        number[at] = keys.indices.to_numpy(zero_copy_only=False)
        yield n, doc[at], number[at], strings


def _occurrences(doc: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, number and occurrences of every n-gram within every text."""
    keys = pa.array(doc * size + number, pa.int64()).dictionary_encode()
    pairs = keys.dictionary.to_numpy(zero_copy_only=False)
    return pairs // max(size, 1), pairs % max(size, 1), np.bincount(keys.indices.to_numpy(zero_copy_only=False), minlength=len(pairs))


def gram_stats(df: DataFrame, text_col: str, low: int = 1, high: int = 2, stop_words: list[str] | None = None,
               folds: list[int] | None = None) -> DataFrame:
    """What ``stats_from_rows(with_terms(df, …))`` gives, counted from the texts a chunk at a time.

    With ``folds``, counts per value of column ``fold``: df_0, total_0, ….  Texts pass as one string each.
    """
    names = [f"{c}{f}" for f in (["_" + str(f) for f in folds] if folds is not None else [""]) for c in ("df", "total")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False) if folds is not None else None
            for a, b in _chunks(texts := batch.column("words")):
                for n, doc, number, strings in _grams(texts.slice(a, b - a), high, stop_words):
                    if n < low:
                        continue
                    size = len(strings)
                    where, which, _ = _occurrences(doc, number, size)
                    own = fold[a:b] if folds is not None else None
                    counts = [np.bincount(x if own is None else x[own[d] == f], minlength=size)
                              for f in (folds if folds is not None else [None]) for x, d in ((which, where), (number, doc))]
                    used = np.sum(counts, axis=0) > 0
                    yield pa.RecordBatch.from_arrays([strings.filter(pa.array(used)), *(pa.array(c[used], pa.int64()) for c in counts)],
                                                     ["term", *names])

    rows = spread(df.select(*(["fold"] if folds is not None else []), text_col), text_col)
    rows = rows.select(*(["fold"] if folds is not None else []), joined_words(F.col(text_col)).alias("words"))
    counted = rows.mapInArrow(run, "term string, " + ", ".join(f"{c} long" for c in names))
    return counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])


def gram_counts(df: DataFrame, key: str, text_col: str, low: int = 1, high: int = 2, stop_words: list[str] | None = None,
                among: list[str] | None = None) -> DataFrame:
    """What ``term_counts(with_terms(df, …), key)`` gives, counted from the texts a chunk at a time; ``among`` keeps only these terms."""
    shipped = None if among is None else df.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shipped is None else pa.array(shipped.value, pa.string())
        for batch in batches:
            for a, b in _chunks(texts := batch.column("words")):
                keys = batch.column(key).slice(a, b - a)
                for n, doc, number, strings in _grams(texts.slice(a, b - a), high, stop_words):
                    if n < low:
                        continue
                    where, which, tf = _occurrences(doc, number, len(strings))
                    if wanted is not None:
                        own = pc.is_in(strings, value_set=wanted).to_numpy(zero_copy_only=False)[which]
                        where, which, tf = where[own], which[own], tf[own]
                    for i in range(0, len(where), 1 << 17):
                        j = slice(i, i + (1 << 17))
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(where[j])), strings.take(pa.array(which[j])), pa.array(tf[j], pa.int64())],
                                                         [key, "term", "tf"])

    tasks = text_tasks(df, text_col)
    rows = df.select(key, text_col).repartition(tasks, F.xxhash64(key, text_col)).select(key, joined_words(F.col(text_col)).alias("words"))
    counted = rows.mapInArrow(run, T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))
    if among is not None:  # few rows a text: dealt by key once, which also serves a norm by key, in as many parts as the texts
        counted = counted.repartition(tasks, key)
    return counted.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def keyed_stats(df: DataFrame, key: str, text_col: str, low: int = 1, high: int = 2, stop_words: list[str] | None = None) -> DataFrame:
    """``stats_from_counts`` of the term counts per ``key``: texts with the same key count as one document.

    Only texts whose key repeats are counted in long form; the others are documents of their own.
    """
    again = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_key", F.lit(True).alias("_again"))
    marked = materialise(df.select(key, text_col).join(again, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key"))
    more = marked.where("_again")
    single = gram_stats(marked.where("_again IS NULL"), text_col, low, high, stop_words)
    if more.isEmpty():
        return single
    shared = stats_from_counts(gram_counts(more, key, text_col, low, high, stop_words))
    return single.unionByName(shared).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def gram_vectors(df: DataFrame, text_col: str, out: str, terms: list[str], high: int, stop_words: list[str] | None, sublinear: bool,
                 idf: list[float] | None = None) -> DataFrame:
    """Add the sparse vector of the counts of ``terms``, with ``idf`` weighted and brought to length one."""
    shipped = df.sparkSession.sparkContext.broadcast((terms, idf))

    @F.arrow_udf(VectorUDT())
    def vectors(texts: pa.Array) -> pa.Array:
        terms, idf = shipped.value
        known, parts = pa.array(terms, pa.string()), []
        for a, b in _chunks(texts):
            for _, doc, number, strings in _grams(texts.slice(a, b - a), high, stop_words):
                place = pc.fill_null(pc.index_in(strings, value_set=known), -1).to_numpy(zero_copy_only=False)[number]
                own = place >= 0
                parts.append(_occurrences(doc[own] + a, place[own].astype(np.int64), len(terms)))
        doc, place, tf = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(3))
        order = np.argsort(doc * max(len(terms), 1) + place)
        doc, place, values = doc[order], place[order], tf[order].astype(float)
        values = np.log(values) + 1 if sublinear else values
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        if idf is not None:
            values = values * np.array(idf)[place]
            norm = np.sqrt(np.bincount(doc, values * values, len(texts)))
            values = values / norm[doc]
        offsets = pa.array(first, pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(len(texts)), pa.int8()), pa.array(np.full(len(texts), len(terms)), pa.int32()),
             pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(values))],
            ["type", "size", "indices", "values"])

    return df.withColumn(out, vectors(joined_words(F.col(text_col))))


def count_cube(df: DataFrame, text_col: str, folds: list[int], high: int, stop_words: list[str] | None = None) -> DataFrame:
    """Per n-gram of 1 to ``high`` words: words, and documents (df) and occurrences (total) in each fold, from one scan.

    The counts of all folds but one are a difference, so vocabularies for any left-out fold, n-gram size and
    document frequency are cuts of this table and need no other pass over the texts.
    """
    return gram_stats(df, text_col, 1, high, stop_words, folds).withColumn("words", F.size(F.split("term", " ")))


def cube_vocabulary(cube: DataFrame, folds: list[int], n_docs: int, high: int, min_df: int, max_df: float,
                    max_features: int | None) -> DataFrame:
    """Vocabulary of the documents in ``folds``, of which there are ``n_docs``: what ``vocabulary`` finds in their texts."""
    df, total = (reduce(lambda a, b: a + b, [F.col(f"{name}_{f}") for f in folds]) for name in ("df", "total"))
    stats = cube.where(F.col("words") <= high).select("term", df.alias("df"), total.alias("total")).where("df > 0")
    return vocabulary(stats, n_docs, min_df, max_df, max_features)


def tfidf_long(counts: DataFrame, vocab: DataFrame, key: str, sublinear: bool = True) -> DataFrame:
    """Unit-length TF-IDF weights as a long table (key, term, weight).

    A vocabulary with a feature limit comes with a broadcast hint, so a term found in every document
    is not a join hot spot; one without is joined by run-time sizes.
    """
    terms = vocab.select("term", "idf")
    tf = F.log(F.col("tf").cast("double")) + 1 if sublinear else F.col("tf").cast("double")
    raw = counts.join(terms, "term").select(key, "term", (tf * F.col("idf")).alias("w"))
    # Partitioning by the document key serves the norm; the vocabulary bounds its rows.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


# --- vectors ---------------------------------------------------------------------

_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vector(size: Column, indices: Column, values: Column) -> Column:
    """Sparse ML vector from arrays, built inside the JVM."""
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), size.cast("int").alias("size"),
                     indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _VECTOR)["v"]


@dataclass
class TextVectorizer:
    """TF-IDF vectors for the learners; the vocabulary has at most ``max_features`` terms."""

    low: int = 1
    high: int = 2
    min_df: int = 1
    max_df: float = 1.0
    max_features: int = 15000
    sublinear: bool = True
    stop_words: list[str] | None = None
    terms: list[str] | None = None
    idf: list[float] | None = None

    def fit(self, df: DataFrame, text_col: str) -> "TextVectorizer":
        stats = gram_stats(df, text_col, self.low, self.high, self.stop_words)
        vocab = vocabulary(stats, df.agg(F.count("*")).scalar(), self.min_df, self.max_df, self.max_features)
        rows = vocab.select("term", "idf").collect()  # at most max_features rows
        rows.sort(key=lambda r: r["term"])
        self.terms, self.idf = [r["term"] for r in rows], [r["idf"] for r in rows]
        return self

    def transform(self, df: DataFrame, text_col: str, out: str = "features") -> DataFrame:
        """Add the vector column; row by row, without any shuffle."""
        return gram_vectors(df, text_col, out, self.terms, self.high, self.stop_words, self.sublinear, self.idf)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(list(zip(self.terms, self.idf)), "term string, idf double").write.mode(
            "overwrite").parquet(f"{path}/vocabulary")
        settings = {k: getattr(self, k) for k in ["low", "high", "min_df", "max_df", "max_features", "sublinear",
                                                  "stop_words"]}
        spark.createDataFrame([(json.dumps(settings),)], "settings string").write.mode("overwrite").json(
            f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextVectorizer":
        settings = json.loads(spark.read.json(f"{path}/settings").first()["settings"])
        rows = sorted(spark.read.parquet(f"{path}/vocabulary").collect(), key=lambda r: r["term"])
        return cls(**settings, terms=[r["term"] for r in rows], idf=[r["idf"] for r in rows])


def vectors_from_long(weights: DataFrame, key: str, terms: list[str], out: str = "features") -> DataFrame:
    """One sparse vector per key from a long table; a row holds at most one entry per term."""
    spark = weights.sparkSession
    index = spark.createDataFrame([(t, i) for i, t in enumerate(sorted(terms))], "term string, index int")
    pairs = weights.join(F.broadcast(index), "term").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("p"))
    return pairs.select(key, sparse_vector(F.lit(len(terms)), F.transform("p", lambda x: x["index"]),
                                           F.transform("p", lambda x: x["weight"])).alias(out))


def svd_features(df: DataFrame, key: str, features: str = "features", components: int = 8,
                 out: str = "vector") -> DataFrame:
    """Project sparse vectors on their leading singular directions and scale rows to length one.

    The number of directions is min(components, rows - 1, columns - 1).  With fewer
    than two, the vectors are used as they are.  Only the direction matrix (columns x 8)
    visits the driver; rows are decomposed and projected on the executors.
    """
    spark = df.sparkSession
    first = df.select(features).first()
    width = first[0].size if first else 0
    k = min(components, df.count() - 1, width - 1)
    parts = F.unwrap_udt(features)
    if k < 2:
        dense = df.select(key, vector_array(features).alias("a"))
        return dense.select(key, unit_array(F.col("a")).alias(out))
    rows = RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(features), features))
    directions = canonical_signs(rows.computeSVD(k, computeU=False).V.toArray())
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(directions)],
                                  "index int, direction array<double>")
    entries = df.select(key, F.explode(F.arrays_zip(parts["indices"].alias("index"),
                                                    parts["values"].alias("value"))).alias("e")).select(
        key, F.col("e.index").alias("index"), F.col("e.value").alias("value"))
    actual = directions.shape[1]
    # The direction table has one row per vocabulary term, which the feature limit bounds.
    sums = entries.join(F.broadcast(table), "index").groupBy(key).agg(*[
        F.sum(F.col("value") * F.col("direction")[i]).alias(f"_{i}") for i in range(actual)])
    full = df.select(key).join(sums, key, "left")
    array = F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i in range(actual)])
    return full.select(key, unit_array(array).alias(out))


def canonical_signs(directions: np.ndarray) -> np.ndarray:
    """Directions (columns) with the sign that makes the largest loading positive, the first one on a tie."""
    largest = np.abs(directions).argmax(axis=0)
    return directions * np.where(directions[largest, np.arange(directions.shape[1])] < 0, -1.0, 1.0)


def vector_array(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(column))


def unit_array(array: Column) -> Column:
    """Array scaled to Euclidean length one; an all-zero array stays."""
    norm = F.sqrt(F.aggregate(array, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(array, lambda x: x / norm)).otherwise(array)
