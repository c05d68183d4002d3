"""Ranked lexical search over an index in strata of equal length.

Scores follow a tf-idf formula in whole numbers, in which a document's length enters through its normaliser ``m`` only.

1. One pass over the texts counts, for the terms that the query block asks for, their occurrences per document.
2. Documents with equal ``m`` form a stratum; a stratum is stored in blocks of bounded size, and a block's postings stand
   by term, then by tf, so that one impact serves all documents of a (stratum, tf).
3. The largest tf of each term gives a bound of a stratum for an item.  Strata are visited by falling bound: first as
   many as hold ``k`` documents, whose k-th score is the threshold; then only what may still reach it, block by block
   under the same kind of bound.  Nothing else is skipped, so the result is exact.

Queries come in blocks of bounded size; what the driver sees is bounded by the query block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import texts
from reviewlens.operators.ordering import top_per_group
from reviewlens.runtime import materialise

#: Bounds of a query block: items, and terms with repeats (a longer item stands alone).
ITEMS, TERMS = 4096, 1 << 18
#: Documents of a block.
DOCS = 512
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
_LAST = np.iinfo(np.int64).max

INDEX = "m long, size int, docs array<long>, term array<int>, tf array<int>, count array<int>, slots binary"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


class Queries(NamedTuple):
    """A query block: item ids, and per item its distinct terms (numbers) and how often it has them, end to end."""

    ids: list
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray
    words: list[str]


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """The items in blocks; items without terms have no result and are left out."""
    def packed(block: list[tuple[object, Counter]]) -> Queries:
        words = sorted(set().union(*(c for _, c in block)))
        number = {w: i for i, w in enumerate(words)}
        return Queries([i for i, _ in block], np.cumsum([0, *(len(c) for _, c in block)]),
                       np.array([number[w] for _, c in block for w in c], np.int64),
                       np.array([n for _, c in block for n in c.values()], np.int64), words)

    block, size = [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        found = Counter(terms_of(row["text"]))
        if not found:
            continue
        if block and (len(block) == ITEMS or size + found.total() > TERMS):
            yield packed(block)
            block, size = [], 0
        block.append((row["item_id"], found))
        size += found.total()
    if block:
        yield packed(block)


def counted(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers and occurrences of those of ``words`` that the text has."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)  # bounded by the query block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): i for i, w in enumerate(shipped.value)}
        for part in texts.chunks(batches):
            data, offsets = texts.utf8(part.column("text"))
            data = _LOWERED[data]
            starts, ends, first = texts.word_spans(data, offsets)
            term, tf, at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            if len(starts):
                borders = pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64))
                dense = pa.py_buffer(np.ascontiguousarray(data[texts.WORD[data]]))
                coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, borders, dense]).dictionary_encode()
                known = np.array([number.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
                found = known[coded.indices.to_numpy()]
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                hit = found >= 0
                keys, tf = np.unique(row[hit] * len(number) + found[hit], return_counts=True)
                row, term = np.divmod(keys, len(number))
                at = np.searchsorted(row, np.arange(len(offsets)))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists],
                                             ["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>"))


def build_index(forward: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Blocks of documents with equal m.  ``docs`` are their ids; the postings of a (term, tf) are ``count`` slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("m").to_numpy()
            change = np.flatnonzero(np.diff(m)) + 1
            stratum = np.concatenate([[0], change])
            inside = np.arange(len(m)) - np.repeat(stratum, np.diff(np.append(stratum, len(m))))
            slot = inside % DOCS
            block = np.cumsum(slot == 0) - 1
            listed = batch.column("term")
            owner = np.repeat(np.arange(len(m)), listed.value_lengths().to_numpy())
            term, tf = (batch.column(c).flatten().to_numpy() for c in ("term", "tf"))
            order = np.lexsort((slot[owner], tf, term, block[owner]))
            owner, term, tf = owner[order], term[order], tf[order]
            of = block[owner]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
            group = np.flatnonzero(new)
            count = np.diff(np.append(group, len(of)))
            blocks = np.arange(block[-1] + 1)
            low, high = np.searchsorted(of[group], blocks), np.searchsorted(of[group], blocks, "right")
            first = np.append(np.searchsorted(block, blocks), len(m))
            slots = slot[owner].astype("<u2")
            post = np.append(group, len(of))
            lists = pa.ListArray.from_arrays
            borders = pa.array(np.append(low, high[-1:]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[first[:-1]]), pa.array(np.diff(first), pa.int32()),
                 lists(pa.array(first, pa.int32()), batch.column("doc_id")), lists(borders, pa.array(term[group], pa.int32())),
                 lists(borders, pa.array(tf[group], pa.int32())), lists(borders, pa.array(count, pa.int32())),
                 pa.array([slots[post[a]:post[b]].tobytes() for a, b in zip(low, high)], pa.binary())],
                ["m", "size", "docs", "term", "tf", "count", "slots"])

    m = F.lit(25) + F.expr(f"(75 * n * {n_docs}L) div {max(n_terms, 1)}L")
    rows = forward.where("size(term) > 0").select(m.cast("long").alias("m"), "doc_id", "term", "tf")
    rows = rows.repartitionByRange(F.col("m"), F.xxhash64("doc_id")).sortWithinPartitions("m", "doc_id")
    return materialise(rows.mapInArrow(run, INDEX))


class Scorer:
    """A query block with its term weights, shipped to the tasks."""

    def __init__(self, queries: Queries, weights: np.ndarray):
        self.first, self.term = queries.first, queries.term
        self.weight = queries.times * weights[queries.term]
        self.n_terms = len(weights)

    def _rows(self, term: np.ndarray) -> np.ndarray:
        """Place of each query entry's term in the sorted distinct ``term``, or -1."""
        at = np.full(self.n_terms, -1, np.int64)
        at[term] = np.arange(len(term))
        return at[self.term]

    def bounds(self, m: int, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Per item, what no document of a block exceeds; ``term`` and ``tf`` are sorted."""
        last = np.append(np.flatnonzero(np.diff(term)), len(term) - 1)
        most = np.append(impacts(tf[last], m), 0)  # the last place serves terms that the block lacks
        return np.add.reduceat(self.weight * most[self._rows(term[last])], self.first[:-1])

    def scores(self, m: int, size: int, term: np.ndarray, tf: np.ndarray, count: np.ndarray, slots: np.ndarray,
               items: np.ndarray) -> np.ndarray:
        """Scores of all documents of a block for ``items``."""
        distinct, row = np.unique(term, return_inverse=True)
        kinds, kind = np.unique(tf, return_inverse=True)
        impact = impacts(kinds, m)[kind]  # one per tf
        table = np.zeros((len(distinct) + 1, size), np.int64)
        table[np.repeat(row, count), slots] = np.repeat(impact, count)
        rows, out = self._rows(distinct), np.zeros((len(items), size), np.int64)
        for i, item in enumerate(items):
            low, high = self.first[item], self.first[item + 1]
            has = rows[low:high] >= 0
            out[i] = self.weight[low:high][has] @ table[rows[low:high][has]]
        return out


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _bounds(index: DataFrame, shipped) -> DataFrame:
    """item (its number), m, bound and size of every stratum that has a term of the item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shipped.value
        for batch in batches:
            out = []
            terms, tfs = batch.column("term"), batch.column("tf")
            for i, (m, size) in enumerate(zip(batch.column("m").to_pylist(), batch.column("size").to_pylist())):
                bound = scorer.bounds(m, terms[i].values.to_numpy(), tfs[i].values.to_numpy())
                items = np.flatnonzero(bound)
                out.append(np.stack([items, np.full(len(items), m), bound[items], np.full(len(items), size)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], ["item", "m", "bound", "size"])

    found = index.select("m", "size", "term", "tf").mapInArrow(run, "item long, m long, bound long, size long")
    return found.groupBy("item", "m").agg(F.max("bound").alias("bound"), F.sum("size").alias("size"))


class _Best:
    """The best documents per item so far: at least the first ``k``, and the threshold they set."""

    def __init__(self, k: int, threshold: np.ndarray):
        self.k, self.threshold, self.found = k, threshold.copy(), {}

    def add(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        if item in self.found:
            docs, scores = (np.concatenate(x) for x in zip(self.found[item], (docs, scores)))
        order = np.lexsort((docs, -scores))[:self.k]
        self.found[item] = docs[order], scores[order]
        if len(order) == self.k:
            self.threshold[item] = max(self.threshold[item], scores[order[-1]])


def _visit(index: DataFrame, shipped, thresholds, wanted, k: int) -> DataFrame:
    """item, doc_id and score of the best documents that each task finds.

    ``wanted`` (broadcast) maps an m to the items that visit it, or is None for all strata whose bound reaches the threshold.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, (seed, visited, only) = shipped.value, thresholds.value
        best = _Best(k, seed)
        for batch in batches:
            ms, columns = batch.column("m").to_pylist(), {c: batch.column(c) for c in ("docs", "term", "tf", "count", "slots")}
            lists = [{c: columns[c][i].values.to_numpy(zero_copy_only=False) for c in ("term", "tf", "count")} for i in range(len(ms))]
            bounds = [scorer.bounds(m, x["term"], x["tf"]) for m, x in zip(ms, lists)]
            for i in sorted(range(len(ms)), key=lambda i: -bounds[i].max()):
                m, x, bound = ms[i], lists[i], bounds[i]
                open_to = (bound > 0) & (bound >= best.threshold)
                if only:
                    chosen = np.zeros(len(bound), bool)
                    chosen[visited.get(m, [])] = True
                    open_to &= chosen
                elif m in visited:
                    open_to[visited[m]] = False
                items = np.flatnonzero(open_to)
                if not len(items):
                    continue
                docs = columns["docs"][i].values.fill_null(_LAST).to_numpy(zero_copy_only=False)
                slots = np.frombuffer(columns["slots"][i].as_py(), "<u2")
                scores = scorer.scores(m, len(docs), x["term"], x["tf"], x["count"], slots, items)
                for item, own in zip(items, scores):
                    good = (own > 0) & (own >= best.threshold[item])
                    if good.any():
                        best.add(int(item), docs[good], own[good])
        rows = [(item, None if d == _LAST else int(d), int(s)) for item, (docs, scores) in best.found.items() for d, s in zip(docs, scores)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item", "doc_id", "score"])

    if wanted is not None:
        index = index.join(F.broadcast(wanted), "m", "left_semi")  # at most k strata per item
    return index.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(docs: DataFrame, queries: Queries, id_type: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    forward = counted(docs, queries.words)
    total = forward.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(queries.words), np.int64)
    for r in forward.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r["term"]] = r["df"]  # one row per term of the query block
    weights = np.floor(1000 * np.log((2 * total["docs"] + 2) / (2 * df + 1))).astype(np.int64)
    index = build_index(forward, total["docs"], total["terms"])
    shipped = spark.sparkContext.broadcast(Scorer(queries, weights))
    bounds = materialise(_bounds(index, shipped))
    # a stratum has a document, so that k strata hold k; few rows per item come to the driver
    most = top_per_group(bounds, ["item"], [F.col("bound").desc(), F.col("m")], k).collect()
    first: dict[int, list[int]] = {}
    held = Counter()
    for r in sorted(most, key=lambda r: (r["item"], -r["bound"], r["m"])):
        if held[r["item"]] < k:
            held[r["item"]] += r["size"]
            first.setdefault(r["m"], []).append(r["item"])
    n = len(queries.ids)
    wanted = spark.createDataFrame([(m,) for m in first], "m long")
    seeds = spark.sparkContext.broadcast((np.zeros(n, np.int64), first, True))
    seen = materialise(_visit(index, shipped, seeds, wanted, k))
    threshold = np.zeros(n, np.int64)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for r in top_per_group(seen, ["item"], order, k, "place").where(F.col("place") == k).collect():
        threshold[r["item"]] = r["score"]
    later = spark.sparkContext.broadcast((threshold, first, False))
    found = seen.union(_visit(index, shipped, later, None, k))
    names = spark.createDataFrame(list(enumerate(queries.ids)), f"item long, item_id {id_type}")
    return top_per_group(found, ["item"], order, k, "rank").join(F.broadcast(names), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; further columns do not matter.  A null or empty text has no
    terms: as a document it is never found and does not count in N, as an item it has no rows.  Rows that repeat a
    doc_id or an item_id, or have none, are ranked each for itself; equal scores go by doc_id, a missing one last.
    Empty tables give no rows.
    """
    id_type = items.schema["item_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for queries in query_blocks(items):
        out = out.union(_ranked(docs, queries, id_type, k))
    return out


ORACLE = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM d, t),
v AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN v USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s
QUALIFY rank <= 10"""
