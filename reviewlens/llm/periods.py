"""Stretches of words that repeat with a period, found in tiles of every scale.

A run is a maximal stretch of at least ``LEAST`` words and three periods.  Periods are taken by octave: 1 to 16, then
(p, 2p] for p = 16, 32, 64 and so on.  Within an octave

1. a document's boundaries stand p words apart, and tiles that overlap hold the words around some of them.  A run of the
   octave has a boundary whose next p words come again one period later, so only tiles in which a window hash says so
   leave the task; hashes only choose, they never decide;
2. tiles are dealt out over the cluster and solved each for itself: from a boundary, one Z-function says how
   far the words after it agree with those after a later word, and another one, of the reversed tile, how far back the
   words before the two agree, for all periods of the octave at once;
3. the fragments are shuffled by document and period and stitched where they touch; what a run with a shorter period
   covers as a whole is no run of its own.

A document's words, runs and the words they leave come together again by row number.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm import texts
from reviewlens.runtime import materialise

LEAST, TIMES, FIRST = 24, 3, 8
#: Words that a tile's boundaries span at least.
SPAN = 1024
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: How a document's words change before they are searched: from its id and its word count to the word each place takes.
Edit = Callable[[int | None, int], np.ndarray | None]

TILES = "array<struct<p:int,start:int,words:binary,live:array<int>>>"
_TILE = pa.struct([("p", pa.int32()), ("start", pa.int32()), ("words", pa.binary()), ("live", pa.list_(pa.int32()))])


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The edit of the registered query: one document in ten ends in a repetition."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _words(part: pa.RecordBatch, edit: Edit | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of a chunk after the edit, each text's first one (one more than texts), and the distinct words."""
    data, offsets = texts.utf8(part.column("text"))
    starts, ends, first = texts.word_spans(data, offsets, ~BLANK)
    first = np.asarray(first, np.int64)
    if not len(starts):
        return np.zeros(0, np.int32), first, pa.array([], pa.large_binary())
    borders = pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64))
    dense = pa.py_buffer(np.ascontiguousarray(data[~BLANK[data]]))
    encoded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, borders, dense]).dictionary_encode()
    codes = encoded.indices.to_numpy().copy()
    if edit is not None:
        for i, doc in enumerate(part.column("doc_id").to_pylist()):
            low, high = first[i], first[i + 1]
            place = edit(doc, int(high - low))
            if place is not None:
                codes[low:high] = codes[low:high][place]
    return codes, first, encoded.dictionary


def _joined(codes: np.ndarray, first: np.ndarray, distinct: pa.Array) -> pa.Array:
    """The words of each text with one blank between them."""
    words = distinct.take(pa.array(codes))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first), words), pa.scalar(b" ", pa.large_binary()))


def _digests(joined: pa.Array) -> list[str]:
    return [hashlib.sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in joined]


def _where(column: pa.Array, wanted: list) -> pa.Array:
    """``column``, null where ``wanted`` is empty."""
    return column.take(pa.array([i if w else None for i, w in enumerate(wanted)], pa.int64()))


def octaves(n: int) -> Iterator[int]:
    """Boundary spacing of each octave that a stretch of ``n`` words has room for."""
    p = FIRST
    while n >= LEAST and (p == FIRST or TIMES * (p + 1) <= n):
        yield p
        p *= 2


def _shortest(p: int) -> int:
    """Shortest period of an octave; the longest is 2 p."""
    return 1 if p == FIRST else p + 1


def _live(codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Text, spacing, first boundary and boundaries (word numbers within the text) of each tile that may hold a run."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")  # long texts first, so that a high octave reads a prefix
    sizes = sizes[order]
    if not len(sizes) or sizes[0] < LEAST:
        return
    sizes = sizes[sizes >= LEAST]
    order = order[:len(sizes)]
    at = np.concatenate([[0], np.cumsum(sizes + 1)])  # a mark that nothing equals stands after each text
    value = np.empty(at[-1], np.uint64)
    value[at[1:] - 1] = texts.mix(np.arange(len(sizes), dtype=np.uint64) + np.uint64(1 << 40))
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    value[inside] = texts.mix(np.concatenate([codes[first[i]:first[i + 1]] for i in order]).astype(np.uint64) + np.uint64(1))
    prefix = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * texts.powers(texts._BASE, len(value)), out=prefix[1:])
    back = texts.powers(texts._INVERSE, len(value))
    for p in octaves(int(sizes[0])):
        end = at[int(np.searchsorted(-sizes, -max(LEAST, TIMES * _shortest(p)), "right"))]
        window = (prefix[p:end + 1] - prefix[:end + 1 - p]) * back[:end + 1 - p]
        again = np.zeros(-(-len(window) // p), bool)
        for least in range(_shortest(p), 2 * p, p):
            n = len(window) - least
            if n <= 0:
                continue
            rows = -(-n // p)
            later = np.zeros(rows * p, np.uint64)
            later[:n] = window[least:]
            same = later.reshape(rows, p) == window[:rows * p:p, None]
            same.reshape(-1)[n:] = False
            again[:rows] |= same.any(axis=1)
        boundaries = np.flatnonzero(again) * p
        if not len(boundaries):
            continue
        text = np.searchsorted(at, boundaries, "right") - 1
        own = boundaries - at[text]
        # boundaries of one text and one span of it make a tile
        tile = own // max(SPAN, p * 8)
        cuts = np.flatnonzero(np.diff(text) | np.diff(tile)) + 1
        for group in np.split(np.arange(len(own)), cuts):
            yield int(order[text[group[0]]]), p, int(own[group[0]]), own[group]


def _tile(codes: np.ndarray, p: int, boundaries: np.ndarray) -> dict:
    start = max(0, int(boundaries[0]) - p)
    stop = min(len(codes), int(boundaries[-1]) + 4 * p)
    return {"p": p, "start": start, "words": codes[start:stop].astype("<i4").tobytes(), "live": (boundaries - start).astype(np.int32)}


def z_function(s: list[int], upto: int) -> list[int]:
    """How far ``s`` agrees with itself from each of the places 0 … ``upto`` on."""
    n = len(s)
    z = [0] * min(upto + 1, n)
    if z:
        z[0] = n
    low = high = 0
    for i in range(1, len(z)):
        k = 0
        if i < high:
            k = z[i - low]
            if k < high - i:
                z[i] = k
                continue
            k = high - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def solve(words: list[int], p: int, boundaries: list[int]) -> list[tuple[int, int, int]]:
    """(period, low, high) of the places x within a tile at which word x equals word x + period, around its boundaries.

    Only stretches that reach p words past their boundary are given, joined where they touch.
    """
    periods, found, out = range(_shortest(p), 2 * p + 1), {}, []
    for b in boundaries:
        ahead = words[b:b + 4 * p]
        forward = z_function(ahead, 2 * p)
        hits = [q for q in periods if q < len(forward) and forward[q] >= p]
        if not hits:
            continue
        # reversed: what stands before the boundary, a mark, then everything up to two periods after it
        before = words[max(0, b - p):b][::-1]
        around = words[max(0, b - p):b + 2 * p][::-1]
        mirrored = z_function([*before, -1, *around], len(before) + 2 * p)
        total = len(before) + 1 + len(around)
        for q in hits:
            # the words before b + q begin at this place of the mirrored tile
            place = total - len(before) - q
            back = min(mirrored[place], len(before)) if before else 0
            low, high = b - back, b + min(forward[q], 2 * p)
            last = found.get(q)
            if last is not None and low <= last[1]:
                last[1] = max(last[1], high)
            else:
                found[q] = last = [low, high]
                out.append((q, last))
    return [(q, low, high) for q, (low, high) in out]


def _prepared(docs: DataFrame, edit: Edit | None) -> DataFrame:
    """row, doc_id, the digest of all words, and where a run is possible the text and its tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts.chunks(batches):
            codes, first, distinct = _words(part, edit)
            tiles: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for text, p, _, boundaries in _live(codes, first):
                tiles[text].append(_tile(codes[first[text]:first[text + 1]], p, boundaries))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(_digests(_joined(codes, first, distinct))),
                 _where(part.column("text"), tiles), pa.array(tiles, pa.list_(_TILE))],
                ["row", "doc_id", "plain", "text", "tiles"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, f"row long, doc_id long, plain string, text string, tiles {TILES}"))


def _fragments(prepared: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, tile in zip(batch.column("row").to_pylist(), batch.column("tile").to_pylist()):
                words = np.frombuffer(tile["words"], "<i4").tolist()
                out += [(row, q, tile["start"] + low, tile["start"] + high) for q, low, high in solve(words, tile["p"], tile["live"])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "period", "low", "high"])

    tiles = prepared.where(F.size("tiles") > 0).select("row", F.explode("tiles").alias("tile"))
    return tiles.repartition("row", "tile.p", "tile.start").mapInArrow(run, "row long, period long, low long, high long")


def _stitched(fragments: DataFrame) -> DataFrame:
    """row and its runs (start, length, period), by start, then period.

    A document has fewer runs than words, and a third of a document's periods at most have fragments.
    """
    order = Window.partitionBy("row", "period").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = fragments.withColumn("opens", (F.coalesce(reach, F.lit(-1)) < F.col("low")).cast("int"))
    opened = opened.withColumn("part", F.sum("opens").over(order))
    whole = opened.groupBy("row", "period", "part").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    runs = whole.withColumn("length", F.col("high") - F.col("start") + F.col("period")).where(
        F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    runs = runs.groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    return runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


RUNS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,period:long,"
        "length:long>>, collapsed string, runs_sha256 string, collapsed_sha256 string")


def find_runs(docs: DataFrame, edit: Edit | None = None, texts_too: bool = True) -> DataFrame:
    """Per row: doc_id, n_runs, the strongest run (start, length, period, exponent_milli), all runs, the collapsed text
    (null where nothing repeats or without ``texts_too``) and the digests of both.

    The strongest run has the greatest length / period, then the smallest start, then period.  A collapsed text
    keeps of each run its first period.  A null or empty text has no words and no run.  Rows that repeat a doc_id, or have
    none, are searched each for itself.  An empty table gives no rows; only doc_id and text are read.
    ``edit`` may put other words of the document in place of its own before the search.
    """
    prepared = _prepared(docs, edit)
    runs = _stitched(_fragments(prepared))
    joined = prepared.join(runs, "row", "left").select(
        "doc_id", "plain", "runs", F.when(F.col("runs").isNotNull(), F.col("text")).alias("text"))
    schema = RUNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts.chunks(batches):
            codes, first, distinct = _words(part, edit)
            found = [[(r["start"], r["length"], r["period"]) for r in x or ()] for x in part.column("runs").to_pylist()]
            plain, rows = part.column("plain").to_pylist(), []
            kept = np.ones(len(codes), bool)
            for i, own in enumerate(found):
                for start, length, period in own:
                    kept[first[i] + start + period:first[i] + start + length] = False
            sums = np.concatenate([[0], np.cumsum(kept)])
            joined = _joined(codes[kept], sums[first], distinct)
            digests = _digests(joined)
            for i, own in enumerate(found):
                best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                rows.append((len(own), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                             hashlib.sha256(listed.encode()).hexdigest(), digests[i] if own else plain[i]))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2)]
            text = _where(joined.cast(pa.string()), found if texts_too else [None] * len(found))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *columns[:5], part.column("runs"), text, *columns[5:]],
                [x.split()[0] for x in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed",
                                        "runs_sha256", "collapsed_sha256")])

    return joined.mapInArrow(run, schema)
