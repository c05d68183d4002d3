"""Exact removal of repeated passages with suffix arrays of grouped Lyndon prefixes.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts elsewhere, in the same text or another.

1. Anchors.  Every window of LENGTH bytes chooses the least-hash GRAM-byte gram in it (leftmost of equal ones).  The
   choice depends on the window's bytes alone, so equal windows choose equal grams at equal places, and neighbouring
   windows share their choice: one anchor stands for a run of windows, its context.
2. Contexts that occur twice or more as a whole (compared by their digests, aggregated before the shuffle) repeat in full.
3. Only contexts that share their anchor with a different context remain.  Equal windows hold their anchor at the same
   place, so no window reaches further to a side of the anchor than its context agrees with another one: contexts are cut
   down to that.  What is left is compared byte by byte through the suffix array of its concatenation: windows repeat where
   neighbours in suffix order agree in LENGTH bytes.
4. An anchor with more than ``BLOCK`` different contexts is dealt out in blocks with a suffix array each; windows not
   repeated within their block meet those of other blocks by digest.  So no group grows with the corpus.

The suffix array is built by linear grouping: suffixes are put in groups by their Lyndon prefix, the groups
processed in descending order along previous-smaller pointers, and the order within groups is emitted along the
same pointers, without renaming or recursion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import texts
from reviewlens.runtime import materialise

LENGTH = 400
GRAM = 64
BLOCK = 64
#: Rows of a result that leave a task together.
SENT = 4096


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of the suffixes of ``symbols`` in order.  The last symbol must be the unique least one."""
    n = len(symbols)
    order = np.argsort(np.array(symbols), kind="stable")
    sa = order.tolist()
    sorted_symbols = np.array(symbols)[order]
    new = np.ones(n, bool)
    new[1:] = sorted_symbols[1:] != sorted_symbols[:-1]
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    start = np.empty(n, np.int64)
    start[order] = heads
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # start: first slot of the group of each suffix; place: its slot; end: slot after a group, by its first slot
    start, place = start.tolist(), place.tolist()
    end = [0] * n
    bounds = np.flatnonzero(new).tolist() + [n]
    for low, high in zip(bounds, bounds[1:]):
        end[low] = high
    before = [-1] * n  # the nearest earlier suffix of a lower group
    high = n
    # The last symbol's group is below all others and index -1 means it, which ends every walk along the pointers.
    while high > 1:
        low = start[sa[high - 1]]
        if high - low == 1:
            # a group of one: its predecessor moves to the end of its own group, alone
            i = sa[low]
            j = i - 1
            while start[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                head = start[j]
                last = end[head] - 1
                if last > head:
                    at = place[j]
                    if at != last:
                        other = sa[last]
                        sa[at], place[other] = other, at
                        sa[last], place[j] = j, last
                    end[head] = start[j] = last
                    end[last] = last + 1
            high = low
            continue
        counts: dict[int, int] = {}
        for i in sorted(sa[low:high]):
            j = i - 1
            while start[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        most = max(counts.values(), default=0)
        by_count: list[list[int]] = [[] for _ in range(most + 1)]
        for j, c in counts.items():
            by_count[c].append(j)
        for c in range(most, 0, -1):
            # those with more repeats of this group's prefix come after those with fewer
            moved: dict[int, int] = {}
            for j in by_count[c]:
                head = start[j]
                last = moved.get(head, end[head]) - 1
                at = place[j]
                if at != last:
                    other = sa[last]
                    sa[at], place[other] = other, at
                    sa[last], place[j] = j, last
                moved[head] = last
            for head, first in moved.items():
                if first == head:
                    continue  # the whole group moved: nothing to split
                stop = end[head]
                for at in range(first, stop):
                    start[sa[at]] = first
                end[head], end[first] = first, stop
        high = low
    # Emit: what stands before a suffix, along the pointers, is next in its group.
    free = list(range(n))
    out = [-1] * n
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for at in range(n):
        j = out[at] - 1
        while not done[j]:
            group = start[j]
            out[free[group]] = j
            free[group] += 1
            done[j] = True
            j = before[j]
    return out


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each context, whether the window that starts at each place occurs twice or more in all contexts; and a
    class number per window, in the order of contexts and starts, equal for equal windows."""
    sizes = np.array([len(c) for c in contexts])
    joined = b"\x00".join(contexts)
    symbols = (np.frombuffer(joined, np.uint8).astype(np.int64) + 2)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols[(begins[1:] - 1)] = 1
    order = np.array(suffix_array([*symbols.tolist(), 0]))
    valid = np.zeros(len(order), bool)
    for b, size in zip(begins, sizes):
        valid[b:b + max(0, size - length + 1)] = True
    order = order[valid[order]]
    hashed = np.zeros(len(order), np.uint64)
    data = np.frombuffer(joined, np.uint8)
    if len(order):
        hashed = texts.span_hashes(texts.rolling(data), order, order + length)
    same = np.flatnonzero(hashed[1:] == hashed[:-1])
    agree = np.zeros(len(order) + 1, bool)
    for i in same.tolist():
        p, q = int(order[i]), int(order[i + 1])
        agree[i + 1] = joined[p:p + length] == joined[q:q + length]
    twice = agree[:-1] | agree[1:]
    number = np.cumsum(~agree[:-1])
    flag, classes = np.zeros(len(valid), bool), np.zeros(len(valid), np.int64)
    flag[order], classes[order] = twice, number
    cut = [slice(b, b + max(0, size - length + 1)) for b, size in zip(begins, sizes)]
    return [flag[c] for c in cut], np.concatenate([classes[c] for c in cut])


def _agreements(parts: list[bytes]) -> list[int]:
    """Of each part, in how many first bytes it agrees with the other part that it agrees with longest."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    best = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = min(len(parts[i]), len(parts[j]))
        differ = int.from_bytes(parts[i][:n], "big") ^ int.from_bytes(parts[j][:n], "big")
        same = n - (differ.bit_length() + 7) // 8
        best[i], best[j] = max(best[i], same), max(best[j], same)
    return best


def open_windows(contexts: list[bytes], grams: list[int], length: int = LENGTH) -> dict[int, tuple[int, int]]:
    """First and last start of the windows that may repeat, by number of context; ``grams`` is where each holds the anchor.

    Windows outside repeat no window of another context; those of one context all differ, their anchors being one place.
    """
    left = list(range(len(contexts)))
    found: dict[int, tuple[int, int]] = {}
    while len(left) > 1:
        before = _agreements([contexts[i][:grams[i]][::-1] for i in left])
        after = _agreements([contexts[i][grams[i]:] for i in left])
        found = {}
        for i, b, a in zip(left, before, after):
            low, high = max(0, grams[i] - b), min(len(contexts[i]), grams[i] + a) - length
            if low <= high:
                found[i] = low, high
        if len(found) == len(left):
            break
        # those without such a window are no partners either
        left, found = list(found), {}
    return found


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first window, last window, gram hash, place of the gram) of each anchor; windows are given by their first byte."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    prefix = texts.rolling(data)
    at = np.arange(n - gram + 1)
    hashed = texts.span_hashes(prefix, at, at + gram)
    least = (hashed >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    span, wide = 1, length - gram + 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[:len(least) - (wide - span)], least[wide - span:])
    chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(chosen)]
    windows = np.flatnonzero(np.arange(len(chosen)) + length <= offsets[1:][row])
    if not len(windows):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    chosen, row = chosen[windows], row[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    return row[first], windows[first], windows[last], hashed[chosen[first]], chosen[first]


def _context(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in texts.chunks(batches):
        data, offsets = texts.utf8(part.column("text"))
        row, low, high, gram, at = anchors(data, offsets)
        raw = memoryview(data)
        contexts = [_context(raw[a:b]) for a, b in zip(low.tolist(), (high + LENGTH).tolist())]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(row)), part.column("text_hash").take(pa.array(row)),
             pa.array(gram.view(np.int64)), pa.array(contexts, pa.int64()),
             pa.array((low - offsets[row]).astype(np.int64)), pa.array((high - low + 1).astype(np.int32)),
             pa.array((at - low).astype(np.int32))],
            ["doc_id", "text_hash", "anchor", "context", "low", "windows", "gram"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted contexts of each text."""
    names = ["anchor", "context", "blocks", "gram", "bytes"]
    for part in texts.chunks(batches):
        out = {name: [] for name in names}
        for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
            raw = text.encode()
            for w in wanted:
                out["anchor"].append(w["anchor"])
                out["context"].append(w["context"])
                out["blocks"].append(w["blocks"])
                out["gram"].append(w["gram"])
                out["bytes"].append(raw[w["low"]:w["low"] + w["windows"] + LENGTH - 1])
        yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["context"], pa.int64()),
                                          pa.array(out["blocks"], pa.int32()), pa.array(out["gram"], pa.int32()),
                                          pa.array(out["bytes"], pa.binary())], names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and block.  Per context: runs of repeated windows (from, to), and for an anchor of several
    blocks the digests of windows that must still meet other blocks (windows that repeat here are sent once)."""
    group: list[tuple[int, int, bytes]] = []
    current, blocks = None, 1
    out: list[list] = [[] for _ in range(6)]

    def compare() -> None:
        anchor = current[0]
        spans = open_windows([raw for *_, raw in group], [gram for _, gram, _ in group])
        flags, classes = repeated_starts([group[i][2][low:high + LENGTH] for i, (low, high) in spans.items()]) if spans else ([], [])
        told = dict(zip(spans, flags))
        seen: set[int] = set()
        at = 0
        for number, (context, _, raw) in enumerate(group):
            flag, first = told.get(number, np.zeros(0, bool)), spans.get(number, (0, 0))[0]
            edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])) if len(flag) else flag
            runs = zip((first + np.flatnonzero(edge == 1)).tolist(), (first + np.flatnonzero(edge == -1) - 1).tolist())
            for a, b in runs:
                for column, value in zip(out, (anchor, context, a, b, None, True)):
                    column.append(value)
            if blocks > 1:
                for i in range(len(raw) - LENGTH + 1):
                    here = i - first
                    repeated = 0 <= here < len(flag) and bool(flag[here])
                    if repeated:
                        if classes[at + here] in seen:
                            continue
                        seen.add(classes[at + here])
                    digest = hashlib.blake2b(raw[i:i + LENGTH], digest_size=16).digest()
                    for column, value in zip(out, (anchor, context, i, i, digest, repeated)):
                        column.append(value)
            at += len(flag)

    def made() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                           ["anchor", "context", "first", "last", "digest", "repeated"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for anchor, block, n, context, gram, raw in zip(*(batch.column(c).to_pylist() for c in (
                "anchor", "block", "blocks", "context", "gram", "bytes"))):
            if (anchor, block) != current:
                if len(group) > 1 or blocks > 1:
                    compare()
                if len(out[0]) >= SENT:
                    yield made()
                group, current, blocks = [], (anchor, block), n
            group.append((context, gram, raw))
    if group:
        compare()
    yield made()


def repeats(texts_with_hash: DataFrame) -> DataFrame:
    """doc_id, text_hash and spans (array of (low, high) in bytes, unmerged) of the texts that repeat something."""
    found = materialise(texts_with_hash.mapInArrow(
        _find, "doc_id long, text_hash long, anchor long, context long, low long, windows int, gram int"))
    whole = found.groupBy("anchor", "context").agg(F.count("*").alias("n"))
    shared = whole.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 or least > 1")
    known = materialise(whole.join(shared, "anchor").select(
        "anchor", "context", "n", F.when((F.col("contexts") > 1) & (F.col("least") == 1),
                                         F.ceil(F.col("contexts") / BLOCK)).otherwise(0).cast("int").alias("blocks")))
    open_contexts = known.where("blocks > 0").select("anchor", "context", "blocks")
    places = found.join(open_contexts, ["anchor", "context"]).groupBy("anchor", "context").agg(
        F.min(F.struct("doc_id", "text_hash", "low", "windows", "blocks", "gram")).alias("p"))
    wanted = places.groupBy("p.doc_id", "p.text_hash").agg(F.collect_list(F.struct(
        "anchor", "context", "p.low", "p.windows", "p.blocks", "p.gram")).alias("wanted"))
    pieces = _join(texts_with_hash, wanted, "inner").select("text", "wanted").mapInArrow(
        _cut_out, "anchor long, context long, blocks int, gram int, bytes binary")
    parts = max(1, int(texts_with_hash.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    compared = materialise(
        pieces.withColumn("block", F.pmod(F.xxhash64("context"), "blocks").cast("int"))
        .repartition(parts, "anchor", "block").sortWithinPartitions("anchor", "block", "context")
        .mapInArrow(_compare, "anchor long, context long, first int, last int, digest binary, repeated boolean"))
    windows = compared.where("digest is not null")
    twice = windows.groupBy("anchor", "digest").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "digest")
    across = windows.where("not repeated").join(twice, ["anchor", "digest"])
    runs = compared.where("digest is null").select("anchor", "context", "first", "last").union(
        across.select("anchor", "context", "first", "last"))
    # a context that occurs more than once repeats in full; a single one where its windows do
    single = known.where("n = 1 and blocks > 0").join(runs, ["anchor", "context"]).select("anchor", "context", "first", "last")
    full = known.where("n > 1").select("anchor", "context", F.lit(0).alias("first"), F.lit(-1).alias("last"))
    spans = found.join(full.union(single), ["anchor", "context"]).select(
        "doc_id", "text_hash", F.struct((F.col("low") + F.col("first")).alias("low"),
                                        (F.col("low") + F.when(F.col("last") < 0, F.col("windows") - 1).otherwise(F.col("last")) + LENGTH).alias("high")).alias("span"))
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"))


def _join(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    other = other.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    return rows.join(other, rows["doc_id"].eqNullSafe(other["__id"]) & (rows["text_hash"] == other["__hash"]), how).drop("__id", "__hash")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in texts.chunks(batches):
        sizes, merged_spans, kept = [], [], []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
            raw = text.encode()
            merged: list[list[int]] = []
            for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            stays, at = [], 0
            for low, high in merged:
                stays.append(raw[at:low])
                at = high
            stays.append(raw[at:])
            sizes.append(len(raw))
            merged_spans.append([{"low": a, "high": b} for a, b in merged])
            kept.append(b"".join(stays))
        span = pa.struct([("low", pa.int64()), ("high", pa.int64())])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(merged_spans, pa.list_(span)),
                                          pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes, low to high) and kept (bytes that stay) of every row.

    A null text is empty; texts shorter than LENGTH bytes lose nothing.  Repeated rows repeat each other and lose
    what is long enough.  An empty table gives no rows; only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return _join(rows, repeats(rows), "left").select("doc_id", "text", "spans").mapInArrow(
        _apply, "doc_id long, n_bytes long, spans array<struct<low: long, high: long>>, kept binary")
