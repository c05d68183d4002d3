"""Packing of documents into sequences by minimum bin slack.

1. Every text is coded and cut into pieces of at most ``capacity`` tokens, in one pass.
2. Whatever the input, pieces have at most ``capacity`` different lengths, so their counts are a table of bounded size.
   On it, bin after bin is planned: the longest piece left opens the bin, and a subset-sum over the lengths left (a bit
   for every reachable fill) finds the fullest combination that still fits, which is taken out.  A combination stays
   the fullest while its lengths last, so it is taken as often as they do in one step, and a plan has as many steps
   as lengths, not as bins.
3. Pieces of a length are numbered over the cluster (a frequent length is spread over buckets), and a piece's number
   says which step, which bin and which place it takes.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm import texts
from reviewlens.llm.pieces import WordTable, end_to_end
from reviewlens.runtime import materialise

CAPACITY = 2048
#: Fixed value: the id that ends a document.
END = 0
PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


class Step(NamedTuple):
    """``bins`` bins, numbered from ``first``, that hold ``uses`` pieces of ``length`` each from offset ``offset``."""

    length: int
    rank: int
    uses: int
    bins: int
    first: int
    offset: int


def fullest(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """Lengths with the largest sum up to ``room``, as few and as long as a scan from the longest finds them."""
    reach, taken, mask, full = 1, [], (1 << room + 1) - 1, 1 << room
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(left[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            taken.append((length, reach))
            reach = more
        if reach & full:
            break
    fill, chosen = reach.bit_length() - 1, []
    for length, before in reversed(taken):
        if not before >> fill & 1:
            chosen.append(length)
            fill -= length
    return sorted(chosen, reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Steps that place ``counts`` pieces of each length; a length's pieces are used up in rank order."""
    left = {length: n for length, n in counts.items() if n > 0}
    lengths, used, steps, bins = sorted(left, reverse=True), dict.fromkeys(left, 0), [], 0
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        chosen = [longest, *fullest(lengths, left, capacity - longest)]
        left[longest] += 1
        need = {length: chosen.count(length) for length in chosen}
        times = min(left[length] // n for length, n in need.items())
        offset = 0
        for length, n in need.items():
            steps.append(Step(length, used[length], n, times, bins, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
        bins += times
        lengths = [length for length in lengths if left[length]]
    return steps


@lru_cache(maxsize=1)
def _coder(spec: str):
    """The library's tokenizer, its added tokens and a table of words, which a Python worker keeps for its next tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tokenizers

    library = tokenizers.Tokenizer.from_str(spec)
    library.no_truncation()
    library.no_padding()
    added = [t.content for t in library.get_added_tokens_decoder().values()]

    def ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return end_to_end([e.ids for e in library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)])

    return library, added, WordTable(ids)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """The pieces of every row: row (a number of the input row), doc_id, piece, start, length, ids_crc32.

    Words are coded by the tokenizers library with the vocabulary file ``path``; ``END`` closes a text.  A text over
    ``capacity`` is cut, and its first piece may be shorter.  With ``ids`` the token ids follow as an array.
    """
    with open(path, encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())  # bounded by the vocabulary
    schema = PIECE + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, added, table = _coder(shipped.value)
        for part in texts.chunks(batches):
            column = part.column("text").fill_null("")
            coded, first = table.ids(table.code(column))
            special = np.zeros(len(column), bool)
            for content in added:
                special |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
            rows, out, kept = part.column("row").to_pylist(), [], []
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                if special[i]:
                    own = np.array(library.encode(column[i].as_py(), add_special_tokens=False).ids, np.int32)
                else:
                    own = coded[first[i]:first[i + 1]]
                own = np.append(own, np.int32(END)).astype("<u4")
                start, n = 0, 0
                while start < len(own):
                    stop = start + ((len(own) - start) % capacity or capacity)
                    out.append((rows[i], doc, n, start, stop - start, zlib.crc32(own[start:stop].tobytes())))
                    if ids:
                        kept.append(own[start:stop].astype(np.int32))
                    start, n = stop, n + 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            names = [x.split()[0] for x in schema.split(", ")]
            if ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def _numbered(pieces: DataFrame, most: int) -> DataFrame:
    """``pieces`` with rank, a number from 0 within the length.

    Buckets of a length have about as many rows as there are buckets, so neither they nor their list is long.
    """
    bucket = F.pmod(F.xxhash64("row", "piece"), F.lit(math.isqrt(most) + 1)).cast("int")
    pieces = pieces.withColumn("bucket", bucket)
    inside = Window.partitionBy("length", "bucket").orderBy("row", "piece")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("inside", F.row_number().over(inside) - 1)
    return ranked.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("inside") + F.col("before")).drop(
        "bucket", "inside", "before")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.  ``row`` and ``piece`` identify a piece, ``length`` is 1 to ``capacity``.

    ``pieces`` should be a written table, as it is read three times.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    steps = sorted(plan(counts, capacity))
    shipped = pieces.sparkSession.sparkContext.broadcast(np.array(steps or [(0,) * 6], np.int64))
    names = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shipped.value
        size = 1 << 40
        keys = step[:, 0] * size + step[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            mine = step[np.searchsorted(keys, length * size + rank, "right") - 1]
            bins, place = np.divmod(rank - mine[:, 1], mine[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(mine[:, 4] + bins), pa.array(mine[:, 5] + place * length)],
                [*names, "sequence_id", "offset"])

    return _numbered(pieces, max(counts.values(), default=0)).select(*names, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Every piece of every row with its sequence and offset: the columns of ``cut`` and of ``place``.

    A null text is empty and gives one piece, the closing id; so do empty texts.  Rows that repeat a doc_id, or have
    none, are packed each for itself.  Equal lengths are told apart by row number only, so which of them
    shares a sequence with whom is arbitrary, and the number of sequences is not.  An empty table gives no rows.  Only
    doc_id and text are read, so further columns do not matter.
    """
    return place(materialise(cut(docs, path, capacity, ids)), capacity)
