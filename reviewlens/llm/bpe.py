"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

The root of the tree holds the leftmost pair of the lowest rank.  A merge changes three
leaves, each in logarithmic time, until the root says that nothing more can be merged, so a
word of n bytes takes O(n log n) even where one "word" is a whole document.

A word's ids do not depend on what stands around it, so each task keeps a bounded table of words already merged, with
their ids written out and decoded; words do not cross documents and documents stay in their tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import texts
from reviewlens.llm.pieces import Coded, WordTable, end_to_end

NONE = 1 << 60
#: Fixed value: how the vocabulary cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS = 1_000_000
KEPT_BYTES = 64
#: Words of up to so many bytes merge side by side.
FOREST = 64
#: What a Python worker holds of the texts at a time, and the words it keeps: every core of an executor has such a worker.
CHUNK_BYTES, TABLE_WORDS = 1 << 19, 1 << 17


class PairTree:
    """Minimum of (rank, position) over the adjacent pairs; leaf i stands for the pair that starts at i."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        self.best = [NONE] * (2 * self.size)
        self.best[self.size:self.size + len(ranks)] = ranks
        for node in range(self.size - 1, 0, -1):
            left, right = self.best[2 * node], self.best[2 * node + 1]
            self.best[node] = left if left <= right else right

    def root(self) -> int:
        return self.best[1]

    def put(self, leaf: int, value: int) -> None:
        best, node = self.best, self.size + leaf
        best[node] = value
        while node > 1:
            node >>= 1
            left, right = best[2 * node], best[2 * node + 1]
            value = left if left <= right else right
            if best[node] == value:
                return
            best[node] = value


class PairForest:
    """Segment trees of many short words, one row each, that merge side by side: every round takes one merge of each word.

    A leaf holds rank * leaves + position, so a root is the leftmost pair of the lowest rank.
    """

    def __init__(self, coder: ByteBpe, words: list[bytes], leaves: int):
        self.coder, self.leaves = coder, leaves
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(len(words), leaves)
        place = np.arange(leaves)
        self.ids = np.where(place < self.size[:, None], coder.single_ids[data], -1)
        self.after = np.minimum(place + 1, self.size[:, None])
        self.before = np.broadcast_to(place - 1, self.ids.shape).copy()
        self.best = np.full((len(words), 2 * leaves), NONE)
        pairs = self.ids[:, :-1], self.ids[:, 1:]
        self.best[:, leaves:-1] = np.where(pairs[1] >= 0, self._leaf(pairs[0], pairs[1], place[:-1]), NONE)
        level = leaves
        while level > 1:
            self.best[:, level // 2:level] = np.minimum(self.best[:, level:2 * level:2], self.best[:, level + 1:2 * level:2])
            level //= 2

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.coder.ranks(left, right)
        return np.where(rank < NONE, rank * self.leaves + place, NONE)

    def _put(self, rows: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        node = place + self.leaves
        self.best[rows, node] = value
        while node[0] > 1:  # all leaves are at one depth
            node = node >> 1
            self.best[rows, node] = np.minimum(self.best[rows, 2 * node], self.best[rows, 2 * node + 1])

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word after word, and their number per word."""
        rows = np.flatnonzero(self.best[:, 1] < NONE)
        while len(rows):
            rank, at = np.divmod(self.best[rows, 1], self.leaves)
            gone = self.after[rows, at]
            right = self.after[rows, gone]
            self.ids[rows, at] = self.coder.merged[rank]
            self.ids[rows, gone] = -1
            self.after[rows, at] = right
            self._put(rows, gone, np.full(len(rows), NONE))
            has = right < self.size[rows]
            self.before[rows[has], right[has]] = at[has]
            value = np.full(len(rows), NONE)
            value[has] = self._leaf(self.ids[rows[has], at[has]], self.ids[rows[has], right[has]], at[has])
            self._put(rows, at, value)
            left = self.before[rows, at]
            has = left >= 0
            if has.any():
                own, left = rows[has], left[has]
                self._put(own, left, self._leaf(self.ids[own, left], self.ids[own, at[has]], left))
            rows = rows[self.best[rows, 1] < NONE]
        kept = self.ids >= 0
        return self.ids[kept], kept.sum(axis=1)


class _Known(dict):
    """Ids of words merged so far; a word it lacks is merged, and kept if it is short and there is room."""

    def __init__(self, coder: ByteBpe):
        self.coder = coder

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.coder.merge(word.encode())
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of one vocabulary file (JSON with ``model.vocab`` and ``model.merges``)."""

    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = model["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.single = [vocab[c] for c in byte_alphabet()]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        self.pieces = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.pieces |= {i: token.encode() for token, i in added.items()}
        self.added = added
        self.added_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") \
            if added else None
        # the same tables as arrays: pairs sorted by key, and what each rank merges to
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], np.array([rank for rank, _ in self.merges.values()], np.int64)[order]
        self.merged = np.zeros(int(self.rank_of.max(initial=-1)) + 1, np.int64)
        self.merged[[rank for rank, _ in self.merges.values()]] = [new for _, new in self.merges.values()]
        self.single_ids = np.array(self.single, np.int64)
        self.words = regex.compile(PATTERN).findall
        self.known = _Known(self)

    def merge(self, word: bytes) -> tuple[int, ...]:
        ids = [self.single[b] for b in word]
        n, merges = len(ids), self.merges
        if n < 2:
            return tuple(ids)
        # A leaf holds rank * n + position, so the least is the leftmost of the lowest rank.
        found = [merges.get(pair) for pair in zip(ids, ids[1:])]
        tree = PairTree([NONE if f is None else f[0] * n + i for i, f in enumerate(found)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree.root()) < NONE:
            at = least % n
            gone = after[at]
            ids[at] = merges[ids[at], ids[gone]][1]
            ids[gone] = -1
            after[at] = right = after[gone]
            if gone < n - 1:
                tree.put(gone, NONE)
            if right < n:
                before[right] = at
                f = merges.get((ids[at], ids[right]))
                tree.put(at, NONE if f is None else f[0] * n + at)
            else:
                tree.put(at, NONE)
            if (left := before[at]) >= 0:
                f = merges.get((ids[left], ids[at]))
                tree.put(left, NONE if f is None else f[0] * n + left)
        return tuple(i for i in ids if i >= 0)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, end to end, and their number per word.  Short words merge side by side, by length."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        least, leaves = 0, 4
        while leaves <= FOREST:
            for at in np.array_split(found := np.flatnonzero((size > least) & (size <= leaves)), len(found) * leaves // (1 << 18) + 1):
                if len(at):
                    parts.append((at, *PairForest(self, [words[i] for i in at], leaves).merge()))
            least, leaves = leaves, 2 * leaves
        if len(at := np.flatnonzero(size > least)):
            parts.append((at, *end_to_end([self.merge(words[i]) for i in at])))
        counts = np.zeros(len(words), np.int64)
        for at, _, own in parts:
            counts[at] = own
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for at, ids, own in parts:
            out[np.repeat(first[at] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return out, counts

    def _ids(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.known.__getitem__, self.words(text)))

    def encode(self, text: str) -> list[int]:
        if self.added_cut is None or not self.added_cut.search(text):
            return list(self._ids(text))
        ids: list[int] = []
        for part in self.added_cut.split(text):
            ids.extend([self.added[part]] if part in self.added else self._ids(part))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def read(path: str) -> str:
    """A vocabulary file; its size is bounded by the vocabulary."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def load(path: str) -> dict:
    """The parts of a vocabulary file that coding needs."""
    return _parts(read(path))


def _parts(text: str) -> dict:
    spec = json.loads(text)
    return {"model": {k: spec["model"][k] for k in ("vocab", "merges")}, "added_tokens": spec.get("added_tokens")}


class Spelled(WordTable):
    """Words with their ids.  What an id is written as and decodes to stands in two tables as long as the vocabulary, so
    that a word costs no more than its ids and both spellings of a chunk are gathered natively."""

    def __init__(self, coder: ByteBpe):
        self.bpe = coder
        every = range(max(coder.pieces, default=-1) + 1)
        self.written = pa.array([b"%d," % i for i in every], pa.large_binary())
        self.decoded = pa.array([coder.pieces.get(i, b"") for i in every], pa.large_binary())
        super().__init__(coder.merge_all, TABLE_WORDS)


def spell(ids: np.ndarray, first: np.ndarray, spelling: pa.Array) -> list[memoryview]:
    """Each text with its ids written or decoded, end to end."""
    own = spelling.take(pa.array(ids))
    _, borders, data = own.buffers()
    at = np.frombuffer(borders, np.int64)[first].tolist() if len(ids) else [0] * len(first)
    data = memoryview(data if data is not None else b"")
    return [data[low:high] for low, high in zip(at, at[1:])]


@lru_cache(maxsize=1)
def _table(text: str) -> Spelled:
    """A Python worker keeps its words for its next tasks."""
    return Spelled(ByteBpe(_parts(text)))


def _over(docs: DataFrame, path: str, columns, schema: str) -> DataFrame:
    """``columns`` of a chunk: a function of the coder, the word table, the chunk's words, and the ids of the texts that
    hold added tokens, by row."""
    shipped = docs.sparkSession.sparkContext.broadcast(read(path))
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shipped.value)
        coder = table.bpe
        for part in texts.chunks(batches, size=CHUNK_BYTES):
            column = part.column("text")
            special = {}
            for content in coder.added:
                for i in np.flatnonzero(pc.fill_null(pc.match_substring(column, content), False)):
                    special[int(i)] = coder.encode(column[int(i)].as_py())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns(coder, table, table.code(column), special)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of each text.  A null text is empty and has no ids; rows may repeat."""
    def columns(coder: ByteBpe, table: Spelled, coded: Coded, special: dict[int, list[int]]):
        ids, first = table.ids(coded)
        own = [special.get(i, ids[first[i]:first[i + 1]]) for i in range(len(first) - 1)]
        return [pa.array(own, pa.list_(pa.int32()))]

    return _over(docs, path, columns, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, digest of the ids joined by commas, digest of the decoded text.

    One row per input row: a null text counts as empty, repeated rows give repeated results, an
    empty table gives no rows.  Only doc_id and text are read, so further columns do not matter.
    Strings of added tokens become their ids, as the tokenizers library has it.
    """
    def columns(coder: ByteBpe, table: Spelled, coded: Coded, special: dict[int, list[int]]):
        flat, first = table.ids(coded)
        sizes = np.diff(first)
        ids = [hashlib.sha256(x[:-1]).hexdigest() for x in spell(flat, first, table.written)]
        decoded = [hashlib.sha256(str(x, "utf-8", "replace").encode()).hexdigest() for x in spell(flat, first, table.decoded)]
        for i, own in special.items():
            sizes[i] = len(own)
            ids[i] = hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
            decoded[i] = hashlib.sha256(coder.decode(own).encode()).hexdigest()
        return [pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return _over(docs, path, columns, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
