"""Texts cut into the words of a byte-level BPE vocabulary, and coded a distinct word at a time.

A chunk of texts is one byte array.  Character classes give the word borders, Arrow's dictionary encoding gives the
distinct words, exactly, and only words that the task has not met yet are coded.  The ids of a chunk are gathered from
the ids of its distinct words, so that no Python code runs per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from reviewlens.llm.texts import utf8

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Fixed value: the short endings that the vocabulary cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: What a task keeps: words by number and by length in bytes, and their ids.
KEPT_WORDS, KEPT_BYTES, KEPT_IDS = 1 << 20, 64, 1 << 24


@cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    # made from bytes: a string per code point would take 80 MB for a moment, in every worker
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, every):
            low, high = ord(every[found.start()]), ord(every[found.end() - 1])
            out[low:high + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the character each byte belongs to, and whether the byte begins a character."""
    classes = _classes()
    out = classes[data]  # right for ASCII
    lead = (data & 0xC0) != 0x80
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        first = data[wide].astype(np.int32)
        length = np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2))
        code = np.where(length == 2, first & 0x1F, np.where(length == 3, first & 0x0F, first & 0x07))
        for i in (1, 2, 3):
            more = length > i
            code[more] = code[more] << 6 | (data[wide[more] + i] & 0x3F)
        kind = classes[code]
        for i in range(4):
            has = length > i
            out[wide[has] + i] = kind[has]
    return out, lead


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which words begin; words tile the texts and never cross ``offsets``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind, lead = byte_classes(data)
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= row[:-1]
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], n)
    run_kind = kind[runs]
    # A run of white space followed by something gives up its last character: a blank to the next word, another one alone.
    space = np.flatnonzero((run_kind == SPACE) & ~row[ends])
    last = ends[space] - 1
    while True:
        inside = ~lead[last]
        if not inside.any():
            break
        last[inside] -= 1
    blank = data[last] == 32
    start = np.zeros(n + 1, bool)
    start[runs] = True
    start[ends[space[blank]]] = False
    start[last] = True
    # An apostrophe that begins a word, before a letter, takes a short ending with it.
    marks = np.flatnonzero((run_kind == OTHER) & (ends - runs == 1) & (data[runs] == 39) & ~row[ends])
    marks = runs[marks]
    marks = marks[start[marks]]
    for ending in ENDINGS:
        size = len(ending)
        at = marks[marks + size < n]
        for i, c in enumerate(ending):
            at = at[(data[at + 1 + i] == ord(c))]
        for i in range(size):
            at = at[~row[at + 1 + i]]
        if len(at):
            start[at + 1] = False
            after = at + 1 + size
            # what is left of the letters is a word of its own
            start[after] = True
    return np.flatnonzero(start[:n])


def end_to_end(coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and their lengths."""
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    return np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum())), sizes


class Coded(NamedTuple):
    """A chunk of texts as words: dictionary index per word, first word per text, and the distinct words' numbers."""

    codes: np.ndarray
    first: np.ndarray
    distinct: np.ndarray


class WordTable:
    """Numbers words and keeps their ids; ``coder`` gives the ids of a list of words (bytes), end to end, and each word's count.

    Beyond ``most`` words (``KEPT_WORDS`` without it) it forgets all and begins again.
    """

    def __init__(self, coder: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int | None = None):
        self.coder, self.most = coder, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.words = np.zeros(1 << 12, np.int64), 0

    def _add(self, words: list[bytes]) -> None:
        ids, sizes = self.coder(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.words + len(words) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.at[self.words + 1:self.words + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.known.update(zip(words, range(self.words, self.words + len(words))))
        self.used, self.words = self.used + len(ids), self.words + len(words)

    def code(self, column: pa.Array) -> Coded:
        """The words of a text column (null is empty); numbers hold until the next call."""
        data, offsets = utf8(column)
        starts = word_starts(data, offsets)
        if not len(starts):
            return Coded(np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64))
        borders = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, borders, pa.py_buffer(np.ascontiguousarray(data))])
        encoded = words.dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        if self.words > (self.most or KEPT_WORDS) or self.used > KEPT_IDS:
            self._clear()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._add(new)
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        for w in new:  # long words are coded again rather than kept
            if len(w) > KEPT_BYTES:
                del self.known[w]
        return Coded(encoded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets), numbers)

    def sizes(self, coded: Coded) -> np.ndarray:
        """Number of ids of each text."""
        size = (self.at[coded.distinct + 1] - self.at[coded.distinct])[coded.codes]
        return np.diff(np.concatenate([[0], np.cumsum(size)])[coded.first])

    def ids(self, coded: Coded) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, and each text's first one (one more than texts)."""
        at = self.at[coded.distinct]
        size = self.at[coded.distinct + 1] - at
        sizes = size[coded.codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(at[coded.codes] - (ends - sizes), sizes) + np.arange(total)
        return self.flat[where], np.concatenate([[0], ends])[coded.first]
