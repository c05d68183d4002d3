"""Ranked search, period runs and packing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor, log

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlens.llm import bpe, lines, mixing, packing, periods, pieces, pivots, search, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n long, m long, rank int, row long, period long, term string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    out = tokenizers.Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "clash") for r in rows], DOCS)


def awkward(rng):
    word = lambda: f"w{rng.randrange(300)}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # a third are copies
    long = " ".join(word() for _ in range(9000))
    return rows + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "€ … ÄÖ ñandú W1 w1"), (2004, long), (7, "same id w1 w2"),
                   (None, "w1 w2 w3 no id"), (None, None), (2005, "w5 " * 5000), (2006, "<|endoftext|> x<|endoftext|>"),
                   (2007, " a\x0bb\x1cc d")]


# --- ranked search ------------------------------------------------------------------------

def plain_search(docs, items, k=10):
    counts = [(d, Counter(search.terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    weight = {w: floor(1000 * log((2 * n_docs + 2) / (2 * df[w] + 1))) for w in df}
    out = Counter()
    for item, text in items:
        asked, found = Counter(search.terms_of(text)), []
        for doc, c in counts:
            m = 25 + 75 * c.total() * n_docs // total
            score = sum(n * weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, n in asked.items() if c[w])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        for rank, (score, missing, doc) in enumerate(sorted(found)[:k], 1):
            out[item, rank, None if missing else doc, -score] += 1
    return out


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block, per_block", [(512, 4096), (4, 3)])
def test_search_matches_a_plain_scan(spark, monkeypatch, block, per_block):
    monkeypatch.setattr(search, "DOCS", block)
    monkeypatch.setattr(search, "ITEMS", per_block)
    rng = random.Random(4)
    docs = awkward(rng)
    items = [(i, " ".join(f"w{rng.randrange(320)}" for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    items += [(50, docs[0][1]), (51, None), (52, "..."), (53, "unknownword"), (54, "W1 w1 ñandú"), (None, "w7 w8"), (1, "w9")]
    got = search.search(frame(spark, docs).repartition(5), items_frame(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items)


def test_search_in_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert search.search(frame(spark, []), items_frame(spark, items)).count() == 0
    assert search.search(frame(spark, docs), items_frame(spark, [])).count() == 0
    assert search.search(frame(spark, [(1, None), (2, "")]), items_frame(spark, items)).count() == 0


def test_a_stratum_bound_is_never_exceeded():
    rng = np.random.default_rng(2)
    queries = search.Queries([0, 1], np.array([0, 3, 5]), np.array([0, 2, 4, 1, 4]), np.array([1, 2, 1, 1, 3]), list("abcde"))
    scorer = search.Scorer(queries, rng.integers(0, 9000, 5))
    docs = rng.integers(0, 4, (30, 5))
    groups = sorted((t, int(docs[d, t]), d) for d in range(30) for t in range(5) if docs[d, t])
    pairs = sorted({g[:2] for g in groups})
    term, tf = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    count = np.array([sum(g[:2] == p for g in groups) for p in pairs])
    scores = scorer.scores(90, 30, term, tf, count, np.array([g[2] for g in groups]), np.arange(2))
    assert (scores.max(axis=1) <= scorer.bounds(90, term, tf)).all()
    expected = [[sum(int(scorer.weight[e]) * int(search.impacts(docs[d, [scorer.term[e]]], 90)[0]) for e in range(low, high)
                     if docs[d, scorer.term[e]]) for d in range(30)] for low, high in ((0, 3), (3, 5))]
    assert scores.tolist() == expected


# --- period runs ------------------------------------------------------------------------------

def plain_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        x = 0
        while x + q < n:
            start = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            if x - start + q >= max(24, 3 * q):
                found.setdefault((start, x - start + q), q)
            x += 1
    return sorted((s, q, length) for (s, length), q in found.items())


def plain_report(doc, text, edit):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    place = edit(doc, len(words)) if edit else None
    if place is not None:
        words = [words[i] for i in place]
    runs = plain_runs(words)
    lost = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
    return (doc, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in lost)))


@pytest.mark.parametrize("span", [8, 1024])
def test_runs_match_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(periods, "SPAN", span)
    rng, rows = random.Random(5), []
    for i in range(300):
        n, k = rng.randrange(0, 300), rng.choice([1, 2, 3, 50])
        words = [rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[:k]) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            q, at = rng.randrange(1, 60), rng.randrange(0, n + 1)
            unit, size = [rng.choice("abcdef") for _ in range(q)], rng.randrange(q, 6 * q + 30)
            words[at:at] = (unit * (size // q + 1))[:size]
        rows.append((i, rng.choice([" ", "  ", "\n"]) + rng.choice([" ", "\t"]).join(words)))
    a, b = ["a"], ["b"]
    for _ in range(11):
        a, b = a + b, a
    unit = [f"u{i}" for i in range(700)]
    rows += [(5000, " ".join(a)), (None, "y " * 40), (5003, "z q " * 50), (5004, " ".join(unit * 4 + ["end"] + unit * 3)),
             *awkward(rng)]
    df = frame(spark, rows).repartition(5)
    for edit in (None, periods.periodic_tail):
        got = periods.find_runs(df, edit).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                                 "collapsed_sha256")
        assert Counter(map(tuple, got.collect())) == Counter(plain_report(d, t, edit) for d, t in rows)


def test_runs_give_the_collapsed_text(spark):
    found = periods.find_runs(frame(spark, [(1, "start " + "a b c " * 10 + "end"), (2, "a b")])).collect()
    by = {r["doc_id"]: r for r in found}
    assert by[1]["collapsed"] == "start a b c end" and by[2]["collapsed"] is None
    assert [tuple(r) for r in by[1]["runs"]] == [(1, 3, 30)]
    assert periods.find_runs(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_z_function(s):
    expected = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
    assert periods.z_function(s, len(s)) == expected


# --- packing --------------------------------------------------------------------------------

def test_words_are_cut_like_the_library_does(library):
    rng = random.Random(1)
    parts = list("ab'stremvld  \n\t\r.,12é   ñ漢\U0001f600\x1c\x85٣Ⅷ_-") + ["'s", "'re", "'ll", " '", "\n\n "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(5000)]
    table = pieces.WordTable(lambda words: pieces.end_to_end([library.encode(w.decode(), add_special_tokens=False).ids for w in words]))
    import pyarrow as pa
    for column in (texts, [None, "", *texts[:5]], [], [""]):
        ids, first = table.ids(table.code(pa.array(column, pa.string())))
        for i, text in enumerate(column):
            assert ids[first[i]:first[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_word_table_forgets(library, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(pieces, "KEPT_WORDS", 5)
    table = pieces.WordTable(lambda words: pieces.end_to_end([library.encode(w.decode(), add_special_tokens=False).ids for w in words]))
    for text in ("one two three four five six seven", "eight nine " + "x" * 200, "one two", "x" * 200):
        ids, _ = table.ids(table.code(pa.array([text])))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def one_by_one(counts, capacity):
    """Minimum bin slack, a bin at a time; gives the fill of every bin."""
    left, fills = Counter(counts), []
    while left := +left:
        longest = max(left)
        left[longest] -= 1
        chosen = packing.fullest(sorted(left, reverse=True), left, capacity - longest)
        left.subtract(chosen)
        fills.append(longest + sum(chosen))
    return fills


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_equals_minimum_bin_slack_bin_by_bin(counts):
    steps, fills, used = packing.plan(counts, 40), defaultdict(int), defaultdict(int)
    for s in sorted(steps, key=lambda s: (s.first, s.offset)):
        assert s.rank == used[s.length]
        used[s.length] += s.uses * s.bins
        for b in range(s.first, s.first + s.bins):
            assert fills[b] == s.offset
            fills[b] += s.uses * s.length
    assert used == counts and max(fills.values(), default=0) <= 40
    assert [fills[b] for b in range(len(fills))] == one_by_one(counts, 40)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(0, 40))
def test_fullest_is_the_best_subset_sum(left, room):
    sums = {0}
    for length, n in left.items():
        sums = {s + i * length for s in sums for i in range(n + 1)}
    chosen = packing.fullest(sorted(left, reverse=True), left, room)
    assert sum(chosen) == max(s for s in sums if s <= room)
    assert all(n <= left[length] for length, n in Counter(chosen).items())


def test_packing(spark, library):
    rows = awkward(random.Random(6))
    got = packing.pack(frame(spark, rows).repartition(4), PATH, ids=True).collect()
    expected = Counter()
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for piece, (low, high) in enumerate(zip(cuts, cuts[1:])):
            expected[doc, piece, low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(r["length"] for r in got) // 2048)
    assert packing.pack(frame(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(1, 0, 3000)], "row long, piece int, length long"))


# --- words merged side by side -----------------------------------------------------------------

def test_forest_merges_like_single_trees():
    coder, rng = bpe.ByteBpe(bpe.load(PATH)), random.Random(8)
    letters = " abcdeghilnorstu\n.,'0"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 70))).encode() for _ in range(3000)]
    words += [b"a" * n for n in range(1, 140)] + [rng.randbytes(n) for n in range(1, 140)]
    ids, counts = coder.merge_all(words)
    expected = [coder.merge(w) for w in words]
    assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]
    assert [x.tolist() for x in coder.merge_all([])] == [[], []]


# --- mended earlier operators --------------------------------------------------------------------

def test_vectors_of_any_size_link(spark):
    near = [1.0, 1.0001, 0.9999]
    rows = [(1, [1e200, 1e200, 1e200], 0), (2, [1e200, 1e200, 1e200], 0), (3, [3e250, 3e250, 3e250], 0),
            (4, [x * 1e-200 for x in near], 0), (5, [x * 1e-300 for x in near], 0), (6, [1e200, -1e200, 0.0], 0), (7, [0.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.link_vectors(df).collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, 6: (0, 6), 7: (0, 7)}


def test_columns_with_names_of_the_operators(spark):
    rows = [(1, "a b c d e f\ng h i j k l", 23, *["x"] * 12), (2, "a b c d e f\nm n o p", 19, *["y"] * 12)]
    names = ["__id", "__removed", "__hash", "__lines", "__whole", "__cut", "__level0", "__copies", "row", "lines", "removed", "copies"]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    kept = lines.drop_repeated_lines(df)
    assert kept.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["__removed"]) for r in kept.collect()} == {
        1: (rows[0][1], 23, "x"), 2: ("m n o p", 7, "y")}
    mixed = mixing.mix(df, [df["__id"], df["row"]], {})
    assert mixed.columns == df.columns and {r["__copies"] for r in mixed.collect()} <= {"x", "y"}


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda sample: sizes.append(len(sample)))
    docs = spark.createDataFrame([(1, f"w{i} x{i}") for i in range(300)] + [(1, "same text")] * 200 + [(i, f"v{i}") for i in range(2, 40)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    toxicity.train(docs, labels, sample_rows=10)
    toxicity.train(docs, labels)
    toxicity.train(docs, labels, sample_bytes=100)
    assert sizes[0] <= 10 and sizes[1] == 301 + 38 and 0 < sizes[2] < 25
