"""Corpus operators against brute force, exact round trips and the awkward rows every table may hold."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlens.llm import (bpe, components, fingerprints, language, licenses, lines, mixing, ordered_minhash, pivots,
                            suffixes, texts, toxicity)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node int, `slice` int, key string"
VOCABULARY = path = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


def awkward_rows():
    """Null and empty texts, no id, repeated rows and ids, a very long text, copies, near copies, shared passages."""
    rng = random.Random(3)
    body = [words(rng, 40) for _ in range(6)]
    long = words(rng, 6000)
    near = body[0].split()
    near[20] = "changed"
    passage = words(rng, 90)
    rows = [(1, "\n".join(body[:2])), (2, "\n".join(body[:2])), (3, None), (4, ""), (5, "   \n\n ..."), (6, long),
            (7, long + " end"), (8, "\n".join([" ".join(near), body[1]])), (9, body[2] + "\n" + passage + "\n" + body[3]),
            (10, body[4] + " " + passage), (11, "tiny"), (12, "tiny"), (12, "tiny"), (None, "no id here"), (None, None),
            (13, "Öl ist teuer\nà la carte €"), (14, body[5] + "\nmit license mit license MIT License"),
            (15, "This work is licensed under the GNU General Public License, version 3.\n" + body[5]), (16, "€ … 12"),
            (17, "ab" * 700), (18, "<|endoftext|> x<|endoftext|>\u0000\U0001f600 's 12 \t\n  y")]
    return [(i, t, None if n % 5 == 4 else ("en", "de")[n % 2], None if n % 7 == 6 else f"src{n % 4}",
             None if t is None else len(t), "x", 1, 2, "k") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


# --- 1 -----------------------------------------------------------------------------------

def test_pivot_index_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(400):
        v = base[i % 60] + rng.normal(size=16) * rng.choice([0.02, 0.06, 0.5])
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3))
    rows += [(1000 + i, rows[0][1], 0) for i in range(200)]  # a third are copies of one vector
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0] * 15 + [None], 1), (2003, [float("nan")] * 16, 1),
           (2004, rows[5][1], None), (2005, [1.0, 2.0], 1), (2006, [], 1), (None, rows[5][1], 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<float>, label int, node string")
    got = {r["vec_id"]: r for r in pivots.link_vectors(df.repartition(4)).collect()}
    x = np.array([r[1] for r in rows])
    label = np.array([r[2] for r in rows])
    norm = np.linalg.norm(x, axis=1)
    link = (x @ x.T / np.outer(norm, norm) >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    expected = link.sum(1)
    found = np.array([got[r[0]]["n_links"] for r in rows])
    assert (found <= expected).all() and found.sum() >= 0.98 * expected.sum()
    assert found[400:].min() >= 199
    for i, *_ in odd[:-1]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0
    for r in got.values():
        if r["vec_id"] is not None:
            assert r["kept"] == (r["vec_id"] == r["component_id"]) and r["component_id"] <= r["vec_id"]
    assert pivots.link_vectors(df.limit(0)).count() == 0


def test_pivot_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    rows = [(i, [float(v) for v in centre + rng.normal(size=8) * 0.01], 0) for i in range(150)]
    got = pivots.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {tuple(r)[1:] for r in got.collect()} == {(149, 0, True), (149, 0, False)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    rows = got.collect()
    assert len(rows) == len({r["node"] for r in rows})
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert {r["node"]: r["component"] for r in rows} == {v: find(v) for v in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2 -----------------------------------------------------------------------------------

def shingle_set(text):
    found, out = re.findall("[0-9a-z\u0080-\U0010ffff]+", (text or "").lower()), []
    grams = [tuple(found[i:i + 5]) for i in range(len(found) - 4)] or ([tuple(found)] if found else [])
    seen = Counter()
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def lcs_similarity(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    m = table[-1, -1]
    return m / (len(a) + len(b) - m) if a and b else 0.0


def test_aligned_matches_dynamic_programming():
    rng = random.Random(4)
    for _ in range(120):
        a = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 90))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = ["n"] * rng.randrange(3)
        if rng.random() < 0.2:
            b = b[len(b) // 2:] + b[:len(b) // 2]
        hashed = [ordered_minhash.labelled_shingles(np.array([hash(w) & 0xFFFFFFFF for w in t], np.uint32)) for t in (a, b)]
        exact = lcs_similarity(shingle_set(" ".join(a)), shingle_set(" ".join(b)))
        got = ordered_minhash.similarity(*hashed)
        assert (got >= 0.8 - 1e-12) == (exact >= 0.8 - 1e-12)
        if exact >= 0.8:
            assert got == pytest.approx(exact)


def test_near_copies_on_awkward_rows(docs, empty):
    got = by_id(ordered_minhash.near_copies(docs))
    assert got[1]["class_id"] == got[2]["class_id"] == got[8]["class_id"] == 1
    assert got[7]["class_id"] == 6 and got[12]["class_id"] == 11
    for alone in (3, 4, 5, 9, 10, 13, 14, 15, 17):
        assert (got[alone]["class_id"], got[alone]["kept"]) == (alone, True)
    assert ordered_minhash.near_copies(docs).count() == docs.count()
    assert ordered_minhash.near_copies(empty).count() == 0
    kept = ordered_minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 4, 5, 6, 9, 10, 11, 13, 14, 15, 16, 17, 18]


@pytest.mark.parametrize("block, rounds", [(1024, 3), (16, 0)])
def test_large_group_of_near_copies(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(ordered_minhash, "BLOCK", block)
    monkeypatch.setattr(ordered_minhash, "STAR_ROUNDS", rounds)
    rng = random.Random(8)
    base = words(rng, 200).split()
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, words(rng, 200)) for i in range(50)]
    got = by_id(ordered_minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    sets = {i: set(shingle_set(t)) for i, t in rows}
    parent = {i: i for i in sets}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in sets}


# --- 3 -----------------------------------------------------------------------------------

def test_shortage_goes_to_siblings_first(spark):
    tokens = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "z", "4"): 30}
    rows = []
    for (d, lang, s), n in tokens.items():
        rows += [(len(rows) + i, "t " * 1, d, lang, s) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, lang string, source string")
    levels = [F.col(c).alias(f"__level{i}") for i, c in enumerate(("d", "lang", "source"))]
    leaf = mixing.leaf_quotas(df.select(*levels, F.lit(1).cast("long").alias("__tokens")), 3,
                              {("a",): 1, ("b",): 1}, 200 / 240, 1)
    got = {tuple(r[f"__level{i}"] for i in range(3)): r["quota"] for r in leaf.collect()}
    # b takes its 30 of 100, a gets 170: x and y 85 each; in x, source 1 has only 10, source 2 takes 75
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 75, ("a", "y", "3"): 85, ("b", "z", "4"): 30}


def test_mixture_is_a_prefix_of_epochs(docs, empty):
    levels = [mixing.domain_of(docs["source"]), docs["lang"], docs["source"]]
    found = mixing.with_copies(docs, levels, mixing.WEIGHTS)
    assert found.drop("__copies").columns == docs.columns and found.count() == docs.count()
    total = docs.select(F.sum(mixing.token_count(F.col("text")))).first()[0]
    taken = found.select(F.sum(mixing.token_count(F.col("text")) * F.col("__copies"))).first()[0]
    assert 0 < taken <= total
    spread = found.groupBy("lang", "source").agg((F.max("__copies") - F.min("__copies")).alias("d"), F.max("__copies").alias("m"))
    assert all(r["d"] <= 1 and r["m"] <= mixing.MOST_EPOCHS for r in spread.collect())
    mixed = mixing.mix(docs, levels, mixing.WEIGHTS)
    assert mixed.columns == docs.columns
    assert mixed.count() == found.agg(F.sum("__copies")).first()[0]
    assert mixing.mixing_report(empty).count() == 0
    assert mixing.mix(empty, [mixing.domain_of(empty["source"]), empty["lang"], empty["source"]], {}).count() == 0


# --- 4 -----------------------------------------------------------------------------------

def test_language_model(spark, docs, empty):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "and", "er"], "de": ["sch", "ung", "der", "ö"], "fr": ["eau", "que", "é", "tion"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(rng.randrange(1, 60))), lang)
            for i, lang in enumerate(rng.choices(list(parts), k=600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.where("doc_id % 4 <> 2"))
    held = df.where("doc_id % 4 = 2").join(language.predict(df, model), "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    got = by_id(language.predict(docs, model))
    for i in (3, 4, 5, 16):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert all(r["lang_pred"] in (*parts, "und") and 0 <= r["score"] <= 1 for r in got.values())
    assert language.predict(docs, model).count() == docs.count() and language.predict(empty, model).count() == 0
    assert language.train(empty).languages == []
    assert {r["lang_pred"] for r in language.predict(docs, language.train(empty)).collect()} == {"und"}


def test_subwords_stay_within_words():
    data, offsets = texts.utf8(__import__("pyarrow").array(["ab", None, "", "cde f"]))
    grams, first = language.subwords(data, offsets)
    # ^ab, ab$, ^ab$ | ^cd, cde, de$, ^f$, ^cde, cde$
    assert np.diff(first).tolist() == [3, 0, 0, 6]


# --- 5 -----------------------------------------------------------------------------------

def test_toxicity(spark, docs, empty):
    rng = random.Random(6)
    bad = ["vile", "rotten", "awful"]
    rows, labels = [], []
    for i in range(600):
        own, toxic = words(rng, rng.randrange(5, 60), 300).split(), int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(bad))
        rows.append((i, " ".join(own)))
        labels.append((i, toxic if i % 50 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab.where("doc_id % 5 <> 0"))
    assert 0 < len(model.weights) < 3000
    held = toxicity.score(df, model).join(lab, "doc_id").where("doc_id % 5 = 0 and toxic is not null")
    assert held.where("predicted = toxic").count() >= 0.95 * held.count()
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and all(0 <= r["score"] <= 1 for r in scored.collect())
    got = by_id(scored)
    assert got[3]["score"] == got[4]["score"] == got[5]["score"]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.where("predicted = 0").count()
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(empty, lab)
    assert len(nothing.weights) == 0 and toxicity.drop_toxic(docs, nothing).count() == docs.count()


# --- 6 -----------------------------------------------------------------------------------

def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows = docs.where("doc_id is not null").collect()
    got = {}
    for r in bpe.round_trip(docs, VOCABULARY).collect():
        got[r["doc_id"]] = r
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert tuple(got[r["doc_id"]])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                               hashlib.sha256(text.encode()).hexdigest())
    assert bpe.round_trip(docs, VOCABULARY).count() == docs.count()
    assert bpe.round_trip(empty, VOCABULARY).count() == 0 and bpe.encode(docs, VOCABULARY).count() == docs.count()


def test_segment_tree_merges_like_a_scan():
    coder = bpe.ByteBpe(bpe.load(VOCABULARY))
    rng = random.Random(9)

    def scan(word):
        ids = [coder.single[b] for b in word]
        while True:
            ranks = [(coder.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in coder.merges]
            if not ranks:
                return tuple(ids)
            at = min(ranks)[1]
            ids[at:at + 2] = [coder.merges[ids[at], ids[at + 1]][1]]

    for _ in range(300):
        word = "".join(rng.choices("aethinorsTé", k=rng.randrange(0, 40))).encode()
        assert coder.merge(word) == scan(word)
    assert b"".join(map(coder.pieces.__getitem__, coder.merge(b"ab" * 20000))) == b"ab" * 20000


def test_encoder_worker_holds_little():
    import tracemalloc

    import pyarrow as pa

    from reviewlens.llm import pieces

    pieces._classes.cache_clear()
    tracemalloc.start()
    pieces._classes()
    peak = tracemalloc.get_traced_memory()[1]
    table = bpe.Spelled(bpe.ByteBpe(bpe.load(VOCABULARY)))
    before = tracemalloc.get_traced_memory()[0]
    for i in range(8):
        table.code(pa.array([" ".join(f"w{j:x}z" for j in range(i * 10000, i * 10000 + 10000))]))
    kept = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert peak < 40 << 20 and kept < 20 << 20
    table.most = 1000  # forgets all and begins again
    table.code(pa.array(["a b c"]))
    assert table.words == 3


# --- 7 -----------------------------------------------------------------------------------

def license_rows(text):
    found = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = {}
    for p in licenses.phrases():
        split = p.split()
        places[p] = [i for i in range(len(found)) if found[i:i + len(split)] == split]
    base = [(i, label) for p, label in licenses.BASE for i in places[p]]
    labels = {label for _, label in base} | {label for label, must, _ in licenses.TEMPLATES if all(places[p] for p in must)}
    starts = [i for i, _ in base]
    return (len(found), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)))


def test_license_scan(docs, empty):
    for r in docs.join(licenses.scan(docs), "doc_id").dropDuplicates(["doc_id"]).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == license_rows(r["text"])
    assert by_id(licenses.scan(docs))[14]["n_base"] == 3
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, [("x", ["single"], [])])


# --- 8 -----------------------------------------------------------------------------------

def test_fingerprints_are_homomorphic():
    a, b, both, swapped = fingerprints.vectors(["one two three", "four five\nsix", "one two three\nfour five\nsix", "six\none two three\nfour five"])
    assert (fingerprints.add(a, b) == both).all() and (both == swapped).all()
    assert (fingerprints.subtract(both, b) == a).all()
    assert (fingerprints.vectors(["", "\n\n"]) == 0).all()
    assert fingerprints.likeness(both[None], swapped[None])[0] == 1.0


def test_fingerprint_query(docs, empty):
    got = fingerprints.compare(docs).collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or "", r["text"] is not None))
    assert len(got) == len(rows)
    expected = Counter()
    for r, n in zip(rows, rows[1:] + rows[:1]):
        edited = fingerprints.edited_text(r["text"] or "", n["text"] or "")
        expected[r["doc_id"], len(r["text"] or ""), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] != by[8]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.compare(empty).count() == 0
    assert fingerprints.compare(docs.where("doc_id = 1")).first()["near_next"] == 1.0
    assert fingerprints.fingerprint_documents(docs).count() == docs.count()


# --- 9 -----------------------------------------------------------------------------------

def repeated_bytes(rows, length):
    seen = Counter(b[i:i + length] for b in rows for i in range(len(b) - length + 1))
    out = []
    for b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append((sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])),
                    bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_suffix_array_by_grouping():
    rng = random.Random(7)
    for _ in range(300):
        own = [rng.randint(1, rng.choice((1, 2, 3, 30))) for _ in range(rng.randrange(50))]
        own = (own * rng.choice((1, 1, 3))) + [0]
        assert suffixes.suffix_array(own) == sorted(range(len(own)), key=lambda i: own[i:])


@pytest.mark.parametrize("block", [1, 2, 64])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = random.Random(11)
    shared = "".join(rng.choices("abcdefgh é", k=700))
    rows = [(i, "".join(rng.choices("abcdef \n", k=rng.randrange(900))) + shared[rng.randrange(300):rng.randrange(300, 700)]
             + "".join(rng.choices("xyz ", k=rng.randrange(500)))) for i in range(40)]
    rows += [(100, shared), (101, shared), (101, shared), (102, "ab" * 600), (103, None), (104, ""), (None, shared[:450])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = {}
    for (i, t), e in zip(rows, repeated_bytes([(t or "").encode() for _, t in rows], suffixes.LENGTH)):
        expected[i] = (len((t or "").encode()), *e)
    got = suffixes.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        gone = sum(s["high"] - s["low"] for s in r["spans"])
        assert (r["n_bytes"], gone, len(r["spans"]), bytes(r["kept"])) == expected[r["doc_id"]]


def test_suffix_arrays_hold_only_what_may_repeat():
    rng = random.Random(12)
    random_bytes = lambda n: bytes(rng.choices(range(97, 123), k=n))
    gram, tail = random_bytes(64), random_bytes(300)
    # places of the gram differ; only the first two agree in 400 bytes around it, the third in 364, the last in none
    one, two = random_bytes(40) + b"A" * 80 + gram + tail + b"x", random_bytes(10) + b"A" * 80 + gram + tail + b"yy"
    near, far = random_bytes(60) + gram + tail + b"z" * 40, random_bytes(100) + gram + random_bytes(300)
    found = suffixes.open_windows([one, two, near, far], [120, 90, 60, 100])
    assert found == {0: (40, 84), 1: (10, 54)}
    flags, _ = suffixes.repeated_starts([one, two, near, far])
    for i, flag in enumerate(flags):
        low, high = found.get(i, (0, -1))
        assert np.flatnonzero(flag).tolist() == list(range(low, high + 1))
    assert suffixes.open_windows([one], [120]) == {}
    assert suffixes.open_windows([near, far], [60, 100]) == {}


def test_suffix_dedup_on_awkward_rows(docs, empty):
    rows = docs.collect()
    expected = Counter((r["doc_id"], e[0], e[1]) for r, e in zip(rows, repeated_bytes([(r["text"] or "").encode() for r in rows], 400)))
    got = suffixes.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], sum(s["high"] - s["low"] for s in r["spans"]), len(r["spans"])) for r in got) == expected
    assert suffixes.remove_repeats(empty).count() == 0


# --- 10 ----------------------------------------------------------------------------------

def kept_lines(rows):
    sets, out = [], {}
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate(t.split("\n")):
            own = frozenset(w for w in re.split("[\x00-/:-@\\[-`{-\x7f]+", line.lower()) if w)
            sets.append((((i is not None, i or 0), n), own, i, n, line))
    for place, own, i, n, line in sets:
        gone = any(p < place and own and 9 * len(own & o) >= 4 * (len(own) + len(o)) for p, o, *_ in sets)
        out.setdefault(i, []).append((n, line, gone))
    return out


def test_line_dedup_matches_brute_force(spark, docs, empty):
    rng = random.Random(12)
    base = [words(rng, rng.randrange(2, 25), 60) for _ in range(30)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(base).split()
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = rng.choice(["New", "word,", ""])
            own.append(" ".join(line))
        rows.append((i, "\n".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    unique = docs.where("doc_id is null or doc_id <> 12")
    for frame in (df, unique.where("doc_id is not null")):
        expected = kept_lines([(r["doc_id"], r["text"]) for r in frame.collect()])
        for r in lines.line_report(frame).collect():
            own = expected[r["doc_id"]]
            kept = "\n".join(line for _, line, gone in own if not gone)
            assert (r["n_lines"], r["n_removed"], r["kept_sha256"]) == (
                len(own), sum(g for *_, g in own), hashlib.sha256(kept.encode()).hexdigest())
    assert lines.line_report(docs).count() == docs.count() and lines.line_report(empty).count() == 0
    kept = lines.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    got = by_id(kept)
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[3]["text"] is None and got[1]["text"] == by_id(docs)[1]["text"]


def test_line_variants_are_verified_a_few_times_each(spark, monkeypatch):
    base, n = [f"base{i}" for i in range(40)], 120
    # half the words of the family stand first in a line of another kind, which is the head of their lists
    rows = [(i, " ".join([base[i], *[f"other{i}x{j}" for j in range(39)] * 200])) for i in range(20)]
    rows += [(100 + i, " ".join([*base[:i % 40], f"own{i}", *base[i % 40 + 1:]])) for i in range(n)]
    counts, verified = [], lines._verified

    def counted(texts, pairs):
        counts.append(pairs.count())
        return verified(texts, pairs)

    monkeypatch.setattr(lines, "_verified", counted)
    found = by_id(lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(r["n_removed"] for r in found.values()) == n - 1 and 0 < sum(counts) <= 6 * n


def test_lines_of_neighbouring_sizes_meet(spark):
    rows = [(0, " ".join(f"w{i}" for i in range(300)))]
    rows += [(k, " ".join(f"w{i}" for i in range(size))) for k, size in enumerate((240, 239, 300, 375, 376), 1)]
    found = {r["doc_id"]: r["n_removed"] for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = kept_lines(rows)
    assert found == {i: sum(g for *_, g in own) for i, own in expected.items()}


# --- pipeline ----------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(13)
    rows = []
    for i in range(120):
        lines_of = [words(rng, rng.randrange(8, 30)) for _ in range(rng.randrange(1, 5))]
        if i % 4 == 1:
            lines_of.append("you vile rotten awful person")
        rows.append((i, "\n".join(lines_of), "en", f"src{i % 3}"))
    rows += [(200, rows[0][1], "en", "src1"), (201, None, None, None), (202, "", "de", "src2")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name != "bpe":
            assert after.columns == df.columns
        if name == "toxicity":
            assert sum(i % 4 == 1 for i in ids if i < 120) <= 2 and {i for i in range(120) if i % 4 != 1} <= ids
        if name == "line_dedup":
            assert ids == {r["doc_id"] for r in before.select("doc_id").collect()}
            assert by_id(after)[200]["text"] == ""
        if name == "bpe":
            assert after.count() == before.count()
        before = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == before.count()
