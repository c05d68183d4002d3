"""Licence scan through a positional rare-token index.

A licence template is a set of key phrases, some mandatory.  The words of all phrases get an inverse document
frequency over the scanned documents.  Each phrase is posted in the index under its two rarest words, with their
positions in the phrase.  A file looks up the places of those words only; the postings of both words must meet at
one start (relative positions intersected); a start so found is verified word by word, and a label needs all of its
mandatory phrases.  Every phrase has two words at least and both postings are necessary for a match, so no place is
lost.

Everything is a DataFrame expression within the row: one scan for the frequencies (a row per licence word and
task is shuffled) and one for the places, which shuffles nothing.  The index is bounded by the templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Labels found by key phrases: (label, mandatory phrases, further phrases).
TEMPLATES = [
    ("apache", ["licensed under the apache license", "version 2 0"], ["unless required by applicable law"]),
    ("mit", ["permission is hereby granted free of charge"], ["the above copyright notice and this permission notice"]),
    ("bsd", ["redistribution and use in source and binary forms"], ["neither the name of"]),
    ("gpl", ["gnu general public license"], ["free software foundation", "any later version"]),
    ("lgpl", ["gnu lesser general public license"], ["free software foundation"]),
    ("agpl", ["gnu affero general public license"], ["free software foundation"]),
    ("mpl", ["mozilla public license"], ["source code form"]),
    ("isc", ["permission to use copy modify and or distribute this software"], ["with or without fee"]),
    ("cc-by-nc", ["licensed under cc by nc"], ["creative commons"]),
    ("cc-by-sa", ["licensed under cc by sa"], ["creative commons"]),
    ("cc-by", ["creative commons attribution"], ["international license"]),
    ("public-domain", ["released into the public domain"], ["no copyright"]),
    ("proprietary", ["all rights reserved"], ["without prior written permission"]),
]


def phrases(templates=None) -> list[str]:
    """Base phrases first, then each key phrase once."""
    found = [p for p, _ in BASE]
    for _, must, more in TEMPLATES if templates is None else templates:
        found += [p for p in (*must, *more) if p not in found]
    return found


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def rarest_words(docs: DataFrame, found: list[str]) -> dict[str, int]:
    """Documents that hold each licence word.  Only words of the templates are counted and returned."""
    vocabulary = sorted({w for p in found for w in p.split()})
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text").cast("string")), _strings(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """Places of the base phrases and the licences of each text.

    One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.  The score
    is the best label's share of words in its key phrases that were found, base phrases counting in full.  A null or empty text has
    no word, no place (null first and last word), empty labels and score 0; overlapping places all count; repeated
    rows repeat; an empty table gives no rows.  Only doc_id and text are read.
    """
    templates = TEMPLATES if templates is None else templates
    found = phrases(templates)
    if any(len(p.split()) < 2 for p in found):
        raise ValueError("a key phrase needs two words at least")
    held = rarest_words(docs, found)
    # The index: rare word -> (phrase, position of the word in it, 0 for the rarest and 1 for the next).
    postings: dict[str, list[tuple[int, int, int]]] = {}
    for number, phrase in enumerate(found):
        split = phrase.split()
        ranked = sorted(range(len(split)), key=lambda i: (held[split[i]], split[i], i))[:2]
        for rank, i in enumerate(ranked):
            postings.setdefault(split[i], []).append((number, i, rank))
    index = F.create_map(*[x for word, posted in sorted(postings.items()) for x in (
        F.lit(word), F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(o).alias("offset"), F.lit(r).alias("rank"))
                               for p, o, r in posted]))])
    rare = sorted(postings)
    lookup = F.array(*[_strings(p.split()) for p in found])

    def starts(rank: int) -> Column:
        """(phrase, start) for which the phrase's word of this rank stands where it must."""
        return F.flatten(F.transform("hits", lambda h: F.transform(
            F.filter(index[h["word"]], lambda p: p["rank"] == rank),
            lambda p: F.struct(p["phrase"].alias("phrase"), (h["at"] - p["offset"]).alias("start")))))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("words"))
    rows = rows.withColumn("hits", F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull()))
    empty = F.array().cast("array<struct<phrase:int,start:int>>")
    rows = rows.withColumn("met", F.when(F.size("hits") > 1, F.array_intersect(starts(0), starts(1))).otherwise(empty))
    rows = rows.withColumn("places", F.filter("met", lambda m: (m["start"] >= 0) & (F.slice(
        F.col("words"), F.greatest(m["start"] + 1, F.lit(1)), F.size(F.get(lookup, m["phrase"]))) == F.get(lookup, m["phrase"]))))
    rows = rows.withColumn("seen", F.array_distinct(F.transform("places", lambda p: p["phrase"])))
    base = F.transform(F.filter("places", lambda p: p["phrase"] < len(BASE)), lambda p: p["start"])

    def has(phrase: str) -> Column:
        return F.array_contains("seen", found.index(phrase))

    base_labels = F.array_compact(F.array(*[F.when(has(p), F.lit(label)) for p, label in BASE]))
    own, shares = [], [F.when(has(p), F.lit(1.0)).otherwise(F.lit(0.0)) for p, _ in BASE]
    for label, must, more in templates:
        all_of = has(must[0])
        for p in must[1:]:
            all_of = all_of & has(p)
        own.append(F.when(all_of, F.lit(label)))
        total = sum(len(p.split()) for p in (*must, *more))
        got = sum((F.when(has(p), F.lit(len(p.split()))).otherwise(F.lit(0)) for p in (*must, *more)), F.lit(0))
        shares.append(F.when(all_of, got.cast("double") / F.lit(float(total))).otherwise(F.lit(0.0)))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, F.array_compact(F.array(*own)))).alias("labels"),
        F.greatest(*shares).alias("score"))


def oracle(templates=None) -> str:
    """The same rows in DuckDB SQL.  Words are joined by two spaces so that neighbouring places don't share one."""
    templates = TEMPLATES if templates is None else templates
    spaced = lambda p: "' " + "  ".join(p.split()) + " '"
    has = lambda p: f"contains(t, {spaced(p)})"
    before = "len(regexp_extract_all(string_split(t, {p})[1], '[^ ]+'))"
    after = "n_words - len(regexp_extract_all(string_split(t, {p})[-1], '[^ ]+')) - {n}"
    firsts = ", ".join(f"CASE WHEN {has(p)} THEN {before.format(p=spaced(p))} END" for p, _ in BASE)
    lasts = ", ".join(f"CASE WHEN {has(p)} THEN {after.format(p=spaced(p), n=len(p.split()))} END" for p, _ in BASE)
    count = " + ".join(f"len(string_split(t, {spaced(p)})) - 1" for p, _ in BASE)
    base = ", ".join(f"CASE WHEN {has(p)} THEN '{label}' END" for p, label in BASE)
    all_of = lambda must: " AND ".join(map(has, must))
    own = ", ".join(f"CASE WHEN {all_of(must)} THEN '{label}' END" for label, must, _ in templates)
    words = lambda ps: [f"CASE WHEN {has(p)} THEN {len(p.split())} ELSE 0 END" for p in ps]
    shares = [f"CASE WHEN {has(p)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for p, _ in BASE]
    shares += [f"CASE WHEN {all_of(must)} THEN ({' + '.join(words([*must, *more]))})::DOUBLE / "
               f"{float(sum(len(p.split()) for p in (*must, *more)))}::DOUBLE ELSE 0.0::DOUBLE END" for _, must, more in templates]
    sort = lambda xs: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{xs}], lambda x: x IS NOT NULL))), ','), '')"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t AS (SELECT doc_id, len(words) AS n_words, ' ' || coalesce(array_to_string(words, '  '), '') || ' ' AS t FROM w)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST({count} AS BIGINT) AS n_base,
  CAST(least({firsts}) AS BIGINT) AS first_word, CAST(greatest({lasts}) AS BIGINT) AS last_word,
  {sort(base)} AS base_labels, {sort(base + ', ' + own)} AS labels, greatest({', '.join(shares)}) AS score
FROM t"""
