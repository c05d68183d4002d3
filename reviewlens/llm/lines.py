"""Line de-duplication by an exact set-similarity join, in DataFrame expressions only.

A line is the set of its words.  A line goes when an earlier line (smaller doc_id, then line number) has a word
set of Jaccard similarity 0.8 or more; the earliest stays.

1. Word rarity: hashed word counts in ``SLOTS`` slots, a byte each, whatever the input.  Any fixed order
   of words keeps the filters below exact; rare first keeps their lists short.
2. Lines with equal sets are one entry with its first place (pre-aggregated, so a line that makes up a third of
   all lines leaves each task once).
3. Prefix filter: entries of sizes ``m <= n`` that match share one of the rarest ``m/9 + 1`` words of the one and ``n/5 + 1`` of
   the other, so they meet in the list of that word and of the level of ``n``.  The join within the lists also applies the
   length filter, the positional filter and a symmetric-difference bound on parity signatures of 64 bits
   (256 for long lines), all of which are necessary conditions.  An entry that may match the earliest entry of a list (its head) is compared
   with that one only, so that a family of thousands of variants costs a comparison each and not one per pair.
4. Pairs of entries are verified by the Jaccard similarity of their words, those with a head first and the others only of
   entries still there.  Such an entry is also compared with all earlier entries of the lists in which its head has put it off.
5. Lines that are a later copy, or that match an earlier entry, are taken out of their texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.runtime import materialise, release

SLOTS = 1 << 16
SEPARATORS = r"[\x00-/:-@\[-`{-\x7F]+"
WORD_CHARACTER = r"[^\x00-/:-@\[-`{-\x7F]"
#: A place: document, line, and a tie-break that is 0 unless rows with different texts share a doc_id.
PLACE = ["doc", "line", "tie"]
FIRST = -(1 << 63)
#: Bits of a posting's size and position; larger ones only weaken the filters.
SIZE_BITS, AT_BITS = 18, 13
#: From so many words on, the parity signature of 64 bits says little and one of 256 bits is kept beside it.
WIDE = 112
LANES = ["lane1", "lane2", "lane3"]
#: Sizes of one level differ by less than this factor, which is larger than that between lines that match.
LEVEL = 1.6
MOST_SIZE, MOST_AT = (1 << SIZE_BITS) - 1, (1 << AT_BITS) - 1


def words_of(line: Column) -> Column:
    """Distinct lower-cased words; punctuation and white space of ASCII separate them."""
    return F.array_distinct(F.array_remove(F.split(F.lower(line), SEPARATORS), ""))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _slot(word_hash: Column) -> Column:
    return word_hash.bitwiseAND(SLOTS - 1).cast("int")


def _rarity(texts: DataFrame) -> Column:
    """One number per slot, larger for more words: four times the binary logarithm of the slot's word count, in the top byte.

    The numbers stay in the plan as one value of ``SLOTS`` entries and never pass the driver's Python or a plan's text.
    """
    slots = texts.select(F.explode(F.split(F.lower("text"), SEPARATORS)).alias("word")).select(
        _slot(F.xxhash64("word")).alias("id")).groupBy("id").agg(
        F.least(F.floor(4 * F.log2(F.count("*") + 1)), F.lit(126)).cast("long").alias("n"))
    every = texts.sparkSession.range(SLOTS).join(slots, "id", "left").select(
        "id", F.shiftleft(1 + F.coalesce("n", F.lit(0).cast("long")), 56).alias("rarity"))
    return every.agg(F.sort_array(F.collect_list(F.struct("id", "rarity"))).alias("all")).select("all.rarity").scalar()


def _lines(texts: DataFrame, rarity: Column) -> DataFrame:
    """doc_id, text_hash, line_no and the line's word set: entry (its hash), size, signature, lanes and prefix of rare words.

    A word toggles one of 256 bits, dealt to four lanes of 64.  ``signature`` is the lanes' exclusive or; ``LANES`` hold
    three of them, from which the fourth follows, and are null for lines of fewer than ``WIDE`` words.
    """
    # A word's code: its slot's rarity above 56 bits of its hash, so that sorting puts rare words first.
    # Never null, so that they sort as plain numbers.
    code = lambda h: F.coalesce(F.get("rarity", _slot(h)), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 8))
    # the digest is taken once per text, below the lines; a line without words is told by its first other character,
    # since a filter on the codes would be pushed below and cut every line twice
    rows = texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).select(
        "doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(WORD_CHARACTER))
    rows = rows.withColumn("rarity", rarity)  # a sub-query may not stand inside a lambda
    words = F.array_remove(F.split(F.lower("line"), SEPARATORS), "")
    hashes = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    rows = rows.select("doc_id", "text_hash", "line_no", F.sort_array(F.transform(hashes, code)).alias("codes"))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda codes: F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c)))
    lane = lambda i: parity(F.filter("codes", lambda c: F.shiftright(c, 6).bitwiseAND(3) == i))
    return rows.select(
        "doc_id", "text_hash", "line_no", F.xxhash64("codes").alias("entry"), F.size("codes").alias("size"), parity("codes").alias("signature"),
        *[F.when(F.size("codes") >= WIDE, lane(i)).alias(name) for i, name in enumerate(LANES, 1)],
        # 32 bits suffice to meet on: the filters and the verification follow
        F.transform(F.slice("codes", F.lit(1), F.floor(F.size("codes") / 5).cast("int") + 1), lambda c: F.hash(c)).alias("prefix"))


def _pack(line: Column, size: Column, at: Column, above: Column) -> Column:
    """Line, size, position and whether the list is of a level above the size's, in one number that orders by line.

    A size or position beyond its bits is cut down to them.
    """
    return F.shiftleft(line.cast("long"), SIZE_BITS + AT_BITS + 1).bitwiseOR(
        F.shiftleft(F.least(size, F.lit(MOST_SIZE)).cast("long"), AT_BITS + 1)).bitwiseOR(
        F.shiftleft(F.least(at, F.lit(MOST_AT)).cast("long"), 1)).bitwiseOR(above.cast("long"))


#: What the filters read of a posting.
FILTERED = ["pack", "signature", *LANES]


def _may_match(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Necessary conditions for two entries with a common prefix word: length, position, symmetric difference."""
    size, size2 = (F.shiftright(side("pack"), AT_BITS + 1).bitwiseAND(MOST_SIZE) for side in (a, b))
    at, at2 = (F.shiftright(side("pack"), 1).bitwiseAND(MOST_AT) for side in (a, b))
    both = size + size2
    folded = a("signature").bitwiseXOR(b("signature"))
    lanes = [a(c).bitwiseXOR(b(c)) for c in LANES]
    last = folded.bitwiseXOR(lanes[0]).bitwiseXOR(lanes[1]).bitwiseXOR(lanes[2])
    differ = sum((F.bit_count(x) for x in lanes), F.bit_count(last))
    return (F.greatest(size, size2) == MOST_SIZE) | (
        (5 * F.least(size, size2) >= 4 * F.greatest(size, size2)) & (9 * F.least(size - at, size2 - at2) >= 4 * both)
        & (9 * F.bit_count(folded) <= both) & F.coalesce(9 * differ <= both, F.lit(True)))


def _meet(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """The list is one in which two entries of these sizes have to meet: of the larger one's level, on a rare word of the smaller."""
    def smaller(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        size, size2 = (F.shiftright(side("pack"), AT_BITS + 1).bitwiseAND(MOST_SIZE) for side in (x, y))
        at = F.shiftright(x("pack"), 1).bitwiseAND(MOST_AT)
        return (size <= size2) & ((9 * at <= size) | (size == MOST_SIZE)) & (y("pack").bitwiseAND(1) == 0)

    return smaller(a, b) | smaller(b, a)


def _level(size: Column) -> Column:
    return F.floor(F.log(size) / math.log(LEVEL)).cast("int")


def _posted(entries: DataFrame, ties: bool) -> DataFrame:
    """A row per word of the prefix at the level of the entry's size, and per word that it needs to meet larger entries at the next."""
    # no other set of fewer than four words reaches the similarity, but its own, which is the same entry
    rows = entries.where("size >= 4 and signature is not null").select(
        *PLACE, "size", "signature", *LANES, _level(F.col("size")).alias("level"), _level(F.col("size") + F.floor(F.col("size") / 4)).alias("highest"),
        F.posexplode("prefix").alias("at", "word"))
    last = F.when(9 * F.col("at") <= F.col("size"), F.col("highest")).otherwise(F.col("level"))
    rows = rows.select("*", F.explode(F.sequence("level", last)).alias("of"))
    return rows.select(F.hash("word", "of").alias("code"), "doc", _pack(F.col("line"), F.col("size"), F.col("at"), F.col("of") > F.col("level")).alias("pack"),
                       "signature", *LANES, *["tie"] * ties)


def _place(side: str, ties: bool) -> Column:
    line = F.shiftright(F.col(f"{side}.pack"), SIZE_BITS + AT_BITS + 1).cast("int")
    return F.struct(F.col(f"{side}.doc").alias("doc"), line.alias("line"),
                    (F.col(f"{side}.tie") if ties else F.lit(0).cast("long")).alias("tie"))


def _met(a: DataFrame, b: DataFrame, ties: bool, among: Callable[[Column], Column] = lambda met: met) -> DataFrame:
    """code, one (earlier) and two (later): places that meet in a list and may match; ``b`` (later) may carry ``near``.

    Of two texts with one doc_id, lines with the same number never remove each other, whichever stands first here.
    """
    before = (F.col("a.doc") < F.col("b.doc")) | ((F.col("a.doc") == F.col("b.doc")) & (F.col("a.pack") < F.col("b.pack")))
    sides = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    condition = (F.col("a.code") == F.col("b.code")) & before & among(_meet(*sides)) & _may_match(*sides)
    return a.alias("a").join(b.alias("b"), condition).select(
        "b.code", _place("a", ties).alias("one"), _place("b", ties).alias("two"), *["b.near"] * ("near" in b.columns))


def _first_met(posted: DataFrame, ties: bool) -> DataFrame:
    """Candidates with near, where what may match its list's head (near) meets the head only."""
    # column by column, so that both sides of the join read one and the same exchange
    key = ["doc", "pack", *["tie"] * ties]
    order = Window.partitionBy("code").orderBy(*key)
    near = posted.withColumns({f"head_{c}": F.first(c).over(order) for c in dict.fromkeys([*key, *FILTERED])})
    near = near.withColumn("near", _may_match(lambda c: F.col(f"head_{c}"), F.col)).drop(*[f"head_{c}" for c in FILTERED if c not in key])
    is_head = F.lit(True)
    for c in key:
        is_head = is_head & (F.col(f"a.{c}") == F.col(f"b.head_{c}"))
    return _met(posted, near, ties, lambda met: (F.col("b.near") & is_head) | (~F.col("b.near") & met))


class _Sieve:
    """A bit per hash of ``keys``: says no to most rows that an equi-join would drop, before they are shuffled.

    Its size is fixed; on more keys than bits it lets more rows pass, and the join that follows decides in any case.
    """

    def __init__(self, keys: DataFrame, *columns: str):
        slot = F.xxhash64(*columns).bitwiseAND(64 * SLOTS - 1)
        found = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(self._bit(F.col("slot"))).alias("bits"))
        words = keys.sparkSession.range(SLOTS).join(found, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
        # one value of fixed size, which the plan takes in when it runs
        self.bits = words.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("w")).select("w.bits").scalar()

    @staticmethod
    def _bit(slot: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))

    def passes(self, *columns: Column) -> Column:
        slot = F.xxhash64(*columns).bitwiseAND(64 * SLOTS - 1)
        return F.get(self.bits, F.shiftright(slot, 6).cast("int")).bitwiseAND(self._bit(slot)) != 0


def _parity(hashes: str, shift: int) -> Column:
    """Which of 64 bits an odd number of ``hashes`` (an array) set."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftright(h, shift).bitwiseAND(63).cast("int"))))


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ok: the words of both reach the similarity and ``two`` stands later.

    Words are compared by 64-bit hashes: the chance that two different words of a pair of lines of a hundred
    words meet is below one in a million billion.  Two more signatures settle most pairs before words travel.
    """
    every = texts.select("doc", "tie", F.posexplode(F.split("text", "\n")).alias("line", "words"))

    def places(of: DataFrame) -> DataFrame:
        return of.select(F.explode(F.array("one", "two")).alias("place")).distinct()

    wanted = materialise(places(pairs).select("place.*"))
    every = every.where(_Sieve(wanted, "doc", "line").passes(F.col("doc"), F.col("line")))
    hashed = F.transform(words_of(F.col("words")), lambda w: F.xxhash64(w))
    words = materialise(every.join(wanted, PLACE).select(F.struct(*PLACE).alias("place"), hashed.alias("words")).dropDuplicates(["place"]).withColumns(
        {"size": F.size("words"), "p": _parity("words", 20), "q": _parity("words", 34)}))

    def side(name: str, *columns: str) -> DataFrame:
        return words.select(F.col("place").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    both = F.col("one_size") + F.col("two_size")
    far = lambda c: 9 * F.bit_count(F.col(f"one_{c}").bitwiseXOR(F.col(f"two_{c}"))) > both
    marked = materialise(pairs.join(side("one", "size", "p", "q"), "one").join(side("two", "size", "p", "q"), "two").select(
        "one", "two", both.alias("both"), (~(far("p") | far("q")) & (F.struct("one.doc", "one.line") < F.struct("two.doc", "two.line"))).alias("close")))
    close = marked.where("close")
    sieve = _Sieve(places(close).select("place.*"), "doc", "line")
    table, words = words, words.where(sieve.passes(F.col("place.doc"), F.col("place.line")))
    joined = close.join(side("one", "words"), "one").join(side("two", "words"), "two")
    ok = 9 * F.size(F.array_intersect("one_words", "two_words")) >= 4 * F.col("both")
    out = materialise(joined.select("one", "two", ok.alias("ok")).union(marked.where("not close").select("one", "two", F.lit(False))))
    release(wanted, marked, table)
    return out


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the sorted line numbers (from 0) that go; documents that lose nothing are left out."""
    texts = _documents(docs)
    lines = materialise(_lines(texts, _rarity(texts)))
    repeated = lines.select("doc_id", "text_hash").distinct().groupBy("doc_id").count().where("count > 1")
    ties = not repeated.isEmpty()
    tie = F.col("text_hash") if ties else F.lit(0).cast("long")
    doc = F.coalesce("doc_id", F.lit(FIRST).cast("long"))
    texts = texts.select(doc.alias("doc"), "text", F.xxhash64("text").alias("text_hash")).select("doc", "text", tie.alias("tie"))
    entries = materialise(lines.groupBy("entry").agg(
        F.min(F.struct(doc.alias("doc"), F.col("line_no").alias("line"), tie.alias("tie"))).alias("place"),
        F.first("size").alias("size"), F.first("signature").alias("signature"), *[F.first(c).alias(c) for c in LANES],
        F.first("prefix").alias("prefix")).select("entry", "place.*", "size", "signature", *LANES, "prefix"))
    posted = _posted(entries, ties)
    met = materialise(_first_met(posted, ties))
    copies = _verified(texts, met.where("near").select("one", "two").distinct())
    settled = materialise(copies.where("ok").select("two").distinct())
    pairs = met.where("not near").select("one", "two")
    late = materialise(met.where("near").select("code", "two.*").join(settled.select("two.*"), PLACE, "left_anti").distinct())
    if not late.isEmpty():
        # lists that hold none of those put off are not shuffled again
        again = posted.where(_Sieve(late, "code").passes(F.col("code"))).alias("p")
        line = F.shiftright("p.pack", SIZE_BITS + AT_BITS + 1).cast("int")
        same = [F.col("p.code") == F.col("l.code"), F.col("p.doc") == F.col("l.doc"), line == F.col("l.line"),
                *[F.col("p.tie") == F.col("l.tie")] * ties]
        pairs = pairs.union(_met(again, again.join(late.alias("l"), same, "left_semi"), ties).select("one", "two"))
    pairs = materialise(pairs.join(settled, "two", "left_anti").select("one", "two").distinct())
    others = _verified(texts, pairs)
    release(met, pairs, late, copies)
    gone = settled.union(others.where("ok").select("two").distinct())
    near = gone.select("two.*").withColumn("near", F.lit(True))
    verdict = entries.join(near, PLACE, "left").select("entry", "doc", "line", F.coalesce("near", F.lit(False)).alias("near"))
    lost = lines.select("entry", "doc_id", "text_hash", "line_no").join(verdict, "entry").where(
        F.col("near") | (F.struct(doc, F.col("line_no")) > F.struct("doc", "line")))
    out = materialise(lost.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed")))
    release(lines, entries, settled, others)
    return out


def _with_removed(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), lines (all of them) and removed (numbers of those that go)."""
    gone = removed_lines(docs.select("doc_id", "text"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").cast("long").alias("id"), text.alias("text"))
    listed = _Sieve(gone, "text_hash").passes(F.xxhash64("text"))
    none = F.array().cast("array<int>")
    changed = rows.where(listed).withColumn("hash", F.xxhash64("text")).alias("r").join(
        gone.alias("g"), F.col("r.id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.hash") == F.col("g.text_hash")), "left")
    return changed.select("r.row", "r.text", F.coalesce("g.removed", none).alias("removed")).union(
        rows.where(~listed).select("row", "text", none.alias("removed"))).select("row", F.split("text", "\n").alias("lines"), "removed")


def _kept_text() -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    return F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, texts without their repeated lines and n_chars to match.

    Every row stays; a text that loses all its lines is empty and a null text stays null.  Columns may have any name.
    """
    columns, touched = [], F.size("removed") > 0
    for name in docs.columns:
        own = F.col("row").getField(name)
        if name == "text":
            own = F.when(touched, _kept_text()).otherwise(own)
        elif name == "n_chars":
            own = F.when(touched, F.length(_kept_text()).cast(docs.schema[name].dataType.simpleString())).otherwise(own)
        columns.append(own.alias(name))
    return _with_removed(docs).select(*columns)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that stays, for every row.

    A null text counts as empty: one line without words, which stays.  Lines without words always stay.  Lines at one place
    (rows that repeat a doc_id) are not later than each other and both stay, unless an earlier place matches.
    An empty table gives no rows; only doc_id and text are read.
    """
    kept = F.when(F.size("removed") > 0, _kept_text()).otherwise(F.coalesce(F.col("row.text"), F.lit("")))
    return _with_removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select(
        "row.doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
        F.sha2(kept, 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, generate_series(1, len(string_split(coalesce(text, ''), chr(10)))) g(i)),
w AS (SELECT doc_id, line_no, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line),
  '[\x00-/:-@\[-`{-\x7F]+'), lambda x: x <> ''))) AS words FROM l),
e AS (SELECT words, min(struct_pack(d := doc_id, n := line_no)) AS place, row_number() OVER () AS e FROM w WHERE len(words) > 0 GROUP BY words),
t AS (SELECT e, unnest(words) AS word FROM e WHERE len(words) >= 4),
c AS (SELECT word, count(*) AS n FROM t GROUP BY word),
r AS (SELECT t.e, t.word, row_number() OVER (PARTITION BY t.e ORDER BY c.n, t.word) AS at FROM t JOIN c USING (word)),
p AS (SELECT r.e, r.word FROM r JOIN e USING (e) WHERE r.at <= len(e.words) // 5 + 1),
m AS (SELECT DISTINCT a.e AS one, b.e AS two FROM p a JOIN p b ON a.word = b.word AND a.e < b.e),
v AS (SELECT CASE WHEN x.place < y.place THEN y.e WHEN y.place < x.place THEN x.e END AS e FROM m
  JOIN e x ON x.e = m.one JOIN e y ON y.e = m.two
  WHERE 5 * least(len(x.words), len(y.words)) >= 4 * greatest(len(x.words), len(y.words))
    AND 9 * len(list_intersect(x.words, y.words)) >= 4 * (len(x.words) + len(y.words))),
f AS (SELECT w.doc_id, w.line_no, w.line, e.e IS NOT NULL AND (e.e IN (SELECT e FROM v WHERE e IS NOT NULL)
  OR struct_pack(d := w.doc_id, n := w.line_no) > e.place) AS gone FROM w LEFT JOIN e ON e.words = w.words AND len(w.words) > 0)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY line_no), '')) AS kept_sha256
FROM f GROUP BY doc_id"""
