"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a tree of levels (for example domain, language, source).  A token budget runs down the
tree: each node's children share what it has by their weights, none beyond its capacity (the tokens below it times
the most epochs).  What a child cannot take goes to its siblings, and only what all siblings cannot take stays with
the parent, whose own siblings get it.  Since a node's share is bounded by the capacity below it, one pass from the
root gives this order.

A leaf's quota is taken from a sequence of epochs; each epoch is all its documents in an order drawn by a seeded hash.
So every document is taken once per whole epoch, and in the last epoch those up to a cut are taken once more.  The cut
is found from token sums of 4096 hash slots per leaf and from the order within one slot only: no leaf is
sorted, however large it is.

Weights are whole numbers and shares are rounded down, so that the result is exact and repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.runtime import materialise

NONE = "(none)"
MOST_EPOCHS = 4
SEED = 17


def token_count(text: Column) -> Column:
    """Runs of anything but white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _level(i: int) -> str:
    return f"__level{i}"


def leaf_columns(levels: list[Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit(NONE)).alias(_level(i)) for i, c in enumerate(levels)]


def _weight(depth: int, weights: dict[tuple[str, ...], int]) -> Column:
    """Weight of a node given by its path, 1 where none is given; a path may end in the node's own name only."""
    named = {k: v for k, v in weights.items() if len(k) == depth + 1}
    plain = {k[0]: v for k, v in weights.items() if len(k) == 1 and depth}
    found = F.lit(None).cast("long")
    if named:
        path = F.concat_ws("\x01", *[F.col(_level(i)) for i in range(depth + 1)])
        found = F.create_map(*[F.lit(x) for k, v in sorted(named.items()) for x in ("\x01".join(k), int(v))])[path].cast("long")
    if plain:
        found = F.coalesce(found, F.create_map(*[F.lit(x) for k, v in sorted(plain.items()) for x in (k, int(v))])[
            F.col(_level(depth))].cast("long"))
    return F.coalesce(found, F.lit(1).cast("long"))


def _share(nodes: DataFrame, depth: int, weights: dict[tuple[str, ...], int]) -> DataFrame:
    """``share`` of each node of its parent's ``budget``: water-filling by weight up to ``capacity``."""
    nodes = nodes.withColumn("weight", _weight(depth, weights)).withColumn(
        "capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)).cast("long"))
    parents = [F.lit(0), *[F.col(_level(i)) for i in range(depth)]]
    fill = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(0.0))
    order = Window.partitionBy(*parents).orderBy("fill", _level(depth))
    nodes = nodes.withColumn("fill", fill)
    nodes = nodes.withColumn("below", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("above", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn("rank", F.row_number().over(order))
    # the water level if all nodes before this one are full
    nodes = nodes.withColumn("level", F.when(F.col("above") > 0, (F.col("budget") - F.col("below")).cast("double") / F.col("above").cast("double")))
    full = F.col("capacity").cast("double") <= F.col("level") * F.col("weight").cast("double")
    first = F.min(F.when(~full, F.struct("rank", "level"))).over(Window.partitionBy(*parents))
    nodes = nodes.withColumn("level", first["level"])
    share = F.when(F.col("level").isNull(), F.col("capacity")).otherwise(
        F.least(F.col("capacity"), F.floor(F.col("level") * F.col("weight").cast("double")).cast("long")))
    return nodes.withColumn("share", F.greatest(share, F.lit(0).cast("long")))


def leaf_quotas(rows: DataFrame, depth: int, weights: dict[tuple[str, ...], int], budget_share: float, most_epochs: int) -> DataFrame:
    """__level…, tokens, quota of each leaf; ``rows`` has __level… and __tokens."""
    names = [_level(i) for i in range(depth)]
    leaves = materialise(rows.groupBy(*names).agg(F.sum("__tokens").alias("tokens")))
    budget = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(budget_share))).cast("long").alias("budget")).first()[0]
    above = None
    for i in range(depth):
        own = names[:i + 1]
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * most_epochs).alias("capacity"))
        nodes = nodes.withColumn("budget", F.lit(budget)) if above is None else nodes.join(above, own[:-1])
        above = _share(nodes, i, weights).select(*own, F.col("share").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "quota"), names)


def _key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(NONE))).cast("binary"))


def plan(rows: DataFrame, depth: int, weights: dict[tuple[str, ...], int], budget_share: float, most_epochs: int, seed: int) -> DataFrame:
    """Per leaf: __level…, __whole (whole epochs) and __cut (key up to which the epoch after them is taken)."""
    names = [_level(i) for i in range(depth)]
    leaves = leaf_quotas(rows, depth, weights, budget_share, most_epochs).withColumn(
        "__whole", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(0)).cast("long"))
    leaves = materialise(leaves.withColumn("rest", F.col("quota") - F.col("__whole") * F.col("tokens")))
    keyed = rows.join(leaves.where("rest > 0").select(*names, "__whole", "rest"), names).withColumn(
        "key", _key(F.col("__whole"), F.col("__id"), seed)).withColumn("slot", F.substring("key", 1, 3))
    slots = keyed.groupBy(*names, "rest", "slot").agg(F.sum("__tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*names).orderBy("slot")) - F.col("n")
    # the slot in which the rest runs out
    split = materialise(slots.withColumn("before", before).where("before <= rest and before + n > rest").select(*names, "slot", "before"))
    order = Window.partitionBy(*names).orderBy("key")
    taken = keyed.join(split, [*names, "slot"]).withColumn("upto", F.col("before") + F.sum("__tokens").over(order)).where(
        "upto <= rest").groupBy(*names).agg(F.max("key").alias("last"))
    cuts = split.join(taken, names, "left").select(*names, F.coalesce("last", "slot").alias("__cut"))
    return materialise(leaves.join(cuts, names, "left").select(*names, "__whole", F.coalesce("__cut", F.lit("")).alias("__cut")))


def with_copies(docs: DataFrame, levels: list[Column], weights: dict[tuple[str, ...], int], budget_share: float = 1.0,
                most_epochs: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with __copies, the number of times each row is taken (0 and up), in place of a column of that name.

    ``levels`` are columns of ``docs`` from the root's children to the leaves; null is a node of its own.
    ``weights`` maps a node's path, or its name alone, to a whole number; other nodes weigh 1 among their siblings, and a weight of 0
    takes nothing.  A leaf without tokens has no quota and its documents are not taken; documents without tokens
    follow their leaf.  Rows that repeat a doc_id are taken together.  An empty table gives no rows.
    """
    found = _taken(docs, levels, weights, budget_share, most_epochs, seed)
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "__copies"], F.col("copies").alias("__copies"))


def _taken(docs: DataFrame, levels: list[Column], weights: dict[tuple[str, ...], int], budget_share: float = 1.0,
           most_epochs: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """row (all columns of ``docs``, whatever their names) and copies."""
    depth = len(levels)
    rows = materialise(docs.select(docs["doc_id"].cast("string").alias("__id"), *leaf_columns(levels), token_count(docs["text"]).alias("__tokens")))
    leaves = plan(rows, depth, weights, budget_share, most_epochs, seed)
    keyed = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"), *leaf_columns(levels))
    joined = keyed.join(leaves, [_level(i) for i in range(depth)], "left")
    last = _key(F.col("__whole"), F.col("row").getField("doc_id"), seed) <= F.col("__cut")
    copies = F.coalesce(F.col("__whole") + F.when(last, F.lit(1)).otherwise(F.lit(0)), F.lit(0)).cast("long")
    return joined.select("row", copies.alias("copies"))


def mix(docs: DataFrame, levels: list[Column], weights: dict[tuple[str, ...], int], **settings) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken, with its own columns."""
    found = _taken(docs, levels, weights, **settings).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])


def domain_of(source: Column) -> Column:
    """Domain of a source name: a stand-in by its last character, as the given tables name none."""
    last = F.substring(source, -1, 1)
    return F.when(last.isin("0", "1", "2", "3"), "web").when(last.isin("4", "5", "6"), "books").when(source.isNotNull(), "code")


#: Target weights of the registered query, in parts among siblings.
WEIGHTS = {("web",): 50, ("books",): 30, ("code",): 20, ("en",): 60, ("de",): 15, ("fr",): 15, ("es",): 10}


def mixing_report(docs: DataFrame, weights: dict[tuple[str, ...], int] | None = None, **settings) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    found = with_copies(docs, [domain_of(F.col("source")), F.col("lang"), F.col("source")], WEIGHTS if weights is None else weights, **settings)
    return found.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source",
                        token_count(F.col("text")).alias("n_tokens"), F.col("__copies").alias("copies"))


def _oracle_level(name: str, source: str, parents: list[str], own: str) -> str:
    part = f"PARTITION BY {', '.join(parents)} " if parents else ""
    weight = ("CASE " + " ".join(f"WHEN {own} = '{k[0]}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1 END")
    keys = ", ".join([*parents, own])
    join = f"JOIN {source} b USING ({', '.join(parents)})" if parents else f"CROSS JOIN {source} b"
    return f"""
{name}_n AS (SELECT {keys}, any_value(b.budget) AS budget, sum(l.tokens) * {MOST_EPOCHS} AS cap, {weight} AS w FROM leaf l {join} GROUP BY {keys}),
{name}_w AS (SELECT *, row_number() OVER o AS rk,
  CAST(budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM {name}_n WINDOW o AS ({part}ORDER BY cap::DOUBLE / w::DOUBLE, {own})),
{name}_f AS (SELECT *, min(CASE WHEN cap::DOUBLE > lev * w THEN rk END) OVER ({part}) AS fr FROM {name}_w),
{name}_l AS (SELECT *, max(CASE WHEN rk = fr THEN lev END) OVER ({part}) AS fl FROM {name}_f),
{name} AS (SELECT {keys}, CASE WHEN fl IS NULL THEN cap ELSE least(cap, CAST(floor(fl * w) AS BIGINT)) END AS budget FROM {name}_l)"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN right(source, 1) IN ('0', '1', '2', '3') THEN 'web'
    WHEN right(source, 1) IN ('4', '5', '6') THEN 'books' WHEN source IS NOT NULL THEN 'code' END AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) AS n_tokens FROM documents),
k AS (SELECT *, coalesce(domain, '{NONE}') AS a, coalesce(lang, '{NONE}') AS b, coalesce(source, '{NONE}') AS c FROM d),
leaf AS (SELECT a, b, c, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM k GROUP BY a, b, c),
root AS (SELECT CAST(sum(tokens) AS BIGINT) AS budget FROM leaf),
{_oracle_level('one', 'root', [], 'a')},
{_oracle_level('two', 'one', ['a'], 'b')},
{_oracle_level('three', 'two', ['a', 'b'], 'c')},
q AS (SELECT a, b, c, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
  budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM three JOIN leaf USING (a, b, c)),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY a, b, c ORDER BY md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '{NONE}'))) AS upto
  FROM k JOIN q USING (a, b, c))
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o"""
