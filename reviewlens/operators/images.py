"""Product images: lookup from review files, exact and loose matching, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import fixed_values as fixed
from reviewlens.functions import names
from reviewlens.functions.images import best_url
from reviewlens.functions.text import has_all, strip
from reviewlens.operators.joins import lookup_join
from reviewlens.runtime import materialise


def image_lookup(rows: DataFrame) -> DataFrame:
    """Unique (key, url, ord) from (source_rank, row_ord, name, imageURLs).

    Inside one source the first row of a name counts, even when none of its
    addresses is usable.  Each name gives two keys; the earliest writer of a key wins.
    """
    first = (rows.filter(F.col("name").isNotNull() & F.col("imageURLs").isNotNull())
             .groupBy("source_rank", "name")
             .agg(F.min_by("imageURLs", "row_ord").alias("imageURLs"), F.min("row_ord").alias("row_ord")))
    usable = first.withColumn("url", best_url(F.col("imageURLs"))).filter(F.length("url") > 0)
    shown = usable.withColumn("shown", names.display_name(F.col("name")))
    keys = F.posexplode(F.array(F.lower("shown"), names.image_key(F.col("shown"))))
    entries = shown.select("url", "source_rank", "row_ord", keys.alias("form", "key"))
    order = F.struct("source_rank", "row_ord", "form")
    return entries.groupBy("key").agg(F.min_by("url", order).alias("url"), F.min(order).alias("ord"))


def alias_table(spark, aliases: dict[str, list[str]] = fixed.IMAGE_ALIASES) -> DataFrame:
    """(target_pos, target_key, source_pos, source_keys) of the alias list."""
    rows = [(i, target, j, source) for i, (target, sources) in enumerate(aliases.items())
            for j, source in enumerate(sources)]
    table = spark.createDataFrame(rows, "target_pos int, target string, source_pos int, source string")
    return table.select("target_pos", names.image_key(F.col("target")).alias("target_key"), "source_pos",
                        F.array(names.image_key(F.col("source")), F.lower(names.display_name(F.col("source"))))
                        .alias("source_keys"))


def add_aliases(lookup: DataFrame, aliases: dict[str, list[str]] = fixed.IMAGE_ALIASES) -> DataFrame:
    """Give names without an image the image of their first alias that has one.

    Aliases are filled in list order and a filled one can serve a later one.  Only
    the entries the fixed alias list mentions are read back, never the lookup itself.
    """
    spark = lookup.sparkSession
    table = alias_table(spark, aliases).orderBy("target_pos", "source_pos").collect()  # the alias list
    mentioned = sorted({r["target_key"] for r in table} | {k for r in table for k in r["source_keys"]})
    known = {r["key"]: r["url"] for r in lookup.filter(F.col("key").isin(mentioned)).select("key", "url").collect()}
    added = []
    for r in table:
        if r["target_key"] in known:
            continue
        url = next((known[k] for k in r["source_keys"] if k in known), None)
        if url:
            known[r["target_key"]] = url
            added.append((r["target_key"], url, r["target_pos"]))
    if not added:
        return lookup
    fresh = spark.createDataFrame(added, "key string, url string, pos int")
    last = F.lit(2147483647)
    ordinal = lookup.schema["ord"].dataType
    order = F.struct(last.cast(ordinal["source_rank"].dataType).alias("source_rank"),
                     F.col("pos").cast(ordinal["row_ord"].dataType).alias("row_ord"), F.lit(0).alias("form"))
    return lookup.unionByName(fresh.select("key", "url", order.alias("ord")))


def exact_matches(products: DataFrame, lookup: DataFrame, id_col: str, match_empty: bool = False) -> DataFrame:
    """(id, image_url) by the first of eight keys that is in the lookup.

    Candidates are display name, cleaned name, raw name and family, each as written
    and as image key.  Many products share a key, so the distinct keys are looked up
    first and only keys with an image go on to the products.
    """
    candidates = [F.col("display_name"), names.display_name(F.col("name")), F.col("raw_product_name"),
                  F.col("product_family")]
    filled = [F.coalesce(c, F.lit("")) for c in candidates]
    keys = F.array(*[k for c in filled for k in (F.lower(strip(c)), names.image_key(c))])
    wanted = products.select(id_col, F.posexplode(keys).alias("pos", "key"))
    if not match_empty:
        wanted = wanted.filter(F.length("key") > 0)
    # a key is looked up once, whatever the number of products that share it
    known = materialise(wanted.select("key").distinct().join(lookup.select("key", "url"), "key"))
    hits = lookup_join(wanted, known, "key")
    return hits.groupBy(id_col).agg(F.min_by("url", "pos").alias("image_url"))


def confident(product_tokens: Column, image_tokens: Column, product_text: Column, shared: Column) -> Column:
    """Loose match rule: enough shared tokens, and agreement on the product family."""
    ratio = shared / F.greatest(F.lit(1), F.size(product_tokens))
    chain = ratio >= 0.65
    for words in reversed(fixed.IMAGE_FAMILY_WORDS):
        agrees = F.lit(True)
        for w in words:
            agrees = agrees & F.array_contains(image_tokens, w)
        chain = F.when(has_all(product_text, words), agrees).otherwise(chain)
    return (shared >= 3) & (ratio >= 0.45) & chain


def loose_matches(products: DataFrame, lookup: DataFrame, id_col: str) -> DataFrame:
    """(id, image_url) of the lookup name with most shared tokens, when the match is convincing.

    A match needs at least t = max(3, 45 % of the product's tokens) shared tokens.
    With the tokens of both sides in one global order, rare first, two names that
    share t tokens must meet within the first T-t+1 tokens of the product and the
    first L-2 tokens of the lookup name.  Only those prefixes are joined, so common
    words rarely take part, and no partner is dropped.  Names with equal token sets
    are matched once, whatever their number.
    """
    wanted = products.select(
        id_col, names.image_tokens(F.col("name")).alias("tokens"),
        F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("category", F.lit("")))).alias("text"))
    wanted = wanted.withColumn("tokens", F.array_sort("tokens")).filter(F.size("tokens") >= 3)
    offered = lookup.select(F.array_sort(names.image_tokens(F.col("key"))).alias("tokens"), "url", "ord").filter(
        F.size("tokens") >= 3)

    product_sets = wanted.select("tokens").distinct()
    image_sets = offered.groupBy("tokens").agg(F.min("ord").alias("ord"), F.min_by("url", "ord").alias("url"))
    token_use = materialise(image_sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("uses")))

    def ordered(sets: DataFrame) -> DataFrame:
        """Tokens of every set that occur in the lookup, rare first."""
        exploded = lookup_join(sets.select("tokens", F.explode("tokens").alias("token")), token_use, "token")
        return exploded.groupBy("tokens").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("uses", "token"))), lambda x: x["token"]).alias("known"))

    needed = F.greatest(F.lit(3), F.ceil(F.size("tokens") * F.lit(0.45) - F.lit(1e-9)).cast("int"))
    left = ordered(product_sets).withColumn("needed", needed).filter(F.size("known") >= F.col("needed"))
    left = left.select("tokens", "needed", F.explode(F.slice(
        F.col("known"), F.lit(1), F.size("known") - F.col("needed") + 1)).alias("token"))
    right = ordered(image_sets.select("tokens")).join(image_sets, "tokens").select(
        F.col("tokens").alias("image_tokens"), "url", "ord",
        F.explode(F.slice(F.col("known"), F.lit(1), F.size("known") - 2)).alias("token"))
    # A pair that meets on several tokens is checked for each; taking the best ignores the repeats.
    scored = left.join(right, "token").withColumn(
        "shared", F.size(F.array_intersect("tokens", "image_tokens"))).filter(F.col("shared") >= F.col("needed"))
    best = scored.groupBy("tokens").agg(F.min_by(
        F.struct("image_tokens", "url", "shared"), F.struct((-F.col("shared")).alias("s"), "ord")).alias("b"))
    matched = wanted.join(best, "tokens")
    return matched.filter(confident(F.col("tokens"), F.col("b.image_tokens"), F.col("text"), F.col("b.shared"))).select(
        id_col, F.col("b.url").alias("image_url"))


def product_images(products: DataFrame, lookup: DataFrame, id_col: str) -> DataFrame:
    """Add ``image_url``: the exact match, else a convincing loose match, else an empty string."""
    exact = materialise(exact_matches(products, lookup, id_col))
    rest = products.join(exact, id_col, "left_anti")
    found = exact.unionByName(loose_matches(rest, lookup, id_col))
    return products.join(found, id_col, "left").withColumn("image_url", F.coalesce("image_url", F.lit("")))
