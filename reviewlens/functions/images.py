"""Column functions over image URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions import fixed_values as fixed
from reviewlens.functions.text import has_any, strip


def usable_url(url: Column) -> Column:
    """A web address that is neither a barcode nor a thumbnail."""
    text = F.lower(url)
    return F.startswith(text, F.lit("http")) & ~has_any(text, fixed.BLOCKED_URL_MARKS)


def url_score(url: Column) -> Column:
    """Points for secure, well-known and large pictures."""
    text = F.lower(url)
    score = F.when(F.startswith(text, F.lit("https://")), 5).otherwise(0)
    for marks, points in fixed.URL_POINTS:
        score = score + F.when(has_any(text, marks), points).otherwise(0)
    numbers = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in fixed.URL_DIMENSION_PATTERNS])
    # More than nine digits is above the cap in any case and would not fit an integer.
    sizes = F.transform(numbers, lambda d: F.when(F.length(d) > 9, 2000).otherwise(d.try_cast("int")))
    largest = F.least(F.array_max(sizes), F.lit(2000))
    return score + F.coalesce(F.floor(largest / 10).cast("int"), F.lit(0))


def best_url(urls: Column) -> Column:
    """Best usable address of a comma-separated list, or an empty string."""
    items = F.filter(F.transform(F.split(F.coalesce(urls, F.lit("")), ","), strip), usable_url)
    ranked = F.transform(items, lambda u: F.struct(url_score(u).alias("score"), u.alias("url")))
    return F.coalesce(F.array_max(ranked)["url"], F.lit(""))
