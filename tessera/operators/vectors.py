"""Element-wise sums and means of vectors over any axes of a table, with partial results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import not_nan

#: Positions that one aggregation holds; longer vectors are cut into slices, a row for each.
SLICE = 64


def _position(array: Column, i: int) -> Column:
    return not_nan(F.get(array, F.lit(i)))


def sums(df: DataFrame, array: str, width: int, *by: str) -> DataFrame:
    """(by, sums, counts): by position, the sum of the values that are neither null nor NaN, and their number.

    Each task adds up its own vectors before the shuffle, which then carries a row for each group and task, of 2 * width
    numbers. A vector of up to SLICE positions is never exploded; a shorter one has nulls at its end.
    """
    slices = -(-width // SLICE)
    each, own = min(width, SLICE), F.col(array)
    if slices == 1:
        rows = df.select(*by, own.alias("_w"), F.lit(0).alias("_slice"))
    else:
        rows = df.select(*by, F.posexplode(F.array(*[F.slice(own, k * SLICE + 1, SLICE) for k in range(slices)])).alias("_slice", "_w"))
    parts = rows.groupBy(*by, "_slice").agg(
        F.array(*[F.sum(_position(F.col("_w"), i)) for i in range(each)]).alias("sums"), F.array(*[F.count(_position(F.col("_w"), i)) for i in range(each)]).alias("counts")
    )
    if slices == 1:
        return parts.drop("_slice")
    order = F.array_sort(F.collect_list(F.struct("_slice", "sums", "counts")))
    joined = parts.groupBy(*by).agg(order.alias("_parts"))
    whole = lambda name: F.slice(F.flatten(F.transform("_parts", lambda p: p[name])), 1, width).alias(name)
    return joined.select(*by, whole("sums"), whole("counts"))


def merged(partial: DataFrame, width: int, axes: Sequence[Sequence[str]], *keys: str) -> DataFrame:
    """(keys, level, sums, counts) for each set of axes that stays, from sums() by all keys; keys that go are null.

    Level has a bit for each key that went, the last key's the lowest. Only the sums of the finest groups are expanded,
    never the vectors.
    """
    add = lambda name: F.array(*[F.sum(F.get(F.col(name), F.lit(i))) for i in range(width)]).alias(name)
    sets = [[F.col(k) for k in own] for own in axes]
    return partial.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.grouping_id().alias("level"), add("sums"), add("counts"))


def means(summed: DataFrame, width: int) -> DataFrame:
    """summed with means (by position) and mean (over all positions alike) in place of sums and counts; null where nothing was counted."""
    at = lambda name, i: F.get(F.col(name), i)
    by_position = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_divide(at("sums", i), at("counts", i)))
    total = lambda name, kind: F.aggregate(name, F.lit(0).cast(kind), lambda a, x: a + F.coalesce(x, F.lit(0).cast(kind)))
    return summed.withColumns({"means": by_position, "mean": F.try_divide(total("sums", "double"), total("counts", "long"))}).drop("sums", "counts")


def axis_means(df: DataFrame, array: str, width: int, axes: Sequence[Sequence[str]], *keys: str) -> DataFrame:
    """(keys, level, means, mean) for each set of keys in axes, in one pass over df."""
    return means(merged(sums(df, array, width, *keys), width, axes, *keys), width)
