"""Array functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: labels with it are not trained on.
IGNORE = -100


def insert_clamped(items: Column, index: int, value: Column) -> Column:
    """items with value at index; an index behind the end appends."""
    k = F.least(F.lit(index), F.size(items))
    return F.concat(F.slice(items, 1, k), F.array(value), F.slice(items, k + 1, F.size(items)))


def pad_to(items: Column, target: Column, value: Column, side: str = "right") -> Column:
    """items cut or padded to target; cut from the end that is padded."""
    fill = F.array_repeat(value, target - F.size(items))
    cut = F.slice(items, 1, target) if side == "right" else F.slice(items, F.size(items) - target + 1, target)
    padded = F.concat(items, fill) if side == "right" else F.concat(fill, items)
    return F.when(F.size(items) >= target, cut).otherwise(padded)


def mask_for(items: Column, target: Column, side: str = "right") -> Column:
    """1 where an item stands once items is padded to target, else 0."""
    n = F.least(F.size(items), target)
    ones, zeros = F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), target - n)
    return F.concat(ones, zeros) if side == "right" else F.concat(zeros, ones)


def unmasked(labels: Column, ignore: int = IGNORE) -> Column:
    return F.filter(labels, lambda x: x != ignore)


def between(items: Column, first, last) -> Column:
    """What stands between the first marker `first` and the first marker `last`."""
    a, b = F.array_position(items, first), F.array_position(items, last)
    return F.when((a > 0) & (b > a), F.slice(items, (a + 1).cast("int"), (b - a - 1).cast("int"))).otherwise(F.slice(items, 1, 0))


def zipped(a: Column, b: Column) -> Column:
    """Pairs of two arrays of one length; other lengths are an error."""
    return F.when(F.isnull(F.assert_true(F.size(a) == F.size(b), F.lit("arrays of unequal length"))), F.arrays_zip(a, b))


def pad_nan(items: Column, target: Column) -> Column:
    return F.concat(items, F.array_repeat(F.lit(float("nan")), target - F.size(items)))


def product(items: Column) -> Column:
    return F.aggregate(items, F.lit(1).cast("long"), lambda a, x: a * x)
