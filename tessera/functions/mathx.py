"""Arithmetic with the rounding and clamping that media measures need, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Side of a patch cell, and the pixel and frame bounds.
FACTOR = 28
IMAGE_PIXELS = (FACTOR * FACTOR * 64, FACTOR * FACTOR * 2048)
VIDEO_PIXELS = (FACTOR * FACTOR * 64, FACTOR * FACTOR * 512)
FRAMES = (4, 420)
TEMPORAL = 2


def round_to(x: Column, factor: int = FACTOR) -> Column:
    """Nearest multiple; a half goes to the even one."""
    return F.rint(x / F.lit(float(factor))) * factor


def ceil_to(x: Column, factor: int = FACTOR) -> Column:
    return F.ceil(x / F.lit(float(factor))) * factor


def floor_to(x: Column, factor: int = FACTOR) -> Column:
    return F.floor(x / F.lit(float(factor))) * factor


def smart_resize(h: Column, w: Column, bounds: tuple[int, int], factor: int = FACTOR) -> tuple[Column, Column]:
    """(height, width) as multiples of factor with an area within bounds, keeping the aspect ratio.

    No side falls below factor, so the area of an image of extreme sides may exceed the upper bound.
    """
    low, high = bounds
    h, w = h.cast("double"), w.cast("double")
    least = F.lit(float(factor))
    rh, rw = F.greatest(least, round_to(h, factor)), F.greatest(least, round_to(w, factor))
    shrink, grow = F.sqrt(h * w / F.lit(float(high))), F.sqrt(F.lit(float(low)) / (h * w))
    too_big, too_small = rh * rw > high, rh * rw < low
    pick = lambda side, rounded: F.when(too_big, F.greatest(least, floor_to(side / shrink, factor))).when(too_small, ceil_to(side * grow, factor)).otherwise(rounded).cast("long")
    return pick(h, rh), pick(w, rw)


def image_tokens(h: Column, w: Column, bounds: tuple[int, int] = IMAGE_PIXELS) -> Column:
    rh, rw = smart_resize(h, w, bounds)
    return F.expr("bigint(1)") * (rh / FACTOR).cast("long") * (rw / FACTOR).cast("long")


def frame_count(seconds: Column, interval: float = 1.0, bounds: tuple[int, int] = FRAMES) -> Column:
    clamped = F.least(F.greatest(F.rint(seconds / F.lit(interval)), F.lit(float(bounds[0]))), F.lit(float(bounds[1])))
    return F.when(seconds.isNotNull(), clamped).cast("long")  # least and greatest skip nulls


def frame_index(i: Column, total: Column, n: Column) -> Column:
    """The i-th of n whole positions from 0 to total - 1, evenly spread; the step is computed first and the last point forced."""
    step = (total - 1).cast("double") / (n - 1)
    return F.when(i == n - 1, total - 1).otherwise(F.floor(i * step)).cast("long")


def frame_indices(total: Column, n: Column) -> Column:
    """n positions, see frame_index()."""
    several = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: frame_index(i, total, n))
    return F.when(n == 1, F.array(F.lit(0).cast("long"))).otherwise(several)


def video_tokens(h: Column, w: Column, frames: Column, bounds: tuple[int, int] = VIDEO_PIXELS, temporal: int = TEMPORAL) -> Column:
    rh, rw = smart_resize(h, w, bounds)
    return F.floor((rh / FACTOR).cast("long") * (rw / FACTOR).cast("long") * frames / temporal).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100
