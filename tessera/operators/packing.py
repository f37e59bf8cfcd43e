"""First-fit-decreasing packing of items into bins of a fixed capacity.

Greedy packing is sequential, so rows are cut into slices of consecutive positions and each slice is packed by one
task; memory is bounded by the slice. No bin exceeds the capacity.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import position

SLICE = 50_000


class Rooms:
    """Free room of bins in a tournament tree: the first bin with enough of it, in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        at = 1
        while at < self.leaves:
            at = 2 * at if self.best[2 * at] >= size else 2 * at + 1
        self.best[at] -= size
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            self.best[at] = max(self.best[2 * at], self.best[2 * at + 1])
        return leaf


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each item. Ties keep the input's order. Oversize items are the caller's to remove."""
    rooms, filled, out = Rooms(max(1, len(sizes)), capacity), {}, [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if sizes[i] > capacity:
            raise ValueError(f"item of {sizes[i]} in bins of {capacity}")
        b = rooms.take(sizes[i])
        filled[b] = filled.get(b, -1) + 1
        out[i] = (b, filled[b])
    return out


def pack(df: DataFrame, key: str, size: str, capacity: int, slice_rows: int = SLICE, isolate: bool = False, ranges: int | None = None) -> DataFrame:
    """(key, size, slice, bin, pos, bin_id). Oversize items get bins of their own if ``isolate``, else an error."""
    items = position(df.select(F.col(key).cast("long").alias("key"), F.col(size).cast("long").alias("size")), "key", name="rn", ranges=ranges).withColumn("slice", F.floor(F.col("rn") / slice_rows).cast("long"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rn")
        big = rows["size"] > capacity
        if big.any() and not isolate:
            raise ValueError(f"items over the capacity of {capacity}: {rows['key'][big].tolist()[:5]}")
        fit = rows[~big].copy()
        placed = first_fit_decreasing(fit["size"].tolist(), capacity)
        fit["bin"], fit["pos"] = [b for b, _ in placed], [p for _, p in placed]
        alone = rows[big].copy()
        start = int(fit["bin"].max()) + 1 if len(fit) else 0
        alone["bin"], alone["pos"] = range(start, start + len(alone)), 0
        out = pd.concat([fit, alone])
        return out[["key", "size", "slice", "bin", "pos"]].astype("int64")

    packed = items.groupBy("slice").applyInPandas(one, "key long, size long, slice long, bin long, pos long")
    return packed.withColumn("bin_id", F.concat_ws("-", "slice", "bin")).withColumnsRenamed({"key": key, "size": size})


def pack_stats(packed: DataFrame, size: str) -> DataFrame:
    """One row: bins, items, greatest, least and mean items of a bin, and the greatest load."""
    bins = packed.groupBy("bin_id").agg(F.count(F.lit(1)).alias("items"), F.sum(size).alias("load"))
    return bins.agg(F.count(F.lit(1)).alias("bins"), F.sum("items").alias("items"), F.max("items").alias("most"), F.min("items").alias("least"), F.avg("items").alias("mean"), F.max("load").alias("load"))


def gather(packed: DataFrame, items: DataFrame, key: str, value: str) -> DataFrame:
    """The values of each bin, in placement order."""
    joined = packed.join(items.select(key, value), key)
    return joined.groupBy("bin_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("values"))
