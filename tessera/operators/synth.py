"""Composed grids of labelled items and the questions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonx import salted
from . import stats as ST

#: The corners of a 2 x 2 grid.
CORNERS = (("top", "left"), ("top", "right"), ("bottom", "left"), ("bottom", "right"))


def most_grids(units: DataFrame, classes: int) -> int:
    """The greatest number of grids of that many different classes; units: (label, u), u uses of each class.

    With j classes used in every grid, the others must fill the rest: the least of (uses without the j greatest classes)
    // (classes - j) over j. Only the greatest classes and one sum come to the driver.
    """
    total = units.agg(F.sum("u").alias("u")).first()["u"] or 0
    top = [r["u"] for r in units.orderBy(F.desc("u")).limit(classes).collect()]
    top += [0] * (classes - len(top))
    return min((total - sum(top[:j])) // (classes - j) for j in range(classes))


def compose(df: DataFrame, key: str, label: str, rows: int = 2, cols: int = 2, per_class: int = 1, seed: str = "grid") -> DataFrame:
    """(grid, row, col, key, label): each grid holds rows*cols/per_class different classes, per_class items of each.

    As many grids are made as any drawing without replacement can make. Uses of the classes are laid one behind the
    other, each class at most once for each grid, and dealt round the grids: so no grid has a class twice and all are
    full. Which items of a class are used, and where they stand in their grid, goes by hash. Items of a class are
    numbered in ranges, so one class may hold most of them. Writes its tables while the plan is built.
    """
    area = rows * cols
    if area % per_class:
        raise ValueError("items of a class must divide the grid")
    classes = area // per_class
    items = df.select(key, label).where(F.col(label).isNotNull())
    units = items.groupBy(label).agg(F.floor(F.count(F.lit(1)) / per_class).cast("long").alias("u"))
    grids = most_grids(units, classes)
    taken = ST.numbered(units.withColumn("u", F.least("u", F.lit(grids).cast("long"))).where("u > 0"), [label], weight=F.col("u"), name="_offset")
    drawn = ST.numbered(items.withColumn("_h", salted(seed, F.col(key))), ["_h", key], label, name="_rank").withColumn("_use", F.floor(F.col("_rank") / per_class))
    used = drawn.join(taken.withColumnRenamed(label, "_label"), F.col(label) == F.col("_label")).where(F.col("_use") < F.col("u"))
    placed = used.withColumn("_at", F.col("_offset") + F.col("_use")).where(F.col("_at") < F.lit(classes * grids)).withColumn("grid", (F.col("_at") % F.lit(max(1, grids))).cast("long"))
    cell = Window.partitionBy("grid").orderBy(salted(seed + "p", F.col(key)), key)
    out = placed.withColumn("_i", F.row_number().over(cell) - 1)
    return out.select("grid", F.floor(F.col("_i") / cols).cast("int").alias("row"), (F.col("_i") % cols).cast("int").alias("col"), key, label)


def corner_questions(df: DataFrame, *keys: str) -> DataFrame:
    """Four rows for each grid, one for each corner, with its question."""
    corners = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(h).alias("h")) for v, h in CORNERS])
    return df.select(*keys, F.explode(corners).alias("c")).select(*keys, "c.v", "c.h", F.concat(F.lit("What is in the "), F.col("c.v"), F.lit(" "), F.col("c.h"), F.lit(" corner?")).alias("question"))


def label_text(label: Column, names: list[str]) -> Column:
    """The name of a label; null out of range."""
    return F.get(F.array(*map(F.lit, names)), label.cast("int"))


def remap_answer(answer: Column, mapping: Column) -> Column:
    """The first letter of the mapped text if the answer is an index, else the answer's own first letter."""
    return F.coalesce(F.substring(F.get(mapping, answer.try_cast("int")), 1, 1), F.substring(answer, 1, 1))
