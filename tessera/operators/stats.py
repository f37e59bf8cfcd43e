"""Statistics over weights and measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

def not_nan(x: Column) -> Column:
    return F.nullif(x.cast("double"), F.lit(float("nan")))


def nan_mean(x: Column) -> Column:
    return F.avg(not_nan(x))


def quantile_band(x: Column, low: float = 0.25, high: float = 0.75) -> tuple[Column, Column]:
    """Exact quantiles with linear interpolation, NaN left out."""
    p = F.percentile(not_nan(x), F.array(F.lit(low), F.lit(high)))
    return p[0], p[1]


def unpivot_positions(df: DataFrame, array: str, *keys: str) -> DataFrame:
    """(keys, pos, w): one row for each element, a generator without a shuffle."""
    return df.select(*keys, F.posexplode(array).alias("pos", "w"))


def quadrant(pos: Column, side: int = 8) -> Column:
    """Quadrant of a position in a square patch, row by row: 0 and 1 above, 2 and 3 below."""
    half = side // 2
    return 2 * (F.floor(pos / side) >= half).cast("int") + (pos % side >= half).cast("int")


def share(x: Column, *by: str) -> Column:
    return x / F.sum(x).over(Window.partitionBy(*by))


def _same(left: str, right: str, *by: str) -> Column:
    on = F.lit(True)
    for c in by:
        on &= F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return on


def numbered(df: DataFrame, order: Sequence[str], *by: str, weight: Column | None = None, name: str = "before") -> DataFrame:
    """df with the weight (1 for each row unless given) of the rows of a group that stand before a row in an order.

    Rows are dealt to ranges of (by, order) and written once; they are summed within a range and shifted by the ranges
    below, so no task sorts a whole group. Rows of equal places must be equal, or the order among them is open. Writes
    its table while the plan is built.
    """
    own = F.lit(1) if weight is None else weight
    placed = materialize(df.withColumn("_weight", own.cast("long")).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    below = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy(*by, "_range").agg(F.sum("_weight").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    return summed.alias("a").join(shift.alias("s"), _same("a", "s", *by, "_range")).select(*[f"a.`{c}`" for c in df.columns], (F.col("_inside") + F.col("_shift")).alias(name))


def cumulative(df: DataFrame, x: str, *by: str, n: Column | None = None) -> DataFrame:
    """(by, x, n, before): the distinct values of each group, how many rows have them and how many have a lesser one.

    Counts are made with partial results and numbered() as above. n: the rows that a row of df stands for.
    """
    counts = df.groupBy(*by, x).agg(F.sum(F.lit(1) if n is None else n).alias("n"))
    return numbered(counts, [x], *by, weight=F.col("n"))


def average_ranks(df: DataFrame, x: str, name: str, *by: str) -> DataFrame:
    """Ranks in which ties share their mean."""
    ranks = cumulative(df, x, *by).select(*by, x, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return df.alias("d").join(ranks.alias("r"), _same("d", "r", *by, x)).select("d.*", name)


#: A sketch has GRID steps of equal shares, each right to a tenth of a step. A bracket is BRACKET steps wide; one of more
#: than INSIDE rows is narrowed by another sketch of what lies in it.
GRID, BRACKET, INSIDE = 250, 6, 2_000_000


def quantiles(df: DataFrame, x: str, shares: dict[str, float], *by: str) -> DataFrame:
    """(by, a column for each of shares): exact quantiles with linear interpolation; null and NaN are left out.

    Selection by histograms, for all groups and shares at once: a sketch brackets each quantile between two values, a
    second pass counts the rows below a bracket and those of each value in it, and the quantile is picked from these.
    Groups of more than INSIDE * GRID / BRACKET rows take a pass more for each factor of GRID / BRACKET. Whether a
    bracket holds its quantile is checked; one that doesn't takes the whole range. Runs its passes while the plan is built.
    """
    rows, grid = df.select(*by, not_nan(F.col(x)).alias("_x")).where("_x is not null"), [i / GRID for i in range(GRID + 1)]
    sketch = lambda v: F.percentile_approx(v, grid, 10 * GRID).alias("steps")
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), sketch(F.col("_x")))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("rows") - 1)).alias("place")) for k, p in enumerate(shares.values())]))
    brackets = _bracket(whole.select(*by, "rows", "steps", F.lit(0).cast("long").alias("under"), wanted.alias("w")).select(*by, "w.*", "rows", "steps", "under"), *by)
    while (brackets.agg(F.max("rows")).first()[0] or 0) > INSIDE:
        inside = ~F.col("below")
        narrow = _hits(rows, brackets, *by).groupBy(*by, "k").agg(F.count_if("below").alias("under"), F.count_if(inside).alias("rows"), sketch(F.when(inside, F.col("_x"))))
        again = brackets.alias("b").join(narrow.alias("n"), _same("b", "n", *by, "k"))
        brackets = _bracket(again.select(*[f"b.{c}" for c in by], "b.k", "b.place", "n.rows", "n.steps", "n.under", F.col("b.lo").alias("was_lo"), F.col("b.hi").alias("was_hi")), *by)
    found = _counted(rows, brackets, *by)
    if not found.where("missed").isEmpty():
        everything = brackets.withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("inf"))})
        found = _counted(rows, everything, *by)
    at = lambda k, name: F.max(F.when(F.col("k") == k, F.col(name)))
    return found.groupBy(*by).agg(*[F.when(at(k, "part") == 0, at(k, "low")).otherwise(at(k, "low") + (at(k, "high") - at(k, "low")) * at(k, "part")).alias(name) for k, name in enumerate(shares)])


def _bracket(sketched: DataFrame, *by: str) -> DataFrame:
    """(by, k, place, lo, hi, rows): steps some way to both sides of a place, and about how many rows lie between."""
    step = (F.col("place") - F.col("under")) / F.greatest(F.lit(1), F.col("rows") - 1) * GRID
    at = lambda k: F.get("steps", F.greatest(F.lit(0), F.least(F.lit(GRID), k.cast("int"))))
    chosen = sketched.withColumns({"lo": at(F.floor(step) - BRACKET // 2), "hi": at(F.ceil(step) + BRACKET // 2)})
    narrower = F.col("lo") < F.col("hi")
    if "was_lo" in sketched.columns:  # between values that most of the rows share, a bracket gets no narrower
        narrower &= (F.col("lo") > F.col("was_lo")) | (F.col("hi") < F.col("was_hi"))
    return materialize(chosen.select(*by, "k", "place", "lo", "hi", F.when(narrower, F.ceil(F.col("rows") * BRACKET / GRID)).otherwise(0).alias("rows")), "brackets")


def _hits(rows: DataFrame, brackets: DataFrame, *by: str) -> DataFrame:
    """(by, k, below, _x): each row once for each bracket that it lies in or below of."""
    packed = brackets.groupBy(*by).agg(F.collect_list(F.struct("k", "lo", "hi")).alias("_brackets"))  # a row for each group, with an entry for each share
    joined = rows.alias("r").join(packed.alias("p"), _same("r", "p", *by))
    hit = F.explode(F.transform(F.filter("_brackets", lambda b: F.col("_x") <= b["hi"]), lambda b: F.struct(b["k"].alias("k"), (F.col("_x") < b["lo"]).alias("below"))))
    return joined.select(*[f"r.{c}" for c in by], "_x", hit.alias("h")).select(*by, "h.*", "_x")


def _counted(rows: DataFrame, brackets: DataFrame, *by: str) -> DataFrame:
    """(by, k, low, high, part, missed): the values at the two ranks round each place; missed if the bracket lacks one."""
    values = F.when(~F.col("below"), F.col("_x"))
    counts = _hits(rows, brackets, *by).groupBy(*by, "k", "below", values.alias("_x")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by, "k").orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).alias("a").join(brackets.alias("b"), _same("a", "b", *by, "k"))
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("_x")))
    place = F.col("place")
    out = own.groupBy(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.k").alias("k")).agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("part"))
    return materialize(out.withColumn("missed", F.col("low").isNull() | F.col("high").isNull()), "quantiles")


def pearson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, n, r) over rows that have both values."""
    rows = df.select(*by, not_nan(F.col(x)).alias("x"), not_nan(F.col(y)).alias("y")).where("x is not null and y is not null")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, n, r) over rows that have both values; ties share their mean rank.

    Equal pairs are counted once and written; ranks are joined to these. Writes its tables while the plan is built.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    pairs = materialize(pairs, "pairs")
    ranked = pairs.alias("p")
    for v in ("_x", "_y"):
        ranks = cumulative(pairs, v, *by, n=F.col("_n")).withColumn(f"_rank{v}", F.col("before") + (F.col("n") + 1) / 2).alias(v)
        ranked = ranked.join(ranks, _same("p", v, *by, v))
    a, b, n = F.col("_rank_x"), F.col("_rank_y"), F.col("_n")
    total = F.sum(n).alias("n")
    # Ranks have the mean (n + 1) / 2; products of ranks less that lose no digits.
    middle = pairs.groupBy(*by).agg(((F.sum("_n") + 1) / 2).alias("_middle"))
    own = ranked.join(middle.alias("m"), _same("p", "m", *by)).withColumns({"_a": a - F.col("_middle"), "_b": b - F.col("_middle")})
    sums = own.groupBy(*[F.col(f"p.{c}").alias(c) for c in by]).agg(total, F.sum(n * F.col("_a") * F.col("_b")).alias("_ab"), F.sum(n * F.col("_a") * F.col("_a")).alias("_aa"), F.sum(n * F.col("_b") * F.col("_b")).alias("_bb"))
    return sums.select(*by, "n", F.try_divide("_ab", F.sqrt(F.col("_aa") * F.col("_bb"))).alias("r"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def correlation_p(n: int, r: float) -> float | None:
    """Two-sided p-value of a correlation of n pairs."""
    if n is None or r is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)


def _p_values(n: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(None if pd.isna(a) else int(a), None if pd.isna(b) else float(b)) for a, b in zip(n, r, strict=True)], dtype="float64")


def significant(df: DataFrame, level: float = 0.05) -> DataFrame:
    """(.., n, r) with p, and r set to null where p is above the level. Runs over groups, after aggregation."""
    return df.withColumn("p", F.pandas_udf(_p_values, "double")("n", "r")).withColumn("r_significant", F.when(F.col("p") <= level, F.col("r")))
