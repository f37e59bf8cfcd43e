"""Row steps of a curation pipeline: ids, shards, portions, filters with a report, verification, exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonx import salted
from ..functions.text import last_turn

Step = Callable[[DataFrame], DataFrame]


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The steps in turn, as one lazy plan."""
    for step in steps:
        df = df.transform(step)
    return df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over spark.sql.shuffle.partitions tasks by its keys, for steps in which a short row is much work: a small file is
    one task otherwise, and adaptive execution puts partitions of few bytes together where no number is given."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def position(df: DataFrame, key: str, split: str | None = None, name: str = "rn", ranges: int | None = None) -> DataFrame:
    """df with dense positions from 0 by (numeric) key, within each split.

    With ``ranges``, keys fall into that many ranges of about equal counts; positions are counted within a range and
    shifted by the counts of the ranges below, so no task sorts a whole split.
    """
    by = [split] if split else []
    if not ranges or ranges < 2:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(key)).cast("long") - 1)
    bounds = sorted(set(df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("b")).first()["b"] or []))
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    dealt = df.withColumn("_range", place)
    below = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(below), F.lit(0))).drop("_n")
    shift = shift.select(F.col("_range").alias("_r"), "_shift", *[F.col(c).alias(f"_s_{c}") for c in by])
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    within = Window.partitionBy(*by, "_range").orderBy(key)
    out = dealt.join(F.broadcast(shift) if not by else shift, same).withColumn(name, (F.row_number().over(within) - 1 + F.col("_shift")).cast("long"))
    return out.select(*df.columns, name)


def add_id(df: DataFrame, key: str, split: str | None = None, name: str = "id", drop_existing: bool = False, ranges: int | None = None) -> DataFrame:
    """An id column 0..n-1 for each split, unless there is one already."""
    if name in df.columns:
        if not drop_existing:
            return df
        df = df.drop(name) if name != key else df
    return position(df, key, split, name, ranges)


def head_portion(df: DataFrame, key: str, portion: float, ranges: int | None = None) -> DataFrame:
    """The first int(n * portion) rows by key."""
    total = df.agg(F.floor(F.count(F.lit(1)) * F.lit(portion)).alias("_top"))
    return position(df, key, name="_rn", ranges=ranges).crossJoin(F.broadcast(total)).where("_rn < _top").drop("_rn", "_top")


def shards(df: DataFrame, key: str, world: int, batch: int | None = None, keep_rest: bool = True, ranges: int | None = None) -> DataFrame:
    """Contiguous shards of n // world rows; the rest goes to the last shard, or is dropped. batch: numbers within a shard."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    out = position(df, key, name="_rn", ranges=ranges).crossJoin(F.broadcast(total))
    items = F.greatest(F.floor(F.col("_n") / world), F.lit(1)).cast("long")
    raw = F.floor(F.col("_rn") / items)
    out = out.withColumn("shard", (F.least(raw, F.lit(world - 1)) if keep_rest else raw).cast("long"))
    out = out if keep_rest else out.where(F.col("shard") < world)
    if batch:
        out = out.withColumn("batch", F.floor((F.col("_rn") - F.col("shard") * items) / batch).cast("long"))
    return out.drop("_rn", "_n")


def keep(df: DataFrame, **rules: Column) -> DataFrame:
    """Rows that pass every rule; native rules reach the scan."""
    for rule in rules.values():
        df = df.where(rule)
    return df


def filter_report(df: DataFrame, **rules: Column) -> DataFrame:
    """For each rule, in order: rows that reach it, rows it removes and their percentage; one pass."""
    total, aggregates, passed = F.count(F.lit(1)), [], F.lit(True)
    for k, rule in enumerate(rules.values()):
        ok = F.coalesce(rule, F.lit(False))
        aggregates += [F.count_if(passed).alias(f"in{k}"), F.count_if(passed & ~ok).alias(f"out{k}")]
        passed = passed & ok
    one = df.agg(total.alias("total"), *aggregates)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"in{k}").alias("rows_in"), F.col(f"out{k}").alias("removed")) for k, n in enumerate(rules)])
    return one.select(F.inline(rows)).select("rule", "rows_in", "removed", F.coalesce(F.try_divide(F.col("removed").cast("double"), F.col("rows_in").cast("double")), F.lit(0.0)).__mul__(100).alias("removed_pct"))


def present(df: DataFrame, listing: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the listing (files that exist)."""
    return df.join(listing.select(on), on, "left_semi")


def absent(df: DataFrame, listing: DataFrame, on: str) -> DataFrame:
    return df.join(listing.select(on), on, "left_anti")


def sample(df: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """n rows without replacement, by hash order: a top-k, not a sort."""
    return df.orderBy(salted(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def halves(df: DataFrame, seed: str, key: str) -> DataFrame:
    """The first half of a shuffle by hash: n // 2 rows."""
    # Counts by the first three hex digits tell in which bucket the half ends; only that bucket is sorted.
    hashed = df.withColumn("_h", salted(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows at most
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b"))).withColumn("_half", F.floor(F.sum("_n").over(Window.partitionBy(F.lit(0))) / 2))
    place = hashed.join(F.broadcast(upto.where("_upto - _n < _half")), "_b")
    inside = Window.partitionBy("_b").orderBy("_h", key)
    whole = place.where("_upto <= _half").select(*df.columns)
    return whole.unionAll(place.where("_upto > _half").withColumn("_rn", F.row_number().over(inside)).where("_rn <= _half - (_upto - _n)").select(*df.columns))


def require(df: DataFrame, *names: str) -> DataFrame:
    """df; columns that a later step needs and that are missing are an error now."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def standard_steps(dataset: str, training: bool, key: str, max_tokens: int, verify: Step, media_tokens: Step, total_tokens: Step) -> list[Step]:
    """The steps of a dataset in order: ids, verified media, media tokens; in training also total tokens and their limit.

    A dataset of digit images (mnist in its name) needs no media steps, and has no num_tokens.
    """
    steps: list[Step] = [lambda df: add_id(df, key)]
    if "mnist" in dataset:
        return steps
    steps += [verify, media_tokens]
    if training:
        steps += [total_tokens, lambda df: require(df, "num_tokens").where(F.col("num_tokens") <= max_tokens)]
    return steps


def join_outputs(items: DataFrame, outputs: DataFrame, on: str = "id", output: str = "output", name: str = "model_answer") -> DataFrame:
    """items with what a model answered: the text behind the last mark of the assistant; null where there is no output."""
    answers = outputs.select(F.col(on).alias("_on"), last_turn(F.col(output)).alias(name))
    return items.join(answers, F.col(on) == F.col("_on"), "left").drop("_on")


def select_except(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Columns by name sets; a name in both is an error."""
    both = set(include or ()) & set(exclude)
    if both:
        raise ValueError(f"columns both included and excluded: {sorted(both)}")
    return df.select(*[c for c in df.columns if (include is None or c in include) and c not in exclude])


def newest(df: DataFrame, step: str, partition: Sequence[str] = ()) -> DataFrame:
    """The row of the greatest step, by an aggregation with partial results."""
    rest = [c for c in df.columns if c not in partition]
    best = df.where(F.col(step).isNotNull()).groupBy(*partition).agg(F.max_by(F.struct(*rest), F.struct(F.col(step).cast("long"), F.struct(*rest))).alias("_best"))
    return best.where("_best is not null").select(*[F.col(c) if c in partition else F.col(f"_best.{c}") for c in df.columns])


#: Files of an older checkpoint that stay, beside the weights model-*.safetensors.
KEPT_FILES = ("config.json", "generation_config.json", "preprocessor_config.json", "video_preprocessor_config.json", "tokenizer.json", "tokenizer_config.json", "vocab.json", "merges.txt", "special_tokens_map.json", "added_tokens.json", "chat_template.jinja", "model.safetensors.index.json")


def retention(files: DataFrame, step: str = "step", name: str = "name") -> DataFrame:
    """files with delete: true for what an older checkpoint loses. The newest keeps all; others keep weights and settings."""
    newest_step = F.broadcast(files.agg(F.max(F.col(step).cast("long")).alias("_newest")))  # one row
    stays = F.col(name).isin(*KEPT_FILES) | F.col(name).rlike(r"^model-.*\.safetensors$")
    return files.crossJoin(newest_step).withColumn("delete", (F.col(step).cast("long") != F.col("_newest")) & ~stays).drop("_newest")
