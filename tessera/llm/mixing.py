"""Mixing sources to target weights (native): DataFrame functions only.

Efraimidis-Spirakis sampling. Each document has the key u^(1/w), with u a
hash of its doc_id in (0, 1) and w its quality weight; higher keys go first.
A source takes as many complete epochs as its target holds, then documents in
key order up to the token budget that is left.

The prefix sums need no sort of a whole source. Keys fall into slices; sizes
are summed by source and slice (with map-side combine), slices are
prefix-summed, and only the slice that the budget ends in is sorted by
document. What is gathered for a source is bounded by the number of slices,
however many rows the source holds. Slices are equal steps of key^LEAST, with
LEAST the least weight: for a weight w that is u^(LEAST/w), so no slice has
more than w/LEAST times its share of the documents of that weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

#: Slices of the keys of a source: that of a source of ten billion documents holds 1.2 million slim rows, six million
#: at most.
SLICES = 8192
#: Least quality weight: a quarter, so that key^LEAST is two square roots, which keep the order of keys exactly.
LEAST = 0.25
#: The plan has a row for each source; up to this many (a few MB) it is broadcast.
BROADCAST_SOURCES = 20_000
SALTS = 64


def quality_weight(size: Column) -> Column:
    """Quality weight where no column of docs has one: rises with the size up to 400 words."""
    return F.lit(LEAST) + F.least(size, F.lit(400)) / F.lit(400.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size), by water-filling.

    Sources, by code point and null last, weigh ``weights``, repeating. They share ``share`` times all sizes;
    a target stops at ``cap`` times its source's size and the excess is reshared by weight until none is above.
    In order of cap * size / weight, a source is capped if the level of those not yet capped reaches it.
    The frame has a row for each source, and no more: windows over all of it are small.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("rank", F.row_number().over(rank))
        .withColumn("w", w)
        .withColumn("top", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("top") / F.col("w"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(after))
        .withColumn("water", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "source", "level"))).over(every)["level"])
        .select("source", "source_size", F.round(F.when(F.col("w") * F.col("water") < F.col("top"), F.col("w") * F.col("water")).otherwise(F.col("top")), 6).alias("target"))
    )


def sized(docs: DataFrame, weight=quality_weight, seed: str = "mix", slices: int = SLICES, extra: tuple[str, ...] = (), quality: str | None = None) -> DataFrame:
    """(doc_id, source, size, key, slice) and the columns named by extra.

    quality names a column of weights, such as a classifier's; weights below LEAST count as LEAST, and a null or NaN has
    the weight by size.
    """
    unit = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    given = F.col(f"`{quality}`").cast("double") if quality else F.lit(None).cast("double")
    size = F.size(F.expr(f"regexp_extract_all(coalesce(cast(text as string), ''), r'{WORD}', 0)")).cast("long")
    return (
        docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), unit.alias("_u"), given.alias("_q"), *extra)
        .withColumn("key", F.pow("_u", 1.0 / F.when(F.col("_q").isNull() | F.isnan("_q"), weight(F.col("size"))).otherwise(F.greatest("_q", F.lit(LEAST)))))
        .drop("_u", "_q")
        .withColumn("slice", F.least(F.floor((1 - F.sqrt(F.sqrt("key"))) * slices), F.lit(slices - 1)).cast("int"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, weight=quality_weight, seed: str = "mix", slices: int = SLICES, extra: tuple[str, ...] = (), quality: str | None = None) -> DataFrame:
    """Rows of docs with size, source_size, target, copies (0 to cap) and taken = size * copies.

    Documents are taken whole; the one that the budget ends in is taken if that comes nearer to the target.
    A null text has size 0. A null source is a source, the last. Null and repeated doc_ids: rows that share an
    id share a key and are taken together. An empty table gives an empty result. Other columns play no part.
    """
    slim = materialize(sized(docs, weight, seed, slices, extra, quality), "mixing")
    by_slice = slim.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    by_source = by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    source_size = F.when(F.col("source_size") > 0, F.col("source_size"))
    plan = targets(by_source, weights, share, cap).withColumn("epochs", F.coalesce(F.floor(F.col("target") / source_size), F.lit(0)).cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan, "mixing-plan")

    running = Window.partitionBy("source").orderBy("slice")
    crossing = (
        by_slice.withColumn("upto", F.sum("slice_size").over(running))
        .join(plan.select(F.col("source").alias("p_source"), "rest"), F.col("source").eqNullSafe(F.col("p_source")))
        .where((F.col("rest") > F.col("upto") - F.col("slice_size")) & (F.col("rest") <= F.col("upto")))
        .select("p_source", F.col("slice").alias("end_slice"), (F.col("rest") - F.col("upto") + F.col("slice_size")).alias("left"))
    )
    # Rows of one doc_id are a unit; only the slices in which a budget ends are sorted.
    order = Window.partitionBy("p_source").orderBy(F.col("key").desc(), F.col("id").asc_nulls_first())
    ends = (
        slim.join(crossing, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("end_slice")))
        .groupBy("p_source", "end_slice", "left", "key", F.col("doc_id").alias("id"))
        .agg(F.sum("size").alias("unit"))
        .withColumn("upto", F.sum("unit").over(order))
        .withColumn("fits", F.col("upto") - F.col("unit") / 2 <= F.col("left"))
        .groupBy("p_source", "end_slice")
        .agg(F.min(F.when(F.col("fits"), F.col("key"))).alias("low_key"), F.max(F.when(F.col("fits"), F.struct((-F.col("key")).alias("k"), F.coalesce("id", F.lit(-(2**63))).alias("i")))).alias("last"))
        .select(F.col("p_source").alias("e_source"), "end_slice", "low_key", F.col("last")["i"].alias("low_id"))
    )
    plan = plan.join(ends, plan["source"].eqNullSafe(F.col("e_source")), "left").select(F.col("source").alias("p_source"), "source_size", "target", "epochs", "end_slice", "low_key", "low_id")
    plan = materialize(plan, "mixing-ends")
    chosen = (F.col("slice") < F.col("end_slice")) | (
        (F.col("slice") == F.col("end_slice")) & ((F.col("key") > F.col("low_key")) | ((F.col("key") == F.col("low_key")) & (F.coalesce("doc_id", F.lit(-(2**63))) <= F.col("low_id"))))
    )
    copies = F.col("epochs") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    if plan.count() <= BROADCAST_SOURCES:
        joined = slim.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("p_source")))
    else:  # sources are spread over SALTS tasks each, by key, and the plan repeated for each
        salted = plan.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = slim.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS))).join(salted, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("salt") == F.col("p_salt")))
    return (
        joined.withColumn("copies", copies.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *extra)
    )


def remix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as in docs.

    A uid of the scan ties the decision to its row, so that clashing column names and repeated ids don't matter.
    """
    uid = "_tessera_uid"
    tagged = docs.withColumn(uid, F.monotonically_increasing_id())
    copies = mix(tagged, extra=(uid,), **options).select(F.col(uid).alias("_tessera_row"), F.col("copies").alias("_tessera_copies"))
    return (
        tagged.join(copies.where("_tessera_copies > 0"), F.col(uid) == F.col("_tessera_row"))
        .withColumn("_tessera_copy", F.explode(F.sequence(F.lit(1), F.col("_tessera_copies").cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ((('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, pow(u, 1.0 / (0.25 + least(size, 400) / 400.0)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             2.0::DOUBLE * source_size AS top, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, top / w AS ratio,
             (budget - coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
water AS (SELECT arg_min(level, ratio) FILTER (ratio > level) AS water FROM l),
t AS (SELECT source, source_size, round(CASE WHEN w * water < top THEN w * water ELSE top END, 6) AS target FROM l, water),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
f AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
             sum(size) OVER (PARTITION BY k.source ORDER BY key DESC, doc_id) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN rest > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM f
"""
