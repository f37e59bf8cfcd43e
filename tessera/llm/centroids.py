"""Centroid clustering: plain Lloyd rounds over integer vectors.

The centroids are a broadcast of k x dims integers. mapInPandas assigns the vectors of a batch with NumPy, centroid by
centroid, and hands on one row of sums for each centroid and partition; a groupBy merges those. All sums are integers,
so a result depends neither on partitions nor on the order of rows, and a lost task can be computed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

DIMS, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Integers beyond this bound count as the bound, so that a squared distance fits in a long.
BOUND = 1 << 27


def usable(vector: Column, dims: int = DIMS) -> Column:
    """Whether a vector has dims components, none null, NaN or infinite."""
    x = vector.cast("array<double>")
    return F.coalesce((F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def integers(values: pd.Series, scale: int = SCALE, dims: int = DIMS) -> np.ndarray:
    """floor(scale * x) of each component, as rows of int64."""
    x = np.stack(values.to_list()).astype(np.float64) if len(values) else np.zeros((0, dims))
    return np.clip(np.floor(scale * x), -BOUND, BOUND).astype(np.int64)


def assign(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the lowest index of equal ones), and its squared distance."""
    d = np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(v)), best]


def _kept(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    chosen = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    return chosen.where(usable(F.col("vector"), dims))


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int, dims: int) -> np.ndarray:
    """Those of the k keys of smallest sha256 of `<seed>:<key>`, in that order; null keys last, rows of one key by their vectors."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = kept.select(digest.alias("digest"), F.col("vector").cast("array<double>").alias("vector")).orderBy(F.asc_nulls_last("digest"), "vector").limit(k).collect()
    return integers(pd.Series([r["vector"] for r in rows], dtype=object), scale, dims)


def _sums(send: Callable[[], np.ndarray], scale: int, dims: int):
    """Batches to one row for each centroid that the partition's vectors use: its number, their count, distances and components summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = send()
        n, inertia, sums = (np.zeros(s, np.int64) for s in (len(centroids), len(centroids), (len(centroids), dims)))
        for batch in batches:
            v = integers(batch["vector"], scale, dims)
            best, distance = assign(v, centroids)
            for c in np.unique(best):
                own = best == c
                n[c] += own.sum()
                inertia[c] += distance[own].sum()
                sums[c] += v[own].sum(axis=0)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": n[used], "inertia": inertia[used], "sums": list(sums[used])})

    return run


def _merged(kept: DataFrame, centroids: np.ndarray, scale: int, dims: int) -> dict[int, tuple[int, int, list[int]]]:
    """(n, inertia, sums) by cluster, exact: at most k rows."""
    sent = kept.sparkSession.sparkContext.broadcast(centroids)
    parts = kept.select("vector").mapInPandas(_sums(lambda: sent.value, scale, dims), "cluster int, n long, inertia long, sums array<long>")
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = F.array(*[total(F.col("sums")[i]) for i in range(dims)])
    merged = parts.groupBy("cluster").agg(total(F.col("n")).alias("n"), total(F.col("inertia")).alias("inertia"), sums.alias("sums"))
    return {r["cluster"]: (int(r["n"]), int(r["inertia"]), [int(x) for x in r["sums"]]) for r in merged.collect()}


def lloyd(df: DataFrame, key: str, vector: str, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS) -> tuple[np.ndarray, dict[int, tuple[int, int, list[int]]]]:
    """Centroids after the rounds, and what the assignment to them sums up to. Reads df once for each round and twice more.

    An empty centroid stays where it is. Fewer than k usable vectors give fewer centroids, none give none.
    """
    kept = _kept(df, key, vector, dims)
    centroids = first_centroids(kept, k, seed, scale, dims)
    if not len(centroids):
        return centroids, {}
    for _ in range(rounds):
        for cluster, (n, _, sums) in _merged(kept, centroids, scale, dims).items():
            centroids[cluster] = [x // n for x in sums]
    return centroids, _merged(kept, centroids, scale, dims)


def clusters(df: DataFrame, key: str, vector: str, centroids: np.ndarray, merged: dict[int, tuple[int, int, list[int]]], scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector; no shuffle.

    An inertia that doesn't fit in a long is null.
    """
    fits = lambda x: x if x < 1 << 63 else None
    own = {c: fits(merged[c][1]) if c in merged else 0 for c in range(len(centroids))}
    whole, digests = fits(sum(m[1] for m in merged.values())), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sent = df.sparkSession.sparkContext.broadcast((centroids, own, whole, digests))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, own, whole, digests = sent.value
        for batch in batches:
            best, distance = assign(integers(batch["vector"], scale, dims), centroids)
            cluster = best.tolist()
            yield pd.DataFrame({
                "key": batch["key"], "cluster": best.astype(np.int32), "distance": distance, "cluster_inertia": pd.array([own[c] for c in cluster], dtype="Int64"),
                "inertia": pd.array([whole] * len(batch), dtype="Int64"), "centroid_sha256": [digests[c] for c in cluster],
            })

    kept = _kept(df, key, vector, dims)
    kind = kept.schema["key"].dataType.simpleString()
    rows = kept.mapInPandas(run, f"key {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string") if len(centroids) else kept.limit(0).selectExpr(
        "key", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"
    )
    return rows.withColumnRenamed("key", key)


def _oracle() -> str:
    near = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    sql = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS c, x FROM (SELECT sha256('{SEED}:' || vec_id::VARCHAR) AS h, x FROM v) ORDER BY h, x LIMIT {K})"""
    for k in range(ROUNDS):
        sql += f""",
a{k} AS (SELECT x, arg_min(c, (d, c)) AS c FROM (SELECT v.vec_id, v.x, c.c, {near} AS d FROM v, c{k} c) GROUP BY vec_id, x),
s{k} AS (SELECT c, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{k}, range(1, {DIMS + 1}) r(i) GROUP BY c, i),
c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m.x, c{k}.x) AS x FROM c{k} LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM s{k} GROUP BY c) m ON m.c = c{k}.c)"""
    return sql + f""",
z AS (SELECT vec_id, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT v.vec_id, v.x, c.c, {near} AS d FROM v, c{ROUNDS} c) GROUP BY vec_id, x)
SELECT vec_id, z.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY z.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM z JOIN c{ROUNDS} c ON c.c = z.c"""


#: vec_id is unique in the tables that this runs on.
OP12_SQL = _oracle()


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """A row for each vector of 64 components, none null or non-finite; others have no row, nor do null vectors.

    Null and repeated vec_ids are rows like others: a null one has no hash and starts no centroid before all others;
    of rows with one vec_id the smaller vector comes first. Integers beyond BOUND count as BOUND. Other columns play no
    part. Fewer than 40 vectors give as many centroids, an empty table an empty result.
    """
    vectors = read(spark, sf_dir, "embeddings")
    return clusters(vectors, "vec_id", "embedding", *lloyd(vectors, "vec_id", "embedding"))
