"""What several operators share: scratch tables, Arrow helpers, hashes and packed exchanges."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, shared_folder  # noqa: F401  (for the modules of this folder)

#: A word, as a pattern of Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch; long texts make batches of the default 10,000 rows heavy.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch, for the session from now on, where it still has Spark's defaults."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) == 10000:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


#: A key of more than 1/HOT of the rows is hot; there are fewer than HOT of them, the bound that a broadcast needs.
HOT = 1000


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows left-joined with side on keys, the first a long; side has one row for a key, and in ``count`` how many of
    rows have it.

    Hot keys are broadcast, the others are joined by a shuffle; there, rows of hot keys are dealt by a hash of all
    their columns, so that no key gathers its rows in one task. Null keys find nothing. side is read three times: it
    should be a written table, or cheap.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    hot, more = F.col(count) * HOT > total, [c for c in side.columns if c not in keys]
    few = side.where(hot).select(*keys, F.struct(*more).alias("_hot"))
    rest = side.where(~hot).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.struct(*more).alias("_cold"))
    cold = F.col("_hot").isNull()
    marked = rows.join(F.broadcast(few), keys, "left").withColumn("_first", F.when(cold, F.col(keys[0])).otherwise(F.xxhash64(*rows.columns)))
    on = cold & (F.col("_first") == F.col(f"_of_{keys[0]}"))
    for k in keys[1:]:
        on &= F.col(k) == F.col(f"_of_{k}")
    return marked.join(rest, on, "left").select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in more])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The bytes of each value; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Each value, a null as an empty text; bytes that are not UTF-8 count as U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in raw_texts(column)]


#: Longer words are looked up anew each time: so what a cache holds is bounded in bytes, too.
LONG_WORD = 64


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; at most LIMIT words of at most LONG_WORD bytes are remembered."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n ids; empty if there are fewer."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
    return mix64(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def deal(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """The rows of parallel columns, gathered by bucket: (bucket, bytes of each column)."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    ordered = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        yield int(bucket[lo]), [c[lo:hi].tobytes() for c in ordered]


def grouped_blobs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition that is sorted by key, one group at a time."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != last:
                yield last, rows
                rows = []
            last = row[key]
            rows.append(row)
    if rows:
        yield last, rows


def worker_env() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
