"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text and one of all documents, give each document the log
ratio of their likelihoods. Documents are then sampled without replacement, in proportion to that ratio, by Gumbel
top-k: a Gumbel variate is added to the log ratio and the k greatest are taken.

N-grams: words and pairs of words, and runs of one to three word shapes (case, length, punctuation behind it, a mark
for a word that repeats the one before). Target text: documents labelled as of good quality, at most TARGET_ROWS of
them (the first by a hash of doc_id). Counts of the raw model and scores cover all documents. k is the number of
documents times the share of good ones among all labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_WORD, materialize, mix64, raw_texts, rolling, small_batches

TARGET_ROWS = 10_000
#: Buckets of words and pairs, and of shapes (powers of two); the models have the sum of both.
WORD_BUCKETS, SHAPE_BUCKETS = 8192, 8192
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: Share of the raw model that is mixed into the target's: bounds the log ratio of an n-gram from below.
PRIOR = 0.5
#: Log ratio of a text without words.
EMPTY = -1000.0
#: Range of a document's log ratio; beyond it, a Gumbel variate decides nothing.
BOUND = 500.0
#: Bytes of text that are measured together.
GROUP_BYTES = 1 << 20
#: ASCII bytes that are no letter or digit: the marks behind a word.
MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
DIGITS = b"0123456789"


@lru_cache(maxsize=100_000)
def _shape(case: int, length: int, digits: bool, tail: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b"%d %d %d %b" % (case, length, digits, tail))


def shape(word: bytes) -> int:
    """A number for case, length and the marks behind a word."""
    body = word.rstrip(MARKS)
    case = 0 if body.islower() else 1 if body.isupper() and len(body) > 1 else 2 if body[:1].isupper() else 3
    return _shape(case, min(len(body), 20) // 4, len(body.translate(None, DIGITS)) < len(body), word[len(body) :][:4])


class Known(dict):
    """Word to its number in two tables, the hashes of words and of shapes; words are remembered up to a bound."""

    LIMIT = 300_000

    def __init__(self):
        super().__init__()
        self.word, self.form = np.zeros(self.LIMIT, np.uint64), np.zeros(self.LIMIT, np.uint64)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        new = set(words).difference(self)
        if len(self) + len(new) > self.LIMIT:
            self.clear()
            new = set(words)
        if len(new) > self.LIMIT or max(map(len, new), default=0) > LONG_WORD:  # huge texts and words are not remembered
            own = {w: (xxhash.xxh3_64_intdigest(w.lower()), shape(w)) for w in set(words)}
            return tuple(np.fromiter((own[w][k] for w in words), np.uint64, len(words)) for k in (0, 1))
        begin, own = len(self), list(new)
        self.update(zip(own, range(begin, begin + len(own)), strict=True))
        self.word[begin : len(self)] = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in own), np.uint64, len(own))
        self.form[begin : len(self)] = np.fromiter(map(shape, own), np.uint64, len(own))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.word[at], self.form[at]


def buckets(texts: list[bytes], known: Known) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of each n-gram of the texts, kind by kind of n-gram."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    word, form = known.of(list(chain.from_iterable(words)))
    owner, last = np.repeat(np.arange(len(texts)), n), np.repeat(np.cumsum(n), n)
    form = form.copy()
    again = np.flatnonzero((word[1:] == word[:-1]) & (owner[1:] == owner[:-1])) + 1
    form[again] ^= np.uint64(0x5BD1E995)
    at = np.arange(len(word))
    for width in (1, 2, 3):
        inside = at[at + width <= last]
        if width < 3:
            yield owner[inside], (rolling(word, width)[inside] & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
        yield owner[inside], (mix64(rolling(form, width)[inside] + np.uint64(width)) & np.uint64(SHAPE_BUCKETS - 1) | np.uint64(WORD_BUCKETS)).astype(np.int64)


def groups(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts of about ``most`` bytes; a longer text is alone."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > most:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, total = Known(), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in groups(raw_texts(batch.column(0))):
            for _, at in buckets(part, known):
                total += np.bincount(at, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the column text; BUCKETS numbers come to the driver, whatever the input."""
    out = np.zeros(BUCKETS, np.float64)
    for r in texts.select(F.col("text").cast("string")).mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log p_target - log p_raw of each bucket; words and shapes are models of their own."""
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS)):
        t, r = target[part] + 1e-9, raw[part] + 1.0
        p = r / r.sum()
        out[part] = np.log((1 - prior) * t / t.sum() + prior * p) - np.log(p)
    return out


def scores(texts: list[bytes], ratio: np.ndarray, known: Known) -> np.ndarray:
    """The log ratio of each text, within BOUND; EMPTY for one without words."""
    out, some = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for owner, at in buckets(texts, known):
        out += np.bincount(owner, ratio[at], len(texts))
        some[owner] = True
    return np.where(some, np.clip(out, -BOUND, BOUND), EMPTY)


def _score(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    known = Known()
    for batch in batches:
        own = [scores(part, ratio, known) for part in groups(raw_texts(batch.column(0)))]
        yield pa.record_batch([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(np.concatenate([*own, np.zeros(0)]))], names=[*batch.schema.names[1:], "_tessera_weight"])


def gumbel(seed: str):
    unit = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(-F.log(unit))


def threshold(keys: DataFrame, k: int, bins: int = 4096, small: int = 20_000) -> tuple[float, int] | None:
    """The k-th (key descending, id ascending) of keys (key, id); None for k = 0.

    Counts in equal bins find the bin that holds it, again and again, until at most ``small`` rows are left to
    collect or all of them share a key. So neither a task nor the driver holds more than that.
    """
    if k <= 0:
        return None
    span = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, left = span["lo"], span["hi"], span["n"]
    k = min(k, left)
    while left > small and lo < hi:
        width = (hi - lo) / bins
        if lo + width <= lo:
            break
        part = keys.where((F.col("key") >= lo) & (F.col("key") <= hi)).groupBy(F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("b")).collect()
        for r in part:
            if k <= r["n"]:
                lo, hi, left = r["lo"], r["hi"], r["n"]
                break
            k -= r["n"]
    inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
    if left > small:  # one key for all: the ids decide
        ids = inside.select(F.bitwise_not(F.col("id").cast("long")).alias("key"), F.col("id"))
        return lo, threshold(ids, k)[1] if ids.select("id").distinct().count() > 1 else inside.first()["id"]
    rows = sorted(((-r["key"], r["id"]) for r in inside.collect()))
    return -rows[k - 1][0], rows[k - 1][1]


def resample(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, seed: str = "dsir", share: float | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, _tessera_weight (log ratio), _tessera_key and kept, for every row of docs.

    A null or empty text has the weight EMPTY and is taken last. Rows that share a doc_id share their Gumbel variate;
    a null doc_id has that of the empty string. Without labels of good quality all rows weigh the same, and without
    any labels all are kept. Other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    good = labels.where("doc_id is not null and quality > 0").select(F.col("doc_id").alias("_tessera_l")).distinct().orderBy(F.xxhash64("_tessera_l"), "_tessera_l").limit(target_rows)
    # At most target_rows ids: the bound that a broadcast needs.
    target = counts(docs.join(F.broadcast(good), F.col("doc_id") == F.col("_tessera_l"), "left_semi"))
    ratio = log_ratio(target, counts(docs)) if target.any() else np.zeros(BUCKETS)
    chosen = docs.select(F.col("text").cast("string").alias("_tessera_text"), *[F.col(f"`{c}`") for c in keep])
    schema = chosen.drop("_tessera_text").withColumn("_tessera_weight", F.lit(0.0)).schema
    scored = chosen.mapInArrow(lambda b: _score(b, ratio), schema).withColumn("_tessera_key", F.col("_tessera_weight") + gumbel(seed))
    scored = materialize(scored, "importance")
    if share is None:
        share = labels.agg(F.avg((F.col("quality") > 0).cast("double")).alias("s")).first()["s"]
    total = scored.count()
    cut = threshold(scored.select(F.col("_tessera_key").alias("key"), F.coalesce("doc_id", F.lit(-1)).alias("id")), math.floor(total * (1.0 if share is None else share) + 0.5))
    if cut is None:
        return scored.withColumn("kept", F.lit(False))
    key, last = cut
    return scored.withColumn("kept", (F.col("_tessera_key") > key) | ((F.col("_tessera_key") == key) & (F.coalesce("doc_id", F.lit(-1)) <= last)))


def op6_importance(spark, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", F.col("_tessera_weight").alias("log_weight"), F.col("_tessera_key").alias("key"), "kept")
