"""Spelling variants: words that one edit separates, found through the parity of their letters.

A word's mask has a bit for each letter that it holds an odd number of times. One inserted, deleted or replaced code
point flips at most two bits, so of three bands of a mask at least one stays equal. Words of an equal band and of like
length meet. A band alone has few values (common letters fill it), so its buckets are split by what an edit must leave
whole: with L the length of the shorter word, the first L // 2 or the last L // 2 code points. Of the buckets in which
a pair meets, one counts: its first equal band, and the first half where that is equal. What meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read, small_batches, texts

RUN = re.compile("[a-zÀ-ÿ]+")
GAP = re.compile("[^a-zÀ-ÿ]")
#: Code points of a text that are searched at a time, and words that a task counts before it hands them on.
PIECE, FLUSH = 1 << 20, 300_000
#: One in so many (document, run) loses a code point.
SLIPS = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Bits 0 to 25 are a to z, and the code points from U+00C0 on share the 22 others; band k has the bits of remainder k.
ACCENTS = 22
BANDS = [sum(1 << i for i in range(k, 26 + ACCENTS, 3)) for k in range(3)]


def lowered(text: str) -> str:
    """text with A-Z in lower case, and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a lower-cased text, piece by piece; a piece ends where no run does not."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield RUN.findall(text, at, end)
        at = end


def slipped(prefix: int, run: str) -> str:
    """run, without one code point where 97 divides the hash of document and run; prefix is the crc32 of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIPS:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
            for found in runs(lowered(text)):
                for run, n in Counter(found).items():
                    if len(run) >= least:
                        word = slipped(prefix, run)
                        if len(word) >= least:
                            seen[word] += n
                if len(seen) >= FLUSH:
                    yield flush()
    yield flush()


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) of at least least_length code points that occur at least least_count times.

    Each task counts before the shuffle, so a frequent word is a row for each FLUSH words, not for each occurrence.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = chosen.mapInArrow(lambda b: _counts(b, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def mask(word: str) -> Column:
    """The parity of each letter of column ``word``, as bits of a long."""
    bit = f"CASE WHEN ascii(c) < 128 THEN ascii(c) - 97 ELSE 26 + (ascii(c) - 192) % {ACCENTS} END"
    return F.expr(f"aggregate(filter(split({word}, ''), c -> c <> ''), 0L, (m, c) -> m ^ shiftleft(1L, {bit}))")


def _half(word: Column, length: Column, side: int) -> Column:
    k = F.floor(length / 2).cast("int")
    return F.substring(word, F.lit(1), k) if side == 0 else F.substring(word, F.length(word) - k + 1, k)


def _entries(words: DataFrame, shorter: bool) -> DataFrame:
    """The buckets of each word: three bands, two halves, and as the longer word also those of words of one code point less."""
    keys = [
        F.struct(
            F.lit(band).alias("band"), F.lit(side).alias("side"),
            F.xxhash64(F.lit(band), F.col("mask").bitwiseAND(F.lit(BANDS[band])), F.lit(side), F.col("length") - less, _half(F.col("word"), F.col("length") - less, side)).alias("key"),
        )
        for less in ((0,) if shorter else (0, 1)) for band in range(3) for side in range(2)
    ]
    return words.select("word", "n", "mask", "length", F.explode(F.array(*keys)).alias("x")).select("word", "n", "mask", "length", "x.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each pair of words (word, n; words distinct) that exactly one edit separates, once.

    No bucket is gathered: the pairs of a bucket come one by one from a join that spills and that adaptive execution splits.
    """
    words = words.select("word", "n", mask("word").alias("mask"), F.length("word").alias("length"))
    a, b = _entries(words, True).alias("a"), _entries(words, False).alias("b")
    flipped = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    first_band = F.when(flipped.bitwiseAND(F.lit(BANDS[0])) == 0, 0).when(flipped.bitwiseAND(F.lit(BANDS[1])) == 0, 1).otherwise(2)
    first_half = _half(F.col("a.word"), F.col("a.length"), 0) == _half(F.col("b.word"), F.col("a.length"), 0)
    return a.join(
        b,
        (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.side") == F.col("b.side"))
        & ((F.col("a.length") < F.col("b.length")) | (F.col("a.word") < F.col("b.word")))
        & (F.bit_count(flipped) <= 2) & (F.col("a.band") == first_band) & (F.col("a.side") == F.when(first_half, 0).otherwise(1))
        & (F.levenshtein("a.word", "b.word", 1) == 1),
    ).select(F.col("a.word").alias("a"), F.col("a.n").alias("an"), F.col("b.word").alias("b"), F.col("b.n").alias("bn"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form), followed to the last; each round doubles the steps taken.

    Counts at least double from a word to its form, so there are no circles, at most 62 steps and 6 rounds.
    """
    up = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        a, b = up.alias("a"), up.alias("b")
        step = a.join(b, F.col("a.root") == F.col("b.word"), "left")
        moved = materialize(step.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.word").isNotNull().alias("moved")), "forms")
        if moved.where("moved").isEmpty():
            return up
        up = moved.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of words (word, n), as op11_spelling states."""
    words = materialize(words.select("word", "n"), "words")
    way = lambda word, other, m: F.struct(F.col(word).alias("word"), F.col(other).alias("other"), F.col(m).alias("m"))
    both = near_pairs(words).select(F.explode(F.array(way("a", "b", "bn"), way("b", "a", "an"))).alias("x"))
    near = both.select("x.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"),
    )
    found = materialize(found, "variants")
    out = found.join(roots(found.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """A row for each word of all documents that has 5 code points and 3 occurrences or more.

    A null text has no words, an empty one neither; a null doc_id is empty in `<doc_id>:`. Repeated rows count again.
    Of near words with an equal n the smallest in code-point order is the form. Other columns play no part. Documents
    without such words, or an empty table, give an empty result.
    """
    return variants(vocabulary(read(spark, sf_dir, "documents")))
