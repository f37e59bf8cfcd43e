"""Quality rules by repetition coverage, in numpy.

For several n-gram lengths, a rolling hash of each window of n words marks the windows that occur twice or more in
their text; the characters of the words they cover, as a share of all characters of words, must stay under a limit.
Lines that repeat an earlier line are measured likewise. A window that repeats holds shorter ones that do, so longer
windows are hashed only where the shorter ones repeat, and their limits fall with the length.

The texts of a batch are measured together: their words stand in one array, and each text's hashes start from a
number of its own, so that windows of different texts never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, raw_texts, small_batches

#: Window length in words, and the largest share of word characters inside windows that repeat. A long passage that
#: repeats is surer a copy than a phrase is, so limits fall with the length: a passage of 10 words or more that repeats
#: is judged by the least limit, shorter ones by that of their length.
NGRAM_LIMITS = ((2, 0.70), (3, 0.65), (4, 0.60), (5, 0.25), (6, 0.24), (7, 0.23), (8, 0.22), (9, 0.21), (10, 0.20))
#: Largest share of word characters in lines that repeat an earlier one, and of such lines.
LINE_CHARS_LIMIT, LINES_LIMIT = 0.30, 0.40
#: Symbols of junk, and how many of them for each word make a text heavy of symbols: reported, no part of the verdict.
SYMBOLS = b"#*$%&|<>"
SYMBOLS_LIMIT = 0.35
LEAST_WORDS = 10
BASE_WINDOW, BASE_PERCENT = 5, 20
#: Words that are measured together; a longer text is measured alone.
GROUP_WORDS = 200_000

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, covered_share double, shares array<double>, reason string, symbol_heavy boolean"
STRIP = b" \t\n\x0b\x0c\r"
STEP = np.uint64(0x9E3779B97F4A7C15)


def code_points(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.decode("utf-8", "replace"))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; hash and code points of every word, one text behind the other."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, counts.sum())
    size = chain.from_iterable(map(len if t.isascii() else code_points, own) for t, own in zip(texts, words, strict=True))
    return counts, ids, np.fromiter(size, np.int64, counts.sum())


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which windows have a hash that occurs twice or more."""
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    return twice[at] == hashes


def coverage(ids: np.ndarray, counts: np.ndarray, lengths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each of the lengths (rising by one), which words stand in a window of that many words that repeats.

    ids: hashes of the words of all texts, one text behind the other; counts: words of each text.
    """
    n = len(ids)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    last = np.repeat(np.cumsum(counts), counts)  # end of the text that a word is in
    rolling = mix64(owner + STEP)
    at = np.arange(n)
    for width in range(1, lengths[-1] + 1):
        at = at[at + width <= last[at]]
        rolling[at] = rolling[at] * STEP + ids[at + width - 1]
        if width < lengths[0]:
            continue
        at = at[repeated(mix64(rolling[at]))]
        edge = np.zeros(n + 1, np.int64)
        edge[at] += 1
        edge[at + width] -= 1
        yield np.cumsum(edge[:-1]) > 0
        marks = np.zeros(n + 1, bool)
        marks[at] = True
        at = at[marks[at + 1]]  # the next length repeats only where both of its parts do


def repeated_lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and the word characters of these."""
    if b"\n" not in text:
        return 1, 0, 0
    seen, lines, again, chars = set(), 0, 0, 0
    for line in text.split(b"\n"):
        if not line.strip(STRIP):
            continue
        lines += 1
        if line in seen:
            again += 1
            chars += sum(map(code_points, line.split()))
        seen.add(line)
    return lines, again, chars


def measure(texts: list[bytes], limits: tuple[tuple[int, float], ...] = NGRAM_LIMITS) -> list[tuple]:
    """The measures of each text, in the order of COLUMNS behind doc_id."""
    counts, ids, size = hashed_words(texts)
    starts = np.concatenate([[0], np.cumsum(counts)])
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
    chars = total(size)
    shares, repeat_words = [], np.zeros(len(texts), np.int64)
    for (width, _), cover in zip(limits, coverage(ids, counts, tuple(w for w, _ in limits)), strict=True):
        if width == BASE_WINDOW:
            repeat_words = total(cover)
        shares.append(total(size * cover) / np.maximum(chars, 1))
    failed = (counts < LEAST_WORDS) | (100 * repeat_words > BASE_PERCENT * counts)
    out = []
    for i, text in enumerate(texts):
        n, own = int(counts[i]), [float(s[i]) for s in shares]
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        lines, again, again_chars = repeated_lines(text)
        rules = {f"ngram_{w}": s > limit for (w, limit), s in zip(limits, own, strict=True)}
        rules = {"base": bool(failed[i])} | rules | {"line_chars": again_chars > LINE_CHARS_LIMIT * chars[i], "lines": again > LINES_LIMIT * lines}
        reason = next((name for name, breaks in rules.items() if breaks), None)
        worst = max((s for (w, _), s in zip(limits, own, strict=True) if w >= BASE_WINDOW), default=0.0)
        out.append((n, int(chars[i]), symbols, again, int(repeat_words[i]), bool(failed[i]), reason is None, again_chars, worst, own, reason, symbols > SYMBOLS_LIMIT * n))
    return out


def groups(texts: list[bytes], most: int = GROUP_WORDS) -> Iterator[list[bytes]]:
    """Runs of texts of about ``most`` words, taking a word for six bytes."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > 6 * most:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.string(), pa.bool_()]
    for batch in batches:
        rows = [row for part in groups(raw_texts(batch.column(1))) for row in measure(part)]
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """A row for each row of docs; see COLUMNS. reason names the first rule that fails, null for a kept text; shares
    are those of NGRAM_LIMITS, in order; covered_share is the greatest of windows of BASE_WINDOW words or more.

    A null or empty text has no words and fails the base rule. Null and repeated doc_ids are rows like others;
    other columns play no part. An empty table gives an empty result. No shuffle; texts are held GROUP_WORDS words at
    a time, a longer text alone.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, COLUMNS)


def op4_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
