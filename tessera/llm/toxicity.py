"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon, the trees and the calibration are learned from labelled rows whose crc32(doc_id as text) mod 5 is not
0, at most TRAIN_ROWS documents (the first by a hash of doc_id, one text for an id); that bound is the only sample here. Remainder 1 fits
the calibration alone. Words, their first letters and the features are of whole texts; every row is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_WORD, materialize, small_batches, texts

TRAIN_ROWS = 10_000
LEXICON = 2_000
#: First letters of words that make units of the lexicon of their own.
STEMS = (4, 5)
LEAST_ODDS = 2.5
#: Insults that count even where no label names them.
SEED = frozenset("idiot moron stupid scum loser pathetic worthless trash clown disgusting dumb imbecile cretin degenerate vermin filth bastard".split())
#: Second-person words in the four languages.
YOU = frozenset("you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton vous votre vos tú ti usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!*|", "oieastasi l", "")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[^\W\d_][\d@$!*|._-]+[^\W\d_]")
LONG = re.compile(r"(.)\1\1")
FEATURES = ("hits_share", "hits_log", "odds_top", "odds_share", "stem_share", "stem_log", "near_you", "you_share", "capitals", "calls", "punctuation", "obfuscated", "obfuscated_hits", "long_log", "elongated", "words_log")
NEAR = 5
#: Share of the uncalibrated value in a score.
TIE = 1e-6


def bare(word: str) -> str:
    return EDGE.sub("", word.lower())


def units(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class Lexicon(dict):
    """Raw word to the number of its marks; marks: log odds of the word, of its stem, bits.

    Words of up to LONG_WORD characters are remembered, up to a bound.
    """

    LIMIT = 300_000
    HIT, STEM, SECOND, ODD, ODD_HIT, ELONGATED = 1, 2, 4, 8, 16, 32

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds
        self.numbers: dict[tuple[float, float, int], int] = {(0.0, 0.0, 0): 0}
        self.marks = np.zeros((1, 3))

    def look_up(self, raw: str) -> tuple[float, float, int]:
        plain = raw.isalpha()
        word = raw.lower() if plain else bare(raw)
        odds = max(self.odds.get(word, 0.0), 4.0 if word in SEED else 0.0)
        stem = max((self.odds.get(f"{word[:k]}*", 0.0) for k in STEMS if len(word) > k), default=0.0)
        bits = self.HIT * (odds > 0) + self.STEM * (stem > 0) + self.SECOND * (word in YOU) + self.ELONGATED * bool(LONG.search(word) and word.isalpha())
        if not plain and INNER.search(raw):
            clean = re.sub(r"[^\w]|_", "", raw.lower().translate(LEET))
            bits += self.ODD + self.ODD_HIT * (clean in SEED or clean in self.odds)
        return odds, stem, bits

    def __missing__(self, raw: str) -> int:
        marks = self.look_up(raw)
        number = self.numbers.get(marks)
        if number is None:
            number = self.numbers[marks] = len(self.numbers)
            self.marks = np.array(list(self.numbers))
        if len(raw) <= LONG_WORD:
            if len(self) >= self.LIMIT:
                self.clear()
            self[raw] = number
        return number


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    numbers = np.fromiter(map(lexicon.__getitem__, words), np.int64, n)
    marks = lexicon.marks[numbers]
    odds, bits = marks[:, 0], marks[:, 2].astype(np.int64)
    hit = (bits & (Lexicon.HIT | Lexicon.ODD_HIT)) > 0
    you = np.flatnonzero(bits & Lexicon.SECOND)
    near = 0
    if len(you) and hit.any():
        at = np.flatnonzero(hit)
        right = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(you[np.maximum(right - 1, 0)] - at))
        near = float((gap <= NEAR).mean())
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    calls = int(counts[33] + counts[63])
    marks_ = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    stems = int(((bits & Lexicon.STEM) > 0).sum())
    return [
        float(hit.sum()) / n, math.log1p(float(hit.sum())), float(odds.max()), float(odds.sum()) / n, stems / n, math.log1p(stems), near, len(you) / n,
        upper / max(1, upper + lower), calls / n, marks_ / n, float(((bits & Lexicon.ODD) > 0).sum()) / n, float(((bits & Lexicon.ODD_HIT) > 0).sum()), math.log1p(float(marks[:, 1].sum())),
        float(((bits & Lexicon.ELONGATED) > 0).sum()) / n, math.log1p(n),
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth on binned features (logistic loss, second-order splits)."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    penalty: float = 1.0
    bins: int = 64
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        self.edges = [np.unique(np.concatenate([e, [np.nextafter(0, 1)]])) for e in self.edges]  # zero stands alone
        b, width = self._binned(x), self.bins + 2
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(math.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            col, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width, np.int64)
            for level in range(self.depth):
                first, k = 2**level - 1, 2**level
                local = node - first
                best = np.full(k, 1e-6)
                for j in range(x.shape[1]):
                    key = local * width + b[:, j]
                    gs = np.bincount(key, g, k * width).reshape(k, width).cumsum(axis=1)
                    hs = np.bincount(key, h, k * width).reshape(k, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(k), at]
                    for i in np.flatnonzero(top > best).tolist():
                        best[i], col[first + i], cut[first + i] = top[i], j, at[i]
                node = 2 * node + 1 + (b[np.arange(len(y)), col[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.penalty)
            score += value[leaf]
            self.trees.append((col, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for col, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, col[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, value) of the non-decreasing least-squares fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = hi
    knots = [(e, (s + 0.5 * (s / w)) / (w + 0.5)) for s, w, lo, hi in blocks for e in sorted({lo, hi})]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    odds: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated value; a millionth of the plain one keeps the order within a step."""
        if self.trees is None:
            return np.full(len(x), self.prior)
        margin = self.trees.margin(x)
        plain = 1 / (1 + np.exp(-margin))
        if self.knots is None:
            return plain
        return np.clip((1 - TIE) * np.interp(margin, *self.knots) + TIE * plain, 0.0, 1.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    good, bad = Counter(), Counter()
    for batch in batches:
        for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            own = {u for w in {bare(w) for w in text.split()} if w for u in units(w)}
            (bad if y else good).update(own)
        yield pa.record_batch([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["unit", "bad", "good"])
    names = list(bad.keys() | good.keys())
    for lo in range(0, len(names), 20_000):
        part = names[lo : lo + 20_000]
        yield pa.record_batch([pa.array(part, pa.string()), pa.array([bad[u] for u in part], pa.int64()), pa.array([good[u] for u in part], pa.int64())], names=["unit", "bad", "good"])


def _features(batches: Iterator[pa.RecordBatch], odds: dict[str, float]) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(odds)
    for batch in batches:
        rows = [features(t, lexicon) for t in texts(batch.column(0))]
        yield pa.record_batch([batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["y", "fold", "x"])


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(model.odds)
    for batch in batches:
        x = np.array([features(t, lexicon) for t in texts(batch.column(0))]).reshape(-1, len(FEATURES))
        score = model.score(x)
        yield pa.record_batch([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(score)], names=[*batch.schema.names[1:], "_tessera_score"])


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``rows`` labelled documents outside fold 0; of rows with one id the smallest text counts.

    Without both labels nothing tells documents apart: every score is 0.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0)
        .groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("long").alias("y"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    )
    # At most `rows` pairs of ids and labels: the bound that a broadcast needs.
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    one = labelled.groupBy("l_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    own = materialize(one.select("text", (F.col("y") > 0).cast("long").alias("y"), fold(F.col("l_id")).alias("fold")), "toxic-train")
    sizes = {int(r["y"]): r["n"] for r in own.where("fold <> 1").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return Model({}, None, None, 0.0)
    least = 3 if n_bad < 200 else 5
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    words = (
        own.where("fold <> 1").select("text", "y").mapInArrow(_count, "unit string, bad long, good long")
        .groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= least).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc("odds"), "unit").limit(LEXICON).collect()
    )
    table = {r["unit"]: float(r["odds"]) for r in words}
    seen = own.select("text", "y", "fold").mapInArrow(lambda b: _features(b, table), "y long, fold long, x array<double>").collect()
    x, y, folds = np.array([r["x"] for r in seen]), np.array([float(r["y"]) for r in seen]), np.array([r["fold"] for r in seen])
    order = np.lexsort([*x.T, y, folds])  # whatever order the rows came in, the same trees
    x, y, folds = x[order], y[order], folds[order]
    trees = Trees().fit(x[folds != 1], y[folds != 1])
    held = folds == 1
    knots = isotonic(trees.margin(x[held]), y[held]) if 0 < y[held].sum() < held.sum() else None
    return Model(table, trees, knots, float(y.mean()))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and _tessera_score, for every row. A null text is empty. No shuffle."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("text").cast("string").alias("_tessera_text"), *[F.col(f"`{c}`") for c in keep])
    schema = chosen.drop("_tessera_text").withColumn("_tessera_score", F.lit(0.0)).schema
    return chosen.mapInArrow(lambda b: _scores(b, model), schema)  # the model is a few hundred KB: LEXICON units and the trees


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score less than threshold, with the same columns."""
    model = train(docs, labels)
    out = score(docs, model, tuple(docs.columns))
    return out.where(F.col("_tessera_score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """A row for each document. Empty and null texts have the score of a text without any features.

    Repeated doc_ids are rows like others; a null doc_id is never held out and never a training row. Other columns
    play no part. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).withColumnRenamed("_tessera_score", "score")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
