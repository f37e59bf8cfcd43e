"""Scores of model answers: one pass over the results each."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import percent, ratio
from ..functions.text import answer_tokens, filter_for, passes, split_words, strip

#: Answer parsers and comparers by name; callers may add their own.
PARSERS: dict[str, Callable[[Column], Column]] = {"first_words": answer_tokens}
COMPARERS: dict[str, Callable[[Column, Column], Column]] = {"first_in": lambda gold, pred: F.array_contains(pred, F.get(gold, F.lit(0)))}


def score(df: DataFrame, gold: str = "answer", pred: str = "model_answer", filter_name: str | None = None, dataset: str = "", parser: str = "first_words", comparer: str = "first_in", strict: bool = False) -> DataFrame:
    """One row: total, correct, incorrect, invalid and both accuracies.

    A row counts if its gold answer passes the filter; it is invalid if the prediction does not, else right if the
    first word of gold is among the first words of the prediction. Without counted rows the accuracies are null,
    or, if ``strict``, an error.
    """
    name = filter_name or filter_for(dataset)
    rows = df.select(PARSERS[parser](F.col(gold).cast("string")).alias("g"), PARSERS[parser](F.coalesce(F.col(pred).cast("string"), F.lit(""))).alias("p"))
    rows = rows.where(passes(F.col("g"), name))
    valid = passes(F.col("p"), name)
    right = COMPARERS[comparer](F.col("g"), F.col("p"))
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(valid & right).alias("correct"), F.count_if(valid & ~right).alias("incorrect"), F.count_if(~valid).alias("invalid"))
    some = F.col("total") > 0
    if strict:
        out = out.where(F.isnull(F.assert_true(some, F.lit("no row passes the gold filter"))))
    return out.select("*", F.when(some, ratio(F.col("correct"), F.col("total"))).alias("accuracy_with_invalid"), F.when(some, ratio(F.col("correct"), F.col("total") - F.col("invalid"))).alias("accuracy_without_invalid"))


def judge_summary(df: DataFrame, ok: str = "is_correct", invalid_is_wrong: bool = False) -> DataFrame:
    """total, correct, invalid (null), accuracies; with ``invalid_is_wrong`` also incorrect, which then counts invalid rows too."""
    value = F.col(ok)
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(value).alias("correct"), F.count_if(value.isNull()).alias("invalid"), F.count_if(~F.coalesce(value, F.lit(False))).alias("incorrect"))
    out = out.select("*", ratio(F.col("correct"), F.col("total")).alias("accuracy"), ratio(F.col("correct"), F.col("total") - F.col("invalid")).alias("accuracy_valid"))
    return out if invalid_is_wrong else out.drop("incorrect")


def verdict_stats(df: DataFrame, verdict: str) -> DataFrame:
    """Counts of the texts correct and incorrect; others only count in the total."""
    v = F.lower(strip(F.col(verdict)))
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(v == "correct").alias("correct"), F.count_if(v == "incorrect").alias("incorrect"))
    return out.select("*", ratio(F.col("correct"), F.col("total")).alias("accuracy"), percent(F.col("correct"), F.col("total")).alias("accuracy_pct"))


def first_word(x: Column) -> Column:
    """The first word as split before lower-casing; a missing answer is empty."""
    return F.lower(F.get(split_words(strip(F.coalesce(x, F.lit("")))), F.lit(0)))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(gold, pred, n): pred is yes, no or invalid; rows whose gold is not exactly yes or no are left out."""
    word = first_word(F.col(pred))
    return df.where(F.col(gold).isin("yes", "no")).groupBy(F.col(gold).alias("gold"), F.when(word.isin("yes", "no"), word).otherwise("invalid").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_rates(matrix: DataFrame) -> DataFrame:
    """Marginals and rates of a confusion table; precision under its right name."""
    cell = lambda g, p: F.coalesce(F.sum(F.when((F.col("gold") == g) & (F.col("pred") == p), F.col("n"))), F.lit(0))
    one = matrix.agg(cell("yes", "yes").alias("yy"), cell("yes", "no").alias("yn"), cell("no", "yes").alias("ny"), cell("no", "no").alias("nn"))
    yy, yn, ny, nn = (F.col(c) for c in ("yy", "yn", "ny", "nn"))
    total = yy + yn + ny + nn
    return one.select(percent(yy + yn, total).alias("actual_yes_pct"), percent(yy + ny, total).alias("model_yes_pct"), ratio(yy + nn, total).alias("accuracy"), ratio(yy, yy + ny).alias("precision_yes"), ratio(nn, nn + yn).alias("precision_no"))


def validity_positional(original: DataFrame, judged: DataFrame, fields: list[str], rn: str = "rn") -> DataFrame:
    """Rows of equal position compared field by field; the longer side's rest is left out."""
    a, b = original.select(rn, F.struct(*fields).alias("a")), judged.select(rn, F.struct(*fields).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return a.join(b, rn).agg(F.count(F.lit(1)).alias("compared"), F.count_if(~same).alias("mismatches"), F.min(F.when(~same, F.col(rn))).alias("first_mismatch"), F.coalesce(F.bool_and(same), F.lit(True)).alias("valid"))


def validity_keyed(original: DataFrame, judged: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """As above by key, with the rows that one side lacks."""
    a, b = original.select(F.col(key).alias("ka"), F.struct(*fields).alias("a")), judged.select(F.col(key).alias("kb"), F.struct(*fields).alias("b"))
    both = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    there = F.col("ka").isNotNull() & F.col("kb").isNotNull()
    return both.agg(F.count_if(there).alias("compared"), F.count_if(there & ~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"), F.count_if(F.col("kb").isNull()).alias("unjudged"), F.count_if(F.col("ka").isNull()).alias("unknown"))


def accuracy_by(df: DataFrame, ok: Column, *keys: Column | str, rollup: bool = False) -> DataFrame:
    grouped = df.rollup(*keys) if rollup else df.groupBy(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("accuracy"))


def judged_by(df: DataFrame, judge: Callable[[pd.DataFrame], list[bool | None]]) -> DataFrame:
    """df (id, question, answer, model_answer) with is_correct from an outside judge, called once for each Arrow batch.

    A verdict that isn't a boolean becomes null, which the summary counts as invalid.
    """
    fields = ["id", "question", "answer", "model_answer"]

    def run(batches):
        for rows in batches:
            verdicts = judge(rows)
            yield rows.assign(is_correct=pd.Series([v if isinstance(v, bool) else None for v in verdicts], dtype="object", index=rows.index))

    return df.select(*fields).mapInPandas(run, "id long, question string, answer string, model_answer string, is_correct boolean")
