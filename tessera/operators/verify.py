"""Verification of media: a status and a reason for each item, and what is left of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import FACTOR
from ..sources.media import NONE, probe

#: The statuses of an item's media.
DONE, MISSING, CORRUPTED, FAILED, OK = "Already Processed", "DNE", "Corrupted", "PyERROR", "OK"


def checked(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(name, frames, fps, height, width, error) of files (name, content); bytes are neither shuffled nor kept."""
    return files.select(F.col(name).alias("name"), probe(content).alias("p")).select("name", "p.*")


def status(exists: Column, error: Column, done: Column) -> Column:
    failed = error.startswith(NONE)
    return F.when(done, DONE).when(~exists, MISSING).when(failed, FAILED).when(error.isNotNull(), CORRUPTED).otherwise(OK)


def verify(items: DataFrame, files: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """items with status, reason and the measures of their media.

    files: (name, content), one row for a name; done: (name) of results that exist, which count before anything else.
    Files are checked where they are read and only their measures meet the items, so a file of a done item is checked
    too. The reason is that of the check, null for OK.
    """
    known = checked(files).withColumn("_exists", F.lit(True))
    finished = done.select(F.col("name").alias("_done")).distinct()
    joined = items.join(known.withColumnRenamed("name", "_file"), F.col(name) == F.col("_file"), "left").join(finished, F.col(name) == F.col("_done"), "left")
    out = joined.withColumn("status", status(F.coalesce("_exists", F.lit(False)), F.col("error"), F.col("_done").isNotNull()))
    reason = F.when(F.col("status").isin(CORRUPTED, FAILED), F.col("error"))
    return out.withColumn("reason", reason).drop("_exists", "_done", "_file", "error")


def usable(verified: DataFrame, side: int = FACTOR) -> tuple[DataFrame, DataFrame]:
    """(kept, report): items that are OK or done, images of at least side by side; and (status, reason, n) of all.

    A done item passes without a look at its sides. Both read verified: write it first if it is dear.
    """
    small = (F.col("status") == OK) & F.col("frames").isNull() & ((F.col("height") < side) | (F.col("width") < side))
    told = verified.withColumn("reason", F.when(small, f"smaller than {side}").otherwise(F.col("reason")))
    kept = told.where(F.col("status").isin(OK, DONE) & F.col("reason").isNull())
    return kept, told.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))
