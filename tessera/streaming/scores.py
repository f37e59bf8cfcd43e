"""Running scores of result files as they arrive, with the same rules as the batch score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import answer_tokens, passes
from ..sources.catalog import RESULT


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RESULT).json(folder)


def running_score(results: DataFrame, filter_name: str = "yes_no") -> DataFrame:
    gold, pred = answer_tokens(F.col("answer")), answer_tokens(F.coalesce("model_answer", F.lit("")))
    rows = results.select(gold.alias("g"), pred.alias("p")).where(passes(F.col("g"), filter_name))
    valid = passes(F.col("p"), filter_name)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(valid & F.array_contains("p", F.get("g", F.lit(0)))).alias("correct"), F.count_if(~valid).alias("invalid"))


def start(scores: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Works off what is there and ends; a restart goes on from the checkpoint."""
    return scores.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
