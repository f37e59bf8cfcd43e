"""Session factory with the settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on ``master`` (``local[*]`` where neither it nor spark-submit names one)."""
    builder = SparkSession.builder.appName("tessera").config(map=SETTINGS).config("spark.driver.memory", memory)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
