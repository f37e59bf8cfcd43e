"""JSON whose keys nobody knows beforehand, as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(json: Column) -> Column:
    """ARRAY<STRUCT<key STRING, value VARIANT>> of an object, in the order of its text; null for anything else.

    A key that occurs twice keeps its first place and is listed once for each of its values.
    """
    keys = F.json_object_keys(json)
    return F.when(keys.isNotNull(), F.map_entries(F.from_json(json, "map<string, variant>")))


def text_of(value: Column, path: str) -> Column:
    """The text at a path of a variant; null if it isn't there or can't be a text."""
    return F.try_variant_get(value, path, "string")


def exploded(df: DataFrame, json: str, *keep: str) -> DataFrame:
    """(keep, key, value, kind): one row for each key of an object; kind is the type that the value has.

    Texts that are no JSON object give no row. No shuffle: the rows of an object come from where it is.
    """
    object_ = F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v"))
    rows = df.select(*keep, F.try_parse_json(json).alias("_v")).withColumn("_v", object_)
    spark = df.sparkSession
    out = rows.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
    return out.select(*keep, "key", "value", F.schema_of_variant("value").alias("kind"))


def profile(df: DataFrame, json: str, *by: str) -> DataFrame:
    """(by, key, n, numbers, low, high, total): how often a key occurs, and its numbers. Partial results go through one shuffle."""
    number = F.try_variant_get("value", "$", "double")
    keys = exploded(df, json, *by).groupBy(*by, "key")
    return keys.agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("numbers"), F.min(number).alias("low"), F.max(number).alias("high"), F.sum(number).alias("total"))
