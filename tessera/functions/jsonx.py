"""JSON and hash functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a JSON line can carry.
CARRIED = (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType, T.ArrayType, T.MapType, T.StructType)


def json_columns(df: DataFrame) -> list[str]:
    """The columns that a JSON line keeps; bytes and timestamps go."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, CARRIED)]


def to_lines(df: DataFrame) -> DataFrame:
    """One JSON text for each row; nulls are left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in json_columns(df)])).alias("value"))


def call_id(x: Column) -> Column:
    """The id of a call, from its text: one of 10,000, equal in any engine and run."""
    number = F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long") % 10000
    return F.concat(F.lit("call_"), number.cast("string"))


def salted(seed: str, *keys: Column) -> Column:
    """A hash that orders or picks without randomness; equal in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def pick(variants: list[str], seed: str, *keys: Column) -> Column:
    """One of the variants, by hash."""
    at = F.conv(F.substring(salted(seed, *keys), 1, 8), 16, 10).cast("long") % len(variants)
    return F.get(F.array(*map(F.lit, variants)), at.cast("int"))
