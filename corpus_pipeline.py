"""A corpus pipeline: each stage takes and returns documents, written as Parquet in between.

toxicity  documents that the classifier rejects go
lines     lines that stand in an earlier document go
near      one document of each group of near copies stays
mixing    documents are repeated or left out so that sources meet their targets
packing   what is left is tokenised and packed; the result has a row for each piece

Every stage takes nulls, empty and long texts, repeated rows, extra columns and empty tables as its operator states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import read
from tessera.llm.jaccard import one_of_each
from tessera.llm.lines import without_repeated_lines
from tessera.llm.mixing import remix
from tessera.llm.packing import pack
from tessera.llm.toxicity import without_toxic
from tessera.scratch import own, owned, shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels are those of the tables, never of docs."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, also those that lose all their lines: a text that others repeat whole is then empty."""
    return without_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the smallest doc_id stays; texts without words link with nothing and stay."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; empty texts have size 0 and go with their key like others."""
    return remix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document; a repeated document is packed as often as it stands there."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("near copies", near), ("mixing", mixing), ("packing", packing)]

#: Models, tokenizers and online packing are not expressible in SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables of the operators go once a stage stands; what stages return stays until the scope that called ends."""
    docs = read(spark, sf_dir, "documents")
    folder = own(f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        with owned(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
