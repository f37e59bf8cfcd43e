"""Sources and sinks: a registry of datasets, readers and writers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cue_text
from ..operators import conversations as C
from .tables import replace

JUDGED = T.StructType([T.StructField("id", T.LongType()), T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("model_answer", T.StringType()), T.StructField("is_correct", T.BooleanType())])
RESULT = T.StructType(JUDGED.fields[:4])


@dataclass(frozen=True)
class Dataset:
    """Where a dataset lies, how it is read, and which maker turns its items into conversations."""

    path: str
    format: str = "parquet"
    maker: str = "vqa"
    media_dir: str | None = None
    list_field: str | None = None
    schema: T.StructType | None = None
    #: Templates of makers that ask by a fixed text; {question} stands for the item's own.
    question: str = "{question}"
    view_question: str = "{question}"


def _field(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _questions(df: DataFrame, d: Dataset) -> Column:
    return F.col(d.list_field) if d.list_field else F.array(F.struct(_field(df, "question").alias("question"), _field(df, "answer").alias("answer")))


def _listed(df: DataFrame, name: str) -> Column:
    return F.col(name) if dict(df.dtypes)[name].startswith("array") else F.array(name)


def _folder(d: Dataset) -> Column | None:
    return F.lit(d.media_dir) if d.media_dir else None


#: What turns the items of a dataset into messages: (items, dataset, training) -> Column.
MAKERS: dict[str, Callable[[DataFrame, Dataset, bool], Column]] = {
    "text": lambda df, d, training: C.text_maker(F.col("text")),
    "vqa": lambda df, d, training: C.vqa_maker(_questions(df, d), _field(df, "image"), _field(df, "video"), training, _folder(d)),
    "label": lambda df, d, training: C.label_maker(F.col("image"), F.col("label"), d.question, training),
    "caption": lambda df, d, training: C.caption_maker(F.col("image"), F.col("caption")) if "image" in df.columns else C.caption_maker(F.col("video"), F.col("caption"), "video"),
    "columns": lambda df, d, training: C.columns_maker(df, exclude=["id", "split"]),
    "radiology": lambda df, d, training: C.radiology_maker(F.col("image"), _listed(df, "question"), _listed(df, "answer"), d.view_question, d.question, training),
    "typed": lambda df, d, training: C.typed_maker(F.col("type"), _questions(df, d), _field(df, "video"), _field(df, "caption"), training),
    "choice": lambda df, d, training: C.choice_maker(F.col("question"), F.col("options")),
}


class Catalog:
    """Datasets by name; an unknown name is an error that lists those there are."""

    def __init__(self, spark: SparkSession, datasets: dict[str, Dataset] | None = None):
        self.spark, self.datasets = spark, {}
        for name, dataset in (datasets or {}).items():
            self.add(name, dataset)

    def add(self, name: str, dataset: Dataset) -> None:
        if dataset.maker not in MAKERS:
            raise ValueError(f"{name}: unknown maker {dataset.maker}")
        self.datasets[name] = dataset

    def load(self, name: str, split: str | None = None) -> DataFrame:
        if name not in self.datasets:
            raise KeyError(f"{name} is not among {sorted(self.datasets)}")
        d = self.datasets[name]
        reader = self.spark.read.schema(d.schema) if d.schema else self.spark.read
        df = reader.option("multiLine", d.format == "json_array").format("json" if d.format in ("jsonl", "json_array") else d.format).load(d.path)
        return df if split is None else df.where(F.col("split") == split)

    def conversations(self, name: str, split: str | None = None, training: bool = True) -> DataFrame:
        """The items of a dataset with a column messages, by its maker. A list of questions is for training only."""
        d, df = self.datasets.get(name), self.load(name, split)
        if d.list_field and not training:
            raise ValueError(f"{name}: items with several questions can't be asked at inference")
        return df.withColumn("messages", MAKERS[d.maker](df, d, training))

    def view(self, name: str, split: str | None = None) -> DataFrame:
        df = self.load(name, split)
        df.createOrReplaceTempView(name)
        return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = JUDGED) -> DataFrame:
    """The items of JSON arrays, a file each; an item that doesn't fit the schema is an error, as in a JSON Lines file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_cues(spark: SparkSession, path: str, pattern: str = "*.vtt") -> DataFrame:
    """(name, text): the spoken lines of each subtitle file below a path."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.substring_index(F.input_file_name(), "/", -1).alias("name"), cue_text(F.col("value")).alias("text"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row for each file."""
    return spark.read.text(path, wholetext=True)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files in a folder, without their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One file for each partition; nulls are left out."""
    df.write.mode("overwrite").json(path)


def gather_jsonl(spark: SparkSession, folder: str, target: str, schema: T.StructType) -> DataFrame:
    """All part files of a folder as one file; the parts stay until it is written."""
    read_jsonl(spark, folder, schema).coalesce(1).write.mode("overwrite").json(target)
    return read_jsonl(spark, target, schema)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as one JSON file."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, key: str) -> None:
    """One sorted file with a header."""
    df.coalesce(1).sortWithinPartitions(key).write.mode("overwrite").option("header", True).csv(path)


def save(df: DataFrame, path: str, exists_ok: bool = True, split: str | None = None) -> None:
    """A table that replaces what is there, once it stands in full; partitioned by split, so that one split is pruned to."""
    if exists_ok:
        replace(df, path, [split] if split else [])
    else:
        df.write.partitionBy(*([split] if split else [])).mode("errorifexists").parquet(path)


def save_results(df: DataFrame, path: str) -> None:
    """Results by dataset, split, model and prompt."""
    df.write.mode("overwrite").partitionBy("dataset", "split", "model", "prompt").json(path)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a job has written path in full, so that a rerun can skip it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def statuses(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
