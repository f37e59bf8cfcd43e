"""Tables that change at once, and steps that are taken up where a run has stopped.

A table is a folder of versions and a small file that names the one that counts. A version is written in full before
that file is replaced by a rename, so a reader finds the old rows or the new ones and never half of them, and a write
that dies leaves nothing that anybody reads. Each version has a key; a step whose key is there already is not run.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..scratch import delete, exists

CURRENT = "current.json"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def rename(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """Moves a file or folder; with overwrite a file takes the place of another at once."""
    jvm = spark._jvm
    (src, _), (dst, fs) = _hadoop(spark, source), _hadoop(spark, target)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(src), fs.makeQualified(dst), how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears at once."""
    staged = f"{path}.{uuid.uuid4().hex}"
    at, fs = _hadoop(spark, staged)
    out = fs.create(at, True)
    out.write(text.encode())
    out.close()
    rename(spark, staged, path, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path, wholetext=True).first()["value"] if exists(spark, path) else None


class Table:
    """A folder whose rows change all at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict:
        """version, key, before (the version it replaced) and the time of writing; empty if nothing was written yet."""
        text = read_text(self.spark, f"{self.path}/{CURRENT}")
        return json.loads(text) if text else {}

    def read(self) -> DataFrame:
        version = self.manifest().get("version")
        if version is None:
            raise FileNotFoundError(f"{self.path} has no version")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, df: DataFrame, key: str = "", partition_by: Sequence[str] = (), **more: object) -> None:
        """df may read the table itself. The version before stays for readers that have begun; older ones go."""
        old, version = self.manifest(), f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{version}")
        write_text(self.spark, f"{self.path}/{CURRENT}", json.dumps({"version": version, "key": key, "before": old.get("version"), "written": time.time()} | more))
        if old.get("before"):
            delete(self.spark, f"{self.path}/{old['before']}")


#: What numbers Spark and this process give to columns and to the arguments of functions: they differ from run to run.
NUMBERS = re.compile(r"#\d+L?|\b[a-z]_\d+\b|, \[plan_id=\d+\]|@[0-9a-f]+")


def fingerprint(df: DataFrame, *more: object) -> str:
    """A hash of the analysed plan, of the files that it reads with their sizes and times, and of more.

    A Python function counts by its name only: name what it depends on in more, such as a version of its code.
    """
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    found = []
    for name in sorted(df.inputFiles()):
        at, fs = _hadoop(df.sparkSession, name)
        if exists(df.sparkSession, name):
            status = fs.getFileStatus(at)
            found.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join([NUMBERS.sub("", plan), str(df.schema), *found, *map(repr, more)]).encode()).hexdigest()


Step = tuple[str, Callable[[DataFrame], DataFrame]]


def run_steps(source: DataFrame, steps: Sequence[Step], folder: str, version: object = None) -> DataFrame:
    """The rows of the last step; each step's rows are a Table of its name in folder.

    A step whose plan and input are those of its table is read, not run: so a run that died goes on with the step that
    it died in, and a change of a step or of the source runs that step and all behind it.
    """
    if len({name for name, _ in steps}) < len(steps):
        raise ValueError("steps of one name")
    df = source
    for name, step in steps:
        table = Table(df.sparkSession, f"{folder}/{name}")
        made = step(df)
        key = fingerprint(made, name, version)
        if table.manifest().get("key") != key:
            table.write(made, key)
        df = table.read()
    return df


def progress(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """(step, finished, written): which of the named steps have a table, and since when (seconds)."""
    rows = [(name, bool(m := Table(spark, f"{folder}/{name}").manifest()), m.get("written")) for name in names]
    return spark.createDataFrame(rows, "step string, finished boolean, written double")


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Writes df as the plain folder path; what was there goes when the new rows stand beside it.

    A reader that lists the folder between two renames finds none; one that must not, reads a Table. df may read path.
    """
    spark, tag = df.sparkSession, uuid.uuid4().hex
    staged, old = f"{path.rstrip('/')}.new-{tag}", f"{path.rstrip('/')}.old-{tag}"
    df.write.partitionBy(*partition_by).parquet(staged)
    there = exists(spark, path)
    if there:
        rename(spark, path, old)
    rename(spark, staged, path)
    if there:
        delete(spark, old)
