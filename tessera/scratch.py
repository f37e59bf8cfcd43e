"""Tables that passes hand to each other: written once to a shared folder, so that neither later passes nor the loss of
executors computes them again.

A table belongs to the scope in which it was written. `with owned(spark):` deletes its own tables at the end, and no
others; put it round the action that reads them. Outside any scope a table stays until `release()` or until the folder
is cleared, as Spark's own checkpoints do.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders made for applications whose session names none, by application.
_made: dict[str, str] = {}
_outside: list[str] = []
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one (local master) or one below the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app = spark.sparkContext.applicationId
        if app not in _made:
            local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
            _made[app] = tempfile.mkdtemp(prefix="tessera-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        path = _made[app]
    return path.rstrip("/")


def delete(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def own(path: str) -> str:
    """path, to be deleted with the scope that is open now."""
    held = _scope.get()
    (_outside if held is None else held).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back."""
    spark = df.sparkSession
    path = own(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; those of outer scopes and of other threads stay."""
    held: list[str] = []
    token = _scope.set(held)
    try:
        yield
    finally:
        _scope.reset(token)
        delete(spark, *held)


def release(spark: SparkSession) -> None:
    """Deletes the tables that were written outside any scope; call it when nothing reads them any more."""
    paths = _outside.copy()
    _outside.clear()
    delete(spark, *paths)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
