"""Results that arrive as a stream, kept by id: replays don't count twice, corrections take the place of what they correct.

Each micro-batch is a folder of its number, so that a batch that is delivered again writes over itself. What counts for
an id is its last row: by the order column, then by the number of the batch. From time to time the batches are merged
into a table that remembers up to which batch it reaches; batches up to there are ignored when they come again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from ..operators import scoring as S
from ..scratch import delete, exists
from ..sources.tables import Table, _hadoop


class ResultStore:
    """The results in a shared folder, of rows with the columns id and, if it is named, order."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, order: str | None = None):
        self.spark, self.folder, self.order = spark, folder.rstrip("/"), order
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.kept = StructType(list(self.schema.fields)).add("_batch", LongType())
        self.base = Table(spark, f"{self.folder}/base")

    def reached(self) -> int:
        """The number of the last batch that the merged table holds; -1 without one."""
        return self.base.manifest().get("upto", -1)

    def batches(self) -> list[int]:
        """Numbers of whole batches that are not merged yet: names in one folder, no rows."""
        at, fs = _hadoop(self.spark, f"{self.folder}/batches")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        upto = self.reached()
        found = [int(n.split("=")[1]) for n in names if n.startswith("n=")]
        return sorted(n for n in found if n > upto and exists(self.spark, f"{self.folder}/batches/n={n}/_SUCCESS"))

    def apply(self, rows: DataFrame, number: int) -> None:
        """Takes a micro-batch; one that was merged before is ignored, one that was written before is written over."""
        if number > self.reached():
            rows.select(*[f.name for f in self.schema.fields]).withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/batches/n={number}")

    def _last(self, batches: list[int]) -> DataFrame:
        parts = [f"{self.folder}/batches/n={n}" for n in batches]
        rows = self.spark.read.schema(self.kept).parquet(*parts) if parts else self.spark.createDataFrame([], self.kept)
        if self.base.manifest():
            rows = rows.unionByName(self.base.read())
        names = [f.name for f in self.kept.fields]
        # Equal places are told apart by the rows themselves, so that any order of arrival gives the same.
        place = F.struct(*([F.col(self.order)] if self.order else []), F.col("_batch"), F.xxhash64(*[f.name for f in self.schema.fields]).alias("_tie"))
        return rows.groupBy("id").agg(F.max_by(F.struct(*names), place).alias("r")).select("r.*")

    def current(self) -> DataFrame:
        """The last row of each id. Rows are reduced by id where they are, then meet in one shuffle."""
        return self._last(self.batches()).drop("_batch")

    def merge(self) -> None:
        """Moves all whole batches into the table; a reader finds the rows before or after, which are the same."""
        done = self.batches()
        if done:
            self.base.write(self._last(done), upto=done[-1])
            delete(self.spark, *[f"{self.folder}/batches/n={n}" for n in done])

    def score(self, **options) -> DataFrame:
        """The score of what counts now, by the rules of the batch score."""
        return S.score(self.current(), **options)


def start(results: DataFrame, store: ResultStore, checkpoint: str, merge_every: int = 50) -> StreamingQuery:
    """Works off what is there and ends; a restart goes on from the checkpoint, and its first batch may be one that was seen."""

    def take(rows: DataFrame, number: int) -> None:
        store.apply(rows, number)
        if number % merge_every == merge_every - 1:
            store.merge()

    return results.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
