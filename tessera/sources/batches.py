"""Batches that leave Spark: dense arrays of equal width, in shards with an index.

Items are numbered by their length, so a batch holds items of like length and little padding. A batch is one row of
three arrays as bytes (int32, row by row); `format("batches")` writes them to shard files, each by one task under a
name that follows from its batches: a task that runs again writes the same bytes to the same name, and what tasks have
staged counts only when the whole write is committed.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.arrays import IGNORE
from ..operators.stats import numbered
from ..operators.tokens import PAD

SCHEMA = "shard long, batch long, rows int, width int, keys binary, input_ids binary, labels binary, attention_mask binary"
FIELDS = ("keys", "input_ids", "labels", "attention_mask")
INDEX, MAGIC = "index.json", b"BATCHES1"


def by_length(items: DataFrame, key: str, ids: str = "input_ids", batch_rows: int = 32, batches_per_shard: int = 64) -> DataFrame:
    """items with batch and shard, by length and then key (unique, not null); writes its numbers while the plan is built."""
    order = items.select(F.col(key), F.size(ids).alias("_length"))
    numbers = numbered(order, ["_length", key], name="_rank").select(F.col(key).alias("_key"), F.floor(F.col("_rank") / batch_rows).alias("batch"))
    return items.join(numbers, F.col(key) == F.col("_key")).drop("_key").withColumn("shard", F.floor(F.col("batch") / batches_per_shard))


def padding(df: DataFrame, batch: str, length: str) -> DataFrame:
    """One row: tokens, and cells (tokens and padding) if each batch is as wide as its longest item."""
    each = df.groupBy(batch).agg(F.sum(length).alias("t"), (F.count(F.lit(1)) * F.max(length)).alias("c"))
    return each.agg(F.sum("t").alias("tokens"), F.sum("c").alias("cells"))


def dense(batched: DataFrame, key: str, side: str = "right") -> DataFrame:
    """One row for each batch of (key, input_ids, labels, batch, shard); see SCHEMA. A group is one batch."""
    chosen = batched.select("shard", "batch", F.col(key).cast("long").alias("key"), "input_ids", "labels")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        lengths = [len(x) for x in rows["input_ids"]]
        width = max(lengths, default=0)
        shape = (len(rows), width)
        ids, labels, mask = np.full(shape, PAD, "<i4"), np.full(shape, IGNORE, "<i4"), np.zeros(shape, "<i4")
        for i, (x, y, n) in enumerate(zip(rows["input_ids"], rows["labels"], lengths, strict=True)):
            at = slice(0, n) if side == "right" else slice(width - n, width)
            ids[i, at], labels[i, at], mask[i, at] = x, y, 1
        first = rows.iloc[0]
        arrays = {"keys": rows["key"].to_numpy("<i8"), "input_ids": ids, "labels": labels, "attention_mask": mask}
        return pd.DataFrame([{"shard": first["shard"], "batch": first["batch"], "rows": len(rows), "width": width} | {k: a.tobytes() for k, a in arrays.items()}])

    return chosen.groupBy("shard", "batch").applyInPandas(one, SCHEMA)


def write(batches: DataFrame, folder: str) -> None:
    """The rows of dense() as shards in folder, a task for each shard or for several."""
    batches.repartition("shard").sortWithinPartitions("shard", "batch").write.format("batches").mode("append").save(folder)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def encoded(rows: list[Row]) -> bytes:
    """A shard: its name, a JSON header with an offset for each batch, and the arrays one behind the other."""
    head, body, at = [], [], 0
    for r in rows:
        parts = [bytes(r[f]) for f in FIELDS]
        head.append({"batch": r["batch"], "rows": r["rows"], "width": r["width"], "at": at, "sizes": [len(p) for p in parts]})
        body += parts
        at += sum(map(len, parts))
    text = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<q", len(text)), text, *body])


def decoded(data: bytes) -> Iterator[dict]:
    """The batches of a shard, arrays as numpy."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard of batches")
    n = struct.unpack("<q", data[8:16])[0]
    for e in json.loads(data[16 : 16 + n]):
        at, out = 16 + n + e["at"], {"batch": e["batch"], "rows": e["rows"], "width": e["width"]}
        for name, size in zip(FIELDS, e["sizes"], strict=True):
            flat = np.frombuffer(data[at : at + size], "<i8" if name == "keys" else "<i4")
            out[name] = flat if name == "keys" else flat.reshape(e["rows"], e["width"])
            at += size
        yield out


@dataclass
class Written(WriterCommitMessage):
    shards: list[dict]


class BatchWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.folder)
        store.create_dir(root, recursive=True)
        out, held = [], []

        def flush() -> None:
            if held:
                data, name = encoded(held), f"shard-{held[0]['shard']:08d}"
                digest = hashlib.sha256(data).hexdigest()
                with store.open_output_stream(f"{root}/{name}.{digest[:16]}.staged") as f:
                    f.write(data)
                size = {"batches": len(held), "rows": sum(r["rows"] for r in held), "bytes": len(data)}
                out.append({"shard": held[0]["shard"], "name": f"{name}.bin", "staged": f"{name}.{digest[:16]}.staged", "sha256": digest} | size)
                held.clear()

        for row in iterator:
            if held and held[0]["shard"] != row["shard"]:
                flush()
            held.append(row)
        flush()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the shards and then the index; a row for each shard comes here, none for a batch."""
        store, root = _store(self.folder)
        shards = sorted((s for m in messages if m for s in m.shards), key=lambda s: s["shard"])
        for s in shards:
            store.move(f"{root}/{s['staged']}", f"{root}/{s['name']}")
        index = [{k: v for k, v in s.items() if k != "staged"} for s in shards]
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{INDEX}.staged") as f:
            f.write(json.dumps(index, indent=0).encode())
        store.move(f"{root}/{INDEX}.staged", f"{root}/{INDEX}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        for s in (s for m in messages if m for s in m.shards):
            store.delete_file(f"{root}/{s['staged']}")


@dataclass
class Shard(InputPartition):
    name: str
    number: int
    sha256: str


class BatchReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Shard]:
        store, root = _store(self.folder)
        with store.open_input_stream(f"{root}/{INDEX}") as f:
            return [Shard(s["name"], s["shard"], s["sha256"]) for s in json.loads(f.read())] or [Shard("", 0, "")]

    def read(self, partition: Shard) -> Iterator[tuple]:
        if not partition.name:
            return
        store, root = _store(self.folder)
        with store.open_input_file(f"{root}/{partition.name}") as f:
            data = f.read()
        if hashlib.sha256(data).hexdigest() != partition.sha256:
            raise ValueError(f"{partition.name} is not the shard that the index names")
        for b in decoded(data):
            yield (partition.number, b["batch"], b["rows"], b["width"], *(bytearray(b[f].tobytes()) for f in FIELDS))


class BatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batches"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes format("batches") known to a session."""
    spark.dataSource.register(BatchSource)
