"""Line dedup with sharded cuckoo filters over exact reference counts.

The state of a corpus is two tables:

* references (shard, h1, h2, id, doc): one row for each distinct key of a document. Its counts by key are exact;
  a batch of documents adds rows, and deleting documents removes theirs, which undoes the insertion exactly.
* filters (shard, blob): for each shard, a cuckoo filter of the keys that are due for a look-up. Unlike a Bloom
  filter it takes deletions, so that keys whose count falls leave it again.

Finding the lines to drop goes through the filters: references are dealt by shard, a great shard to several tasks
by its count; each task streams over its shard's filter and drops the references that the filter rules out, and only the few that pass are joined with
the exact counts. So an answer never rests on the filter alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, mix64, partitions, raw_texts, small_batches

#: Keys of fewer code points are never dropped.
LEAST = 10
#: Most references of a shard that one task screens, and how many times the mean of all shards: a shard that holds a hot
#: line has more and is spread over several tasks.
TASK_REFERENCES, TASK_MEANS = 1_000_000, 2
STRIP = b" \t\n\x0b\x0c\r"
#: Sorts null doc_ids behind all others.
NO_ID = 2**63 - 1


class CuckooFilter:
    """16-bit fingerprints in buckets of four, over arrays of 64-bit keys; partial-key cuckoo hashing."""

    SLOTS = 4
    KICKS = 500

    def __init__(self, capacity: int):
        size = 1
        while size * self.SLOTS * 0.84 < max(capacity, 1):
            size *= 2
        self.table = np.zeros((size, self.SLOTS), np.uint16)
        #: Keys that found no slot: kept in full, so that nothing that was inserted is ever missed.
        self.stash: list[int] = []

    @property
    def mask(self) -> np.uint64:
        return np.uint64(len(self.table) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = mix64(keys) & self.mask
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ mix64(prints.astype(np.uint64))) & self.mask

    def insert(self, keys: np.ndarray) -> None:
        prints, first, second = self._places(keys)
        left = np.arange(len(keys))
        for places in (first, second):
            for slot in range(self.SLOTS):
                if not len(left):
                    return
                free = left[self.table[places[left], slot] == 0]
                _, one = np.unique(places[free], return_index=True)  # one newcomer for each bucket in a round
                took = free[one]
                self.table[places[took], slot] = prints[took]
                left = np.setdiff1d(left, took, assume_unique=True)
        for i in left.tolist():
            self._kick(prints[i], int(second[i]), int(keys[i]))

    def _kick(self, mark: np.uint16, bucket: int, key: int) -> None:
        undo = []
        for turn in range(self.KICKS):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return
            slot = turn % self.SLOTS
            undo.append((bucket, slot, mark))
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self._other(np.array([bucket], np.uint64), np.array([mark], np.uint16))[0])
        for bucket, slot, own in reversed(undo):
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            assert mark == own
        self.stash.append(key)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        found = ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)
        return found | np.isin(keys, np.array(self.stash, np.uint64)) if self.stash else found

    def delete(self, keys: np.ndarray) -> None:
        """Removes one copy of each key; only keys that were inserted may be given."""
        prints, first, second = self._places(keys)
        for i, key in enumerate(keys.tolist()):
            if key in self.stash:
                self.stash.remove(key)
                continue
            for bucket in (int(first[i]), int(second[i])):
                at = np.flatnonzero(self.table[bucket] == prints[i])
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return len(self.table).to_bytes(8, "little") + self.table.tobytes() + np.array(self.stash, np.uint64).tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        size = int.from_bytes(blob[:8], "little")
        out = cls(1)
        out.table = np.frombuffer(blob, np.uint16, size * cls.SLOTS, 8).reshape(size, cls.SLOTS).copy()
        out.stash = np.frombuffer(blob, np.uint64, -1, 8 + 2 * size * cls.SLOTS).tolist()
        return out


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """The key, stripped and with A-Z lower-cased, or None if it is too short to be dropped."""
    key = line.strip(STRIP).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def _references(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            own = {xxhash.xxh3_128_digest(k) for k in map(line_key, text.split(b"\n")) if k is not None}
            ids += [NO_ID if doc is None else doc] * len(own)
            hashes += own
        h = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2)
        h1, h2 = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
        yield pa.record_batch([pa.array((h1 % np.uint64(shards)).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.int64())], names=["shard", "h1", "h2", "id"])


def references(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, h1, h2, id): the distinct keys of each document; the 128-bit hash stands for the key."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda b: _references(b, shards), "shard int, h1 long, h2 long, id long")


def counts(refs: DataFrame) -> DataFrame:
    """The exact reference counts: (shard, h1, h2, n, keeper, last), with a partial count in each task first."""
    return refs.groupBy("shard", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper"), F.max("id").alias("last"))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter for each run of a shard; a shard that is dealt to several tasks gets several filters."""
    keys: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        shard = batch.column(0).to_numpy()
        h = batch.column(1).to_numpy().view(np.uint64)
        for s in np.unique(shard).tolist():
            keys.setdefault(s, []).append(h[shard == s])
    for s, parts in keys.items():
        own = np.concatenate(parts)
        f = CuckooFilter(len(own))
        f.insert(own)
        yield pa.record_batch([pa.array([s], pa.int32()), pa.array([f.to_bytes()], pa.binary())], names=["shard", "blob"])


def state(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(references, filters) of docs, to be changed by insert() and delete()."""
    refs = materialize(references(docs, shards).distinct(), "line-references")
    return refs, materialize(filters(counts(refs).where("keeper < last")), "line-filters")


def insert(refs: DataFrame, blobs: DataFrame, docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The state with docs added; shards is that of state(). A key that a document has already isn't counted again."""
    new = references(docs, shards).distinct().join(refs, ["shard", "h1", "h2", "id"], "left_anti")
    new = materialize(new, "line-references-new")
    after = materialize(refs.unionByName(new), "line-references")
    return after, _follow(refs, after, new, blobs)


def delete(refs: DataFrame, blobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state without the documents of ids (doc_id); a null stands for the rows without one."""
    gone = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")).distinct()
    after = materialize(refs.join(gone, "id", "left_anti").select(*refs.columns), "line-references")
    return after, _follow(refs, after, refs.join(gone, "id", "left_semi"), blobs)


def _follow(before: DataFrame, after: DataFrame, touched: DataFrame, blobs: DataFrame) -> DataFrame:
    """The filters with those of the touched keys that became due inserted, and those that are due no longer deleted."""
    keys = ["shard", "h1", "h2"]
    touched = touched.select(*keys).distinct()
    was, now = (counts(x.join(touched, keys, "left_semi")).where("keeper < last").select(*keys) for x in (before, after))
    none = F.lit(None)
    moves = now.join(was, keys, "left_anti").withColumn("due", F.lit(True)).unionByName(was.join(now, keys, "left_anti").withColumn("due", F.lit(False)))
    rows = moves.select("shard", "h1", "due", none.cast("binary").alias("blob")).unionByName(blobs.select("shard", none.cast("long").alias("h1"), none.cast("boolean").alias("due"), "blob"))
    moved = materialize(rows.groupBy("shard").applyInArrow(_move, "shard int, blob binary"), "line-filters-moved")
    full = counts(after.join(moved.where("blob is null").select("shard"), "shard", "left_semi")).where("keeper < last")
    return materialize(moved.where("blob is not null").unionByName(filters(full)), "line-filters")


def _move(rows: pa.Table) -> pa.Table:
    """A shard's filter after its moves; null if it must be built anew, as it is missing, one of several or too full."""
    old = [x for x in rows["blob"].to_pylist() if x is not None]
    moves = rows.filter(rows["h1"].is_valid())
    h, due, blob = moves["h1"].to_numpy().view(np.uint64), np.array(moves["due"].to_pylist(), bool), None
    if len(old) == 1:
        f = CuckooFilter.from_bytes(old[0])
        f.delete(h[~due])
        if int((f.table > 0).sum()) + int(due.sum()) <= 0.84 * f.table.size:
            f.insert(h[due])
            blob = f.to_bytes()
    return pa.table({"shard": pa.array([rows["shard"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})


def filters(shared: DataFrame) -> DataFrame:
    """(shard, blob) over the keys of (shard, h1, ...); a shard's filter holds some two bytes a key."""
    return shared.select("shard", "h1").repartition(partitions(shared.sparkSession), "shard").mapInArrow(_build, "shard int, blob binary")


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, salt, blob is null): filters come before the references of their shard."""
    at, held = None, []
    for batch in batches:
        shard, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
        keep = np.zeros(len(shard), bool)
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            if lo == hi:
                continue
            if (int(shard[lo]), int(salt[lo])) != at:
                at, held = (int(shard[lo]), int(salt[lo])), []
            part = batch.slice(lo, hi - lo)
            new = part.num_rows - part.column(5).null_count
            held += [CuckooFilter.from_bytes(x) for x in part.column(5).slice(0, new).to_pylist()]
            h = part.column(2).slice(new).to_numpy().view(np.uint64)
            for f in held:
                keep[lo + new : hi] |= f.contains(h)
        yield batch.select([0, 2, 3, 4]).filter(pa.array(keep))


def candidates(refs: DataFrame, blobs: DataFrame, each: int = TASK_REFERENCES) -> DataFrame:
    """The references that the filter of their shard doesn't rule out.

    References are counted by shard, and a shard is spread over a task for each ``each`` of them, or TASK_MEANS times the
    mean of all shards if that is less, with a copy of its filter in each. The counts have a row for each shard, and
    shards are a parameter: the bound that a broadcast needs.
    """
    n = partitions(refs.sparkSession)
    sizes = refs.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    most = min(each, max(1.0, TASK_MEANS * (sizes.agg(F.avg("n")).first()[0] or 0.0)))
    tasks = F.broadcast(sizes.select("shard", F.ceil(F.col("n") / most).cast("int").alias("salts")))
    rows = refs.join(tasks, "shard").select("shard", F.pmod(F.hash("id", "h2"), F.col("salts")).alias("salt"), "h1", "h2", "id", F.lit(None).cast("binary").alias("blob"))
    zero = F.lit(0).cast("long")
    own = blobs.join(tasks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), zero.alias("h1"), zero.alias("h2"), zero.alias("id"), "blob")
    return rows.unionByName(own).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull()).mapInArrow(_screen, "shard int, h1 long, h2 long, id long")


def drops(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(id, keys): the 16-byte keys whose lines a document loses, as they stay in a document of a smaller id.

    Keys of more than 1/HOT of all references are broadcast to the references that passed, the others are joined.
    """
    shards = shards or 4 * partitions(docs.sparkSession)
    refs = materialize(references(docs, shards), "line-references")
    shared = materialize(counts(refs).where("keeper < last"), "line-counts")
    passed = candidates(refs, filters(shared))
    lost = join_hot(passed, shared.select("h1", "h2", "n", "keeper"), ["h1", "h2"], "n").where("id > keeper")
    return lost.groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))


def _rebuild(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        lost_at, text_at = names.index("_tessera_keys"), names.index("_tessera_text")
        n_lines, n_dropped, kept = [], [], []
        for text, lost in zip(raw_texts(batch.column(text_at)), batch.column(lost_at).to_pylist(), strict=True):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if lost:
                gone = {(x["h1"] % 2**64).to_bytes(8, "big") + (x["h2"] % 2**64).to_bytes(8, "big") for x in lost}
                left = [line for line in lines if (k := line_key(line)) is None or xxhash.xxh3_128_digest(k) not in gone]
                n_dropped.append(len(lines) - len(left))
                text = b"\n".join(left)
            else:
                n_dropped.append(0)
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        rest = [i for i in range(batch.num_columns) if i not in (lost_at, text_at)]
        yield pa.record_batch([*(batch.column(i) for i in rest), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=[*(names[i] for i in rest), "_tessera_lines", "_tessera_dropped", "_tessera_kept"])


def dedup_lines(docs: DataFrame, digest: bool = False, shards: int | None = None) -> DataFrame:
    """The columns of docs but text, then _tessera_lines, _tessera_dropped and _tessera_kept (text, or its SHA-256).

    A null or empty text is one empty line. Rows that share a doc_id are one document; rows without one are
    together a document behind all others. Lines of fewer than LEAST code points stay. Repeated lines within
    the document that holds them stay. An empty table gives an empty result.
    """
    lost = drops(docs, shards).select(F.col("id").alias("_tessera_id"), F.col("keys").alias("_tessera_keys"))
    rest = [c for c in docs.columns if c != "text"]
    joined = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").cast("string").alias("_tessera_text")).join(lost, F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("_tessera_id"), "left").drop("_tessera_id")
    schema = joined.select(*[F.col(f"`{c}`") for c in rest], F.lit(0).cast("long").alias("_tessera_lines"), F.lit(0).cast("long").alias("_tessera_dropped"), F.lit("").alias("_tessera_kept")).schema
    return joined.mapInArrow(lambda b: _rebuild(b, digest), schema)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines gone from text, and n_chars (where there is one) set anew; all rows stay."""
    out = dedup_lines(docs)
    new = {"text": F.col("_tessera_kept"), "n_chars": F.length("_tessera_kept").cast("long")}
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, digest=True).select("doc_id", F.col("_tessera_lines").alias("n_lines"), F.col("_tessera_dropped").alias("n_dropped"), F.col("_tessera_kept").alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
d AS (SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
