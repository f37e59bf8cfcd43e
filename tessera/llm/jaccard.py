"""N-gram Jaccard join by rare-first prefix filtering, and the groups that its links form.

A class is a set of shingles; documents with equal sets are one class (its id: 64 + 32 bits of a hash of the set), so
exact copies are never compared. The steps, each a stream over packed arrays:

1. shingle   texts -> postings (hash, class), dealt by range of the hash; the number of ranges follows the size of
             the input. Within a flush of a task, shingles of HEAVY classes or more are set apart, for the rest of the
             task too: their postings go straight to the classes and only a mark goes to the range, so that a passage
             of a third of all documents never meets in one task. Rows of documents are dealt by batch, not by class.
2. rank      a range counts the classes of each shingle. Those of one class are dropped: no other holds them. The
             others go back to their classes with their count.
3. prefix    a class has n shingles, of which s are shared. In the order rare first (unique, by count, heavy; then
             by hash) two linked classes have a common shingle among the first n - ceil(0.75 n) + 1. If unique ones
             fill that prefix, no link is possible. The others are candidates, with their prefix and all shared ones.
4. join      candidates meet on prefix shingles. Those of near length form a chain by length, tied to its first, so
             that what is linked by any chain of candidate pairs falls into one block, without a row for each pair.
5. verify    within a block, a pair is compared once, after the length, prefix, positional and suffix filters; a
             search over the links leaves out classes that are reached already, so a group of thousands of near
             copies costs few comparisons. A block beyond the bound of a task is not compared as a whole: classes
             first meet on one or two of their prefix shingles, which finds most links; what these links join need
             not meet again. Then only shingles whose classes are not yet all joined are taken, each set of classes
             once, and in them only what is outside the greatest joined part is compared with the others.
6. group     connected components of the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, deal, grouped_blobs, join_hot, materialize, partitions, raw_texts, rolling, signed, small_batches
from .components import components

WORDS = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
#: Shingles of one flush of a task, and the classes of a flush from which a shingle is heavy.
FLUSH, HEAVY = 1_000_000, 16
#: Heavy shingles that a task remembers.
REMEMBERED = 1_000_000
#: Bytes of input for each range of shingles, and the most tasks that ranges are dealt to.
RANGE_BYTES, MOST_TASKS = 12 << 20, 20_000
#: Classes and shared shingles that are compared in one go.
CUT_CLASSES, CUT_SHINGLES = 1024, 4_000_000
#: Rounds in which the classes of a great block meet on one shingle each.
ROUNDS = 2
#: Ranges of shingles whose counts bound an overlap (suffix filter).
SUFFIX = 8

PACKED = "bucket int, kind int, a binary, b binary, c binary, d binary"
POSTINGS, MARKS, HEAVIES, SHARED, DOCS, SIZES = range(6)
CLASS = np.dtype([("s", "<u8"), ("t", "<u4")])
#: Rank of heavy shingles: behind all counts.
LAST = np.uint32(2**32 - 1)


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    """The smallest intersection of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def shingles(text: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; A-Z count as a-z."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    return np.unique(rolling(hashes.of(own), min(words, len(own))))


def class_id(own: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(own.tobytes())
    return h & (2**64 - 1), (h >> 64) & (2**32 - 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    types = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "kind", "a", "b", "c", "d"])


def _batches(rows: list[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += sum(map(len, row[2:]))
        if held >= most:
            yield _batch(part)
            part, held = [], 0
    if part:
        yield _batch(part)


def _packed(kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    return [(b, kind, *blobs, *[b""] * (4 - len(blobs))) for b, blobs in deal(bucket, columns)]


def class_bucket(s: np.ndarray, buckets: int) -> np.ndarray:
    return ((s >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def token_bucket(t: np.ndarray, buckets: int) -> np.ndarray:
    return ((t >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _by_class(kind: int, bucket: np.ndarray, cls: np.ndarray, rest: list[np.ndarray]) -> list[tuple]:
    """Packed rows of parallel columns in which the classes of a bucket stand once, with their run lengths."""
    if not len(cls):
        return []
    order = np.lexsort((cls["t"], cls["s"], bucket))
    bucket, cls, rest = bucket[order], cls[order], [c[order] for c in rest]
    starts = np.flatnonzero(np.concatenate([[True], (cls[1:] != cls[:-1]) | (bucket[1:] != bucket[:-1])]))
    runs = np.diff(np.append(starts, len(cls))).astype(np.uint32)
    heads = dict(deal(bucket[starts], [cls[starts], runs]))
    return [(b, kind, *heads[b], *blobs, *[b""] * (2 - len(blobs))) for b, blobs in deal(bucket, rest)]


def _unpacked(rows: list[dict], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """What _by_class packed: the class of each element, and the columns."""
    types = (np.uint64, np.uint32)
    cls = [np.repeat(np.frombuffer(r["a"], CLASS), np.frombuffer(r["b"], np.uint32)) for r in rows]
    columns = [np.concatenate([np.frombuffer(r[k], t) for r in rows] or [np.zeros(0, t)]) for k, t in list(zip("cd", types, strict=True))[:width]]
    return np.concatenate(cls or [np.zeros(0, CLASS)]), columns


def _shingle(batches: Iterator[pa.RecordBatch], buckets: int, words: int, flush_at: int = FLUSH, heavy_at: int = HEAVY) -> Iterator[pa.RecordBatch]:
    hashes, seen = WordHashes(), set()
    sets: list[np.ndarray] = []
    classes: list[tuple[int, int]] = []
    held, place, known_heavy = 0, TaskContext.get().partitionId(), np.zeros(0, np.uint64)

    def flush() -> list[tuple]:
        nonlocal held, known_heavy
        if not sets:
            return []
        tokens = np.concatenate(sets)
        sizes = np.array([len(x) for x in sets], np.uint32)
        own = np.array(classes, CLASS)
        cls = np.repeat(own, sizes)
        ordered = np.sort(tokens)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        heavy = ordered[starts][np.diff(np.append(starts, len(ordered))) >= heavy_at]
        new = np.setdiff1d(heavy, known_heavy, assume_unique=True)
        known_heavy = np.union1d(known_heavy, new) if len(known_heavy) + len(new) <= REMEMBERED else heavy
        at = np.minimum(np.searchsorted(known_heavy, tokens), max(0, len(known_heavy) - 1))
        is_heavy = known_heavy[at] == tokens if len(known_heavy) else np.zeros(len(tokens), bool)
        rows = _packed(MARKS, token_bucket(new, buckets), [new])
        rows += _packed(SIZES, class_bucket(own["s"], buckets), [own, sizes])
        rows += _by_class(HEAVIES, class_bucket(cls["s"][is_heavy], buckets), cls[is_heavy], [tokens[is_heavy]])
        light = ~is_heavy
        rows += _by_class(POSTINGS, token_bucket(tokens[light], buckets), cls[light], [tokens[light]])
        sets.clear(), classes.clear()
        held = 0
        return rows

    for batch in batches:
        docs, n, own_class = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            own = shingles(text, hashes, words)
            c = class_id(own)
            docs.append(doc), n.append(len(own)), own_class.append(c)
            if len(own) and c not in seen:
                seen.add(c)
                sets.append(own), classes.append(c)
                held += len(own)
        cls = np.array(own_class, CLASS)
        known = np.array([d is not None for d in docs])
        ids = np.array([0 if d is None else d for d in docs], np.int64)
        place += 7919  # the rows of a batch go to one task, whatever their classes are
        yield from _batches(_packed(DOCS, np.full(len(docs), place % buckets), [cls, np.array(n, np.uint32), ids, known]))
        if held >= flush_at:
            yield from _batches(flush())
            if len(seen) > 1_000_000:
                seen.clear()
    yield from _batches(flush())


def _rank(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for _, rows in grouped_blobs(batches, "bucket"):
        yield from _batches([tuple(r[k] for k in ("bucket", "kind", "a", "b", "c", "d")) for r in rows if r["kind"] not in (POSTINGS, MARKS)])
        yield from _rank_range([r for r in rows if r["kind"] == POSTINGS], [np.frombuffer(r["a"], np.uint64) for r in rows if r["kind"] == MARKS], buckets)


def _rank_range(postings: list[dict], marks: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    heavy = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
    cls, (tokens,) = _unpacked(postings, 1)
    postings.clear()
    if not len(tokens):
        return
    order = np.argsort(tokens)
    tokens, cls = tokens[order], cls[order]
    same = tokens[1:] == tokens[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    if len(heavy):
        several |= np.isin(tokens, heavy)
    tokens, cls = tokens[several], cls[several]
    order = np.lexsort((cls["t"], cls["s"], tokens))
    tokens, cls = tokens[order], cls[order]
    once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])])[: len(tokens)]
    tokens, cls = tokens[once], cls[once]  # copies in several tasks count once
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)])
    runs = np.diff(np.append(starts, len(tokens)))
    rank = np.repeat(runs.astype(np.uint32), runs)
    if len(heavy):
        rank[np.isin(tokens, heavy)] = LAST
    shared = rank >= 2
    tokens, cls, rank = tokens[shared], cls[shared], rank[shared]
    yield from _batches(_by_class(SHARED, class_bucket(cls["s"], buckets), cls, [tokens, rank]))


CANDIDATES = "doc_id long, n int, s long, t long, tokens binary, prefix binary, places binary"
NAMES = [c.split()[0] for c in CANDIDATES.split(", ")]


def _prefix(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, n, class), and rows of candidate classes (with tokens); see prefix above."""
    for _, rows in grouped_blobs(batches, "bucket"):
        kinds = {k: [r for r in rows if r["kind"] == k] for k in (HEAVIES, SHARED, SIZES, DOCS)}
        rows.clear()
        if docs := kinds.pop(DOCS):
            cls = np.concatenate([np.frombuffer(r["a"], CLASS) for r in docs])
            n = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in docs])
            ids = np.concatenate([np.frombuffer(r["c"], np.int64) for r in docs])
            known = np.concatenate([np.frombuffer(r["d"], bool) for r in docs])
            blank = pa.nulls(len(n), pa.binary())
            yield pa.record_batch([pa.array(ids, mask=~known), pa.array(n.astype(np.int32)), pa.array(signed(np.ascontiguousarray(cls["s"]))), pa.array(cls["t"].astype(np.int64)), blank, blank, blank], names=NAMES)
        yield from _prefix_classes(kinds[HEAVIES], kinds[SHARED], kinds[SIZES], percent)


def _prefix_classes(heavies: list[dict], shared: list[dict], sizes: list[dict], percent: int) -> Iterator[pa.RecordBatch]:
    cls_h, (tok_h,) = _unpacked(heavies, 1)
    cls_s, (tok_s, rank_s) = _unpacked(shared, 2)
    heavies.clear(), shared.clear()
    cls, tokens, rank = np.concatenate([cls_h, cls_s]), np.concatenate([tok_h, tok_s]), np.concatenate([np.full(len(tok_h), LAST), rank_s])
    if not len(cls):
        return
    # In the order of each class: rare first, then by hash; what came both as heavy and as light counts once.
    order = np.lexsort((tokens, rank, cls["t"], cls["s"]))
    cls, tokens, rank = cls[order], tokens[order], rank[order]
    once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])])
    cls, tokens = cls[once], tokens[once]
    starts = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    table = np.concatenate([np.frombuffer(r["a"], CLASS) for r in sizes])
    count = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in sizes])
    length = dict(zip(zip(table["s"].tolist(), table["t"].tolist(), strict=True), count.tolist(), strict=True))
    rows = []
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cls)], strict=True):
        s, t = int(cls["s"][lo]), int(cls["t"][lo])
        n, own = length[s, t], tokens[lo:hi]
        reach = n - least_overlap(n, percent) + 1  # length of the prefix
        unique = n - len(own)
        if unique >= reach:
            continue
        head = own[: reach - unique]
        rows.append((None, n, s - 2**64 if s >= 2**63 else s, t, own.tobytes(), head.tobytes(), np.arange(unique, reach, dtype=np.uint32).tobytes()))
        if len(rows) >= 2000:
            yield _candidate_batch(rows)
            rows = []
    yield _candidate_batch(rows)


def _candidate_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, node, prefix) -> a row for each shingle of a prefix."""
    for batch in batches:
        heads = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        runs = [len(x) for x in heads]
        yield pa.record_batch([pa.array(np.concatenate([*heads, np.zeros(0, np.int64)])), pa.array(np.repeat(batch.column(0).to_numpy(), runs)), pa.array(np.repeat(batch.column(1).to_numpy(), runs))], names=["token", "n", "node"])


def _chains(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, n). In a run each length is near the one before; all of a run are tied to its first."""
    last, seen = None, np.zeros(0, np.dtype([("a", "<i8"), ("b", "<i8")]))

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.ascontiguousarray(seen["a"])), pa.array(np.ascontiguousarray(seen["b"]))], names=["a", "b"])

    for batch in batches:
        token, n, s = (batch.column(i).to_numpy() for i in range(3))
        if not len(token):
            continue
        before = last or (token[:1] ^ 1, n[:1], s[:1])
        near = (token == np.append(before[0], token[:-1])) & (100 * np.append(before[1], n[:-1]).astype(np.int64) >= percent * n.astype(np.int64))
        first = np.maximum.accumulate(np.where(near, -1, np.arange(len(s))))
        hub = np.where(first < 0, before[2], s[np.maximum(first, 0)])
        last = (token[-1:], n[-1:], hub[-1:])
        pairs = np.zeros(len(s), seen.dtype)
        pairs["a"], pairs["b"] = np.minimum(s, hub), np.maximum(s, hub)
        seen = np.unique(np.concatenate([seen, pairs[s != hub]]))
        if len(seen) > 200_000:
            yield out()
            seen = seen[:0]
    yield out()


def links(n: np.ndarray, sets: list[np.ndarray], heads: list[np.ndarray], places: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs (first of a search, class it reaches), which join all that is linked; with two sides (0 and 1), only pairs across are compared.

    A search: a class is compared with those not yet reached, so each pair is compared once at most. Before its sets
    are intersected, a pair passes the filters of length, prefix, position and suffix.
    """
    k = len(n)
    runs = np.array([len(x) for x in sets])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(k), runs)
    offsets = np.concatenate([[0], np.cumsum(runs)])
    part = flat * SUFFIX // max(1, len(vocabulary))
    spread = np.bincount(owner * SUFFIX + part, minlength=k * SUFFIX).reshape(k, SUFFIX)
    head_flat = np.searchsorted(vocabulary, np.concatenate(heads))
    head_owner, head_place = np.repeat(np.arange(k), [len(x) for x in heads]), np.concatenate(places).astype(np.int64)
    order = np.argsort(head_flat, kind="stable")
    posted, posted_place = head_owner[order], head_place[order]
    first = np.searchsorted(head_flat[order], np.arange(len(vocabulary) + 1))
    head_offsets = np.concatenate([[0], np.cumsum([len(x) for x in heads])])
    two = bool(side.any()) and not side.all()
    reached, found, mark = np.zeros(k, bool), [], np.zeros(len(vocabulary), bool)
    n = n.astype(np.int64)
    for begin in range(k):
        if reached[begin]:
            continue
        reached[begin] = True
        queue = [begin]
        while queue:
            v = queue.pop()
            own = head_flat[head_offsets[v] : head_offsets[v + 1]]
            slots = [slice(first[x], first[x + 1]) for x in own.tolist()]
            who = np.concatenate([posted[s] for s in slots])
            there = np.concatenate([posted_place[s] for s in slots])
            here = np.repeat(head_place[head_offsets[v] : head_offsets[v + 1]], [s.stop - s.start for s in slots])
            fresh = ~reached[who]
            if two:
                fresh &= side[who] != side[v]
            who, there, here = who[fresh], there[fresh], here[fresh]
            if not len(who):
                continue
            who, at = np.unique(who, return_index=True)  # the first common shingle of each
            need = -(-percent * (n[v] + n[who]) // (100 + percent))
            near = (100 * np.minimum(n[v], n[who]) >= percent * np.maximum(n[v], n[who])) & (1 + np.minimum(n[v] - here[at] - 1, n[who] - there[at] - 1) >= need)
            near &= np.minimum(spread[v], spread[who]).sum(axis=1) >= need
            who = who[near]
            if not len(who):
                continue
            mark[flat[offsets[v] : offsets[v + 1]]] = True
            common = np.array([int(np.count_nonzero(mark[flat[offsets[w] : offsets[w + 1]]])) for w in who.tolist()])
            mark[flat[offsets[v] : offsets[v + 1]]] = False
            for w in who[100 * common >= percent * (n[v] + n[who] - common)].tolist():
                reached[w] = True
                found.append((begin, w))
                queue.append(w)
    return found


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, i, j): the links of each; classes of cut i are on one side, others on the other."""
    key, rows = None, []

    def done() -> pa.RecordBatch:
        pairs = []
        if len(rows) > 1:
            ids = [r["node"] for r in rows]
            side = np.array([r["cut"] != r["i"] for r in rows])
            found = links(np.array([r["n"] for r in rows]), [np.sort(np.frombuffer(r["tokens"], np.uint64)) for r in rows], [np.frombuffer(r["prefix"], np.uint64) for r in rows], [np.frombuffer(r["places"], np.uint32) for r in rows], side, percent)
            pairs = [(ids[a], ids[b]) for a, b in found]
        a, b = list(zip(*pairs, strict=True)) or ((), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for row in batch.to_pylist():
            own = (row["block"], row["i"], row["j"])
            if key is not None and own != key:
                yield done()
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield done()


def verified(tasks: DataFrame, buckets: int, percent: int) -> DataFrame:
    """The links (a, b) in tasks (block, i, j, cut and the columns of classes)."""
    own = tasks.select("block", "i", "j", "cut", "n", "node", "tokens", "prefix", "places")
    return own.repartition(buckets, "block", "i", "j").sortWithinPartitions("block", "i", "j", "n", "node").mapInArrow(lambda b: _verify(b, percent), "a long, b long")


def great_links(classes: DataFrame, buckets: int, percent: int, cut: int) -> DataFrame:
    """Links (a, b) that join what is linked among classes of blocks too great for a task; see verify above."""
    heads = classes.select("n", "node", "prefix").mapInArrow(_heads, "token long, n int, node long")
    heads = materialize(heads.join(classes.select("node", (F.length("tokens") / 8).alias("w")), "node"), "jaccard-heads")
    found = None
    for turn in range(ROUNDS):
        met = heads.groupBy("node").agg(F.min(F.xxhash64("token", F.lit(turn))).alias("block"))
        met = join_hot(met, met.groupBy("block").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), ["block"], "k").where("k is not null")
        part = F.pmod(F.hash("node", F.lit(turn)), F.ceil(F.col("k") / cut)).cast("int")
        tasks = classes.join(met, "node").withColumn("i", part).withColumn("j", F.col("i")).withColumn("cut", F.col("i"))
        own = verified(tasks, buckets, percent)
        found = own if found is None else found.unionAll(own)
    found = materialize(found, "jaccard-links")

    # Shingles whose classes are not all joined yet; of those with the same classes, one.
    heads = heads.join(components(found).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("token", "node", "w", F.coalesce("root", "node").alias("root"))
    heads = materialize(heads, "jaccard-heads")
    by_part = heads.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    mixed = by_part.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("k"), F.sum("w").alias("all_w"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("c", "root")).alias("top")).where("parts > 1")
    mixed = mixed.groupBy("k", "x", "y").agg(F.min(F.struct("token", "all_w", "top")).alias("one")).select("k", "one.token", "one.all_w", F.col("one.top.root").alias("top_root"), F.col("one.top.c").alias("top_c"))
    mixed = materialize(mixed, "jaccard-mixed")
    rest = join_hot(heads, mixed, ["token"], "k").where("k is not null")
    # Within the bound, all in one go. Else cuts of the greatest part (0 .. d - 1) meet those of the others (d .. d + m - 1),
    # and these each other.
    half = F.greatest(F.lit(1.0), F.least(F.lit(float(cut)), F.lit(float(CUT_SHINGLES)) * F.col("k") / F.col("all_w")) / 2)
    whole = (F.col("k") <= cut) & (F.col("all_w") <= CUT_SHINGLES)
    rest = rest.withColumn("d", F.when(whole, 0).otherwise(F.ceil(F.col("top_c") / half)).cast("int")).withColumn("m", F.when(whole, 1).otherwise(F.ceil((F.col("k") - F.col("top_c")) / half)).cast("int"))
    top = ~whole & (F.col("root") == F.col("top_root"))
    rest = rest.withColumn("cut", F.when(top, F.pmod(F.hash("node"), F.col("d"))).otherwise(F.col("d") + F.pmod(F.hash("node"), F.col("m"))))
    others = F.when(top, F.sequence(F.col("d"), F.col("d") + F.col("m") - 1)).otherwise(F.sequence(F.lit(0), F.col("d") + F.col("m") - 1))
    rest = rest.withColumn("other", F.explode(others)).select("node", F.col("token").alias("block"), "cut", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"))
    return found.unionAll(verified(classes.join(rest, "node"), buckets, percent))


def ranges(docs: DataFrame, column: str = "text") -> int:
    """Ranges of shingles for docs: one for each RANGE_BYTES of its files, at least the shuffle partitions.

    The size comes from the plan's statistics, without a pass over the texts; where there are none, it is summed.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 2**60:
        size = docs.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // RANGE_BYTES))


def by_range(df: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket behind one another in one task."""
    if buckets <= MOST_TASKS:
        return df.repartitionById(buckets, F.col("bucket"))
    return df.repartitionById(MOST_TASKS, F.pmod("bucket", F.lit(MOST_TASKS))).sortWithinPartitions("bucket")


def near_groups(docs: DataFrame, id_column: str = "doc_id", words: int = WORDS, percent: int = PERCENT, heavy: int = HEAVY, cut: int = CUT_CLASSES) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs; component_id is the smallest id that links reach.

    A null, empty or wordless text has no shingles and links with nothing. A text of fewer words than a shingle has
    one, of all its words. Rows that repeat an id count as rows; a null id has the component of its text, and is
    never the smallest. Other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = ranges(docs)
    dealt = by_range(docs.select(F.col(id_column).cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: _shingle(b, buckets, words, FLUSH, heavy), PACKED), buckets)
    ranked = by_range(dealt.mapInArrow(lambda b: _rank(b, buckets), PACKED), buckets)
    found = materialize(ranked.mapInArrow(lambda b: _prefix(b, percent), CANDIDATES), "jaccard")
    rows = found.where("tokens is null").select("doc_id", "n", "s", "t")
    # A node is 64 bits of a class; should two classes share one, all nodes are numbered by another hash.
    classes, turn = found.where("tokens is not null").withColumn("node", F.col("s")), 0
    while classes.groupBy("node").count().where("count > 1").limit(1).count():
        turn += 1
        classes = classes.withColumn("node", F.xxhash64("s", "t", F.lit(turn)))

    heads = classes.select("n", "node", "prefix").mapInArrow(_heads, "token long, n int, node long")
    chained = heads.repartition(buckets, "token").sortWithinPartitions("token", "n", "node").mapInArrow(lambda b: _chains(b, percent), "a long, b long")
    slim = classes.select("node", (F.length("tokens") / 8).alias("w")).join(components(chained).withColumnRenamed("root", "block"), "node")
    slim = materialize(slim, "jaccard-blocks")
    sizes = slim.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("all_w"))
    slim = join_hot(slim.drop("w"), sizes, ["block"], "k")
    fits = (F.col("k") <= cut) & (F.col("all_w") <= CUT_SHINGLES)
    zero = F.lit(0)
    edges = verified(classes.join(slim.where(fits), "node").withColumn("i", zero).withColumn("j", zero).withColumn("cut", zero), buckets, percent)
    if sizes.where(~fits).limit(1).count():
        great = materialize(classes.join(slim.where(~fits).select("node"), "node"), "jaccard-great")
        edges = edges.unionAll(great_links(great, buckets, percent, cut))
    linked = components(edges).join(classes.select("node", "s", "t"), "node").select("s", "t", "root")

    # Documents of a class, then classes of a group, are gathered by their least id alone; what belongs to a hot class or
    # group learns it by broadcast.
    own = rows.where("n > 0").groupBy("s", "t").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).join(linked, ["s", "t"], "left").where("c > 1 or root is not null")
    own = materialize(own, "jaccard-classes")
    best = own.where("root is not null").groupBy("root").agg(F.min("least").alias("group_least"), F.count(F.lit(1)).alias("k"))
    own = materialize(join_hot(own, best, ["root"], "k").select("s", "t", "c", F.coalesce("group_least", "least").alias("least")), "jaccard-groups")
    out = join_hot(rows.where("n > 0"), own, ["s", "t"], "c").select("doc_id", "n", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least"))
    out = out.unionAll(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("least")))
    return out.select(F.col("doc_id").alias(id_column), F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies, that of the smallest (doc_id, place in the scan); same columns.

    Groups are formed over the places of rows, so repeated and null doc_ids are rows of their own.
    """
    uid = "_tessera_uid"
    tagged = docs.withColumn(uid, F.monotonically_increasing_id())
    groups = near_groups(tagged, uid).select(F.col(uid).alias("_tessera_row"), F.col("component_id").alias("_tessera_group"))
    ids = tagged.select(F.col(uid).alias("_tessera_u"), F.col("doc_id").alias("_tessera_doc"))
    best = groups.join(ids, F.col("_tessera_row") == F.col("_tessera_u")).groupBy("_tessera_group").agg(F.min(F.struct(F.col("_tessera_doc").isNull(), "_tessera_doc", "_tessera_row"))["_tessera_row"].alias("_tessera_best"))
    return tagged.join(best.select("_tessera_best"), F.col(uid) == F.col("_tessera_best"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
