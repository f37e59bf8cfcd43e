"""Packing: bounded-space online packing of tokenised documents into windows.

Each task keeps a fixed number of open windows. A document gives whole windows while it is longer than one; what
is left goes to the open window with the least room that holds it (best fit). When none holds it, a window is
opened while there are fewer than the bound; else the fullest is topped up with the head of the piece and emitted,
and the rest of the piece is placed anew. At the end of a task its open windows are run together, and the one
partial window that stays is merged with those of the other tasks, FAN at a time: so a group of FAN tasks pads one
window, and no task gathers more than FAN of them.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches, texts, worker_env

WINDOW = 2048
OPEN = 64
#: Partial windows that one task of the last step merges.
FAN = 256
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPILL = "part long, ord long, ids binary"


def lowered(text: str) -> str:
    """Lower case where that is what the tokenizer does, character by character; other texts are left to it."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


def plain(chunk: str) -> bool:
    """Whether a chunk is letters of Latin-1 only: normalising leaves each of them one letter, so they make one word.

    Other letters may turn into a letter and a mark, to which punctuation behind it is then joined.
    """
    return chunk.isalpha() and (chunk.isascii() or max(chunk) <= "\xff")


class Words:
    """Token ids of texts, by white-space-free chunks that are remembered up to a bound.

    The tokenizer drops white space and joins nothing across it, so the ids of a text are those of its chunks in
    turn. Texts that spell a special token are given to the tokenizer whole. At most LIMIT chunks of at most LONG
    characters are kept in each of two generations, some 100 MB each; longer ones are tokenised each time.
    """

    LIMIT, LONG = 400_000, 48
    #: Plain words that are tokenised as one text.
    RUN = 500
    MARKS = ".,;:!?"
    #: By path: a worker process keeps what it has learned from one task to the next.
    kept: dict[str, Words] = {}

    @classmethod
    def at(cls, path: str) -> Words:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def __init__(self, path: str):
        worker_env()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids of tokens that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """As _ids, for plain words: RUN of them are given to the tokenizer as one text and cut behind each word's last token."""
        runs, out = [words[i : i + self.RUN] for i in range(0, len(words), self.RUN)], []
        for run, joined in zip(runs, self._ids([" ".join(run) for run in runs]), strict=True):
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(joined, "<u4")]) + 1)).tolist()
            if len(stops) == len(run):
                out += [joined[a:b] for a, b in zip([0, *stops], stops)]  # noqa: B905
            else:  # a vocabulary without word ends
                out += self._ids(run)
        return out

    def _learn(self, chunks: set[str]) -> set[str]:
        """A run of punctuation behind plain letters is a token run of its own; both parts are looked up apart."""
        known, old, wanted, split = self.known, self.old, set(), []
        for c in chunks:
            if c in old:
                known[c] = old[c]
                continue
            head = c.rstrip(self.MARKS)
            if len(head) < len(c) and plain(head):
                tail = c[len(head) :]
                split.append((c, head, tail))
                wanted.add(head)
                wanted.add(tail)
            else:
                wanted.add(c)
        new = [c for c in wanted if c not in known]
        words = [c for c in new if len(c) <= self.LONG and plain(c)]
        known.update(zip(words, self._words(words), strict=True))
        other = [c for c in new if c not in known]
        known.update(zip(other, self._ids(other), strict=True))
        for c, head, tail in split:
            known[c] = known[head] + known[tail]
        return wanted

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > self.LIMIT:
            self.known, self.old = {"": b""}, self.known  # what is still in use comes over
        whole = {i for i, t in enumerate(batch) if any(s in t for s in self.special)}
        chunks = [[] if i in whole else lowered(t).replace("\n", " ").split(" ") for i, t in enumerate(batch)]
        new: set[str] = set()
        for own in chunks:
            new.update(own)
        new -= self.known.keys()
        new |= self._learn(new)
        direct = dict(zip(whole, self._ids([batch[i] for i in whole]), strict=True))
        get = self.known.__getitem__
        out = [direct[i] if i in whole else b"".join(map(get, own)) for i, own in enumerate(chunks)]
        for c in new:
            if len(c) > self.LONG:
                self.known.pop(c, None)
        return out


class Windows:
    """Open windows of one task. Pieces are (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, bound: int):
        self.size, self.bound = size, bound
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.made = 0

    def _open(self, piece: tuple) -> Iterator[list[tuple]]:
        self.made += 1
        self.pieces[self.made] = [piece]
        room = self.size - len(piece[2]) // 4
        if room:
            insort(self.rooms, (room, self.made))
        else:
            yield self.pieces.pop(self.made)

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        """Windows that are full once the document is placed."""
        total, start, width = len(ids) // 4, 0, self.size
        while total - start >= width:
            yield [(doc, start, ids[4 * start : 4 * (start + width)], total)]
            start += width
        while start < total:
            need = total - start
            at = bisect_left(self.rooms, (need, 0))
            if at < len(self.rooms):  # best fit
                room, w = self.rooms.pop(at)
            elif len(self.rooms) < self.bound:
                yield from self._open((doc, start, ids[4 * start :], total))
                return
            else:  # top up and emit the fullest
                room, w = self.rooms.pop(0)
            took = min(need, room)
            self.pieces[w].append((doc, start, ids[4 * start : 4 * (start + took)], total))
            start += took
            if took == room:
                yield self.pieces.pop(w)
            else:
                insort(self.rooms, (room - took, w))

    def close(self) -> tuple[list[list[tuple]], list[tuple]]:
        """The open windows run together: full ones, and the pieces of the last, partial one."""
        return fill([p for _, w in self.rooms for p in self.pieces[w]], self.size)


def fill(pieces: list[tuple], size: int) -> tuple[list[list[tuple]], list[tuple]]:
    full, now, used = [], [], 0
    for doc, start, ids, total in pieces:
        while ids:
            part = ids[: 4 * (size - used)]
            now.append((doc, start, part, total))
            ids, start, used = ids[len(part) :], start + len(part) // 4, used + len(part) // 4
            if used == size:
                full.append(now)
                now, used = [], 0
    return full, now


class Rows:
    """Collects output rows and yields them as batches."""

    def __init__(self, spill: bool):
        self.spill, self.rows = spill, []

    def put(self, window: list[tuple], sequence: int) -> None:
        at = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, sequence, at) + ((None, None, None) if self.spill else ()))
            at += n

    def leave(self, window: list[tuple], part: int) -> None:
        for k, (doc, start, ids, total) in enumerate(window):
            self.rows.append((doc, start, len(ids) // 4, 0, total, -1, 0, part, k, ids))

    def batch(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["part", "ord", "ids"] * self.spill
        types = [pa.int64()] * 7 + [pa.int64(), pa.int64(), pa.binary()] * self.spill
        columns = list(zip(*self.rows, strict=True)) or [()] * len(names)
        self.rows = []
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _pack(batches: Iterator[pa.RecordBatch], path: str, size: int, bound: int) -> Iterator[pa.RecordBatch]:
    words, windows, rows = Words.at(path), Windows(size, bound), Rows(True)
    part, made, end = TaskContext.get().partitionId(), 0, np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), words.encode(texts(batch.column(1))), strict=True):
            for w in windows.add(doc, ids + end):
                rows.put(w, (part << 32) + made)
                made += 1
        yield rows.batch()
    full, rest = windows.close()
    for w in full:
        rows.put(w, (part << 32) + made)
        made += 1
    rows.leave(rest, part)
    yield rows.batch()


def _merge(batches: Iterator[pa.RecordBatch], size: int, fan: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, part, ord); a group's last window is the only one that is padded."""
    rows = Rows(False)
    group, made, open_ = None, 0, []

    def flush(done: list[list[tuple]]) -> None:
        nonlocal made
        for w in done:
            rows.put(w, (1 << 62) + (group << 32) + made)
            made += 1

    for batch in batches:
        for r in batch.to_pylist():
            if group is not None and r["part"] // fan != group:
                flush([open_] if open_ else [])
                open_, made = [], 0
            group = r["part"] // fan
            full, open_ = fill([*open_, (r["doc_id"], r["start"], r["ids"], r["doc_tokens"])], size)
            flush(full)
        yield rows.batch()
    if open_:
        flush([open_])
        yield rows.batch()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, path: str | None = None, size: int = WINDOW, bound: int = OPEN, fan: int = FAN) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and has the end id alone. Repeated rows and null doc_ids are packed as rows of their own.
    An empty table gives an empty result. Other columns than doc_id and text play no part. Tasks follow the scan's
    partitions, without a shuffle of texts; a task that runs again on the same rows gives the same windows.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    first = materialize(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda b: _pack(b, path, size, bound), f"{FIELDS}, {SPILL}"), "packing")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    left = first.where("part is not null").withColumn("group", F.expr(f"part div {fan}"))
    n = partitions(docs.sparkSession)
    merged = left.repartition(n, "group").sortWithinPartitions("group", "part", "ord").mapInArrow(lambda b: _merge(b, size, fan), FIELDS)
    return first.where("part is null").select(*names).unionByName(merged)




def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
