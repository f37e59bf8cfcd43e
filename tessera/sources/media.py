"""Media files: what their structure says, without a decoder.

A video (MP4/MOV boxes, also in fragments, or AVI chunks) is probed from its headers: number of frames, rate, sides.
An image (PNG, JPEG, GIF) is walked from its first to its last block. What is cut or broken has a reason instead.

    register(spark); spark.read.format("video").load(folder)      headers only, read by seeking
    df.select(probe("content"))                                   bytes that Spark has read already
"""

from __future__ import annotations

import fnmatch
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Read = Callable[[int, int], bytes]
#: Bytes of a header that is read whole; a larger one is an error row.
HEADER = 64 << 20
SCHEMA = "frames long, fps double, height int, width int, error string"
PARTS = ("moov", "trak", "mdia", "minf", "stbl", "mvex", "moof", "traf")
NONE = "unreadable"


class Broken(ValueError):
    """A file that can't be what its first bytes say; the reason."""


def _take(read: Read, at: int, form: str) -> tuple:
    data = read(at, n := struct.calcsize(form))
    if len(data) < n:
        raise Broken("truncated")
    return struct.unpack(form, data)


# Videos -----------------------------------------------------------------------------------------------------------


def boxes(read: Read, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end of the content) of each box between two positions."""
    while at < end:
        size, kind = _take(read, at, ">I4s")
        head = 8
        if size == 1:
            size, head = _take(read, at + 8, ">Q")[0], 16
        size = size or end - at
        if size < head:
            raise Broken("box without a size")
        if at + size > end:
            raise Broken("truncated")
        yield kind.decode("latin-1"), at + head, at + size
        at += size


def _tree(read: Read, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """All boxes below, those that hold others before what they hold."""
    for kind, lo, hi in boxes(read, at, end):
        yield kind, lo, hi
        if kind in PARTS:
            yield from _tree(read, lo, hi)


def _runs(read: Read, at: int, count: int, fields: int) -> tuple[int, int]:
    """Samples and their duration in a table of (count, duration)."""
    data = read(at, 8 * count)
    if len(data) < 8 * count:
        raise Broken("truncated")
    pairs = list(struct.iter_unpack(">II", data))
    return sum(n for n, _ in pairs), sum(n * d for n, d in pairs)


def probe_mp4(read: Read, length: int) -> tuple[int, float, int, int]:
    top = list(boxes(read, 0, length))
    moov = next(((lo, hi) for kind, lo, hi in top if kind == "moov"), None)
    if moov is None:
        raise Broken("no moov box")
    if moov[1] - moov[0] > HEADER:
        raise Broken("header too large")
    head = read(moov[0], moov[1] - moov[0])
    own: Read = lambda at, n: head[at : at + n]
    lengths: dict[int, int] = {}
    track: dict[str, int] = {}
    video: dict[str, int] | None = None
    for kind, lo, hi in _tree(own, 0, len(head)):
        if kind == "trak":
            track = {}
        elif kind == "tkhd":
            track["id"] = _take(own, lo + (20 if head[lo] else 12), ">I")[0]
        elif kind == "mdhd":
            track["scale"] = _take(own, lo + (20 if head[lo] else 12), ">I")[0]
        elif kind == "hdlr" and _take(own, lo + 8, ">4s")[0] == b"vide" and video is None:
            video = track
        elif kind == "stsd" and track is video and hi - lo >= 44:
            track["width"], track["height"] = _take(own, lo + 40, ">HH")
        elif kind == "stts" and track is video:
            track["frames"], track["ticks"] = _runs(own, lo + 8, _take(own, lo + 4, ">I")[0], 2)
        elif kind == "trex":
            lengths[_take(own, lo + 4, ">I")[0]] = _take(own, lo + 12, ">I")[0]
    if video is None:
        raise Broken("no video track")
    frames, ticks = video.get("frames", 0), video.get("ticks", 0)
    for kind, lo, hi in top:
        if kind == "moof":
            n, t = _fragment(read, lo, hi, video.get("id", 0), lengths)
            frames, ticks = frames + n, ticks + t
    if not frames or not ticks or not video.get("scale"):
        raise Broken("no frames or no rate")
    return frames, frames * video["scale"] / ticks, video.get("height", 0), video.get("width", 0)


def _fragment(read: Read, at: int, end: int, track: int, lengths: dict[int, int]) -> tuple[int, int]:
    """Samples and duration of a track in a moof box; durations stand by sample, by fragment or by track."""
    frames = ticks = 0
    mine, each = False, 0
    for kind, lo, _ in _tree(read, at, end):
        if kind == "tfhd":
            flags, own = _take(read, lo, ">II")
            mine, each = own == track, lengths.get(own, 0)
            if flags & 0x8:
                each = _take(read, lo + 8 + 8 * bool(flags & 0x1) + 4 * bool(flags & 0x2), ">I")[0]
        elif kind == "trun" and mine:
            flags, n = _take(read, lo, ">II")
            first, width = lo + 8 + 4 * bool(flags & 0x1) + 4 * bool(flags & 0x4), 4 * (flags & 0xF00).bit_count()
            frames += n
            ticks += sum(_take(read, first + i * width, ">I")[0] for i in range(n)) if flags & 0x100 else n * each
    return frames, ticks


def probe_avi(read: Read, length: int) -> tuple[int, float, int, int]:
    if 8 + _take(read, 4, "<I")[0] > length:
        raise Broken("truncated")
    at, end = 12, min(length, HEADER)
    frames = height = width = 0
    rate = 0.0
    while at + 8 <= end and not rate:
        kind, size = _take(read, at, "<4sI")
        if kind == b"LIST":
            at += 12
            continue
        if kind == b"avih":
            frames, width, height = _take(read, at + 24, "<I")[0], *_take(read, at + 40, "<II")
        elif kind == b"strh" and _take(read, at + 8, "<4s")[0] == b"vids":
            scale, speed = _take(read, at + 28, "<II")
            rate, frames = speed / scale if scale else 0.0, _take(read, at + 40, "<I")[0] or frames
        at += 8 + size + size % 2
    if not frames or not rate:
        raise Broken("no frames or no rate")
    return frames, rate, height, width


def probe_video(read: Read, length: int) -> tuple[int | None, float | None, int | None, int | None, str | None]:
    """(frames, rate, height, width, None), or nulls and a reason."""
    try:
        head = read(0, 12)
        if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
            return (*probe_avi(read, length), None)
        if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
            return (*probe_mp4(read, length), None)
        raise Broken("not a video")
    except Broken as e:
        return None, None, None, None, str(e)


# Images -----------------------------------------------------------------------------------------------------------


def _png(b: bytes) -> tuple[int, int]:
    at, seen, sides = 8, set(), (0, 0)
    while "IEND" not in seen:
        size, kind = _take(lambda a, n: b[a : a + n], at, ">I4s")
        if at + 12 + size > len(b):
            raise Broken("truncated")
        if zlib.crc32(b[at + 4 : at + 8 + size]) != int.from_bytes(b[at + 8 + size : at + 12 + size]):
            raise Broken("wrong checksum")
        if not seen:
            if kind != b"IHDR" or size != 13:
                raise Broken("no header")
            sides = struct.unpack(">II", b[at + 8 : at + 16])
        seen.add(kind.decode("latin-1"))
        at += 12 + size
    if "IDAT" not in seen:
        raise Broken("no pixels")
    return sides[1], sides[0]


#: In the data of a scan: a marker that is neither a stuffed 0xFF nor a restart.
MARK = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")


def _jpeg(b: bytes) -> tuple[int, int]:
    at, sides = 2, None
    while True:
        mark, = _take(lambda a, n: b[a : a + n], at + 1, ">B")
        if b[at] != 0xFF:
            raise Broken("no marker")
        if mark == 0xFF:
            at += 1
        elif mark == 0xD9:
            if sides is None:
                raise Broken("no header")
            return sides
        elif 0xD0 <= mark <= 0xD8 or mark == 1:
            at += 2
        else:
            size, = _take(lambda a, n: b[a : a + n], at + 2, ">H")
            if size < 2 or at + 2 + size > len(b):
                raise Broken("truncated")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                sides = _take(lambda a, n: b[a : a + n], at + 5, ">HH")
            at += 2 + size
            if mark == 0xDA:
                found = MARK.search(b, at)
                if not found:
                    raise Broken("truncated")
                at = found.end() - 2


def _gif(b: bytes) -> tuple[int, int]:
    take = lambda at, form: _take(lambda a, n: b[a : a + n], at, form)
    width, height, flags = take(6, "<HHB")
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    at, images = 13 + table(flags), 0

    def skip(at: int) -> int:
        while n := take(at, "B")[0]:
            at += 1 + n
        return at + 1

    while (kind := take(at, "B")[0]) != 0x3B:
        if kind == 0x21:
            at = skip(at + 2)
        elif kind == 0x2C:
            at, images = skip(at + 11 + table(take(at + 9, "B")[0])), images + 1
        else:
            raise Broken("no block")
    if not images:
        raise Broken("no pixels")
    return height, width


def check_image(b: bytes) -> tuple[int, int]:
    """(height, width) of an image that is whole; Broken with a reason otherwise."""
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(b)
    if b[:2] == b"\xff\xd8":
        return _jpeg(b)
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return _gif(b)
    raise Broken("not an image")


def check(content: bytes | None) -> tuple[int | None, float | None, int | None, int | None, str | None]:
    """probe_video() or check_image() of bytes; an image has no frames. Bytes that are missing are unreadable."""
    if content is None:
        return None, None, None, None, NONE
    if content[:1] in (b"\x89", b"\xff") or content[:4] == b"GIF8":
        try:
            return None, None, *check_image(content), None
        except Broken as e:
            return None, None, None, None, str(e)
    return probe_video(lambda at, n: content[at : at + n], len(content))


def _checked(content: pd.Series) -> pd.DataFrame:
    kinds = {"frames": "Int64", "fps": "Float64", "height": "Int32", "width": "Int32", "error": "string"}
    return pd.DataFrame([check(b) for b in content], columns=list(kinds)).astype(kinds)


def probe(content: str | Column) -> Column:
    """STRUCT<frames, fps, height, width, error> of media bytes; error is null where the file is whole."""
    return F.pandas_udf(_checked, SCHEMA)(content)


# Source -----------------------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class VideoReader(DataSourceReader):
    """Files in the order of their names, filesPerPartition in a partition. Of each only headers are read, by seeking."""

    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options.get("path", ""), options.get("pathGlobFilter", "*")
        self.each = int(options.get("filesPerPartition", "200"))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = self._open()
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        infos = [found] if found.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.is_file and fnmatch.fnmatch(i.base_name, self.pattern))
        return [Files(files[k : k + self.each]) for k in range(0, len(files), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        rows = []
        for path, length in partition.paths:
            try:
                with store.open_input_file(path) as f:
                    rows.append((path, length, *probe_video(lambda at, n, f=f: f.read_at(n, at), length)))
            except OSError as e:
                rows.append((path, length, None, None, None, None, f"{NONE}: {type(e).__name__}"))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        names = ["path", "length", "frames", "fps", "height", "width", "error"]
        yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


class VideoSource(DataSource):
    """format("video"): a row for each file below a path. Options: pathGlobFilter, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "video"

    def schema(self) -> str:
        return f"path string, length long, {SCHEMA}"

    def reader(self, schema) -> VideoReader:
        return VideoReader(self.options)  # keys in any case


def register(spark: SparkSession) -> None:
    """Makes format("video") known to a session."""
    spark.dataSource.register(VideoSource)
