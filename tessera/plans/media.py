"""Queries on media files: containers and images made from the tables, probed, verified and taken through the whole chain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import mathx as M
from ..functions import text as T
from ..operators import measure as E
from ..operators import rows as R
from ..operators import verify as V
from ..sources.media import probe
from .items import COUNT_SQL, _resize_sql
from .registry import query

Piece = tuple[Column, int]
"""A binary Column and its number of bytes."""


def raw(data: bytes) -> Piece:
    return F.unhex(F.lit(data.hex())), len(data)


def number(x: Column | int, size: int, little: bool = False) -> Piece:
    x = F.lit(x) if isinstance(x, int) else x
    big = F.unhex(F.lpad(F.hex(x.cast("long")), 2 * size, "0"))
    parts = [F.substring(big, k, 1) for k in range(size, 0, -1)]
    return F.concat(*parts) if little and size > 1 else big, size


def joined(*pieces: Piece) -> Piece:
    return F.concat(*[p for p, _ in pieces]), sum(n for _, n in pieces)


def box(kind: bytes, *pieces: Piece) -> Piece:
    body, n = joined(*pieces)
    return joined(number(n + 8, 4), raw(kind), (body, n))


def chunk(kind: bytes, *pieces: Piece) -> Piece:
    """A chunk of an AVI file."""
    body, n = joined(*pieces)
    return joined(raw(kind), number(n, 4, True), (body, n))


def png_chunk(kind: bytes, *pieces: Piece) -> Piece:
    body, n = joined(raw(kind), *pieces)
    return joined(number(n - 4, 4), (body, n), number(F.crc32(body), 4))


def mp4(frames: Column, scale: Column, ticks: Column, h: Column, w: Column) -> Piece:
    head = raw(b"\0" * 12)
    stsd = box(b"stsd", number(0, 4), number(1, 4), number(86, 4), raw(b"avc1"), raw(b"\0" * 24), number(w, 2), number(h, 2), raw(b"\0" * 50))
    stts = box(b"stts", number(0, 4), number(2, 4), number(frames - 1, 4), number(ticks, 4), number(1, 4), number(ticks, 4))
    mdia = box(b"mdia", box(b"mdhd", head, number(scale, 4), raw(b"\0" * 8)), box(b"hdlr", raw(b"\0" * 8), raw(b"vide"), raw(b"\0" * 13)), box(b"minf", box(b"stbl", stsd, stts)))
    return joined(box(b"ftyp", raw(b"isom\0\0\2\0isom")), box(b"mdat", raw(b"\0" * 40)), box(b"moov", box(b"trak", box(b"tkhd", head, number(1, 4), raw(b"\0" * 68)), mdia)))


def avi(frames: Column, rate: Column, scale: int, h: Column, w: Column) -> Piece:
    avih = chunk(b"avih", raw(b"\0" * 16), number(frames, 4, True), raw(b"\0" * 12), number(w, 4, True), number(h, 4, True), raw(b"\0" * 16))
    strh = chunk(b"strh", raw(b"vidsH264"), raw(b"\0" * 12), number(scale, 4, True), number(rate, 4, True), raw(b"\0" * 4), number(frames, 4, True), raw(b"\0" * 20))
    listed = lambda kind, *pieces: chunk(b"LIST", raw(kind), *pieces)
    return chunk(b"RIFF", raw(b"AVI "), listed(b"hdrl", avih, listed(b"strl", strh)), listed(b"movi"))


def png(h: Column, w: Column) -> Piece:
    return joined(raw(b"\x89PNG\r\n\x1a\n"), png_chunk(b"IHDR", number(w, 4), number(h, 4), raw(b"\x08\2\0\0\0")), png_chunk(b"IDAT", raw(b"\0" * 9)), png_chunk(b"IEND"))


def _cut(piece: Piece, n: int) -> Column:
    return F.substring(piece[0], 1, piece[1] - n)


def _containers(t):
    """A video of each part; by its key it is cut in its data or its header, an AVI file, no video, or without frames."""
    key = F.col("p_partkey")
    frames, h, w = key % 5000 + 2, key % 900 + 10, key % 1300 + 10
    made = mp4(frames, (key % 4 + 1) * 600, F.lit(40), h, w)
    kind = key % 10
    empty = mp4(F.lit(1), F.lit(0), F.lit(40), h, w)
    odd = {3: _cut(made, 9), 4: F.substring(made[0], 1, 50), 5: F.encode("p_name", "utf-8"), 7: avi(frames, (key % 4 + 1) * 15, 1, h, w)[0], 9: empty[0]}
    content = made[0]
    for k, other in odd.items():
        content = F.when(kind == k, other).otherwise(content)
    return t("part").select("p_partkey", content.alias("content"))


CONTAINER_SQL = """WITH v AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 3 THEN 'truncated' WHEN 4 THEN 'truncated' WHEN 5 THEN 'not a video' WHEN 9 THEN 'no frames or no rate' END AS error,
  p_partkey % 5000 + 2 AS total, (p_partkey % 4 + 1) * 15.0::DOUBLE AS fps, p_partkey % 900 + 10 AS h, p_partkey % 1300 + 10 AS w FROM part),
p AS (SELECT p_partkey, error, CASE WHEN error IS NULL THEN total END AS total, CASE WHEN error IS NULL THEN fps END AS fps, h, w,
  CASE WHEN error IS NULL THEN least(least(greatest(round_even(total / fps, 0), 4.0), 420.0)::BIGINT, total) END AS n_frames FROM v)"""


@query(CONTAINER_SQL + f""", r AS ({_resize_sql('p', *M.VIDEO_PIXELS)})
SELECT p_partkey, error, total AS frames, fps, CASE WHEN error IS NULL THEN h::INT END AS height, CASE WHEN error IS NULL THEN w::INT END AS width, n_frames,
  CASE WHEN n_frames IS NULL THEN -1 ELSE floor((oh // 28) * (ow // 28) * n_frames / 2) END::BIGINT AS tokens FROM r""")
def video_probe(t):
    """From bytes to frames, rate and sides, to the frames that are read and the tokens they take; broken files keep a row."""
    df = _containers(t).select("p_partkey", probe("content").alias("p")).select("p_partkey", "p.*").withColumnRenamed("frames", "total")
    tokens = F.when(F.col("n_frames").isNull(), E.FAILED).otherwise(M.video_tokens(F.col("height"), F.col("width"), F.col("n_frames"))).cast("long")
    return E.frame_plan(df, "total", "fps").select("p_partkey", "error", F.col("total").alias("frames"), "fps", "height", "width", "n_frames", tokens.alias("tokens"))


def _files(t):
    """(name, content): an image for each part but every sixth; by its key cut, with a wrong checksum, or unreadable."""
    key = F.col("p_partkey")
    made = png(key % 300 + 10, key % 500 + 10)
    kind = key % 12
    flipped = F.concat(F.substring(made[0], 1, 20), F.unhex(F.lit("77")), F.substring(made[0], 22, made[1]))
    content = F.when(kind == 1, _cut(made, 5)).when(kind == 2, flipped).when(kind == 3, F.lit(None).cast("binary")).when(kind == 4, F.encode("p_name", "utf-8")).otherwise(made[0])
    return t("part").where(key % 6 != 5).select(F.concat("p_partkey", F.lit(".png")).alias("name"), content.alias("content"))


def _verified(t):
    items = t("part").select("p_partkey", "p_name", F.concat("p_partkey", F.lit(".png")).alias("name"))
    done = t("part").where("p_partkey % 7 = 0").select(F.concat("p_partkey", F.lit(".png")).alias("name"))
    return V.verify(items, _files(t), done)


STATUS_SQL = """WITH i AS (SELECT *, p_partkey % 12 AS k, p_partkey % 300 + 10 AS h, p_partkey % 500 + 10 AS w FROM part),
s AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'Already Processed' WHEN p_partkey % 6 = 5 THEN 'DNE' WHEN k = 3 THEN 'PyERROR' WHEN k IN (1, 2, 4) THEN 'Corrupted' ELSE 'OK' END AS status,
  CASE k WHEN 1 THEN 'truncated' WHEN 2 THEN 'wrong checksum' WHEN 3 THEN 'unreadable' WHEN 4 THEN 'not a video' END AS error FROM i),
v AS (SELECT *, CASE WHEN status IN ('Corrupted', 'PyERROR') THEN error WHEN status = 'OK' AND (h < 28 OR w < 28) THEN 'smaller than 28' END AS reason FROM s)"""


@query(STATUS_SQL + " SELECT p_partkey, status, CASE WHEN status <> 'OK' THEN reason END AS reason, CASE WHEN k NOT IN (1, 2, 3, 4) AND p_partkey % 6 <> 5 THEN h::INT END AS height FROM v")
def media_status(t):
    """Whether an item's image is there, whole and readable, or needs no look."""
    return _verified(t).select("p_partkey", "status", "reason", "height")


@query(STATUS_SQL + " SELECT status, reason, count(*)::BIGINT AS n FROM v GROUP BY 1, 2")
def media_report(t):
    """How many items have which status and reason; too small images have a reason of their own."""
    return V.usable(_verified(t))[1]


@query(STATUS_SQL + f""", o AS (SELECT p_partkey, p_name AS text, h, w FROM v WHERE status = 'OK' AND reason IS NULL), r AS ({_resize_sql('o', *M.IMAGE_PIXELS)}),
c AS (SELECT p_partkey, 1::BIGINT AS num_media, ((oh // 28) * (ow // 28))::BIGINT AS num_media_tokens, ({COUNT_SQL} - 1 + (oh // 28) * (ow // 28))::BIGINT AS num_tokens FROM r)
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS rn, * FROM c WHERE num_tokens <= 150""")
def dataset_chain(t):
    """A dataset's steps in a row: verify, measure media, measure items, keep what fits, number the rest; packing follows."""
    kept = V.usable(_verified(t).where(F.col("status") == V.OK))[0]
    measured = kept.withColumn("num_media", F.lit(1).cast("long")).withColumn("num_media_tokens", E.media_tokens(F.col("height"), F.col("width")))
    measured = measured.withColumn("num_tokens", E.total_tokens(F.col("p_name"), F.col("num_media"), F.col("num_media_tokens"))).where(E.fits(F.col("num_tokens"), 150))
    return R.position(measured.select("p_partkey", "num_media", "num_media_tokens", "num_tokens"), "p_partkey", ranges=8)



@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN (p_partkey % 300 + 10)::INT END AS height, CASE WHEN p_partkey % 4 < 2 THEN (p_partkey % 500 + 10)::INT END AS width,
  CASE p_partkey % 4 WHEN 2 THEN 'truncated' WHEN 3 THEN 'unreadable' END AS error FROM part""")
def image_uri_check(t):
    """Images that come as data URIs: whole, cut, or a path instead."""
    key = F.col("p_partkey")
    made = png(key % 300 + 10, key % 500 + 10)
    coded = F.concat(F.lit("data:image/png;base64,"), F.base64(F.when(key % 4 == 2, _cut(made, 7)).otherwise(made[0])))
    uri = F.when(key % 4 == 3, F.concat(F.lit("media/"), key, F.lit(".png"))).otherwise(coded)
    return t("part").select("p_partkey", probe(T.data_uri_bytes(uri)).alias("p")).select("p_partkey", "p.height", "p.width", "p.error")


@query("SELECT conv_id, string_agg(role || ' speaks', ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def subtitle_text(t):
    """The spoken lines of subtitle files, one for each conversation."""
    turn = F.col("turn")
    cue = F.concat((turn + 1).cast("string"), F.lit("\n00:0"), (turn % 10).cast("string"), F.lit(":00.000 --> 00:0"), (turn % 10).cast("string"), F.lit(":09.000\n"), F.col("role"), F.lit(" speaks"))
    files = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda c: c["cue"]), "\n\n").alias("cues"))
    return files.select("conv_id", T.cue_text(F.concat(F.lit("WEBVTT\n\n"), F.col("cues"))).alias("text"))
