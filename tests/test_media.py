"""Media files: probes of containers, walks of images, the video source, and the verification of items."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import verify as V
from tessera.sources import media as MD


def box(kind, *body):
    data = b"".join(body)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def track(kind, number=1, scale=600, runs=((10, 40),), h=30, w=50, version=0):
    wide = b"\0" * (16 if version else 8)
    tkhd = box(b"tkhd", bytes([version, 0, 0, 0]), wide, struct.pack(">I", number), b"\0" * 60)
    mdhd = box(b"mdhd", bytes([version, 0, 0, 0]), wide, struct.pack(">I", scale), b"\0" * 8)
    stsd = box(b"stsd", b"\0" * 4, struct.pack(">II4s", 1, 86, b"avc1"), b"\0" * 24, struct.pack(">HH", w, h), b"\0" * 50)
    stts = box(b"stts", b"\0" * 4, struct.pack(">I", len(runs)), *[struct.pack(">II", *r) for r in runs])
    return box(b"trak", tkhd, box(b"mdia", mdhd, box(b"hdlr", b"\0" * 8, kind, b"\0" * 13), box(b"minf", box(b"stbl", stsd, stts))))


def probe(data):
    return MD.probe_video(lambda at, n: data[at : at + n], len(data))


def test_boxes_of_videos():
    ftyp, sound, video = box(b"ftyp", b"isom"), track(b"soun", 1, 48000, ((999, 1),), 0, 0), track(b"vide", 2, 30000, ((100, 1001), (20, 2002)), version=1)
    moov = box(b"moov", sound, video, track(b"vide", 3, runs=((7, 1),)))
    want = (120, pytest.approx(120 * 30000 / 140140), 30, 50, None)
    assert probe(ftyp + moov) == probe(ftyp + box(b"mdat", b"x" * 99) + moov) == want
    assert probe(ftyp + struct.pack(">I4sQ", 1, b"mdat", 16 + 5) + b"12345" + moov) == want, "a box with a size of 64 bits"
    assert probe(ftyp + moov + struct.pack(">I4s", 0, b"mdat") + b"to the end") == want
    whole = ftyp + moov + box(b"mdat", b"x" * 9)
    for n in range(12, len(whole)):
        assert probe(whole[:n])[4] in ("truncated", "no moov box") or n == len(ftyp) + len(moov), n
    assert probe(ftyp + moov)[4] is None
    assert probe(ftyp + box(b"mdat"))[4] == "no moov box" and probe(ftyp + box(b"moov", sound))[4] == "no video track"
    assert probe(ftyp + box(b"moov", track(b"vide", runs=())))[4] == "no frames or no rate" and probe(ftyp + struct.pack(">I4s", 3, b"moov"))[4] == "box without a size"
    assert probe(b"")[4] == probe(b"RIFF\0\0\0\0WAVE")[4] == "not a video"


def test_boxes_of_fragments():
    moov = box(b"moov", track(b"vide", 2, 1000, ()), box(b"mvex", box(b"trex", b"\0" * 4, struct.pack(">III", 2, 1, 50))))
    one = box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0, 2)), box(b"trun", struct.pack(">II", 0, 10))))
    two = box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">III", 0x8, 2, 25)), box(b"trun", struct.pack(">IIi", 0x1, 4, 0))), box(b"traf", box(b"tfhd", struct.pack(">II", 0, 1)), box(b"trun", struct.pack(">II", 0, 99))))
    three = box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0, 2)), box(b"trun", struct.pack(">II", 0x300, 2), struct.pack(">IIII", 30, 1, 70, 1))))
    assert probe(box(b"ftyp", b"iso5") + moov + one + box(b"mdat", b"x") + two + three) == (16, pytest.approx(16_000 / (500 + 100 + 100)), 30, 50, None)


def avi(frames=90, scale=1001, rate=30000, h=40, w=60):
    chunk = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    avih = chunk(b"avih", struct.pack("<10I", 0, 0, 0, 0, 1, 0, 0, 0, w, h) + b"\0" * 16)
    strh = lambda kind, n: chunk(b"strh", kind + b"H264" + b"\0" * 12 + struct.pack("<4I", scale, rate, 0, n) + b"\0" * 20)
    listed = lambda kind, data: chunk(b"LIST", kind + data)
    body = b"AVI " + listed(b"hdrl", avih + listed(b"strl", strh(b"auds", 9)) + chunk(b"junk", b"odd") + listed(b"strl", strh(b"vids", frames))) + listed(b"movi", b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_chunks_of_videos():
    assert probe(avi()) == (90, pytest.approx(29.97, abs=1e-3), 40, 60, None)
    assert probe(avi(frames=0))[:1] == (1,), "the main header counts where the stream's is 0"
    assert probe(avi()[:-1])[4] == "truncated" and probe(avi(rate=0))[4] == "no frames or no rate"


def png(h=30, w=50):
    chunk = lambda kind, data=b"": struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", w, h) + b"\x08\2\0\0\0") + chunk(b"tEXt", b"a") + chunk(b"IDAT", zlib.compress(b"\0" * 99)) + chunk(b"IEND")


def jpeg(h=31, w=51):
    part = lambda mark, data: bytes([0xFF, mark]) + struct.pack(">H", len(data) + 2) + data
    scan = part(0xDA, b"\1\1\0\0\x3f\0") + b"ab\xff\0cd\xff\xd0ef"
    return b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, b"\0" * 65) + b"\xff" + part(0xC2, struct.pack(">BHHB", 8, h, w, 0)) + part(0xC4, b"\0" * 5) + scan + part(0xC4, b"\0" * 3) + scan + b"\xff\xd9"


def gif(h=32, w=52):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80, 0, 0) + b"\0" * 6 + b"!\xf9\4\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0x81) + b"\0" * 12 + b"\2\3abc\2de\0" + b";"


@pytest.mark.parametrize("made,sides", [(png, (30, 50)), (jpeg, (31, 51)), (gif, (32, 52))])
def test_images_that_are_whole_or_cut(made, sides):
    whole = made()
    assert MD.check_image(whole) == sides and MD.check_image(whole + b"more") == sides
    assert MD.check(whole) == (None, None, *sides, None)
    for n in range(8, len(whole)):
        with pytest.raises(MD.Broken):
            MD.check_image(whole[:n])


def test_images_that_are_broken():
    data = png()
    for k in range(len(data) - 12):
        assert MD.check(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])[4], k
    assert MD.check(data.replace(b"IDAT", b"IDAX"))[4] == "wrong checksum" and MD.check(b"\x89PNG")[4] == "not an image"
    assert MD.check(jpeg().replace(b"\xff\xc2", b"\xff\xc4"))[4] == "no header" and MD.check(gif()[:-1] + b"x")[4] == "no block"
    assert MD.check(None)[4] == MD.NONE and MD.check(b"")[4] == MD.check(b"text")[4] == "not a video"


def test_video_source(spark, tmp_path):
    MD.register(spark)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    good = box(b"ftyp", b"isom") + box(b"moov", track(b"vide"))
    for k in range(7):
        (tmp_path / "in" / f"{k}.mp4").write_bytes(good)
    (tmp_path / "in" / "deep" / "a.avi").write_bytes(avi())
    (tmp_path / "in" / "cut.mp4").write_bytes(good[:-1])
    (tmp_path / "in" / "none.mp4").write_bytes(b"")
    with open(tmp_path / "in" / "long.mp4", "wb") as f:  # 4 GB of data that nothing reads, the header behind them
        f.write(box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", 4 << 30))
        f.seek((4 << 30) - 16, 1)
        f.write(box(b"moov", track(b"vide", runs=((1000, 20),))))
    df = spark.read.format("video").option("filesPerPartition", 3).load(str(tmp_path / "in"))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in df.collect()}
    assert df.rdd.getNumPartitions() == 4 and len(rows) == 11
    assert (rows["0.mp4"]["frames"], rows["0.mp4"]["fps"], rows["0.mp4"]["error"]) == (10, 15.0, None)
    assert (rows["long.mp4"]["frames"], rows["long.mp4"]["fps"]) == (1000, 30.0) and rows["long.mp4"]["length"] > 4 << 30
    assert rows["a.avi"]["height"] == 40 and rows["cut.mp4"]["error"] == "truncated" and rows["none.mp4"]["error"] == "not a video"
    assert spark.read.format("video").option("pathGlobFilter", "*.avi").load(str(tmp_path / "in")).count() == 1
    assert spark.read.format("video").load(f"file://{tmp_path}/in/deep").count() == 1
    (tmp_path / "empty").mkdir()
    assert spark.read.format("video").load(str(tmp_path / "empty")).collect() == []
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("video").load(str(tmp_path / "absent")).collect()
    as_bytes = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9c]*.mp4").load(str(tmp_path / "in")).select(MD.probe("content").alias("p")).select("p.*")
    assert sorted(tuple(r) for r in as_bytes.where("error is null").collect()) == [(10, 15.0, 30, 50, None)] * 7 and as_bytes.where("error = 'truncated'").count() == 1


def test_verification(spark):
    items = spark.createDataFrame([(k, n) for k, n in enumerate(["ok.png", "cut.png", "gone.png", "null.png", "done.png", "small.png", None, "ok.png", "v.mp4", "gone-done.png"])], "id int, name string")
    video = box(b"ftyp", b"isom") + box(b"moov", track(b"vide", h=10, w=10))
    files = spark.createDataFrame([("ok.png", png()), ("cut.png", png()[:-1]), ("null.png", None), ("done.png", png()[:-1]), ("small.png", png(27, 99)), ("v.mp4", video)], "name string, content binary")
    done = spark.createDataFrame([("done.png",), ("done.png",), ("gone-done.png",)], "name string")
    verified = V.verify(items, files, done)
    got = {r["id"]: (r["status"], r["reason"]) for r in verified.collect()}
    assert got == {0: ("OK", None), 1: ("Corrupted", "truncated"), 2: ("DNE", None), 3: ("PyERROR", "unreadable"), 4: ("Already Processed", None), 5: ("OK", None), 6: ("DNE", None), 7: ("OK", None), 8: ("OK", None), 9: ("Already Processed", None)}
    kept, report = V.usable(verified)
    assert {r["id"] for r in kept.collect()} == {0, 4, 7, 8, 9}
    assert {(r["status"], r["reason"]): r["n"] for r in report.collect()} == {("OK", None): 3, ("OK", "smaller than 28"): 1, ("Corrupted", "truncated"): 1, ("DNE", None): 2, ("PyERROR", "unreadable"): 1, ("Already Processed", None): 2}
    assert V.verify(items.where("false"), files, done).count() == 0 and V.verify(items, files.where("false"), done.where("false")).select("status").distinct().first()[0] == "DNE"
    assert verified.where(F.col("id") == 8).first()["frames"] == 10
