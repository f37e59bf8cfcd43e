"""Media and token measures of items."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mathx
from ..functions.text import parent_name, token_count
from .rows import dealt

#: Fixed value: tokens of media that could not be measured.
FAILED = -1
#: Fixed value: folder whose videos are read frame by frame.
ALL_FRAMES_FOLDER = "vid_processed"


def frame_plan(df: DataFrame, total: str, fps: str, path: str | None = None, interval: float = 1.0) -> DataFrame:
    """df with n_frames, frames (positions) and effective fps; null where the rate is not positive."""
    seconds = F.when(F.col(fps) > 0, F.col(total) / F.col(fps))
    n = F.when(seconds.isNotNull(), F.least(mathx.frame_count(seconds, interval), F.col(total).cast("long")))
    if path:
        n = F.when(parent_name(F.col(path)) == ALL_FRAMES_FOLDER, F.col(total).cast("long")).otherwise(n)
    return df.withColumn("n_frames", n).withColumn("frames", F.when(F.col("n_frames").isNotNull(), mathx.frame_indices(F.col(total).cast("long"), F.col("n_frames")))).withColumn("effective_fps", F.col("n_frames") / seconds)


def frame_rows(df: DataFrame, total: str, fps: str, *keys: str, path: str | None = None, interval: float = 1.0) -> DataFrame:
    """(keys, i, frame): one row for each frame of the plan; keys tell the videos apart.

    A short row makes hundreds, so videos are dealt over all tasks first, and each frame is computed where it is counted off.
    """
    videos = frame_plan(df, total, fps, path, interval).where("n_frames > 0").select(*keys, F.col(total).cast("long").alias("_total"), F.col("n_frames").alias("_n"))
    counted = dealt(videos, *keys).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    i, n = F.col("i"), F.col("_n")
    frame = F.when(n == 1, F.lit(0).cast("long")).otherwise(mathx.frame_index(i, F.col("_total"), n))
    return counted.select(*keys, "i", frame.alias("frame"))


def valid_image(h: Column, w: Column, side: int = mathx.FACTOR) -> Column:
    return F.coalesce((h >= side) & (w >= side), F.lit(False))


def media_tokens(h: Column, w: Column, frames: Column | None = None) -> Column:
    """Tokens of an image, or of a video where frames is not null; FAILED where a side is missing or empty."""
    ok = (h > 0) & (w > 0)
    image = mathx.image_tokens(h, w)
    value = image if frames is None else F.when(frames.isNull(), image).otherwise(mathx.video_tokens(h, w, frames))
    return F.when(ok, value).otherwise(F.lit(FAILED)).cast("long")


def total_tokens(text: Column, num_media: Column, num_media_tokens: Column) -> Column:
    """Text tokens with each placeholder (counted once in the text) swapped for the size of its media."""
    return token_count(text) - num_media + num_media_tokens


def fits(num_tokens: Column, limit: int) -> Column:
    return num_tokens <= limit


def is_valid_image_udf():
    """A vectorised check of image bytes: (ok, h, w) from the header of a PNG, GIF or JPEG; no decoder is needed."""
    def size(blob: bytes | None) -> tuple[bool, int | None, int | None]:
        try:
            if blob[:8] == b"\x89PNG\r\n\x1a\n":
                w, h = struct.unpack(">II", blob[16:24])
                return True, h, w
            if blob[:6] in (b"GIF87a", b"GIF89a"):
                w, h = struct.unpack("<HH", blob[6:10])
                return True, h, w
            if blob[:2] == b"\xff\xd8":
                at = 2
                while at < len(blob) - 9:
                    mark, length = blob[at + 1], struct.unpack(">H", blob[at + 2 : at + 4])[0]
                    if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                        h, w = struct.unpack(">HH", blob[at + 5 : at + 9])
                        return True, h, w
                    at += 2 + length
        except (TypeError, struct.error, IndexError):
            pass
        return False, None, None

    @F.pandas_udf("ok boolean, h int, w int")
    def header(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([size(b) for b in blobs], columns=["ok", "h", "w"]).astype({"h": "Int32", "w": "Int32"})

    return header
