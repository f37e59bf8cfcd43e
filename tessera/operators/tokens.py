"""Token ids, label masks and padding of conversations, in relational form.

A tokenizer is a Column builder from text to ARRAY<INT>; the built-in one numbers word pieces by a hash. Pieces are
tokenised apart and joined, as a trainer does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import IGNORE, mask_for, pad_to
from ..functions.text import PIECE

Tokenizer = Callable[[Column], Column]
#: Size of the built-in vocabulary, and ids that it keeps free for marks: padding, pads of a picture and of a video, start
#: and end of a medium.
VOCABULARY, PAD, IMAGE_PAD, VIDEO_PAD, MEDIA_START, MEDIA_END = 50_000, 0, 1, 2, 3, 4


def hashed_pieces(text: Column) -> Column:
    """Ids 10 and up, by the md5 of each piece: equal in any engine."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.transform(pieces, lambda p: (F.conv(F.substring(F.md5(p.cast("binary")), 1, 8), 16, 10).cast("long") % (VOCABULARY - 10) + 10).cast("int"))


def media_ids(media: Column, text_only: bool = False) -> Column:
    """Start, as many pads of its kind as it has tokens (one if ``text_only``), and end of each medium.

    media: ARRAY<STRUCT<kind, tokens>>, of kind image or video; another kind is an error.
    """
    pad = lambda m: F.when(m["kind"] == "image", F.lit(IMAGE_PAD)).when(m["kind"] == "video", F.lit(VIDEO_PAD)).otherwise(F.raise_error(F.concat(F.lit("unknown medium: "), F.coalesce(m["kind"], F.lit("null")))).cast("int"))
    count = lambda m: F.lit(1) if text_only else m["tokens"].cast("int")
    return F.flatten(F.transform(media, lambda m: F.concat(F.array(F.lit(MEDIA_START)), F.array_repeat(pad(m), count(m)), F.array(F.lit(MEDIA_END)))))


def features(rows: DataFrame, tokenizer: Tokenizer = hashed_pieces, template: bool = True, generation_prompt: bool = False, media: Column | None = None, text_only: bool = False, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, input_ids, labels) of conversations: only what an assistant says is a training target.

    media: the pictures and videos before the text of a row, see media_ids(); all their ids are masked. Pieces are
    tokenised once; masks are made from their counts.
    """
    none = F.expr("cast(array() as array<int>)")
    head = tokenizer(F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"))) if template else none
    before = F.concat(head, F.coalesce(media_ids(media, text_only), none)) if media is not None else head
    said = rows.select(conv, turn, (F.col("role") == "assistant").alias("_own"), before.alias("_before"), tokenizer(F.coalesce(F.col("text"), F.lit(""))).alias("_said"), tokenizer(F.lit("<|im_end|>\n") if template else F.lit("\n")).alias("_tail"))
    masked = lambda ids: F.array_repeat(F.lit(IGNORE), F.size(ids))
    spoken = F.when(F.col("_own"), F.col("_said")).otherwise(masked("_said"))
    pieces = said.select(conv, turn, F.concat("_before", "_said", "_tail").alias("ids"), F.concat(masked("_before"), spoken, masked("_tail")).alias("labels"))
    joined = pieces.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "ids", "labels"))).alias("_all"))
    out = joined.select(conv, F.flatten(F.transform("_all", lambda x: x["ids"])).alias("input_ids"), F.flatten(F.transform("_all", lambda x: x["labels"])).alias("labels"))
    if template and generation_prompt:
        ask = tokenizer(F.lit("<|im_start|>assistant\n"))
        out = out.select(conv, F.concat("input_ids", ask).alias("input_ids"), F.concat("labels", ask).alias("labels"))
    return out


def batch(df: DataFrame, batch_id: str, side: str = "right", pad_id: int = PAD, target: Column | None = None) -> DataFrame:
    """input_ids, labels and attention_mask, padded to the longest of each batch (or to target)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch_id))
    sized = df.withColumn("_target", target if target is not None else longest)
    return sized.select(
        *[c for c in df.columns if c not in ("input_ids", "labels")],
        pad_to(F.col("input_ids"), F.col("_target"), F.lit(pad_id), side).alias("input_ids"),
        pad_to(F.col("labels"), F.col("_target"), F.lit(IGNORE), side).alias("labels"),
        mask_for(F.col("input_ids"), F.col("_target"), side).alias("attention_mask"),
    )
