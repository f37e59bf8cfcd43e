"""Text functions as Column builders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends, Unicode-aware.
EDGES = r"(?U)^\s+|\s+$"
#: What stands between words: everything but letters, numbers and underscores.
BETWEEN = r"[^\p{L}\p{N}_]+"
#: Word pieces of the built-in tokenizer: runs of word characters, or single other marks.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Token sets of the answer filters.
FILTERS = {"yes_no": ("yes", "no", "y", "n"), "chexpert": ("present", "absent", "ap", "pa", "lateral", "frontal"), "mc": ("a", "b", "c", "d")}


def strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGES, "")


def split_words(x: Column) -> Column:
    """Split at non-word runs; an empty head or tail stays."""
    return F.split(x, BETWEEN, -1)


def answer_tokens(x: Column, k: int = 3) -> Column:
    """The first k words of an answer, stripped and in lower case; empty heads take a place."""
    return F.slice(split_words(F.lower(strip(x))), 1, k)


def token_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(PIECE), F.lit(0))).cast("long")


def passes(tokens: Column, name: str) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, FILTERS[name])))


def add_filter(name: str, words: Iterable[str]) -> None:
    """A filter of the caller's own: answers that have one of the words, in lower case."""
    FILTERS[name] = tuple(words)


def lines(x: Column) -> Column:
    """The lines of a text."""
    return F.split(x, "\n", -1)


def filter_for(dataset: str) -> str:
    """The filter that a dataset's name asks for."""
    return "chexpert" if "chexpert" in dataset else "mc" if "mc" in dataset else "yes_no"


def last_turn(x: Column, marker: str = "assistant") -> Column:
    """What follows the last marker, stripped."""
    return strip(F.element_at(F.split(x, marker, -1), -1))


def prompt_names(x: Column) -> Column:
    return F.reverse(F.split(x, ","))


def basename(x: Column) -> Column:
    return F.substring_index(x, "/", -1)


def stem(x: Column) -> Column:
    return F.regexp_replace(basename(x), r"(?<=.)\.[^.]*$", "")


def parent_name(x: Column) -> Column:
    """The last folder of a path; null if there is none."""
    parts = F.split(x, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def with_dir(folder: Column, path: Column) -> Column:
    """folder/path; an absolute path stays as it is."""
    return F.when(path.startswith("/") | folder.isNull(), path).otherwise(F.concat_ws("/", folder, path))


def subtitle_path(x: Column) -> Column:
    return F.replace(x, F.lit(".mp4"), F.lit(".en.vtt"))


def cue_text(vtt: Column) -> Column:
    """The spoken lines of a WebVTT text, joined by spaces."""
    bare = F.regexp_replace(vtt, r"(?m)^(WEBVTT.*|NOTE.*|\d+|\d[\d:.]+\s+-->.*)$", "")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def data_uri_bytes(x: Column) -> Column:
    """The bytes of a data:image URI, null for other texts."""
    return F.when(x.startswith("data:image"), F.unbase64(F.split_part(x, F.lit(","), F.lit(2))))
