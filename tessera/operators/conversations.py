"""Conversations: makers that turn items into messages, modifiers that add prompts, rendering and flattening.

A message is STRUCT<role, content ARRAY<part>>, a part STRUCT<type, text, uri>; the relational form is one row for
each message (conv_id, turn, role, text). Makers give Columns of ARRAY<message>, so any of them runs in a projection.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import insert_clamped
from ..functions.jsonx import pick
from ..functions.openjson import entries, text_of
from ..functions.text import with_dir

log = logging.getLogger(__name__)
MESSAGE = "array<struct<role:string,content:array<struct<type:string,text:string,uri:string>>>>"
#: Answers that ask for the view of an image.
VIEWS = ("Frontal", "Lateral", "AP", "PA")


def part(kind: str, value: Column) -> Column:
    text, uri = (value, F.lit(None).cast("string")) if kind == "text" else (F.lit(None).cast("string"), value)
    return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), uri.cast("string").alias("uri"))


def message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def says(role: str, text: Column) -> Column:
    return message(role, part("text", text))


def none() -> Column:
    return F.lit(None).cast(MESSAGE)


# Makers ---------------------------------------------------------------------------------------------------------


def text_maker(text: Column) -> Column:
    return F.array(says("assistant", text))


def media_parts(image: Column, video: Column, folder: Column | None = None) -> Column:
    """The media part of an item, none if it has neither; both are an error."""
    place = (lambda x: with_dir(folder, x)) if folder is not None else (lambda x: x)
    both = F.raise_error(F.lit("an item has an image or a video, not both"))
    empty = F.slice(F.array(part("image", F.lit(""))), 1, 0)
    return F.when(image.isNotNull() & video.isNotNull(), both.cast("array<struct<type:string,text:string,uri:string>>")).when(image.isNotNull(), F.array(part("image", place(image)))).when(video.isNotNull(), F.array(part("video", place(video)))).otherwise(empty)


def vqa_maker(qa: Column, image: Column, video: Column, training: bool = True, folder: Column | None = None) -> Column:
    """qa: ARRAY<STRUCT<question, answer>>. A user turn with the media, then a turn for each question, and its answer in training."""
    media = F.array(F.struct(F.lit("user").alias("role"), media_parts(image, video, folder).alias("content")))
    turns = F.transform(qa, lambda x: F.array(says("user", x["question"]), *([says("assistant", x["answer"])] if training else [])))
    return F.concat(media, F.flatten(turns))


def label_maker(image: Column, label: Column, question: str, training: bool = True) -> Column:
    turns = [message("user", part("image", image), part("text", F.lit(question)))]
    return F.array(*turns, *([says("assistant", label.cast("string"))] if training else []))


def caption_maker(medium: Column, caption: Column, kind: str = "image") -> Column:
    """A user turn with the medium, an image or a video, and its caption, also at inference."""
    return F.array(message("user", part(kind, medium)), says("assistant", caption))


def radiology_maker(image: Column, questions: Column, answers: Column, view_template: str, template: str, training: bool = True) -> Column:
    """A user turn with the image, then a question for each of two arrays of equal length, and its answer in training.

    The template follows the answer, see view_question(); a single question is an array of one. Other lengths are an error.
    """
    media = F.array(message("user", part("image", image)))
    asked = F.transform(F.arrays_zip(questions.alias("q"), answers.alias("a")), lambda x: F.array(says("user", view_question(x["q"], x["a"], view_template, template)), *([says("assistant", x["a"])] if training else [])))
    uneven = F.raise_error(F.lit("questions and answers differ in number")).cast(MESSAGE)
    return F.when(F.size(questions) != F.size(answers), uneven).otherwise(F.concat(media, F.flatten(asked)))


def columns_maker(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = (), image: str = "image") -> Column:
    """A user turn with the image, then a question and an answer for each other kept column; without a column image, only these."""
    if set(include or ()) & set(exclude):
        raise ValueError("a column is both included and excluded")
    kept = [c for c in df.columns if (include is None or c in include) and c not in exclude and c != image]
    media = [F.array(message("user", part("image", F.col(image))))] if image in df.columns else []
    return F.flatten(F.array(*media, *[F.array(says("user", F.lit(f"{c.lower()}: ")), says("assistant", F.col(c).cast("string"))) for c in kept]))


def view_question(question: Column, answer: Column, view_template: str, template: str) -> Column:
    """One of two templates with {question} filled in, by whether the answer names a view."""
    fill = lambda t: F.replace(F.lit(t), F.lit("{question}"), question)
    return F.when(answer.isin(*VIEWS), fill(view_template)).otherwise(fill(template))


def choice_text(question: Column, options: Column) -> Column:
    """A line for the question and for each option. options: ARRAY<STRUCT<key, text>>, in order."""
    return F.concat(F.lit("Question: "), question, F.array_join(F.transform(options, lambda o: F.concat(F.lit("\nOption "), o["key"], F.lit(": "), o["text"])), ""), F.lit("\n"))


def open_options(options: Column) -> Column:
    """Options for choice_text() from a JSON object with any keys, in the order of its text; null if it is none."""
    return F.transform(entries(options), lambda e: F.struct(e["key"].alias("key"), F.coalesce(text_of(e["value"], "$"), F.lit("None")).alias("text")))


def choice_maker(question: Column, options: Column, answer: Column | None = None) -> Column:
    return F.array(says("user", choice_text(question, options)), *([says("assistant", answer)] if answer is not None else []))


def typed_maker(kind: Column, qa: Column, video: Column, caption: Column, training: bool = True, strict: bool = False) -> Column:
    """By the item's type: qa_pairs or caption; another type gives none, or an error if ``strict``."""
    other = F.raise_error(F.concat(F.lit("unknown item type: "), F.coalesce(kind, F.lit("null")))).cast(MESSAGE) if strict else none()
    return F.when(kind == "qa_pairs", vqa_maker(qa, F.lit(None).cast("string"), video, training)).when(kind == "caption", caption_maker(video, caption, "video")).otherwise(other)


# Content --------------------------------------------------------------------------------------------------------


def contents(messages: Column, kind: str) -> Column:
    """The texts or URIs of one kind, in order."""
    return F.transform(F.filter(F.flatten(F.transform(messages, lambda m: m["content"])), lambda p: p["type"] == kind), lambda p: p["text"] if kind == "text" else p["uri"])


def media_of(messages: Column) -> Column:
    """Media parts of all but system messages."""
    return F.filter(F.flatten(F.transform(F.filter(messages, lambda m: m["role"] != "system"), lambda m: m["content"])), lambda p: p["type"].isin("image", "video"))


def to_rows(df: DataFrame, messages: str, *keys: str) -> DataFrame:
    """One row for each part: keys, turn, pos, role, type, text, uri."""
    turns = df.select(*keys, F.posexplode(messages).alias("turn", "_m"))
    return turns.select(*keys, "turn", F.col("_m.role").alias("role"), F.posexplode_outer("_m.content").alias("pos", "_p")).select(*keys, "turn", "pos", "role", "_p.type", "_p.text", "_p.uri")


def media_index(rows: DataFrame, conv: str, kind: str, *order: str) -> DataFrame:
    """rows with the running number of each medium of a conversation, by kind ("Picture 1:", "Video 1:")."""
    return rows.withColumn("media_index", F.row_number().over(Window.partitionBy(conv, kind).orderBy(*order)))


def media_mark(kind: Column, index: Column | None = None) -> Column:
    """The text of a medium, empty for a null kind; index: its number from 1, "Picture 1: " or "Video 1: "."""
    name = F.when(kind == "image", F.lit("Picture ")).when(kind == "video", F.lit("Video "))
    label = F.concat(name, index.cast("string"), F.lit(": ")) if index is not None else F.lit("")
    return F.coalesce(F.concat(label, F.lit("<|vision_start|><|"), kind, F.lit("_pad|><|vision_end|>")), F.lit(""))


# Modifiers ------------------------------------------------------------------------------------------------------


def prompt_all(messages: Column, role: str, prompt: Column, index: int = 0) -> Column:
    """A message of the role at index in every conversation."""
    return insert_clamped(messages, index, says_column(role, prompt))


def says_column(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(part("text", text)).alias("content"))


def prompt_first_in_pack(df: DataFrame, messages: str, pack: str, order: str, prompt: Column, index: int = 0) -> DataFrame:
    """The system prompt in the first conversation of each pack."""
    first = F.row_number().over(Window.partitionBy(pack).orderBy(order)) == 1
    return df.withColumn("_first", first).withColumn(messages, F.when(F.col("_first"), prompt_all(F.col(messages), "system", prompt, index)).otherwise(F.col(messages))).drop("_first")


def prompt_role_first(messages: Column, role: str, prompt: Column, index: int = 0) -> Column:
    """A text part at index in the first message of the role."""
    at = F.array_position(F.transform(messages, lambda m: m["role"]), role) - 1
    return F.transform(messages, lambda m, i: F.when(i == at, F.struct(m["role"].alias("role"), insert_clamped(m["content"], index, part("text", prompt)).alias("content"))).otherwise(m))


def prompt_order(messages: Column, system: Sequence[Column], custom: Sequence[Column]) -> Column:
    """System prompts, then custom ones, then the conversation: each is put in front, from the last to the first."""
    for prompt in reversed(custom):
        messages = prompt_all(messages, "user", prompt)
    for prompt in reversed(system):
        messages = prompt_all(messages, "system", prompt)
    return messages


def variant(variants: Sequence[str], seed: str, *keys: Column) -> Column:
    """One of a prompt's variants for each row, by hash of its keys."""
    return pick(list(variants), seed, *keys)


def chosen(names: str, catalogue: Mapping[str, Sequence[str]]) -> list[tuple[str, Sequence[str]]]:
    """The prompts of a comma-separated list of names, the last first; a name that the catalogue lacks is skipped with a warning."""
    out = []
    for name in reversed([n.strip() for n in names.split(",")]):
        if name in catalogue:
            out.append((name, catalogue[name]))
        elif name:
            log.warning("prompt %s not found, not using it", name)
    return out


def with_prompts(messages: Column, keys: Sequence[Column], everywhere: str = "", user: str = "", catalogues: Sequence[Mapping[str, Sequence[str]]] = ({}, {})) -> Column:
    """messages with the named prompts of two catalogues: those put in front of all conversations, then those of user messages.

    Each conversation gets one variant of a prompt, by hash of keys. Prompts of the first message of a pack need its rows,
    see prompt_first_in_pack().
    """
    for name, variants in chosen(everywhere, catalogues[0]):
        messages = prompt_all(messages, "user", variant(variants, name, *keys))
    for name, variants in chosen(user, catalogues[1]):
        messages = prompt_role_first(messages, "user", variant(variants, name, *keys), 1)
    return messages


def join_pack(df: DataFrame, messages: str, pack: str, order: str) -> DataFrame:
    """The conversations of each pack as one, in order."""
    return df.groupBy(pack).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(messages).alias("m")))), lambda x: x["m"])).alias(messages))


# Relational form ------------------------------------------------------------------------------------------------


def render(rows: DataFrame, template: bool = True, generation_prompt: bool = False, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, text): the chat text of each conversation."""
    piece = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n")) if template else F.concat(F.col("text"), F.lit("\n"))
    tail = "<|im_start|>assistant\n" if template and generation_prompt else ""
    return rows.select(conv, turn, piece.alias("piece")).groupBy(conv).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "piece"))), lambda x: x["piece"]), ""), F.lit(tail)).alias("text"))


def qa_pairs(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, question, answer): user turns that the assistant answers next."""
    order = Window.partitionBy(conv).orderBy(turn)
    ahead = rows.withColumn("_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    return ahead.where("role = 'user' and _role = 'assistant'").select(conv, turn, F.col("text").alias("question"), "answer")
