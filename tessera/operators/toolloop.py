"""The loop of generation and tool calls, as rounds over a frontier of conversations.

A round asks the model for what follows each conversation that still runs. One without a call is answered; the others
have their call executed, and the call and its result join the text that the next round reads. Each round is written
once, so a lost executor reads it again and the plan doesn't grow with the rounds. With a folder, rounds that a run has
finished are read by the next run instead of being made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import exists, materialize
from . import toolcalls as TC
from .rows import dealt

#: Fixed value: calls of a conversation, after which one more text is generated and taken as it is.
MAX_CALLS = 10
Step = Callable[[DataFrame], DataFrame]


def lookup(tools: DataFrame) -> Step:
    """Executes calls by a table of results: (name, arguments, result), unique by name and arguments (JSON text).

    Only the different calls of a round meet the tools, and their results the calls. Both are written while the plan is
    built, so Spark knows their size: where few are different, neither calls nor tools are shuffled, however often one
    is made. A name that no tool has, and arguments that a tool does not know, give an error text as the result.
    """
    known = tools.select(F.col("name").alias("_name"), F.col("arguments").alias("_arguments"), "result")

    def execute(calls: DataFrame) -> DataFrame:
        wanted = materialize(calls.select("name", "arguments").distinct(), "calls")
        same = (F.col("name") == F.col("_name")) & (F.col("arguments") == F.col("_arguments"))
        hits = known.join(wanted, same, "left_semi")
        names = tools.select(F.col("name").alias("_tool")).distinct()
        joined = wanted.join(hits, same, "left").join(names, F.col("name") == F.col("_tool"), "left")
        missing = F.concat(F.lit("Error: Tool '"), F.coalesce("name", F.lit("None")), F.lit("' not found"))
        failed = F.concat(F.lit("Error executing tool: no result for "), F.col("arguments"))
        result = F.when(F.col("_tool").isNull(), missing).otherwise(F.coalesce("result", failed))
        results = materialize(joined.select(F.col("name").alias("_name"), F.col("arguments").alias("_arguments"), result.alias("result")), "results")
        return calls.join(results, F.col("name").eqNullSafe(F.col("_name")) & F.col("arguments").eqNullSafe(F.col("_arguments")), "left").drop("_name", "_arguments")

    return execute


def _round(df: DataFrame, number: int, folder: str | None) -> DataFrame:
    """df of a round, written; or read, where an earlier run has written it in full."""
    if folder is None:
        return materialize(df, "round")
    if not _finished(df, number, folder):
        df.write.mode("overwrite").parquet(f"{folder}/round-{number}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/round-{number}")


def _finished(df: DataFrame, number: int, folder: str | None) -> bool:
    return folder is not None and exists(df.sparkSession, f"{folder}/round-{number}/_SUCCESS")


def converse(items: DataFrame, key: str, text: str, generate: Step, execute: Step, max_calls: int = MAX_CALLS, folder: str | None = None) -> DataFrame:
    """(key, text, output, calls, answered): each conversation after its last generation.

    generate: adds the column output to rows of (key, text); execute: adds the column result to rows with name and
    arguments. A text without a valid call is an answer; after max_calls calls the next text is taken whatever it is
    (answered is then whether it holds no call). A null output counts as an empty one. Rounds run while the plan is
    built: at most max_calls + 1, fewer where no conversation calls any more. The folder must belong to these items.
    Conversations are dealt over all tasks first: a short text is much work, round after round.
    """
    frontier, over = dealt(items.select(F.col(key).alias("_key"), F.col(text).alias("text")), "_key"), []
    for number in range(max_calls + 1):
        asked = generate(frontier).select("_key", "text", F.coalesce("output", F.lit("")).alias("output"))
        asked = _round(TC.with_call(asked, "output"), number, folder)
        last = number == max_calls
        done = asked if last else asked.where("call is null")
        over.append(done.select(F.col("_key").alias(key), "text", "output", F.lit(number).alias("calls"), F.col("call").isNull().alias("answered")))
        going = asked.where("call is not null")
        if last or going.isEmpty():
            break
        if _finished(asked, number + 1, folder):  # what an earlier run has asked next is read
            frontier = going.select("_key", "text")
            continue
        called = execute(going.select("_key", "text", "output", "call.name", "call.arguments", F.col("call.id").alias("_call")))
        step = F.concat("text", "output", TC.format_result(F.col("result"), F.col("_call")))
        frontier = called.select("_key", step.alias("text"))
    out = over[0]
    for part in over[1:]:
        out = out.unionByName(part)
    return out
