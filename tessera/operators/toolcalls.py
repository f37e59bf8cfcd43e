"""Tool calls in text: <tool_call>{"name": .., "arguments": {..}}</tool_call> and <tool_result>..</tool_result>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import call_id
from ..functions.openjson import entries, text_of
from ..functions.text import strip

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_result.*?>(.*?)</tool_result>"
#: What a JSON text escapes in a name, and with what.
QUOTED, ESCAPED = r"([\"\\])", r"\\$1"


def raw_call(text: Column) -> Column:
    """The text of the first call, stripped; null if there is none."""
    return F.when(text.rlike(CALL), strip(F.regexp_extract(text, CALL, 1)))


def _whole(raw: Column) -> Column:
    return F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})


def _call(raw: Column, whole: Column) -> Column:
    valid = raw.startswith("{") & (F.size(whole) == 1) & F.get(whole, F.lit(0)).isNotNull()
    arguments = F.coalesce(F.get_json_object(raw, "$.arguments"), F.lit("{}"))
    return F.when(valid, F.struct(F.get_json_object(raw, "$.name").alias("name"), arguments.alias("arguments"), call_id(raw).alias("id"), raw.alias("raw")))


def parse(text: Column) -> Column:
    """STRUCT<name, arguments (JSON text), id, raw> of the first call; null if it is missing or not one JSON object.

    The whole text of the call must be JSON: as the only element of an array, nothing can stand behind it. A call
    without a name has a null one; missing arguments are {}.
    """
    raw = raw_call(text)
    return _call(raw, _whole(raw))


def with_call(df: DataFrame, text: str, name: str = "call") -> DataFrame:
    """df with parse() of a column; its steps are columns, so that each is computed once a row."""
    steps = df.withColumn("_raw", raw_call(F.col(text))).withColumn("_whole", _whole(F.col("_raw")))
    return steps.withColumn(name, _call(F.col("_raw"), F.col("_whole"))).drop("_raw", "_whole")


def call_text(name: Column, arguments: Column) -> Column:
    """The JSON text of a call; arguments are JSON already."""
    quoted = F.regexp_replace(name, QUOTED, ESCAPED)
    return F.concat(F.lit('{"name": "'), quoted, F.lit('", "arguments": '), arguments, F.lit("}"))


def format_call(name: Column, arguments: Column) -> Column:
    return F.concat(F.lit("<tool_call>"), call_text(name, arguments), F.lit("</tool_call>"))


def format_result(result: Column, call: Column | None = None) -> Column:
    """The result in its tags; call: the id of its call, as an attribute."""
    head = F.lit("<tool_result>") if call is None else F.concat(F.lit("<tool_result id='"), call, F.lit("'>"))
    return F.concat(head, result, F.lit("</tool_result>"))


def strip_calls(text: Column) -> Column:
    """text without calls and results, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, CALL, ""), RESULT, ""))


def catalogue(tools: DataFrame, name: str, description: str, params: str) -> DataFrame:
    """(name, text): a tool with its parameters; params: ARRAY<STRUCT<name, description, required>>."""
    lines = F.array_join(F.transform(params, lambda p: F.concat(F.lit("\n  - "), p["name"], F.when(p["required"], F.lit(" (required)")).otherwise(F.lit("")), F.lit(": "), p["description"])), "")
    return tools.select(name, F.concat(F.col(name), F.lit(": "), F.col(description), lines).alias("text"))


#: How a prompt introduces its tools, and how it explains calls.
INTRODUCED = "You have access to the following tools:\n\n"
EXPLAINED = (
    "To call a tool, use this format: <tool_call>{'name': 'tool_name', 'arguments': {...}}</tool_call>\n"
    "You will receive the tool result in this format: <tool_result id='call_id'>result</tool_result>\n\n"
)


def described(schema: Column) -> Column:
    """The lines of a tool in a prompt, from its own JSON schema {"function": {name, description, parameters}}.

    The properties of the parameters may have any names; they are listed in the order of the schema, those in the
    list `required` as required and the others as optional. A text that is no such object gives null.
    """
    tool = F.try_parse_json(schema)
    name, about = text_of(tool, "$.function.name"), text_of(tool, "$.function.description")
    required = F.coalesce(F.try_variant_get(tool, "$.function.parameters.required", "array<string>"), F.array().cast("array<string>"))
    listed = entries(F.get_json_object(schema, "$.function.parameters.properties"))

    def line(e: Column) -> Column:
        about = F.coalesce(text_of(e["value"], "$.description"), F.lit(""))
        need = F.when(F.array_contains(required, e["key"]), " (required)").otherwise(" (optional)")
        return F.concat(F.lit("    - "), e["key"], F.lit(": "), about, need, F.lit("\n"))

    params = F.when(listed.isNotNull(), F.concat(F.lit("  Parameters:\n"), F.array_join(F.transform(listed, line), "")))
    return F.concat(F.lit("- "), name, F.lit(": "), F.coalesce(about, F.lit("")), F.lit("\n"), F.coalesce(params, F.lit("")), F.lit("\n"))


def prompt_of(tools: DataFrame, schema: str, order: str, *by: str) -> DataFrame:
    """(by, text): the tools of each prompt, in an order, between the introduction and the explanation of calls.

    The tools of one prompt meet in one row, as they do in the prompt itself.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), described(F.col(schema)).alias("text")))), lambda t: t["text"])
    return tools.groupBy(*by).agg(F.concat(F.lit(INTRODUCED), F.array_join(lines, ""), F.lit(EXPLAINED)).alias("text"))


def dispatch(calls: DataFrame, tools: DataFrame, name: str = "name", result: str = "result") -> DataFrame:
    """calls with the result of their tool, an error text where the tool is unknown; tools is a small table."""
    joined = calls.join(tools.select(F.col(name).alias("_tool"), F.col(result)), F.col(name) == F.col("_tool"), "left")
    return joined.withColumn(result, F.coalesce(F.col(result), F.concat(F.lit("Error: Tool '"), F.col(name), F.lit("' not found")))).drop("_tool")


def context(original: Column, steps: Column) -> Column:
    """The text with each call and its result behind it; steps: ARRAY<STRUCT<name, arguments, id, result>>."""
    return F.concat(original, F.array_join(F.transform(steps, lambda s: F.concat(format_call(s["name"], s["arguments"]), format_result(s["result"], s["id"]))), ""))


def extend_mask(mask: Column, added: Column) -> Column:
    """One more 1 for each added token."""
    return F.concat(mask, F.array_repeat(F.lit(1), added))


def bounded_rounds(turns: DataFrame, conv: str, turn: str, limit: int = 10) -> DataFrame:
    """The call turns of a conversation up to the limit of rounds."""
    from pyspark.sql import Window

    order = Window.partitionBy(conv).orderBy(turn)
    return turns.where(F.col("text").rlike(CALL)).withColumn("round", F.row_number().over(order)).where(F.col("round") <= limit)
