"""Queries on tool calls in rounds, tools' own schemas, JSON with unknown keys, and means over several axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import openjson as O
from ..operators import toolcalls as TC
from ..operators import toolloop as L
from ..operators import vectors as V
from .registry import query


def _model(rows):
    """Stands for a model: it asks for what follows the last value that it has read, until that is 5 more than a multiple of 6."""
    rows = rows.withColumn("_value", F.regexp_extract("text", r"(?s)^.*value (\d+)", 1).cast("long"))
    value = F.col("_value")
    name = F.when(value % 40 == 7, F.lit("other")).otherwise(F.lit("next"))
    call = F.concat(F.lit("I look.\n"), TC.format_call(name, F.concat(F.lit('{"k":'), value, F.lit("}"))))
    return rows.withColumn("output", F.when(value % 6 == 5, F.concat(F.lit("It is "), value, F.lit("."))).otherwise(call)).drop("_value")


@query(r"""WITH RECURSIVE tool AS (SELECT p_partkey AS k, (p_partkey * 31 + p_size) % 150 AS next FROM part),
loop AS (SELECT c_custkey, c_custkey % 150 AS v, 0 AS calls, 0 AS errors FROM customer
  UNION ALL SELECT c_custkey, CASE WHEN v % 40 = 7 THEN v ELSE next END, calls + 1, errors + (v % 40 = 7)::INT FROM loop JOIN tool ON k = v WHERE calls < 10 AND v % 6 <> 5)
SELECT c_custkey, max(calls)::INT AS calls, arg_max(v, calls) % 6 = 5 AS answered, CASE WHEN arg_max(v, calls) % 6 = 5 THEN 'It is ' || arg_max(v, calls) || '.' ELSE 'I look.' END AS answer, max(errors)::BIGINT AS errors FROM loop GROUP BY 1""")
def tool_loop(t):
    """Conversations that call a tool again and again, each call by the result before it, ten times at most."""
    part = F.col("p_partkey")
    tools = t("part").select(F.lit("next").alias("name"), F.concat(F.lit('{"k":'), part, F.lit("}")).alias("arguments"), F.concat(F.lit("value "), (part * 31 + F.col("p_size")) % 150).alias("result"))
    items = t("customer").select("c_custkey", F.concat(F.lit("Start with value "), F.col("c_custkey") % 150).alias("text"))
    errors = F.size(F.regexp_extract_all("text", F.lit("Error: Tool 'other' not found"), F.lit(0))).cast("long")
    out = L.converse(items, "c_custkey", "text", _model, L.lookup(tools))
    return out.select("c_custkey", "calls", "answered", TC.strip_calls(F.col("output")).alias("answer"), errors.alias("errors"))


@query(r"""SELECT p_partkey % 50 AS prompt, 'You have access to the following tools:' || chr(10) || chr(10) || string_agg('- tool_' || p_partkey || ': ' || p_name || chr(10) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '  Parameters:' || chr(10)
  || '    - zone ' || p_size || ': ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' (required)' ELSE ' (optional)' END || chr(10) || '    - ' || p_brand || ': ' || ' (optional)' || chr(10) || '    - a.b: it''s "free" text (required)' || chr(10) END || chr(10), '' ORDER BY p_partkey)
  || 'To call a tool, use this format: <tool_call>{''name'': ''tool_name'', ''arguments'': {...}}</tool_call>' || chr(10) || 'You will receive the tool result in this format: <tool_result id=''call_id''>result</tool_result>' || chr(10) || chr(10) AS text FROM part GROUP BY 1""")
def tool_schema_prompt(t):
    """Prompts from the JSON schemas of their tools; each tool has properties of names of its own."""
    key = F.col("p_partkey")
    zone = F.concat(F.lit("zone "), "p_size")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    properties = F.concat(F.lit("{"), quoted(zone), F.lit(': {"type": "string", "description": '), F.substring_index(F.substring_index(F.to_json(F.struct(F.col("p_type").alias("x"))), '{"x":', -1), "}", 1), F.lit("}, "), quoted(F.col("p_brand")), F.lit(': {"type": "integer"}, "a.b": {"description": "it\'s \\"free\\" text"}}'))
    required = F.when(key % 2 == 0, F.concat(F.lit('["a.b", '), quoted(zone), F.lit("]"))).otherwise(F.lit('["a.b", "unknown"]'))
    params = F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "parameters": {"type": "object", "properties": '), properties, F.lit(', "required": '), required, F.lit("}")))
    schema = F.concat(F.lit('{"type": "function", "function": {"name": "tool_'), key, F.lit('", "description": '), quoted(F.col("p_name")), params, F.lit("}}"))
    return TC.prompt_of(t("part").select((key % 50).alias("prompt"), "p_partkey", schema.alias("schema")), "schema", "p_partkey", "prompt")


OPEN_SQL = """WITH e AS (SELECT event_type, CASE event_id % 10 WHEN 9 THEN '[1, 2]' WHEN 8 THEN 'not json' ELSE '{"' || event_type || '_' || (user_id % 3) || '": ' || value || ', "note": "x", ' || substr(props, 2) END AS j FROM events),
k AS (SELECT event_type, unnest(json_keys(j)) AS key, j FROM (SELECT * FROM e WHERE starts_with(j, '{')))
SELECT event_type, key, count(*)::BIGINT AS n, count(TRY_CAST(j->>('$."' || key || '"') AS DOUBLE))::BIGINT AS numbers, min(TRY_CAST(j->>('$."' || key || '"') AS DOUBLE)) AS low,
  max(TRY_CAST(j->>('$."' || key || '"') AS DOUBLE)) AS high, round(sum(TRY_CAST(j->>('$."' || key || '"') AS DOUBLE)), 4) AS total FROM k GROUP BY 1, 2"""


@query(OPEN_SQL)
def open_keys(t):
    """The keys of events' properties, some of them named by the event, with how often they occur and their numbers."""
    kind = F.col("event_id") % 10
    joined = F.concat(F.lit('{"'), "event_type", F.lit("_"), F.col("user_id") % 3, F.lit('": '), F.col("value"), F.lit(', "note": "x", '), F.substring("props", F.lit(2), F.length("props")))
    json = F.when(kind == 9, F.lit("[1, 2]")).when(kind == 8, F.lit("not json")).otherwise(joined)
    return O.profile(t("events").select("event_type", json.alias("j")), "j", "event_type").withColumn("total", F.round("total", 4))


AXES = [["sample", "layer"], ["layer", "head"], ["layer"], ["head"], ["sample"], []]


@query("""WITH a AS (SELECT vec_id // 16 AS sample, vec_id % 4 AS layer, vec_id // 4 % 4 AS head, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
f AS (SELECT sample, layer, head, pos, CASE WHEN w > 0.35 THEN NULL ELSE w END AS w FROM a),
g AS (SELECT sample, layer, head, pos, grouping(sample, layer, head) AS level, sum(w) AS s, count(w) AS n FROM f GROUP BY GROUPING SETS ((sample, layer, pos), (layer, head, pos), (layer, pos), (head, pos), (sample, pos), (pos)))
SELECT level::BIGINT AS level, sample, layer, head, pos::INT AS pos, round(s / n, 6) AS mean, round(sum(s) OVER (PARTITION BY level, sample, layer, head) / sum(n) OVER (PARTITION BY level, sample, layer, head), 6) AS mean_of_all FROM g""")
def attention_means(t):
    """Weights of (sample, layer, head) averaged over six sets of axes at once, by position and over all positions; missing weights are left out."""
    key = F.col("vec_id")
    weights = F.transform("embedding", lambda w: F.when(w.cast("double") <= 0.35, w.cast("double")))
    rows = t("embeddings").select(F.floor(key / 16).alias("sample"), (key % 4).alias("layer"), (F.floor(key / 4) % 4).alias("head"), weights.alias("w"))
    out = V.axis_means(rows, "w", 64, AXES, "sample", "layer", "head")
    return out.select("level", "sample", "layer", "head", F.posexplode("means").alias("pos", "mean"), F.round("mean", 6).alias("mean_of_all")).withColumn("mean", F.round("mean", 6))
