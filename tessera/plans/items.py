"""Queries on media measures, paths, JSON, statistics, grids, packing and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import jsonx as J
from ..functions import mathx as M
from ..functions import text as T
from ..operators import measure as E
from ..operators import packing as P
from ..operators import stats as ST
from ..operators import synth as SY
from ..operators import toolcalls as TC
from .registry import query

#: Line 7 of an order has extreme sides: at most 40 by up to 240,000.
SIDES = "((l_partkey * 7 + l_linenumber * 131) % CASE WHEN l_linenumber = 7 THEN 40 ELSE 3000 END) + 1 AS h, ((l_suppkey * 53 + l_orderkey * 17) % 4000 + 1) * CASE WHEN l_linenumber = 7 THEN 60 ELSE 1 END AS w"
RESIZE = """
SELECT *, CASE WHEN rh * rw > hi THEN greatest(28.0, floor(h / sqrt(h * w / hi) / 28.0) * 28) WHEN rh * rw < lo THEN ceil(h * sqrt(lo / (h * w)) / 28.0) * 28 ELSE rh END::BIGINT AS oh,
  CASE WHEN rh * rw > hi THEN greatest(28.0, floor(w / sqrt(h * w / hi) / 28.0) * 28) WHEN rh * rw < lo THEN ceil(w * sqrt(lo / (h * w)) / 28.0) * 28 ELSE rw END::BIGINT AS ow
FROM (SELECT *, greatest(28.0, round_even(h / 28.0, 0) * 28)::DOUBLE AS rh, greatest(28.0, round_even(w / 28.0, 0) * 28)::DOUBLE AS rw FROM {src})
"""


def _resize_sql(src: str, lo: int, hi: int) -> str:
    return RESIZE.format(src=f"(SELECT * REPLACE (greatest(h, 1)::DOUBLE AS h, greatest(w, 1)::DOUBLE AS w), h > 0 AND w > 0 AS seen, {float(lo)}::DOUBLE AS lo, {float(hi)}::DOUBLE AS hi FROM {src})")


def _sides(t):
    flat = F.col("l_linenumber") == 7
    h, w = F.col("l_partkey") * 7 + F.col("l_linenumber") * 131, F.col("l_suppkey") * 53 + F.col("l_orderkey") * 17
    return t("lineitem").select("l_orderkey", "l_linenumber", (h % F.when(flat, 40).otherwise(3000) + 1).alias("h"), ((w % 4000 + 1) * F.when(flat, 60).otherwise(1)).alias("w"))


@query(f"WITH s AS (SELECT l_orderkey, l_linenumber, {SIDES} FROM lineitem), r AS ({_resize_sql('s', *M.IMAGE_PIXELS)}) SELECT l_orderkey, l_linenumber, oh AS height, ow AS width, (oh // 28) * (ow // 28) AS tokens FROM r")
def media_tokens_resize(t):
    h, w = M.smart_resize(F.col("h"), F.col("w"), M.IMAGE_PIXELS)
    return _sides(t).select("l_orderkey", "l_linenumber", h.alias("height"), w.alias("width"), E.media_tokens(F.col("h"), F.col("w")).alias("tokens"))


PART_SQL = "SELECT p_partkey, p_partkey % 5000 + 1 AS total, CASE p_partkey % 5 WHEN 0 THEN 0.0 ELSE (p_partkey % 5) * 7.5 END::DOUBLE AS fps, CASE p_partkey % 11 WHEN 0 THEN p_partkey % 15 ELSE p_partkey % 900 END + 10 AS h, (p_partkey % 1300 + 10) * CASE p_partkey % 11 WHEN 0 THEN 40 ELSE 1 END AS w FROM part"
PLAN_SQL = f"""WITH v AS ({PART_SQL}),
p AS (SELECT *, CASE WHEN fps > 0 THEN least(least(greatest(round_even(total / fps, 0), 4.0), 420.0)::BIGINT, total) END AS n_frames FROM v)"""


def _videos(t):
    part = F.col("p_partkey")
    return t("part").select("p_partkey", (part % 5000 + 1).alias("total"), F.when(part % 5 == 0, 0.0).otherwise((part % 5) * 7.5).alias("fps"), (F.when(part % 11 == 0, part % 15).otherwise(part % 900) + 10).alias("h"), ((part % 1300 + 10) * F.when(part % 11 == 0, 40).otherwise(1)).alias("w"))


@query(PLAN_SQL + f""", r AS ({_resize_sql('p', *M.VIDEO_PIXELS)})
SELECT p_partkey, n_frames, CASE WHEN n_frames IS NULL THEN -1 ELSE floor((oh // 28) * (ow // 28) * n_frames / 2) END::BIGINT AS tokens FROM r""")
def video_tokens(t):
    df = E.frame_plan(_videos(t), "total", "fps")
    return df.select("p_partkey", "n_frames", F.when(F.col("n_frames").isNull(), E.FAILED).otherwise(M.video_tokens(F.col("h"), F.col("w"), F.col("n_frames"))).cast("long").alias("tokens"))


@query(PLAN_SQL + r""", x AS (SELECT p_partkey, total, n_frames, unnest(range(n_frames)) AS i FROM p WHERE n_frames IS NOT NULL)
SELECT p_partkey, i, CASE WHEN n_frames = 1 THEN 0 WHEN i = n_frames - 1 THEN total - 1 ELSE floor(i * ((total - 1)::DOUBLE / (n_frames - 1))) END::BIGINT AS frame FROM x""")
def frame_plan(t):
    """The frames of every part."""
    return E.frame_rows(_videos(t), "total", "fps", "p_partkey")


COUNT_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"


@query(f"SELECT doc_id, {COUNT_SQL}::BIGINT AS n FROM documents")
def token_count_words(t):
    return t("documents").select("doc_id", T.token_count(F.col("text")).alias("n"))


@query(f"""WITH m AS (SELECT doc_id, text, doc_id % 40 * 13 AS h, doc_id % 60 * 11 AS w FROM documents), r AS ({_resize_sql('m', *M.IMAGE_PIXELS)})
SELECT doc_id, CASE WHEN seen THEN 1 ELSE 0 END::BIGINT AS num_media, CASE WHEN seen THEN (oh // 28) * (ow // 28) ELSE -1 END::BIGINT AS num_media_tokens,
  ({COUNT_SQL} - CASE WHEN seen THEN 1 ELSE 0 END + CASE WHEN seen THEN (oh // 28) * (ow // 28) ELSE -1 END)::BIGINT AS num_tokens FROM r""")
def num_tokens_total(t):
    return _measured(t).select("doc_id", "num_media", "num_media_tokens", "num_tokens")


def _measured(t):
    df = t("documents").select("doc_id", "text", "lang", (F.col("doc_id") % 40 * 13).alias("h"), (F.col("doc_id") % 60 * 11).alias("w"))
    ok = (F.col("h") > 0) & (F.col("w") > 0)
    df = df.withColumn("num_media", F.when(ok, 1).otherwise(0).cast("long")).withColumn("num_media_tokens", E.media_tokens(F.col("h"), F.col("w")))
    return df.withColumn("num_tokens", E.total_tokens(F.col("text"), F.col("num_media"), F.col("num_media_tokens")))


@query(f"""WITH m AS (SELECT lang, doc_id % 40 * 13 AS h, doc_id % 60 * 11 AS w FROM documents), r AS ({_resize_sql('m', *M.IMAGE_PIXELS)})
SELECT lang, count(*)::BIGINT AS n, round(avg(CASE WHEN seen THEN (oh // 28) * (ow // 28) ELSE -1 END), 9) AS mean_tokens FROM r GROUP BY ROLLUP (lang)""")
def avg_media_tokens_by_split(t):
    return _measured(t).rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("num_media_tokens"), 9).alias("mean_tokens"))


@query(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS name, 'media/' || url AS under,
  regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem, CASE WHEN contains(url, '/') THEN list_extract(string_split(url, '/'), -2) END AS folder FROM pages""")
def basename_source(t):
    url = F.col("url")
    return t("pages").select("page_id", T.basename(url).alias("name"), T.with_dir(F.lit("media"), url).alias("under"), T.stem(url).alias("stem"), T.parent_name(url).alias("folder"))


@query(r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/abs/' || page_id || '.jpg' ELSE page_id || '.jpg' END AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/') THEN path ELSE 'media/' || path END AS path FROM p""")
def media_prefix(t):
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/abs/"), "page_id", F.lit(".jpg"))).otherwise(F.concat("page_id", F.lit(".jpg")))
    return t("pages").select("page_id", T.with_dir(F.lit("media"), path).alias("path"))


@query(r"""SELECT page_id, CASE WHEN starts_with(u, 'data:image') THEN decode(from_base64(split_part(u, ',', 2))) END AS body FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'data:image/png;base64,' || to_base64(encode(url)) ELSE url END AS u FROM pages)""")
def data_uri(t):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("url", "utf-8")))).otherwise(F.col("url"))
    return t("pages").select("page_id", F.decode(T.data_uri_bytes(u), "utf-8").alias("body"))


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def drop_non_json(t):
    events = t("events")
    return events.select(*[c for c in J.json_columns(events)])


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, event_type AS kind, value FROM events")
def json_roundtrip(t):
    made = t("events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), "value")).alias("j"))
    return made.select("event_id", F.from_json("j", "kind string, value double").alias("x")).select("event_id", "x.kind", "x.value")


NAMES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
NAMES_SQL = "['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine']"


@query(f"SELECT vec_id, {NAMES_SQL}[label + 1] AS name FROM embeddings")
def label_lookup(t):
    dim = t("embeddings").sparkSession.createDataFrame(list(enumerate(NAMES)), "label int, name string")
    return t("embeddings").select("vec_id", "label").join(F.broadcast(dim), "label").select("vec_id", "name")


@query(f"SELECT vec_id, CASE WHEN label + 3 <= 9 THEN {NAMES_SQL}[label + 4] END AS name FROM embeddings")
def label_array_lookup(t):
    return t("embeddings").select("vec_id", SY.label_text(F.col("label") + 3, NAMES).alias("name"))


@query(f"SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'Q' ELSE substr({NAMES_SQL}[label + 1], 1, 1) END AS answer FROM embeddings")
def answer_remap(t):
    raw = F.when(F.col("label") % 3 == 0, F.lit("Q?")).otherwise(F.col("label").cast("string"))
    return t("embeddings").select("vec_id", SY.remap_answer(raw, F.array(*map(F.lit, NAMES))).alias("answer"))


@query(r"""SELECT vec_id, v, h, 'What is in the ' || v || ' ' || h || ' corner?' AS question FROM embeddings, (VALUES ('top', 'left'), ('top', 'right'), ('bottom', 'left'), ('bottom', 'right')) c(v, h)""")
def corner_questions(t):
    return SY.corner_questions(t("embeddings"), "vec_id")


@query(r"""
WITH u AS (SELECT label, count(*) AS u FROM embeddings GROUP BY 1),
s AS (SELECT row_number() OVER (ORDER BY u DESC) AS j, sum(u) OVER () - sum(u) OVER (ORDER BY u DESC ROWS UNBOUNDED PRECEDING) + u AS rest FROM u),
g AS (SELECT CASE WHEN count(*) < 4 THEN 0 ELSE min(rest // (5 - j)) END::BIGINT AS n FROM s WHERE j <= 4),
o AS (SELECT label, least(u, n) AS u, sum(least(u, n)) OVER (ORDER BY label) - least(u, n) AS off FROM u, g),
d AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('grid|' || vec_id::VARCHAR), vec_id) - 1 AS k FROM embeddings),
p AS (SELECT (off + k) % n AS grid, vec_id, d.label FROM d JOIN o ON d.label = o.label, g WHERE k < u AND off + k < 4 * n),
i AS (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY md5('gridp|' || vec_id::VARCHAR), vec_id) - 1 AS i FROM p)
SELECT grid::BIGINT AS grid, (i // 2)::INT AS "row", (i % 2)::INT AS col, vec_id, label FROM i""")
def grid_compose(t):
    return SY.compose(t("embeddings"), "vec_id", "label")


@query("SELECT pos::INT AS pos, round(avg(w), 6) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos")
def axis_mean(t):
    return ST.unpivot_positions(t("embeddings"), "embedding").groupBy("pos").agg(F.round(F.avg(F.col("w").cast("double")), 6).alias("mean"))


QUAD_SQL = "WITH q AS (SELECT label, 2 * ((pos // 8) >= 4)::INT + ((pos % 8) >= 4)::INT AS quadrant, w FROM (SELECT label, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"


def _quadrants(t):
    return ST.unpivot_positions(t("embeddings"), "embedding", "label").select("label", ST.quadrant(F.col("pos")).alias("quadrant"), F.col("w").cast("double").alias("w"))


@query(QUAD_SQL + " SELECT label, quadrant, round(avg(w), 6) AS mean FROM q GROUP BY 1, 2")
def quadrant_mean(t):
    return _quadrants(t).groupBy("label", "quadrant").agg(F.round(F.avg("w"), 6).alias("mean"))


@query(QUAD_SQL + " SELECT label, quadrant, round(s / sum(s) OVER (PARTITION BY label), 6) AS share FROM (SELECT label, quadrant, sum(abs(w)) AS s FROM q GROUP BY 1, 2)")
def quadrant_share(t):
    sums = _quadrants(t).groupBy("label", "quadrant").agg(F.sum(F.abs("w")).alias("s"))
    return sums.select("label", "quadrant", F.round(ST.share(F.col("s"), "label"), 6).alias("share"))


@query("SELECT label, round(avg(w) FILTER (w <= 0.1), 6) AS mean, count(*)::BIGINT AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS w FROM embeddings) GROUP BY label")
def nan_mean(t):
    rows = ST.unpivot_positions(t("embeddings"), "embedding", "label").withColumn("x", F.when(F.col("w").cast("double") > 0.1, F.lit(float("nan"))).otherwise(F.col("w").cast("double")))
    return rows.groupBy("label").agg(F.round(ST.nan_mean(F.col("x")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS low, round(quantile_cont(l_extendedprice, 0.75), 6) AS high FROM lineitem GROUP BY 1")
def quantile_band(t):
    out = ST.quantiles(t("lineitem"), "l_extendedprice", {"low": 0.25, "high": 0.75}, "l_returnflag")
    return out.select("l_returnflag", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT l_linestatus, count(*)::BIGINT AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson(t):
    return ST.pearson(t("lineitem"), "l_quantity", "l_extendedprice", "l_linestatus").withColumn("r", F.round("r", 6))


@query(r"""WITH r AS (SELECT l_linestatus, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT l_linestatus, count(*)::BIGINT AS n, round(corr(a::DOUBLE, b::DOUBLE), 6) AS r FROM r GROUP BY 1""")
def spearman(t):
    return ST.spearman(t("lineitem").select("l_linestatus", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", "l_linestatus").withColumn("r", F.round("r", 6))


@query()
def spearman_pvalue_mask(t):
    """Rank correlations of many groups with their p-values; those above the level are left out."""
    rows = t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax")
    return ST.significant(ST.spearman(rows, "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"))


@query()
def pearson_pvalue_mask(t):
    return ST.significant(ST.pearson(t("lineitem"), "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


def _docs_to_pack(t):
    return t("documents").select("doc_id", F.col("n_chars").alias("size"))


@query()
def pack_ffd(t):
    return P.pack(_docs_to_pack(t), "doc_id", "size", 8000, isolate=True, ranges=8)


@query()
def pack_stats(t):
    return P.pack_stats(P.pack(_docs_to_pack(t), "doc_id", "size", 8000, isolate=True, ranges=8), "size")


@query()
def pack_gather(t):
    packed = P.pack(_docs_to_pack(t), "doc_id", "size", 8000, isolate=True, ranges=8)
    out = P.gather(packed, t("documents").select("doc_id", "source"), "doc_id", "source")
    return out.select("bin_id", F.array_join("values", ",").alias("sources"))


CALLS_SQL = """WITH c AS (SELECT conv_id, turn, text, CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN 'x <tool_call>{"name":"find","arguments":{"q":"' || conv_id || '"}}</tool_call> y' WHEN 2 THEN '<tool_call>{bad</tool_call>' ELSE '<tool_call>{"name":"list"}' || CASE WHEN turn % 2 = 0 THEN '' ELSE ' and more' END || '</tool_call><tool_result id=''c1''>ok</tool_result>' END AS s FROM conversations)"""


def _calls(t):
    m = F.col("conv_id") % 4
    s = F.when(m == 0, F.col("text")).when(m == 1, F.concat(F.lit('x <tool_call>{"name":"find","arguments":{"q":"'), "conv_id", F.lit('"}}</tool_call> y'))).when(m == 2, F.lit("<tool_call>{bad</tool_call>")).otherwise(F.concat(F.lit('<tool_call>{"name":"list"}'), F.when(F.col("turn") % 2 == 0, "").otherwise(" and more"), F.lit("</tool_call><tool_result id='c1'>ok</tool_result>")))
    return t("conversations").select("conv_id", "turn", "text", s.alias("s"))


@query(CALLS_SQL + """ SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 THEN 'find' WHEN conv_id % 4 = 3 AND turn % 2 = 0 THEN 'list' END AS name, CASE WHEN conv_id % 4 = 1 THEN '{"q":"' || conv_id || '"}' WHEN conv_id % 4 = 3 AND turn % 2 = 0 THEN '{}' END AS arguments FROM c""")
def tool_parse(t):
    """Calls, malformed ones, and calls with text behind their JSON, which are none."""
    return _calls(t).select("conv_id", "turn", TC.parse(F.col("s")).alias("c")).select("conv_id", "turn", "c.name", "c.arguments")


@query(CALLS_SQL + """, r AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 THEN '{"name":"find","arguments":{"q":"' || conv_id || '"}}' WHEN conv_id % 4 = 3 AND turn % 2 = 0 THEN '{"name":"list"}' END AS raw FROM c)
SELECT conv_id, turn, 'call_' || (('0x' || substr(md5(raw), 1, 8))::BIGINT % 10000) AS id FROM r WHERE raw IS NOT NULL""")
def tool_call_ids(t):
    return _calls(t).select("conv_id", "turn", TC.parse(F.col("s"))["id"].alias("id")).where("id is not null")


@query(CALLS_SQL + r""" SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(s, '(?s)<tool_call>.*?</tool_call>', '', 'g'), '(?s)<tool_result.*?>.*?</tool_result>', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM c""")
def tool_strip(t):
    return _calls(t).select("conv_id", "turn", TC.strip_calls(F.col("s")).alias("text"))


@query("""SELECT conv_id, turn, '<tool_call>{"name": "find", "arguments": {"q": ' || turn || '}}</tool_call>' AS call, '<tool_result>' || role || '</tool_result>' AS result FROM conversations""")
def tool_format(t):
    return t("conversations").select("conv_id", "turn", TC.format_call(F.lit("find"), F.concat(F.lit('{"q": '), "turn", F.lit("}"))).alias("call"), TC.format_result(F.col("role")).alias("result"))


@query(r"""SELECT n_name, n_name || ': tool of region ' || n_regionkey || chr(10) || '  - key (required): key ' || n_nationkey || chr(10) || '  - note: free text' AS text FROM nation""")
def tool_catalogue(t):
    params = F.array(F.struct(F.lit("key").alias("name"), F.concat(F.lit("key "), "n_nationkey").alias("description"), F.lit(True).alias("required")), F.struct(F.lit("note").alias("name"), F.lit("free text").alias("description"), F.lit(False).alias("required")))
    return TC.catalogue(t("nation").withColumn("d", F.concat(F.lit("tool of region "), "n_regionkey")).withColumn("p", params), "n_name", "d", "p")


@query(r"""SELECT o_orderkey, CASE WHEN n_name IS NULL THEN 'Error: Tool ' || chr(39) || 't' || (o_custkey % 30) || chr(39) || ' not found' ELSE n_name END AS result FROM orders LEFT JOIN nation ON o_custkey % 30 = n_nationkey""")
def tool_dispatch(t):
    tools = t("nation").select(F.concat(F.lit("t"), "n_nationkey").alias("name"), F.col("n_name").alias("result"))
    calls = t("orders").select("o_orderkey", F.concat(F.lit("t"), F.col("o_custkey") % 30).alias("name"))
    return TC.dispatch(calls, tools).select("o_orderkey", "result")


@query(r"""WITH r AS (SELECT conv_id, turn, role, '{"name": "find", "arguments": {"q": ' || turn || '}}' AS raw FROM conversations)
SELECT conv_id, 'start' || string_agg('<tool_call>' || raw || '</tool_call><tool_result id=' || chr(39) || 'call_' || (('0x' || substr(md5(raw), 1, 8))::BIGINT % 10000) || chr(39) || '>' || role || '</tool_result>', '' ORDER BY turn) AS text FROM r GROUP BY conv_id""")
def tool_context(t):
    """A text with the calls made and their results behind it, each with the id of its call."""
    arguments = F.concat(F.lit('{"q": '), "turn", F.lit("}"))
    step = F.struct("turn", F.lit("find").alias("name"), arguments.alias("arguments"), J.call_id(TC.call_text(F.lit("find"), arguments)).alias("id"), F.col("role").alias("result"))
    steps = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return steps.select("conv_id", TC.context(F.lit("start"), F.col("steps")).alias("text"))


@query(r"""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '<tool_call>{}</tool_call>' ELSE text END AS text FROM conversations),
r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS "round" FROM c WHERE regexp_matches(text, '(?s)<tool_call>.*?</tool_call>')) SELECT * FROM r WHERE "round" <= 2""")
def tool_rounds(t):
    rows = t("conversations").withColumn("text", F.when(F.col("role") == "assistant", F.lit("<tool_call>{}</tool_call>")).otherwise(F.col("text")))
    return TC.bounded_rounds(rows, "conv_id", "turn", 2).select("conv_id", "turn", "round")


@query("SELECT p_size % 7 AS g, sum((p_size % 5 + 1) * (p_size % 6 * 2) * 14 // 4)::BIGINT AS tokens FROM part GROUP BY 1")
def vision_token_sum(t):
    grid = F.array((F.col("p_size") % 5 + 1).cast("long"), (F.col("p_size") % 6 * 2).cast("long"), F.lit(14).cast("long"))
    return t("part").select((F.col("p_size") % 7).alias("g"), F.floor(A.product(grid) / 4).alias("x")).groupBy("g").agg(F.sum("x").cast("long").alias("tokens"))


@query("SELECT p_partkey, round_even(p_size / 4.0, 0)::DOUBLE AS half_even, ceil(p_size / 28.0) * 28 AS up, floor(p_size / 28.0) * 28 AS down FROM part")
def rounding(t):
    return t("part").select("p_partkey", F.rint(F.col("p_size") / 4).alias("half_even"), M.ceil_to(F.col("p_size")).cast("double").alias("up"), M.floor_to(F.col("p_size")).cast("double").alias("down"))


@query("""SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*)::BIGINT AS n FROM nation GROUP BY 1""")
def group_values(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


@query(r"""SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%' GROUP BY 1""")
def star_join(t):
    """Host-engine check: dimensions are joined and filtered first; adaptive execution broadcasts those that it finds small."""
    nation = t("nation").join(t("region").where("r_name like 'A%'"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = t("customer").select("c_custkey", "c_nationkey").join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t("orders").select("o_custkey", "o_totalprice").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query(r"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_events(t):
    out = t("events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("hour"), "event_type", "n", "total")
