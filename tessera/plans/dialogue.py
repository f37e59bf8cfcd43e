"""Queries on conversations, their prompts and their features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversations as C
from ..operators import tokens as K
from .registry import query

ORDERED = "ORDER BY turn"


@query(f"SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' {ORDERED}) AS text FROM conversations GROUP BY 1")
def render_chat(t):
    return C.render(t("conversations"))


@query(f"SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' {ORDERED}) || '<|im_start|>assistant' || chr(10) AS text FROM conversations GROUP BY 1")
def render_chat_generation(t):
    return C.render(t("conversations"), generation_prompt=True)


@query(f"SELECT conv_id, string_agg(text || chr(10), '' {ORDERED}) AS text FROM conversations GROUP BY 1")
def render_plain(t):
    return C.render(t("conversations"), template=False)


@query(r"SELECT conv_id, regexp_replace(list_extract(string_split(s, 'assistant'), -1), '^\s+|\s+$', '', 'g') AS answer FROM (SELECT conv_id, string_agg(role || chr(10) || text, chr(10) ORDER BY turn) AS s FROM conversations GROUP BY 1)")
def last_answer(t):
    joined = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit("\n"), "text").alias("x")))).alias("a"))
    return joined.select("conv_id", T.last_turn(F.array_join(F.transform("a", lambda x: x["x"]), "\n")).alias("answer"))


def _messages(t):
    """Conversations as arrays of messages; each third user turn has an image, each fifth a video."""
    media = F.when((F.col("role") != "assistant") & (F.col("turn") % 3 == 0), F.array(C.part("image", F.concat(F.lit("i"), "conv_id", F.lit("-"), "turn")))).when((F.col("role") == "user") & (F.col("turn") % 5 == 1), F.array(C.part("video", F.concat(F.lit("v"), "conv_id", F.lit("-"), "turn")))).otherwise(F.slice(F.array(C.part("image", F.lit(""))), 1, 0))
    rows = t("conversations").select("conv_id", "turn", F.struct("role", F.concat(media, F.array(C.part("text", F.col("text")))).alias("content")).alias("m"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]).alias("messages"))


@query(r"""SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS texts,
  coalesce(string_agg('i' || conv_id || '-' || turn, ',' ORDER BY turn) FILTER (role <> 'assistant' AND turn % 3 = 0), '') AS images,
  coalesce(string_agg('v' || conv_id || '-' || turn, ',' ORDER BY turn) FILTER (role = 'user' AND turn % 5 = 1 AND turn % 3 <> 0), '') AS videos FROM conversations GROUP BY 1""")
def flatten_content(t):
    m = F.col("messages")
    return _messages(t).select("conv_id", F.array_join(C.contents(m, "text"), "|").alias("texts"), F.array_join(C.contents(m, "image"), ",").alias("images"), F.array_join(C.contents(m, "video"), ",").alias("videos"))


@query(r"""SELECT conv_id, (count(*) FILTER ((role = 'user' AND turn % 3 = 0) OR (role = 'user' AND turn % 5 = 1 AND turn % 3 <> 0)))::BIGINT AS n FROM conversations GROUP BY 1""")
def media_without_system(t):
    return _messages(t).select("conv_id", F.size(C.media_of(F.col("messages"))).cast("long").alias("n"))


MEDIA_SQL = "WITH m AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' END AS kind, turn % 5 + 2 AS tokens FROM conversations)"


def _with_media(t):
    """Messages of which two of three hold a picture or a video, of some tokens."""
    kind = F.when(F.col("turn") % 3 == 0, "image").when(F.col("turn") % 3 == 1, "video")
    return t("conversations").withColumn("kind", kind).withColumn("tokens", F.col("turn") % 5 + 2)


@query(MEDIA_SQL + r""" SELECT conv_id, turn, kind, (row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn))::INT AS media_index FROM m WHERE kind IS NOT NULL""")
def media_index(t):
    """Pictures and videos of a conversation are numbered apart."""
    rows = _with_media(t).where("kind is not null").select("conv_id", "turn", "kind")
    return C.media_index(rows, "conv_id", "kind", "turn")


@query(MEDIA_SQL + r""", i AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) AS k FROM m)
SELECT conv_id, turn, CASE kind WHEN 'image' THEN 'Picture ' || k || ': <|vision_start|><|image_pad|><|vision_end|>' WHEN 'video' THEN 'Video ' || k || ': <|vision_start|><|video_pad|><|vision_end|>' ELSE '' END || text AS text FROM i""")
def media_text(t):
    rows = C.media_index(_with_media(t), "conv_id", "kind", "turn")
    return rows.select("conv_id", "turn", F.concat(C.media_mark(F.col("kind"), F.col("media_index")), F.col("text")).alias("text"))


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS target FROM conversations GROUP BY 1")
def training_target_text(t):
    said = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("a"))
    return said.select("conv_id", F.array_join(F.transform("a", lambda x: x["text"]), "\n").alias("target"))


PIECES = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'"
FEATURES_SQL = rf"""
WITH p AS (SELECT conv_id, turn, role, regexp_extract_all('<|im_start|>' || role || chr(10), {PIECES}) AS head, regexp_extract_all(text, {PIECES}) AS said, regexp_extract_all('<|im_end|>' || chr(10), {PIECES}) AS tail FROM conversations),
i AS (SELECT *, list_transform(list_concat(head, said, tail), lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 49990 + 10)::INT) AS ids FROM p),
l AS (SELECT conv_id, turn, ids, CASE WHEN role = 'assistant' THEN list_concat(list_transform(head, lambda x: -100), ids[len(head) + 1:len(head) + len(said)], list_transform(tail, lambda x: -100)) ELSE list_transform(ids, lambda x: -100) END AS labels FROM i),
f AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS input_ids, flatten(list(labels ORDER BY turn)) AS labels FROM l GROUP BY 1)
"""


@query(FEATURES_SQL + "SELECT conv_id, len(input_ids)::BIGINT AS total, len(list_filter(labels, lambda x: x = -100))::BIGINT AS masked, len(list_filter(labels, lambda x: x <> -100))::BIGINT AS kept, list_sum(input_ids)::BIGINT AS id_sum, coalesce(list_sum(list_filter(labels, lambda x: x <> -100)), 0)::BIGINT AS label_sum FROM f")
def label_mask_counts(t):
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    labels = F.col("labels")
    return K.features(t("conversations")).select("conv_id", F.size("input_ids").cast("long").alias("total"), F.size(F.filter(labels, lambda x: x == -100)).cast("long").alias("masked"), F.size(F.filter(labels, lambda x: x != -100)).cast("long").alias("kept"), add(F.col("input_ids")).alias("id_sum"), add(F.filter(labels, lambda x: x != -100)).alias("label_sum"))


@query(rf"""
WITH p AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS pad, turn % 5 + 2 AS n, regexp_extract_all('<|im_start|>' || role || chr(10), {PIECES}) AS head, regexp_extract_all(text, {PIECES}) AS said, regexp_extract_all('<|im_end|>' || chr(10), {PIECES}) AS tail FROM conversations),
i AS (SELECT *, list_transform(head, lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 49990 + 10)::INT) AS h, list_transform(said, lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 49990 + 10)::INT) AS s, list_transform(tail, lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 49990 + 10)::INT) AS e,
  CASE WHEN pad IS NULL THEN []::INT[] ELSE list_concat([3], list_transform(range(n), lambda x: pad), [4]) END::INT[] AS v FROM p),
l AS (SELECT conv_id, turn, list_concat(h, v, s, e) AS ids, list_concat(list_transform(list_concat(h, v), lambda x: -100), CASE WHEN role = 'assistant' THEN s ELSE list_transform(s, lambda x: -100) END, list_transform(e, lambda x: -100)) AS labels FROM i),
f AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS input_ids, flatten(list(labels ORDER BY turn)) AS labels FROM l GROUP BY 1)
SELECT conv_id, len(input_ids)::BIGINT AS total, md5(array_to_string(input_ids, ',')) AS ids, md5(array_to_string(labels, ',')) AS labels FROM f""")
def media_features(t):
    """Token ids with start, pads of the medium's kind and end in front of a message's text; all of them masked."""
    none = F.expr("cast(array() as array<struct<kind:string,tokens:int>>)")
    media = F.when(F.col("kind").isNotNull(), F.array(F.struct("kind", F.col("tokens").cast("int").alias("tokens")))).otherwise(none)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").cast("binary"))
    return K.features(_with_media(t), media=media).select("conv_id", F.size("input_ids").cast("long").alias("total"), text("input_ids").alias("ids"), text("labels").alias("labels"))


@query(rf"""
WITH c AS (SELECT k // 4 = 1 AS template, k // 2 % 2 = 1 AS ask, k % 2 = 1 AS text_only FROM range(8) r(k)),
p AS (SELECT c.*, conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS pad, CASE WHEN text_only THEN 1 ELSE turn % 5 + 2 END AS n, CASE WHEN template THEN regexp_extract_all('<|im_start|>' || role || chr(10), {PIECES}) ELSE [] END AS head, regexp_extract_all(text, {PIECES}) AS said, CASE WHEN template THEN regexp_extract_all('<|im_end|>' || chr(10), {PIECES}) ELSE [] END AS tail FROM conversations, c),
i AS (SELECT *, list_transform(head, lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 49990 + 10)::INT) AS h, list_transform(said, lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 49990 + 10)::INT) AS s, list_transform(tail, lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 49990 + 10)::INT) AS e,
  CASE WHEN pad IS NULL THEN []::INT[] ELSE list_concat([3], list_transform(range(n), lambda x: pad), [4]) END::INT[] AS v FROM p),
l AS (SELECT template, ask, text_only, conv_id, turn, list_concat(h, v, s, e) AS ids, list_concat(list_transform(list_concat(h, v), lambda x: -100), CASE WHEN role = 'assistant' THEN s ELSE list_transform(s, lambda x: -100) END, list_transform(e, lambda x: -100)) AS labels FROM i),
q AS (SELECT list_transform(regexp_extract_all('<|im_start|>assistant' || chr(10), {PIECES}), lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 49990 + 10)::INT) AS q),
f AS (SELECT template, ask, text_only, conv_id, flatten(list(ids ORDER BY turn)) AS input_ids, flatten(list(labels ORDER BY turn)) AS labels FROM l GROUP BY ALL),
g AS (SELECT f.* REPLACE (CASE WHEN template AND ask THEN list_concat(input_ids, q) ELSE input_ids END AS input_ids, CASE WHEN template AND ask THEN list_concat(labels, q) ELSE labels END AS labels) FROM f, q)
SELECT template, ask, text_only, conv_id, len(input_ids)::BIGINT AS total, md5(array_to_string(input_ids, ',')) AS ids, md5(array_to_string(labels, ',')) AS labels FROM g""")
def feature_sweep(t):
    """Token ids and labels of conversations with media under each of the eight settings of chat template, generation prompt and short media."""
    none = F.expr("cast(array() as array<struct<kind:string,tokens:int>>)")
    media = F.when(F.col("kind").isNotNull(), F.array(F.struct("kind", F.col("tokens").cast("int").alias("tokens")))).otherwise(none)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").cast("binary"))
    rows, out = _with_media(t), None
    for k in range(8):
        template, ask, text_only = k // 4 == 1, k // 2 % 2 == 1, k % 2 == 1
        part = K.features(rows, template=template, generation_prompt=ask, media=media, text_only=text_only)
        part = part.select(F.lit(template).alias("template"), F.lit(ask).alias("ask"), F.lit(text_only).alias("text_only"), "conv_id", F.size("input_ids").cast("long").alias("total"), text("input_ids").alias("ids"), text("labels").alias("labels"))
        out = part if out is None else out.unionByName(part)
    return out


def _batched(t, side, target=None):
    df = K.features(t("conversations")).withColumn("batch_id", F.floor(F.col("conv_id") / 4))
    out = K.batch(df, "batch_id", side, target=target)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").cast("binary"))
    return out.select("conv_id", F.size("input_ids").cast("long").alias("width"), text(F.col("input_ids")).alias("ids"), text(F.col("labels")).alias("labels"), text(F.col("attention_mask")).alias("mask"))


def _batch_sql(ids: str, labels: str, mask: str, target: str = "max(len(input_ids)) OVER (PARTITION BY conv_id // 4)") -> str:
    return FEATURES_SQL + f""", b AS (SELECT *, {target} AS t, len(input_ids) AS n FROM f),
    o AS (SELECT conv_id, {ids} AS input_ids, {labels} AS labels, {mask} AS mask FROM b)
    SELECT conv_id, len(input_ids)::BIGINT AS width, md5(array_to_string(input_ids, ',')) AS ids, md5(array_to_string(labels, ',')) AS labels, md5(array_to_string(mask, ',')) AS mask FROM o"""


def _fill(value: str) -> str:
    return f"list_transform(range(t - n), lambda x: {value})"


@query(_batch_sql(f"list_concat(input_ids, {_fill('0')})", f"list_concat(labels, {_fill('-100')})", f"list_concat(list_transform(range(n), lambda x: 1), {_fill('0')})"))
def pad_right(t):
    return _batched(t, "right")


@query(_batch_sql(f"list_concat({_fill('0')}, input_ids)", f"list_concat({_fill('-100')}, labels)", f"list_concat({_fill('0')}, list_transform(range(n), lambda x: 1))"))
def pad_left(t):
    return _batched(t, "left")


@query(_batch_sql("CASE WHEN n >= t THEN input_ids[n - t + 1:n] ELSE list_concat(list_transform(range(t - n), lambda x: 0), input_ids) END", "CASE WHEN n >= t THEN labels[n - t + 1:n] ELSE list_concat(list_transform(range(t - n), lambda x: -100), labels) END", "CASE WHEN n >= t THEN list_transform(range(t), lambda x: 1) ELSE list_concat(list_transform(range(t - n), lambda x: 0), list_transform(range(n), lambda x: 1)) END", "120"))
def truncate_left(t):
    return _batched(t, "left", F.lit(120))


def _flat(df):
    """(conv_id, roles, texts): an array of messages as two texts."""
    m = F.col("messages")
    return df.select("conv_id", F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), F.md5(F.array_join(C.contents(m, "text"), "|").cast("binary")).alias("texts"))


def _plain(t):
    rows = t("conversations").select("conv_id", "turn", F.struct("role", F.array(C.part("text", F.col("text"))).alias("content")).alias("m"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]).alias("messages"))


VARIANTS = ["Be brief.", "Be kind.", "Be exact."]
PICK_SQL = "['Be brief.', 'Be kind.', 'Be exact.'][(('0x' || substr(md5('p|' || conv_id::VARCHAR), 1, 8))::BIGINT % 3 + 1)::INT]"
LISTS_SQL = "WITH m AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS x FROM conversations GROUP BY 1)"


@query(LISTS_SQL + f""", f AS (SELECT *, row_number() OVER (PARTITION BY conv_id // 3 ORDER BY conv_id) = 1 AS first FROM m)
SELECT conv_id, array_to_string(CASE WHEN first THEN list_concat(['system'], r) ELSE r END, ',') AS roles, md5(array_to_string(CASE WHEN first THEN list_concat([{PICK_SQL}], x) ELSE x END, '|')) AS texts FROM f""")
def prompt_first_in_pack(t):
    df = _plain(t).withColumn("pack", F.floor(F.col("conv_id") / 3))
    return _flat(C.prompt_first_in_pack(df, "messages", "pack", "conv_id", C.variant(VARIANTS, "p", F.col("conv_id"))))


@query(LISTS_SQL + """ SELECT conv_id, array_to_string(list_concat(r[1:2], ['user'], r[3:]), ',') AS roles, md5(array_to_string(list_concat(x[1:2], ['Think.'], x[3:]), '|')) AS texts FROM m""")
def prompt_all(t):
    return _flat(_plain(t).withColumn("messages", C.prompt_all(F.col("messages"), "user", F.lit("Think."), 2)))


@query(LISTS_SQL + """, p AS (SELECT *, list_position(r, 'user') AS place FROM m)
SELECT conv_id, array_to_string(r, ',') AS roles, md5(array_to_string(CASE WHEN place IS NULL OR place = 0 THEN x ELSE list_concat(x[1:place], ['Look.'], x[place + 1:]) END, '|')) AS texts FROM p""")
def prompt_role_first(t):
    return _flat(_plain(t).withColumn("messages", C.prompt_role_first(F.col("messages"), "user", F.lit("Look."), 1)))


@query(LISTS_SQL + """ SELECT conv_id, array_to_string(list_concat(['system', 'system', 'user', 'user'], r), ',') AS roles, md5(array_to_string(list_concat(['s1', 's2', 'c1', 'c2'], x), '|')) AS texts FROM m""")
def prompt_order(t):
    return _flat(_plain(t).withColumn("messages", C.prompt_order(F.col("messages"), [F.lit("s1"), F.lit("s2")], [F.lit("c1"), F.lit("c2")])))


@query(r"SELECT DISTINCT role, array_to_string(list_reverse(string_split(role || ',b,c', ',')), ',') AS names FROM conversations")
def prompt_names(t):
    return t("conversations").select("role").distinct().select("role", F.array_join(T.prompt_names(F.concat("role", F.lit(",b,c"))), ",").alias("names"))


@query(r"""SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def qa_pairs(t):
    return C.qa_pairs(t("conversations"))


@query(r"""SELECT doc_id, 'user,user,assistant,user,assistant' AS roles, 'media/' || doc_id || '.png' AS images, 'quality: |' || quality || '|toxic: |' || toxic AS texts FROM labels""")
def unpivot_labels(t):
    """Labelled images: the image, then a question for each label."""
    labels = t("labels").withColumn("image", F.concat(F.lit("media/"), "doc_id", F.lit(".png")))
    m = labels.select("doc_id", C.columns_maker(labels, exclude=["doc_id"]).alias("messages"))
    return m.select("doc_id", F.array_join(C.contents(F.col("messages"), "image"), "|").alias("images"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"), F.array_join(C.contents(F.col("messages"), "text"), "|").alias("texts"))


@query(r"""SELECT doc_id, 'user,user,assistant,user,assistant' AS roles, 'View? q1|AP|Answer: q2|' || quality AS texts FROM labels""")
def radiology_conversation(t):
    answers = F.array(F.lit("AP"), F.col("quality").cast("string"))
    m = t("labels").select("doc_id", C.radiology_maker(F.lit("i.png"), F.array(F.lit("q1"), F.lit("q2")), answers, "View? {question}", "Answer: {question}").alias("m"))
    return m.select("doc_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.array_join(C.contents(F.col("m"), "text"), "|").alias("texts"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'View? q' || doc_id ELSE 'Answer: q' || doc_id END AS question FROM labels""")
def conditional_question(t):
    answer = F.when(F.col("doc_id") % 3 == 0, F.lit("AP")).otherwise(F.lit("Edema"))
    return t("labels").select("doc_id", C.view_question(F.concat(F.lit("q"), "doc_id"), answer, "View? {question}", "Answer: {question}").alias("question"))


@query(r"""SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'Option A: ' || p_brand || chr(10) || 'Option B: ' || p_type || chr(10) AS text FROM part""")
def multiple_choice_prompt(t):
    option = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).alias("text"))
    m = t("part").select("p_partkey", C.choice_maker(F.col("p_name"), F.array(option("A", "p_brand"), option("B", "p_type"))).alias("m"))
    return m.select("p_partkey", C.contents(F.col("m"), "text")[0].alias("text"))


@query(r"""SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'Option ' || p_brand || ': ' || p_size || chr(10) || 'Option z: ' || p_type || chr(10) || 'Option ' || (p_partkey % 5) || ': last' || chr(10) AS text FROM part""")
def choice_open_keys(t):
    """Multiple choice from JSON objects whose keys differ from item to item."""
    options = F.concat(F.lit('{"'), "p_brand", F.lit('": '), "p_size", F.lit(', "z": "'), "p_type", F.lit('", "'), F.col("p_partkey") % 5, F.lit('": "last"}'))
    return t("part").select("p_partkey", C.choice_text(F.col("p_name"), C.open_options(options)).alias("text"))


@query(r"""WITH a AS (SELECT conv_id, turn, text, CASE conv_id % 5 WHEN 0 THEN 'qa_pairs' WHEN 1 THEN 'other' WHEN 2 THEN 'qa_pairs' ELSE 'caption' END AS kind FROM conversations)
SELECT conv_id, turn, CASE kind WHEN 'qa_pairs' THEN 'user,user,assistant' WHEN 'caption' THEN 'user,assistant' END AS roles, CASE kind WHEN 'qa_pairs' THEN 'Q?|' || text WHEN 'caption' THEN text END AS texts, CASE WHEN kind <> 'other' THEN '' END AS images, CASE WHEN kind <> 'other' THEN 'v' || conv_id END AS videos FROM a""")
def typed_dispatch(t):
    """Items by their type; one of another type gives no conversation."""
    rest = F.col("conv_id") % 5
    kind = F.when(rest == 0, "qa_pairs").when(rest == 1, "other").when(rest == 2, "qa_pairs").otherwise("caption")
    qa = F.array(F.struct(F.lit("Q?").alias("question"), F.col("text").alias("answer")))
    m = t("conversations").select("conv_id", "turn", C.typed_maker(kind, qa, F.concat(F.lit("v"), "conv_id"), F.col("text")).alias("m"))
    return m.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.array_join(C.contents(F.col("m"), "text"), "|").alias("texts"), F.array_join(C.contents(F.col("m"), "image"), ",").alias("images"), F.array_join(C.contents(F.col("m"), "video"), ",").alias("videos"))


@query(r"""SELECT vec_id, 'user,assistant' AS roles, 'Which digit?|' || label AS texts, 'img' || vec_id AS images FROM embeddings""")
def label_conversation(t):
    m = t("embeddings").select("vec_id", C.label_maker(F.concat(F.lit("img"), "vec_id"), F.col("label"), "Which digit?").alias("m"))
    return m.select("vec_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.array_join(C.contents(F.col("m"), "text"), "|").alias("texts"), F.array_join(C.contents(F.col("m"), "image"), ",").alias("images"))


@query(r"""SELECT conv_id // 5 AS pack, count(*)::BIGINT AS messages, md5(string_agg(text, '|' ORDER BY conv_id, turn)) AS texts FROM conversations GROUP BY 1""")
def join_pack(t):
    df = _plain(t).withColumn("pack", F.floor(F.col("conv_id") / 5))
    out = C.join_pack(df, "messages", "pack", "conv_id")
    return out.select("pack", F.size("messages").cast("long").alias("messages"), F.md5(F.array_join(C.contents(F.col("messages"), "text"), "|").cast("binary")).alias("texts"))


@query(r"""SELECT conv_id, min(turn) FILTER (role = 'assistant') AS first_assistant FROM conversations GROUP BY 1""")
def first_of_role(t):
    return t("conversations").groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first_assistant"))


@query(r"""SELECT conv_id, turn, max(length(text)) OVER (PARTITION BY conv_id)::BIGINT AS longest FROM conversations""")
def batch_longest(t):
    return t("conversations").select("conv_id", "turn", F.max(F.length("text")).over(Window.partitionBy("conv_id")).cast("long").alias("longest"))
