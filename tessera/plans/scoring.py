"""Queries on answers, judges and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rows as R
from ..operators import scoring as S
from .registry import query

RESULTS_SQL = r"""
WITH results AS (
  SELECT l.doc_id AS id, l.doc_id AS rn, d.lang, d.source, l.quality, l.toxic,
    CASE WHEN l.toxic = 1 THEN 'Yes.' WHEN l.doc_id % 7 = 0 THEN 'maybe' ELSE 'No' END AS answer,
    CASE l.doc_id % 5 WHEN 0 THEN 'Yes, it is' WHEN 1 THEN ' no.' WHEN 2 THEN d.text WHEN 3 THEN NULL ELSE upper(d.lang) || ' y' END AS model_answer,
    CASE WHEN l.doc_id % 11 = 0 THEN NULL ELSE l.quality = 1 END AS is_correct
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""
TOKENS_SQL = r"regexp_split_to_array(lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')), '[^\p{{L}}\p{{N}}_]+')[1:3]"


def results(t):
    """Items with a gold and a model answer, from labels and the texts of their documents."""
    said = F.when(F.col("doc_id") % 5 == 2, F.col("text"))  # the texts that are answers; no others are shuffled
    return (
        t("labels").join(t("documents").select("doc_id", said.alias("text"), "lang", "source"), "doc_id")
        .select(
            F.col("doc_id").alias("id"), F.col("doc_id").alias("rn"), "lang", "source", "quality", "toxic",
            F.when(F.col("toxic") == 1, "Yes.").when(F.col("doc_id") % 7 == 0, "maybe").otherwise("No").alias("answer"),
            F.when(F.col("doc_id") % 5 == 0, F.lit("Yes, it is")).when(F.col("doc_id") % 5 == 1, F.lit(" no.")).when(F.col("doc_id") % 5 == 2, F.col("text")).when(F.col("doc_id") % 5 == 4, F.concat(F.upper("lang"), F.lit(" y"))).alias("model_answer"),
            F.when(F.col("doc_id") % 11 != 0, F.col("quality") == 1).alias("is_correct"),
        )
    )


@query(RESULTS_SQL + rf"""
, t AS (SELECT {TOKENS_SQL.format(x="answer")} AS g, {TOKENS_SQL.format(x="coalesce(model_answer, '')")} AS p FROM results),
r AS (SELECT *, list_has_any(p, ['yes', 'no', 'y', 'n']) AS ok, list_contains(p, g[1]) AS hit FROM t WHERE list_has_any(g, ['yes', 'no', 'y', 'n']))
SELECT count(*)::BIGINT AS total, count(*) FILTER (ok AND hit)::BIGINT AS correct, count(*) FILTER (ok AND NOT hit)::BIGINT AS incorrect, count(*) FILTER (NOT ok)::BIGINT AS invalid,
  count(*) FILTER (ok AND hit)::DOUBLE / nullif(count(*), 0) AS accuracy_with_invalid,
  CASE WHEN count(*) > 0 THEN coalesce(count(*) FILTER (ok AND hit)::DOUBLE / nullif(count(*) FILTER (ok), 0), 0) END AS accuracy_without_invalid
FROM r""")
def answer_scoring(t):
    return S.score(results(t))


@query(rf"""
SELECT conv_id, turn, array_to_string({TOKENS_SQL.format(x="text")}, '|') AS tokens, len({TOKENS_SQL.format(x="text")})::BIGINT AS n FROM conversations""")
def answer_tokens(t):
    tokens = T.answer_tokens(F.col("text"))
    return t("conversations").select("conv_id", "turn", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).cast("long").alias("n"))


def _filter_sql(words: str) -> str:
    return rf"""WITH t AS (SELECT doc_id, regexp_split_to_array(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[^\p{{L}}\p{{N}}_]+')[1:3] AS w FROM documents)
    SELECT doc_id, array_to_string(w, ' ') AS words FROM t WHERE list_has_any(w, {words})"""


def _filtered(t, name):
    docs = t("documents").select("doc_id", T.answer_tokens(F.col("text")).alias("w"))
    return docs.where(T.passes(F.col("w"), name)).select("doc_id", F.array_join("w", " ").alias("words"))


@query(_filter_sql("['yes', 'no', 'y', 'n']"))
def filter_yes_no(t):
    return _filtered(t, "yes_no")


@query(_filter_sql("['present', 'absent', 'ap', 'pa', 'lateral', 'frontal']"))
def filter_label_set(t):
    return _filtered(t, "chexpert")


@query(_filter_sql("['a', 'b', 'c', 'd']"))
def filter_choice(t):
    return _filtered(t, "mc")


@query(r"""
WITH t AS (SELECT source, regexp_split_to_array(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[^\p{L}\p{N}_]+')[1:3] AS w,
  CASE WHEN doc_id % 3 = 0 THEN 'chexpert_' || source WHEN doc_id % 3 = 1 THEN 'mc_' || source ELSE source END AS ds FROM documents)
SELECT CASE WHEN contains(ds, 'chexpert') THEN 'chexpert' WHEN contains(ds, 'mc') THEN 'mc' ELSE 'yes_no' END AS filter_name, count(*)::BIGINT AS n,
  count(*) FILTER (CASE WHEN contains(ds, 'chexpert') THEN list_has_any(w, ['present', 'absent', 'ap', 'pa', 'lateral', 'frontal']) WHEN contains(ds, 'mc') THEN list_has_any(w, ['a', 'b', 'c', 'd']) ELSE list_has_any(w, ['yes', 'no', 'y', 'n']) END)::BIGINT AS passed
FROM t GROUP BY 1""")
def filter_dispatch(t):
    ds = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("chexpert_"), "source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("mc_"), "source")).otherwise(F.col("source"))
    docs = t("documents").select(ds.alias("ds"), T.answer_tokens(F.col("text")).alias("w"))
    name = F.when(F.contains("ds", F.lit("chexpert")), "chexpert").when(F.contains("ds", F.lit("mc")), "mc").otherwise("yes_no")
    ok = F.when(name == "chexpert", T.passes(F.col("w"), "chexpert")).when(name == "mc", T.passes(F.col("w"), "mc")).otherwise(T.passes(F.col("w"), "yes_no"))
    return docs.groupBy(name.alias("filter_name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"))


CONFUSION_SQL = RESULTS_SQL + r"""
, g AS (SELECT CASE WHEN toxic = 1 THEN 'yes' WHEN id % 7 = 0 THEN 'maybe' ELSE 'no' END AS gold,
  lower(regexp_split_to_array(regexp_replace(coalesce(model_answer, ''), '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_]+')[1]) AS word FROM results),
m AS (SELECT gold, CASE WHEN word IN ('yes', 'no') THEN word ELSE 'invalid' END AS pred, count(*)::BIGINT AS n FROM g WHERE gold IN ('yes', 'no') GROUP BY 1, 2)
"""


def _matrix(t):
    rows = results(t).withColumn("gold", F.when(F.col("toxic") == 1, "yes").when(F.col("id") % 7 == 0, "maybe").otherwise("no"))
    return S.confusion(rows, "gold", "model_answer")


@query(CONFUSION_SQL + "SELECT gold, pred, n FROM m")
def confusion_matrix(t):
    return _matrix(t)


@query(CONFUSION_SQL + r"""
, c AS (SELECT coalesce(sum(n) FILTER (gold = 'yes' AND pred = 'yes'), 0) AS yy, coalesce(sum(n) FILTER (gold = 'yes' AND pred = 'no'), 0) AS yn,
  coalesce(sum(n) FILTER (gold = 'no' AND pred = 'yes'), 0) AS ny, coalesce(sum(n) FILTER (gold = 'no' AND pred = 'no'), 0) AS nn FROM m)
SELECT coalesce((yy + yn)::DOUBLE / nullif(yy + yn + ny + nn, 0), 0) * 100 AS actual_yes_pct, coalesce((yy + ny)::DOUBLE / nullif(yy + yn + ny + nn, 0), 0) * 100 AS model_yes_pct,
  coalesce((yy + nn)::DOUBLE / nullif(yy + yn + ny + nn, 0), 0) AS accuracy, coalesce(yy::DOUBLE / nullif(yy + ny, 0), 0) AS precision_yes, coalesce(nn::DOUBLE / nullif(nn + yn, 0), 0) AS precision_no FROM c""")
def confusion_rates(t):
    return S.confusion_rates(_matrix(t))


JUDGE_SQL = RESULTS_SQL + r"""
SELECT count(*)::BIGINT AS total, count(*) FILTER (is_correct)::BIGINT AS correct, count(*) FILTER (is_correct IS NULL)::BIGINT AS invalid{more},
  coalesce(count(*) FILTER (is_correct)::DOUBLE / nullif(count(*), 0), 0) AS accuracy, coalesce(count(*) FILTER (is_correct)::DOUBLE / nullif(count(is_correct), 0), 0) AS accuracy_valid FROM results"""


@query(JUDGE_SQL.format(more=""))
def judge_summary(t):
    return S.judge_summary(results(t))


@query(JUDGE_SQL.format(more=", count(*) FILTER (NOT coalesce(is_correct, false))::BIGINT AS incorrect"))
def judge_summary_invalid_wrong(t):
    return S.judge_summary(results(t), invalid_is_wrong=True)


@query(r"""
WITH v AS (SELECT lower(trim(CASE doc_id % 4 WHEN 0 THEN ' Correct' WHEN 1 THEN 'incorrect ' WHEN 2 THEN 'CORRECT' ELSE 'unsure' END)) AS v FROM labels)
SELECT count(*)::BIGINT AS total, count(*) FILTER (v = 'correct')::BIGINT AS correct, count(*) FILTER (v = 'incorrect')::BIGINT AS incorrect,
  coalesce(count(*) FILTER (v = 'correct')::DOUBLE / nullif(count(*), 0), 0) AS accuracy, coalesce(count(*) FILTER (v = 'correct')::DOUBLE / nullif(count(*), 0), 0) * 100 AS accuracy_pct FROM v""")
def verdict_stats(t):
    m = F.col("doc_id") % 4
    return S.verdict_stats(t("labels").select(F.when(m == 0, " Correct").when(m == 1, "incorrect ").when(m == 2, "CORRECT").otherwise("unsure").alias("verdict")), "verdict")


@query(r"""
WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rn, doc_id, quality FROM labels),
b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rn, doc_id, CASE WHEN doc_id % 97 = 5 THEN 1 - quality ELSE quality END AS quality FROM labels),
j AS (SELECT a.rn, a.doc_id = b.doc_id AND a.quality = b.quality AS same FROM a JOIN b ON a.rn = b.rn)
SELECT count(*)::BIGINT AS compared, count(*) FILTER (NOT same)::BIGINT AS mismatches, (min(rn) FILTER (NOT same))::BIGINT AS first_mismatch, coalesce(bool_and(same), true) AS valid FROM j""")
def judged_validity_positional(t):
    a = R.position(t("labels").select("doc_id", "quality"), "doc_id", ranges=8)
    b = a.withColumn("quality", F.when(F.col("doc_id") % 97 == 5, 1 - F.col("quality")).otherwise(F.col("quality")))
    return S.validity_positional(a, b, ["doc_id", "quality"])


@query(r"""
WITH a AS (SELECT doc_id, quality FROM labels WHERE doc_id % 13 <> 3),
b AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN 1 - quality ELSE quality END AS quality FROM labels WHERE doc_id % 17 <> 4),
j AS (SELECT a.doc_id AS ka, b.doc_id AS kb, a.quality = b.quality AS same FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL)::BIGINT AS compared, count(*) FILTER (NOT same)::BIGINT AS mismatches, count(*) FILTER (kb IS NULL)::BIGINT AS unjudged, count(*) FILTER (ka IS NULL)::BIGINT AS unknown FROM j""")
def judged_validity_keyed(t):
    rows = t("labels").select("doc_id", "quality")
    b = rows.where("doc_id % 17 <> 4").withColumn("quality", F.when(F.col("doc_id") % 97 == 5, 1 - F.col("quality")).otherwise(F.col("quality")))
    return S.validity_keyed(rows.where("doc_id % 13 <> 3"), b, ["doc_id", "quality"], "doc_id")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rn, quality FROM labels)
SELECT (rn % 4)::BIGINT AS question_type, count(*)::BIGINT AS n, avg(quality::DOUBLE) AS accuracy FROM r GROUP BY 1""")
def accuracy_by_position(t):
    rows = R.position(t("labels").select("doc_id", "quality"), "doc_id", ranges=8)
    return S.accuracy_by(rows, F.col("quality"), (F.col("rn") % 4).alias("question_type"))


@query("SELECT lang, source, count(*)::BIGINT AS n, round(avg(quality::DOUBLE), 9) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def accuracy_rollup(t):
    rows = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id")
    return S.accuracy_by(rows, F.col("quality"), "lang", "source", rollup=True).withColumn("accuracy", F.round("accuracy", 9))


@query("""SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::BIGINT AS id FROM documents""")
def add_row_id(t):
    return R.add_id(t("documents").select("doc_id", "lang"), "doc_id", "lang", ranges=8)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) WHERE rn < floor(n * 0.3)")
def portion_head(t):
    return R.head_portion(t("documents").select("doc_id"), "doc_id", 0.3, ranges=8)


SHARD_SQL = "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () // 7 AS items FROM documents)"


@query(SHARD_SQL + " SELECT doc_id, least(rn // items, 6)::BIGINT AS shard FROM r")
def shard_rows(t):
    return R.shards(t("documents").select("doc_id"), "doc_id", 7, ranges=8)


@query(SHARD_SQL + " SELECT doc_id, (rn // items)::BIGINT AS shard, ((rn - (rn // items) * items) // 10)::BIGINT AS batch FROM r WHERE rn // items < 7")
def shard_batches(t):
    return R.shards(t("documents").select("doc_id"), "doc_id", 7, batch=10, keep_rest=False, ranges=8)


@query("SELECT doc_id, doc_id % 3 AS part, n_chars FROM documents")
def gather_union(t):
    """What three processes wrote, gathered; each document was dealt to one of them."""
    docs = t("documents").select("doc_id", "n_chars")
    parts = [docs.where(F.pmod("doc_id", F.lit(3)) == k).withColumn("part", F.lit(k).cast("long")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(r"SELECT 'docs/' || coalesce(nullif(lang, ''), 'none') AS folder, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def partition_paths(t):
    return t("documents").groupBy(F.concat(F.lit("docs/"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("none"))).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) WHERE rn >= 20 AND rn < 60")
def slice_rows(t):
    return R.position(t("documents").select("doc_id"), "doc_id", ranges=8).where("rn >= 20 and rn < 60")


@query("SELECT item_id, text FROM benchmark ORDER BY item_id")
def sort_export(t):
    return t("benchmark").select("item_id", "text").orderBy("item_id")


@query("SELECT item_id, md5('s|' || item_id::VARCHAR) AS h FROM benchmark ORDER BY h, item_id LIMIT 10")
def sample_hash(t):
    from ..functions.jsonx import salted

    return R.sample(t("benchmark").select("item_id"), 10, "s", "item_id").withColumn("h", salted("s", F.col("item_id")))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('half|' || doc_id::VARCHAR), doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= n // 2")
def shuffle_halves(t):
    return R.halves(t("documents").select("doc_id"), "half", "doc_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def sort_by_size(t):
    """A top-k report: the 100 longest documents. order_by_size has all."""
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id")
def order_by_size(t):
    """All documents in order of size, range by range; ties by doc_id."""
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars <= 2000 AND lang = 'en'")
def length_filter(t):
    return R.keep(t("documents").select("doc_id", "lang", "n_chars"), size=F.col("n_chars") <= 2000, lang=F.col("lang") == "en")


@query(r"""
WITH r AS (SELECT count(*) AS n, count(*) FILTER (n_chars > 5000) AS a, count(*) FILTER (n_chars <= 5000) AS n2, count(*) FILTER (n_chars <= 5000 AND lang <> 'en') AS b,
  count(*) FILTER (n_chars <= 5000 AND lang = 'en') AS n3, count(*) FILTER (n_chars <= 5000 AND lang = 'en' AND n_chars < 100) AS c FROM documents)
SELECT 'long' AS rule, n::BIGINT AS rows_in, a::BIGINT AS removed, coalesce(a::DOUBLE / nullif(n, 0), 0) * 100 AS removed_pct FROM r
UNION ALL SELECT 'lang', n2::BIGINT, b::BIGINT, coalesce(b::DOUBLE / nullif(n2, 0), 0) * 100 FROM r
UNION ALL SELECT 'short', n3::BIGINT, c::BIGINT, coalesce(c::DOUBLE / nullif(n3, 0), 0) * 100 FROM r""")
def filter_report(t):
    return R.filter_report(t("documents").select("n_chars", "lang"), long=F.col("n_chars") <= 5000, lang=F.col("lang") == "en", short=F.col("n_chars") >= 100)


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def verify_semi(t):
    return R.present(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def verify_anti(t):
    return R.absent(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT lang AS status, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def status_histogram(t):
    from ..sources.catalog import statuses

    return statuses(t("documents").select(F.col("lang").alias("status")))


@query(r"""
WITH p AS (SELECT page_id, 'vids/' || url || '.mp4' AS v FROM pages),
l AS (SELECT DISTINCT 'vids/' || url || CASE WHEN page_id % 3 = 0 THEN '.en.vtt' ELSE '.mp4' END AS path FROM pages)
SELECT page_id, replace(v, '.mp4', '.en.vtt') AS subtitle FROM p WHERE replace(v, '.mp4', '.en.vtt') IN (SELECT path FROM l)""")
def subtitle_exists(t):
    """Videos whose subtitle file is in a listing of paths; the listing has subtitles of a third of them, and videos."""
    paths = t("pages").select("page_id", T.subtitle_path(F.concat(F.lit("vids/"), "url", F.lit(".mp4"))).alias("path"))
    listing = t("pages").select(F.concat(F.lit("vids/"), "url", F.when(F.col("page_id") % 3 == 0, ".en.vtt").otherwise(".mp4")).alias("path"))
    return R.present(paths, listing, "path").select("page_id", F.col("path").alias("subtitle"))


@query("""SELECT l_orderkey, bool_and(l_quantity > 5) AS every, bool_or(l_discount = 0) AS some_free FROM lineitem GROUP BY l_orderkey""")
def bool_all_any(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("every"), F.bool_or(F.col("l_discount") == 0).alias("some_free"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def newest_checkpoint(t):
    return R.newest(t("orders").select("o_custkey", "o_orderkey"), "o_orderkey", ["o_custkey"])


@query(r"""
WITH f AS (SELECT o_orderkey % 50 AS step, ['config.json', 'generation_config.json', 'preprocessor_config.json', 'video_preprocessor_config.json', 'tokenizer.json', 'tokenizer_config.json', 'vocab.json', 'merges.txt', 'special_tokens_map.json', 'added_tokens.json', 'chat_template.jinja', 'model.safetensors.index.json', 'optimizer.pt', 'rng_state.pth', 'scheduler.pt', 'trainer_state.json', 'training_args.bin', 'model-' || o_orderkey || '.safetensors'][o_orderkey % 18 + 1] AS name, o_orderkey % 18 AS k FROM orders)
SELECT step, name, step <> (SELECT max(step) FROM f) AND k BETWEEN 12 AND 16 AS "delete" FROM f""")
def checkpoint_retention(t):
    """Each file name that is kept, and five that are not."""
    names = [*R.KEPT_FILES, "optimizer.pt", "rng_state.pth", "scheduler.pt", "trainer_state.json", "training_args.bin"]
    name = F.element_at(F.array(*map(F.lit, names), F.concat(F.lit("model-"), "o_orderkey", F.lit(".safetensors"))), (F.col("o_orderkey") % 18 + 1).cast("int"))
    return R.retention(t("orders").select((F.col("o_orderkey") % 50).alias("step"), name.alias("name")))


@query(r"""WITH o AS (SELECT doc_id AS id, 'user' || chr(10) || 'q assistant old' || chr(10) || 'assistant' || chr(10) || ' ' || lang || ' ' || n_chars || chr(10) AS output FROM documents WHERE doc_id % 4 > 0)
SELECT l.doc_id AS id, CASE WHEN o.id IS NOT NULL THEN d.lang || ' ' || d.n_chars END AS model_answer FROM labels l LEFT JOIN o ON l.doc_id = o.id LEFT JOIN documents d ON l.doc_id = d.doc_id""")
def model_outputs(t):
    """Items with the answers that a model gave to three of four of them, joined by id."""
    text = F.concat(F.lit("user\nq assistant old\nassistant\n "), "lang", F.lit(" "), "n_chars", F.lit("\n"))
    outputs = t("documents").where("doc_id % 4 > 0").select(F.col("doc_id").alias("id"), text.alias("output"))
    return R.join_outputs(t("labels").select(F.col("doc_id").alias("id")), outputs)


@query("SELECT r_name AS model, n_name AS dataset FROM region, nation")
def run_matrix(t):
    return t("region").select(F.col("r_name").alias("model")).crossJoin(t("nation").select(F.col("n_name").alias("dataset")))
