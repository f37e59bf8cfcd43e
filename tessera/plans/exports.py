"""Queries on batches by length, packing from SQL, and results that are kept by id."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packtable as PT
from ..scratch import materialize, own, shared_folder
from ..sources import batches as B
from ..sources.tables import progress, run_steps
from ..streaming.store import ResultStore
from .items import COUNT_SQL
from .registry import query
from .scoring import RESULTS_SQL, TOKENS_SQL, results


@query(f"""WITH n AS (SELECT doc_id, {COUNT_SQL}::BIGINT AS n FROM documents),
b AS (SELECT n, (row_number() OVER (ORDER BY n, doc_id) - 1) // 32 AS by_length, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS arrival FROM n),
l AS (SELECT sum(c) AS cells FROM (SELECT count(*) * max(n) AS c FROM b GROUP BY by_length)), a AS (SELECT sum(c) AS cells FROM (SELECT count(*) * max(n) AS c FROM b GROUP BY arrival))
SELECT (SELECT sum(n) FROM n)::BIGINT AS tokens, l.cells::BIGINT AS cells_by_length, a.cells::BIGINT AS cells_by_arrival FROM l, a""")
def bucket_padding(t):
    """Tokens of all documents, and the cells that batches of 32 take if they go by length or by arrival."""
    items = t("documents").select("doc_id", T.token_count(F.col("text")).alias("n"))
    by_length = B.numbered(items, ["n", "doc_id"], name="rank")
    by_arrival = B.numbered(items, ["doc_id"], name="rank")
    cells = [B.padding(d.withColumn("batch", F.floor(F.col("rank") / 32)), "batch", "n") for d in (by_length, by_arrival)]
    both = cells[0].withColumn("kind", F.lit(0)).unionByName(cells[1].withColumn("kind", F.lit(1)))
    return both.agg(F.max("tokens").alias("tokens"), F.max(F.when(F.col("kind") == 0, F.col("cells"))).alias("cells_by_length"), F.max(F.when(F.col("kind") == 1, F.col("cells"))).alias("cells_by_arrival"))


@query()
def pack_sql(t):
    """All documents packed from SQL, in slices of 50,000 ids; those of one slice equal what pack_ffd gives."""
    docs = t("documents")
    spark, view = docs.sparkSession, f"documents_{uuid.uuid4().hex}"
    PT.register(spark)
    docs.select("doc_id", F.col("n_chars").alias("size"), F.floor(F.col("doc_id") / 50_000).alias("slice")).createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT doc_id, size, slice, bin, pos FROM pack_items(TABLE({view}) PARTITION BY slice ORDER BY doc_id, capacity => 8000, isolate => true)")
    finally:
        spark.catalog.dropTempView(view)


@query(RESULTS_SQL + rf""", f AS (SELECT id, answer, CASE WHEN id % 4 = 1 THEN 'yes' ELSE coalesce(model_answer, '') END AS model_answer FROM results),
t AS (SELECT {TOKENS_SQL.format(x="answer")} AS g, {TOKENS_SQL.format(x="model_answer")} AS p FROM f),
r AS (SELECT list_has_any(p, ['yes', 'no', 'y', 'n']) AS ok, list_contains(p, g[1]) AS hit FROM t WHERE list_has_any(g, ['yes', 'no', 'y', 'n']))
SELECT count(*)::BIGINT AS total, count(*) FILTER (ok AND hit)::BIGINT AS correct, count(*) FILTER (ok AND NOT hit)::BIGINT AS incorrect, count(*) FILTER (NOT ok)::BIGINT AS invalid FROM r""")
def kept_results_score(t):
    """Results in three deliveries, one of them twice, and a late one that corrects a quarter of them: each id counts once."""
    rows = materialize(results(t).select("id", "answer", "model_answer"), "results")  # each delivery reads it again
    spark = rows.sparkSession
    store = ResultStore(spark, own(f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"), "id long, answer string, model_answer string")
    for number, part in ((0, 0), (1, 1), (1, 1), (2, 2)):
        store.apply(rows.where(F.pmod("id", F.lit(3)) == part), number)
    store.merge()
    store.apply(rows.where(F.pmod("id", F.lit(3)) == 0), 0)
    store.apply(rows.where(F.pmod("id", F.lit(4)) == 1).withColumn("model_answer", F.lit("yes")), 3)
    return store.score(filter_name="yes_no").select("total", "correct", "incorrect", "invalid")


@query(f"""WITH n AS (SELECT doc_id, lang, {COUNT_SQL}::BIGINT AS n FROM documents), k AS (SELECT * FROM n WHERE n BETWEEN 1 AND 2000)
SELECT lang, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens, 3::BIGINT AS finished FROM k GROUP BY 1""")
def resumed_steps(t):
    """Steps whose tables are kept: the second run finds each under its fingerprint and makes none of them again."""
    docs = t("documents").select("doc_id", "lang", "text")
    spark = docs.sparkSession
    steps = [
        ("counted", lambda df: df.select("doc_id", "lang", T.token_count(F.col("text")).alias("n"))),
        ("kept", lambda df: df.where("n BETWEEN 1 AND 2000")),
        ("summed", lambda df: df.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))),
    ]
    folder = own(f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}")
    run_steps(docs, steps, folder)
    before = progress(spark, folder, [name for name, _ in steps]).collect()
    out = run_steps(docs, steps, folder)
    same = sum(a == b for a, b in zip(before, progress(spark, folder, [name for name, _ in steps]).collect(), strict=True))
    return out.withColumn("finished", F.lit(same).cast("long"))
