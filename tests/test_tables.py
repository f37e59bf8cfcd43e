"""Tables that change at once, steps that are taken up again, shards of batches, packing in SQL, and kept results."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import packing as P
from tessera.operators import packtable as PT
from tessera.operators import scoring as S
from tessera.operators import synth as SY
from tessera.scratch import materialize
from tessera.sources import batches as B
from tessera.sources import catalog as SO
from tessera.sources import tables as TB
from tessera.streaming import store as ST


def test_tables_change_at_once(spark, tmp_path):
    table = TB.Table(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.range(5), "a")
    held = table.read()
    table.write(table.read().unionAll(spark.range(5, 8)), "b")
    assert held.count() == 5 and table.read().count() == 8, "a reader that has begun keeps its version"
    with pytest.raises(Exception):  # noqa: B017
        table.write(spark.range(3).select(F.raise_error(F.lit("lost"))), "c")
    assert table.manifest()["key"] == "b" and table.read().count() == 8
    table.write(spark.range(1), "d", note="x")
    assert table.manifest()["note"] == "x" and sum(n.startswith("v-") for n in os.listdir(tmp_path / "t")) == 3, "the version before, this one and what died"
    assert not [n for n in os.listdir(tmp_path / "t") if n.startswith("current.json.")]


def test_steps_are_taken_up_again(spark, tmp_path):
    source = lambda: spark.read.parquet(f"{tmp_path}/in")
    spark.range(100).write.parquet(f"{tmp_path}/in")
    fails = [True]

    def third(df):
        return df.select("id", F.raise_error(F.lit("lost")) if fails[0] else F.col("twice"))

    steps = [("one", lambda df: df.where("id % 2 = 0")), ("two", lambda df: df.withColumn("twice", F.element_at(F.transform(F.array("id"), lambda x: x * 2), 1))), ("three", third)]
    with pytest.raises(Exception, match="lost"):
        TB.run_steps(source(), steps, f"{tmp_path}/s")
    state = {r["step"]: r["finished"] for r in TB.progress(spark, f"{tmp_path}/s", ["one", "two", "three"]).collect()}
    assert state == {"one": True, "two": True, "three": False}
    versions = lambda: {n: TB.Table(spark, f"{tmp_path}/s/{n}").manifest().get("version") for n in ("one", "two", "three")}
    before = versions()
    fails[0] = False
    assert TB.run_steps(source(), steps, f"{tmp_path}/s").count() == 50
    done = versions()
    assert (done["one"], done["two"]) == (before["one"], before["two"]) and done["three"]
    assert TB.run_steps(source(), steps, f"{tmp_path}/s").count() == 50 and versions() == done, "nothing runs again"
    changed = [steps[0], ("two", lambda df: df.withColumn("twice", F.col("id") * 3)), steps[2]]
    assert TB.run_steps(source(), changed, f"{tmp_path}/s").agg(F.sum("twice")).first()[0] == 3 * sum(range(0, 100, 2))
    assert versions()["one"] == done["one"] and versions()["two"] != done["two"] and versions()["three"] != done["three"]
    spark.range(100, 104).write.mode("append").parquet(f"{tmp_path}/in")
    assert TB.run_steps(source(), changed, f"{tmp_path}/s").count() == 52
    now = versions()
    TB.run_steps(source(), changed, f"{tmp_path}/s", version=2)
    assert now["one"] != versions()["one"], "a version of the code runs everything anew"
    with pytest.raises(ValueError):
        TB.run_steps(source(), [steps[0], steps[0]], f"{tmp_path}/s")


def test_save_replaces_what_stands(spark, tmp_path):
    path = f"{tmp_path}/t"
    SO.save(spark.range(4).withColumn("split", F.lit("a")), path, split="split")
    with pytest.raises(Exception):  # noqa: B017
        SO.save(spark.range(4).select(F.raise_error(F.lit("lost"))), path)
    assert spark.read.parquet(path).count() == 4
    SO.save(spark.read.parquet(path).where("id < 2"), path)
    assert spark.read.parquet(path).count() == 2 and [n for n in os.listdir(tmp_path) if ".old-" in n] == []
    with pytest.raises(Exception, match="EXISTS"):
        SO.save(spark.range(1), path, exists_ok=False)


def test_arrays_with_odd_items_are_errors(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"id": 1, "is_correct": true}, {"id": 2}]')
    (tmp_path / "bad.json").write_text('[{"id": 1}, {"id": "no number"}]')
    assert [r["id"] for r in SO.read_json_array(spark, str(tmp_path / "good.json")).collect()] == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        SO.read_json_array(spark, str(tmp_path / "bad.json")).collect()


def test_cues_of_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.en.vtt").write_text("WEBVTT\n\n1\n00:00.000 --> 00:01.000\nHello there\n\n00:02.000 --> 00:03.000\nfriend\n")
    (tmp_path / "d" / "a.mp4").write_text("x")
    assert [tuple(r) for r in SO.read_cues(spark, str(tmp_path)).collect()] == [("a.en.vtt", "Hello there friend")]


def some_items(rng, n):
    return [(k, [rng.randint(5, 99) for _ in range(m)], [rng.choice([-100, 7]) for _ in range(m)]) for k in range(n) for m in [rng.choice([0, 1, 3, rng.randint(0, 60)])]]


@pytest.mark.parametrize("side", ["right", "left"])
def test_batches_come_back_equal(spark, tmp_path, side):
    B.register(spark)
    items = some_items(random.Random(5), 150)
    df = spark.createDataFrame(items, "id long, input_ids array<int>, labels array<int>").repartition(4)
    batched = materialize(B.by_length(df, "id", batch_rows=8, batches_per_shard=3), "batched")
    B.write(B.dense(batched, "id", side), f"{tmp_path}/a")
    index = json.loads((tmp_path / "a" / "index.json").read_text())
    assert [s["shard"] for s in index] == list(range(7)) and sum(s["rows"] for s in index) == 150 and sum(s["batches"] for s in index) == 19
    assert sorted(os.listdir(tmp_path / "a")) == ["index.json", *sorted(s["name"] for s in index)]
    by, want = {}, {k: (x, y) for k, x, y in items}
    order = sorted(items, key=lambda r: (len(r[1]), r[0]))
    for s in index:
        for b in B.decoded((tmp_path / "a" / s["name"]).read_bytes()):
            assert b["keys"].tolist() == sorted(r[0] for r in order[b["batch"] * 8 : b["batch"] * 8 + 8]) and b["width"] == max(len(want[k][0]) for k in b["keys"].tolist())
            for k, ids, labels, mask in zip(b["keys"].tolist(), b["input_ids"], b["labels"], b["attention_mask"], strict=True):
                n = len(want[k][0])
                at = slice(0, n) if side == "right" else slice(b["width"] - n, b["width"])
                assert ids[at].tolist() == want[k][0] and labels[at].tolist() == want[k][1] and mask.sum() == n and mask[at].all()
                assert (labels[mask == 0] == -100).all() and (ids[mask == 0] == 0).all()
                by[k] = 1
    assert len(by) == 150
    back = spark.read.format("batches").load(f"{tmp_path}/a")
    assert sorted(map(str, back.collect())) == sorted(map(str, B.dense(batched, "id", side).collect()))
    B.write(B.dense(batched.repartition(7), "id", side), f"{tmp_path}/b")
    for s in index:
        assert (tmp_path / "a" / s["name"]).read_bytes() == (tmp_path / "b" / s["name"]).read_bytes(), "another run writes the same files"
    cells = B.padding(batched.withColumn("n", F.size("input_ids")), "batch", "n").first()
    arrival = B.padding(df.withColumn("n", F.size("input_ids")).withColumn("batch", F.floor(F.col("id") / 8)), "batch", "n").first()
    assert cells["tokens"] == arrival["tokens"] and cells["cells"] < 0.8 * arrival["cells"]
    (tmp_path / "a" / index[0]["name"]).write_bytes(b"other")
    with pytest.raises(Exception, match="not the shard"):
        spark.read.format("batches").load(f"{tmp_path}/a").collect()


def test_a_write_of_batches_that_dies(spark, tmp_path):
    B.register(spark)
    df = spark.createDataFrame(some_items(random.Random(6), 40), "id long, input_ids array<int>, labels array<int>")
    dense = B.dense(B.by_length(df, "id", batch_rows=4, batches_per_shard=2), "id")
    with pytest.raises(Exception):  # noqa: B017
        B.write(dense.withColumn("keys", F.when(F.col("batch") == 7, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("keys"))), f"{tmp_path}/a")
    assert not (tmp_path / "a" / "index.json").exists() and not [n for n in os.listdir(tmp_path / "a")if n.endswith(".bin")] if (tmp_path / "a").exists() else True
    B.write(dense, f"{tmp_path}/a")
    assert spark.read.format("batches").load(f"{tmp_path}/a").count() == 10
    B.write(dense.where("false"), f"{tmp_path}/none")
    assert spark.read.format("batches").load(f"{tmp_path}/none").count() == 0


def test_packing_in_sql(spark):
    PT.register(spark)
    rng = random.Random(7)
    df = spark.createDataFrame([(k, rng.choice([0, 3, 50, 99, 100, 101, 250, rng.randint(1, 100)])) for k in range(400)], "doc long, n int").repartition(5)
    P.pack(df, "doc", "n", 100, slice_rows=150, isolate=True).createOrReplaceTempView("packed")
    df.createOrReplaceTempView("items")
    got = spark.sql("SELECT doc, n, slice, bin, pos FROM pack_items(TABLE(SELECT doc, n, doc DIV 150 AS slice FROM items) PARTITION BY slice ORDER BY doc, capacity => 100, size => 'n', isolate => true)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.table("packed").select("doc", "n", "slice", "bin", "pos").collect()))
    assert spark.sql("SELECT * FROM pack_items(TABLE(SELECT 1 AS size WHERE false) WITH SINGLE PARTITION, capacity => 5)").count() == 0
    for sql, message in (("TABLE(SELECT 'a' AS size), capacity => 5", "whole numbers"), ("TABLE(SELECT 1 AS size), capacity => 0", "capacity"), ("TABLE(SELECT 1 AS size, 2 AS bin), capacity => 5", "already"), ("TABLE(SELECT 9 AS size) WITH SINGLE PARTITION, capacity => 5", "over the capacity")):
        with pytest.raises(Exception, match=message):
            spark.sql(f"SELECT * FROM pack_items({sql})").collect()


def test_kept_results(spark, tmp_path):
    schema = "id long, at long, answer string, model_answer string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    store = ST.ResultStore(spark, f"{tmp_path}/s", schema, order="at")
    assert store.current().count() == 0 and store.score(filter_name="yes_no").first()["total"] == 0
    store.apply(rows((1, 1, "yes", "yes"), (2, 1, "no", "yes"), (3, 1, "no", None)), 0)
    for _ in range(3):  # the same batch again and again
        store.apply(rows((1, 1, "yes", "yes"), (2, 1, "no", "yes"), (3, 1, "no", None)), 0)
    first = store.score(filter_name="yes_no").first()
    assert (first["total"], first["correct"], first["incorrect"], first["invalid"]) == (3, 1, 1, 1)
    store.apply(rows((2, 2, "no", "no"), (3, 0, "no", "no"), (4, 1, "yes", "no")), 1)  # a correction, an older row, a new one
    want = {(1, "yes"), (2, "no"), (3, None), (4, "no")}
    assert {(r["id"], r["model_answer"]) for r in store.current().collect()} == want
    store.merge()
    assert store.batches() == [] and store.reached() == 1 and {(r["id"], r["model_answer"]) for r in store.current().collect()} == want
    store.apply(rows((1, 9, "yes", "no")), 1)
    assert {(r["id"], r["model_answer"]) for r in store.current().collect()} == want, "a batch that was merged is ignored"
    os.makedirs(tmp_path / "s" / "batches" / "n=2")  # began and did not end
    assert store.batches() == [] and store.current().count() == 4
    store.apply(rows((1, 9, "yes", "no"), (1, 9, "yes", "yes")), 2)
    store.merge()
    assert store.current().count() == 4 and store.score(filter_name="yes_no").first()["total"] == 4


def test_a_stream_into_the_store(spark, tmp_path):
    schema = "id long, answer string, model_answer string"
    folder = tmp_path / "in"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
    write([(k, "yes", "yes" if k % 2 else "no") for k in range(20)])
    store = ST.ResultStore(spark, f"{tmp_path}/s", schema)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    ST.start(stream(), store, f"{tmp_path}/ck").awaitTermination(60)
    write([(k, "yes", "yes") for k in range(10, 25)])
    ST.start(stream(), store, f"{tmp_path}/ck", merge_every=1).awaitTermination(60)
    want = S.score(spark.createDataFrame([(k, "yes", "yes" if k % 2 or k >= 10 else "no") for k in range(25)], schema), filter_name="yes_no").first()
    assert store.score(filter_name="yes_no").first() == want and store.reached() >= 1


def most_by_greed(sizes, classes):
    left, n = sorted(sizes), 0
    while len(left) >= classes and left[-classes] > 0:
        for k in range(1, classes + 1):
            left[-k] -= 1
        left.sort()
        n += 1
    return n


@pytest.mark.parametrize("sizes,rows,cols,per_class", [([10, 1, 1, 1], 2, 2, 1), ([5, 5, 5, 5, 5], 2, 2, 1), ([100, 3, 2, 2, 2, 1], 2, 2, 1), ([9, 8, 7, 1], 1, 3, 1), ([4, 4, 4], 2, 2, 1), ([7, 6, 5, 3], 2, 2, 2), ([3, 3, 1], 1, 2, 1), ([], 2, 2, 1)])
def test_as_many_grids_as_there_can_be(spark, sizes, rows, cols, per_class):
    labels = [c for c, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame([*enumerate(labels), (9999, None)], "id long, label int").repartition(3)
    cells = SY.compose(df, "id", "label", rows, cols, per_class).collect()
    by = {}
    for r in cells:
        by.setdefault(r["grid"], []).append(r)
    assert len(by) == most_by_greed([n // per_class for n in sizes], rows * cols // per_class)
    assert len({r["id"] for r in cells}) == len(cells) == len(by) * rows * cols
    for own in by.values():
        assert sorted((r["row"], r["col"]) for r in own) == [(i, j) for i in range(rows) for j in range(cols)]
        assert all(sum(r["label"] == c for r in own) == per_class for c in {r["label"] for r in own})
    assert {tuple(r) for r in SY.compose(df.repartition(1), "id", "label", rows, cols, per_class).collect()} == {tuple(r) for r in cells}
