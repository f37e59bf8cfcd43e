"""Edge cases of the library: functions with exact semantics, invariants, sources and streams."""

from __future__ import annotations

import itertools
import json
import math
import random
import re
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import jsonx as J
from tessera.functions import mathx as M
from tessera.functions import text as T
from tessera.operators import conversations as C
from tessera.operators import measure as E
from tessera.operators import packing as P
from tessera.operators import rows as R
from tessera.operators import scoring as S
from tessera.operators import stats as ST
from tessera.operators import synth as SY
from tessera.operators import tokens as K
from tessera.operators import toolcalls as TC
from tessera.plans.queries import QUERIES
from tessera.sources import catalog as SO
from tessera.streaming import scores as STREAM


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


ANSWERS = ["Yes.", "  yes, it is", "", "...A", "été no", " Yes_x y", "no", "one two three yes", "²", "a,b;c d"]


def test_answer_tokens(spark):
    want = [re.split(r"[^\w]+", a.strip().lower())[:3] for a in ANSWERS]
    got = [r["x"] for r in column(spark, ANSWERS).select(T.answer_tokens(F.col("x")).alias("x")).collect()]
    assert got == want


def test_text_helpers(spark):
    assert one(spark, T.last_turn(F.lit("a assistant\nb assistant\n c \n"))) == "c"
    assert one(spark, T.prompt_names(F.lit("a,b,c"))) == ["c", "b", "a"] and one(spark, T.prompt_names(F.lit(""))) == [""]
    assert one(spark, T.basename(F.lit("a/b/c.mp4"))) == "c.mp4" and one(spark, T.stem(F.lit("a/b/c.d.mp4"))) == "c.d" and one(spark, T.stem(F.lit(".rc"))) == ".rc"
    assert one(spark, T.with_dir(F.lit("m"), F.lit("x.png"))) == "m/x.png" and one(spark, T.with_dir(F.lit("m"), F.lit("/x.png"))) == "/x.png"
    assert one(spark, T.data_uri_bytes(F.lit("data:image/png;base64,aGk="))) == b"hi" and one(spark, T.data_uri_bytes(F.lit("x"))) is None
    assert one(spark, T.cue_text(F.lit("WEBVTT\n\n1\n00:00.000 --> 00:01.000\nHello there\n\n00:02.000 --> 00:03.000\nfriend"))) == "Hello there friend"
    assert [T.filter_for(d) for d in ("chexpert_mc", "mc_x", "vqa")] == ["chexpert", "mc", "yes_no"]


def resize(h, w, low, high, f=28):
    rh, rw = max(f, round(h / f) * f), max(f, round(w / f) * f)
    if rh * rw > high:
        b = math.sqrt(h * w / high)
        return max(f, math.floor(h / b / f) * f), max(f, math.floor(w / b / f) * f)
    if rh * rw < low:
        b = math.sqrt(low / (h * w))
        return math.ceil(h * b / f) * f, math.ceil(w * b / f) * f
    return rh, rw


def test_smart_resize_and_rounding(spark):
    rng = random.Random(1)
    sides = [(14, 42), (70, 98), (126, 28), (1, 1), (5, 4000), (3000, 3000), *((rng.randint(1, 4000), rng.randint(1, 4000)) for _ in range(500))]
    df = spark.createDataFrame(sides, "h int, w int")
    h, w = M.smart_resize(F.col("h"), F.col("w"), M.IMAGE_PIXELS)
    for r in df.select("h", "w", h.alias("a"), w.alias("b")).collect():
        assert (r["a"], r["b"]) == resize(r["h"], r["w"], *M.IMAGE_PIXELS)
    assert one(spark, F.struct(*M.smart_resize(F.lit(10), F.lit(200_000), M.IMAGE_PIXELS))) == (28, 179_200) and one(spark, E.media_tokens(F.lit(10), F.lit(200_000))) == 6400
    for a, b, bounds in ((10, 200_000, M.IMAGE_PIXELS), (200_000, 10, M.IMAGE_PIXELS), (20, 15_000, M.VIDEO_PIXELS), (15_000, 20, M.VIDEO_PIXELS)):
        assert tuple(one(spark, F.struct(*M.smart_resize(F.lit(a), F.lit(b), bounds)))) == resize(a, b, *bounds) and min(resize(a, b, *bounds)) == 28
    got = [r["x"] for r in column(spark, [14, 42, 70, 98, 126, 1, 28, 41, 43], "int").select(M.round_to(F.col("x")).alias("x")).collect()]
    assert got == [round(n / 28) * 28 for n in (14, 42, 70, 98, 126, 1, 28, 41, 43)]


def test_frames(spark):
    df = spark.createDataFrame([(1, 30.0, "a/x"), (9000, 30.0, "a/x"), (100, 0.0, "a/x"), (50, 10.0, "vid_processed/x"), (100000, 5.0, "a/x"), (7, None, "a/x")], "total long, fps double, path string")
    rows = E.frame_plan(df, "total", "fps", "path").collect()
    assert [r["n_frames"] for r in rows] == [1, 300, None, 50, 420, None]
    assert rows[0]["frames"] == [0] and rows[1]["frames"][-1] == 8999 and rows[3]["frames"] == list(range(50)) and rows[2]["frames"] is None
    import numpy as np

    for total, n in itertools.product((5, 17, 100, 977), (1, 2, 4, 5)):
        assert one(spark, M.frame_indices(F.lit(total).cast("long"), F.lit(n).cast("long"))) == np.linspace(0, total - 1, n).astype(int).tolist()


def test_frame_plan_of_every_part(spark, tmp_path):
    import numpy as np

    parts = [1, 2, 5, 10, 11, 419, 4999, 5003, 9997]
    spark.createDataFrame([(k,) for k in parts], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    want = []
    for k in parts:
        total, fps = k % 5000 + 1, k % 5 * 7.5
        if fps:
            n = min(int(min(max(round(total / fps), 4), 420)), total)
            want += [(k, i, f) for i, f in enumerate(np.linspace(0, total - 1, n).astype(int).tolist())]
    got = [tuple(r) for r in QUERIES["frame_plan"](spark, str(tmp_path)).collect()]
    assert sorted(got) == want and {k for k, _, _ in want} == {1, 2, 11, 419, 4999, 5003, 9997}


def test_frames_are_made_by_all_tasks(spark, tmp_path):
    spark.range(400).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    per_task = [r["count"] for r in QUERIES["frame_plan"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 4 and max(per_task) < 2 * min(per_task)
    rows = spark.createDataFrame([(1, 1, 30.0), (2, 0, 30.0), (3, None, 30.0), (4, 9, None), (5, 9, 1.0)], "k int, total long, fps double")
    assert sorted(map(tuple, E.frame_rows(rows, "total", "fps", "k").collect())) == [(1, 0, 0)] + [(5, i, i) for i in range(9)]


def test_media_tokens(spark):
    df = spark.createDataFrame([(280, 280, None), (0, 10, None), (None, 10, None), (280, 280, 5)], "h int, w int, f int")
    assert [r["x"] for r in df.select(E.media_tokens(F.col("h"), F.col("w"), F.col("f")).alias("x")).collect()] == [100, -1, -1, 250]
    assert [r["x"] for r in df.select(E.valid_image(F.col("h"), F.col("w")).alias("x")).collect()] == [True, False, False, True]


def test_image_header(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 40, 30)
    gif = b"GIF89a" + struct.pack("<HH", 7, 9)
    jpg = b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", 11, 12) + b"\0" * 10
    check = E.is_valid_image_udf()
    rows = column(spark, [png, gif, jpg, b"no", None], "binary").select(check("x").alias("r")).select("r.*").collect()
    assert [tuple(r) for r in rows] == [(True, 30, 40), (True, 9, 7), (True, 11, 12), (False, None, None), (False, None, None)]


def test_arrays(spark):
    a = F.array(*map(F.lit, [1, 2, 3]))
    for k in (0, 1, 3, 9):
        want = [1, 2, 3]
        want.insert(k, 7)
        assert one(spark, A.insert_clamped(a, k, F.lit(7))) == want
    assert one(spark, A.pad_to(a, F.lit(5), F.lit(0))) == [1, 2, 3, 0, 0] and one(spark, A.pad_to(a, F.lit(5), F.lit(0), "left")) == [0, 0, 1, 2, 3]
    assert one(spark, A.pad_to(a, F.lit(2), F.lit(0))) == [1, 2] and one(spark, A.pad_to(a, F.lit(2), F.lit(0), "left")) == [2, 3]
    assert one(spark, A.mask_for(a, F.lit(5))) == [1, 1, 1, 0, 0] and one(spark, A.mask_for(a, F.lit(5), "left")) == [0, 0, 1, 1, 1] and one(spark, A.mask_for(a, F.lit(2))) == [1, 1]
    assert one(spark, A.unmasked(F.array(F.lit(-100), F.lit(5)))) == [5]
    assert one(spark, A.between(F.array(*map(F.lit, [9, 1, 4, 5, 2, 1])), 1, 2)) == [4, 5] and one(spark, A.between(a, 3, 1)) == []
    assert one(spark, A.product(F.array(*[F.lit(x).cast("long") for x in (2, 3, 4)]))) == 24
    assert len(one(spark, A.pad_nan(F.array(F.lit(1.0)), F.lit(3)))) == 3
    assert [tuple(x) for x in one(spark, A.zipped(F.array(F.lit(1)), F.array(F.lit(2))))] == [(1, 2)]
    with pytest.raises(Exception, match="unequal"):
        one(spark, A.zipped(a, F.array(F.lit(2))))


def test_json(spark):
    df = spark.createDataFrame([(1, None, b"x", "é")], "a int, b string, c binary, d string")
    assert json.loads(J.to_lines(df).first()["value"]) == {"a": 1, "d": "é"}
    assert one(spark, J.call_id(F.lit("x"))).startswith("call_")
    picks = [r["x"] for r in spark.range(300).select(J.pick(["a", "b", "c"], "s", F.col("id")).alias("x")).collect()]
    assert set(picks) == {"a", "b", "c"} and picks == [r["x"] for r in spark.range(300).select(J.pick(["a", "b", "c"], "s", F.col("id")).alias("x")).collect()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=60))
def test_first_fit_decreasing(sizes):
    placed = P.first_fit_decreasing(sizes, 10)
    bins: list[int] = []
    want = {}
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((b for b, load in enumerate(bins) if load + sizes[i] <= 10), len(bins))
        if b == len(bins):
            bins.append(0)
        bins[b] += sizes[i]
        want[i] = b
    assert {i: b for i, (b, _) in enumerate(placed)} == want and all(x <= 10 for x in bins)


def test_packing_cases(spark):
    for sizes, n in (([6, 5, 4, 4], 2), ([7, 7, 6, 4, 4, 3, 3], 4), ([10], 1), ([], 0)):
        df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
        packed = P.pack(df, "id", "size", 10)
        loads = [r["s"] for r in packed.groupBy("bin_id").agg(F.sum("size").alias("s")).collect()]
        assert len(loads) == n and all(x <= 10 for x in loads) and packed.count() == len(sizes)
    big = spark.createDataFrame([(0, 12), (1, 3)], "id long, size long")
    with pytest.raises(Exception, match="over the capacity"):
        P.pack(big, "id", "size", 10).collect()
    assert P.pack(big, "id", "size", 10, isolate=True).select("bin_id").distinct().count() == 2
    stats = P.pack_stats(P.pack(spark.createDataFrame([(0, 6), (1, 4), (2, 5)], "id long, size long"), "id", "size", 10), "size").first()
    assert (stats["bins"], stats["items"], stats["most"], stats["least"], stats["load"]) == (2, 3, 2, 1, 10)


def test_pack_queries_keep_whole_sizes(spark, tmp_path):
    sizes = [3, 8000, 8001, 20_000, 5000, 3000, 128_657]
    rows = [(i, f"s{i}", n) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["pack_ffd"](spark, str(tmp_path)).collect()}
    assert [got[i]["size"] for i in range(len(sizes))] == sizes
    bins = [got[i]["bin_id"] for i in range(len(sizes))]
    assert len({bins[k] for k in (0, 1, 2, 3, 4, 6)}) == 6 and bins[4] == bins[5]
    stats = QUERIES["pack_stats"](spark, str(tmp_path)).first()
    assert (stats["bins"], stats["items"], stats["most"], stats["load"]) == (6, 7, 2, 128_657)
    assert sorted(r["sources"] for r in QUERIES["pack_gather"](spark, str(tmp_path)).collect()) == ["s0", "s1", "s2", "s3", "s4,s5", "s6"]


def test_order_by_size_is_whole(spark, tmp_path):
    rows = [(i, i * 37 % 50) for i in range(333)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["order_by_size"](spark, str(tmp_path)).collect()]
    assert got == sorted(rows, key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("ranges", [None, 4])
def test_positions_and_shards(spark, ranges):
    df = spark.range(0, 211, 2).withColumn("split", (F.col("id") % 3).cast("string"))
    got = R.position(df, "id", "split", ranges=ranges).collect()
    for s in "012":
        own = sorted((r["id"], r["rn"]) for r in got if r["split"] == s)
        assert [n for _, n in own] == list(range(len(own)))
    for world in (3, 7, 200):
        shards = R.shards(df, "id", world, ranges=ranges).collect()
        assert len(shards) == 106 and [r["shard"] for r in sorted(shards, key=lambda r: r["id"])] == sorted(r["shard"] for r in shards)
    assert R.shards(df, "id", 7, keep_rest=False, ranges=ranges).count() == 105
    assert R.head_portion(df, "id", 0.5, ranges=ranges).count() == 53 and R.head_portion(df, "id", 0.0, ranges=ranges).count() == 0
    assert R.add_id(df, "id") is df and "row" in R.add_id(df, "id", name="row", ranges=ranges).columns


def test_row_steps(spark):
    df = spark.range(10)
    report = {r["rule"]: (r["rows_in"], r["removed"], r["removed_pct"]) for r in R.filter_report(df, even=F.col("id") % 2 == 0, small=F.col("id") < 3).collect()}
    assert report == {"even": (10, 5, 50.0), "small": (5, 3, 60.0)}
    assert R.run_steps(df, [lambda d: d.where("id > 2"), lambda d: d.where("id < 5")]).count() == 2
    with pytest.raises(ValueError):
        R.select_except(df, ["id"], ["id"])
    assert R.sample(df, 4, "s", "id").count() == 4 and R.halves(df, "s", "id").count() == 5
    files = spark.createDataFrame([(9, "optimizer.pt"), (10, "optimizer.pt"), (9, "config.json"), (9, "model-1.safetensors")], "step int, name string")
    assert [r["name"] for r in R.retention(files).where("delete").collect()] == ["optimizer.pt"]
    kept = ["preprocessor_config.json", "video_preprocessor_config.json", "vocab.json", "merges.txt", "special_tokens_map.json", "added_tokens.json", "chat_template.jinja", "model.safetensors.index.json"]
    files = spark.createDataFrame([(1, n) for n in [*kept, "trainer_state.json"]] + [(2, "optimizer.pt")], "step int, name string")
    assert [r["name"] for r in R.retention(files).where("delete").collect()] == ["trainer_state.json"]
    for n in (0, 1, 7, 5000):
        some = {r["id"] for r in R.halves(spark.range(n), "s", "id").collect()}
        order = [r["id"] for r in spark.range(n).orderBy(J.salted("s", F.col("id")), "id").collect()]
        assert some == set(order[: n // 2])
    steps = R.standard_steps("a_set", True, "k", 5, lambda d: d.where("k <> 3"), lambda d: d.withColumn("m", F.lit(1)), lambda d: d.withColumn("num_tokens", F.col("k") + F.col("m")))
    assert sorted((r["id"], r["num_tokens"]) for r in R.run_steps(spark.range(9).withColumnRenamed("id", "k"), steps).collect()) == [(0, 1), (1, 2), (2, 3), (4, 5)]
    assert R.run_steps(spark.range(9).withColumnRenamed("id", "k"), R.standard_steps("mnist", True, "k", 5, None, None, None)).columns == ["k", "id"]
    with pytest.raises(ValueError, match="num_tokens"):
        R.require(df, "num_tokens")


def test_prompts_by_name(spark, caplog):
    chat = F.array(C.says("user", F.lit("q")), C.says("assistant", F.lit("a")))
    out = one(spark, C.with_prompts(chat, [F.lit(1)], "one,gone,two", "three", ({"one": ["1"], "two": ["2"]}, {"three": ["3"]})))
    assert [[p["text"] for p in m["content"]] for m in out][:3] == [["1", "3"], ["2"], ["q"]] and "gone" in caplog.text


def test_catalogue_makes_conversations(spark, tmp_path):
    items = spark.createDataFrame([(1, "q1", "a1", "i.png", None), (2, "q2", "AP", None, "v.mp4")], "id int, question string, answer string, image string, video string")
    items.write.parquet(f"{tmp_path}/items")
    sets = {"qa": SO.Dataset(f"{tmp_path}/items", media_dir="media"), "list": SO.Dataset(f"{tmp_path}/items", list_field="pairs"), "xray": SO.Dataset(f"{tmp_path}/items", maker="radiology", question="Is {question} there?", view_question="Which view of {question}?")}
    catalog = SO.Catalog(spark, sets)
    rows = {r["id"]: r["messages"] for r in catalog.conversations("qa").collect()}
    assert [m["role"] for m in rows[1]] == ["user", "user", "assistant"] and rows[2][0]["content"][0]["type"] == "video" and rows[1][0]["content"][0]["uri"] == "media/i.png"
    assert len(catalog.conversations("qa", training=False).first()["messages"]) == 2
    asked = {r["id"]: r["messages"][1]["content"][0]["text"] for r in catalog.conversations("xray").collect()}
    assert asked == {1: "Is q1 there?", 2: "Which view of q2?"}
    with pytest.raises(ValueError, match="inference"):
        catalog.conversations("list", training=False)
    with pytest.raises(ValueError, match="unknown maker"):
        catalog.add("x", SO.Dataset("p", maker="none"))


def test_scores(spark):
    rows = [("Yes.", "yes, it is"), ("yes", "No"), ("no", "perhaps"), ("maybe", "yes"), ("no", None), ("No", "well it is no")]
    df = spark.createDataFrame(rows, "answer string, model_answer string")
    r = S.score(df).first()
    assert (r["total"], r["correct"], r["incorrect"], r["invalid"]) == (5, 1, 1, 3) and r["accuracy_with_invalid"] == 0.2 and r["accuracy_without_invalid"] == 0.5
    assert S.score(df.where("false")).first()["accuracy_with_invalid"] is None
    with pytest.raises(Exception, match="no row"):
        S.score(df.where("false"), strict=True).collect()
    matrix = S.confusion(df, "answer", "model_answer")
    assert sum(x["n"] for x in matrix.collect()) == 3
    judged = spark.createDataFrame([(True,), (False,), (None,)], "is_correct boolean")
    j = S.judge_summary(judged, invalid_is_wrong=True).first()
    assert (j["total"], j["correct"], j["invalid"], j["incorrect"], j["accuracy_valid"]) == (3, 1, 1, 2, 0.5)
    assert S.judge_summary(judged.where("false")).first()["accuracy"] == 0.0


def test_statistics(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), float(rng.randint(0, 9)), rng.gauss(0, 1)) for _ in range(400)] + [("a", float("nan"), 1.0), ("a", None, 2.0)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    import numpy as np

    for r in ST.significant(ST.pearson(df, "x", "y", "g")).collect():
        own = np.array([(x, y) for g, x, y in data if g == r["g"] and x is not None and x == x])
        assert r["r"] == pytest.approx(np.corrcoef(own.T)[0, 1]) and r["n"] == len(own)
        assert (r["r_significant"] is None) == (r["p"] > 0.05)
    assert ST.correlation_p(10, 0.6) == pytest.approx(0.066688, abs=1e-5) and ST.correlation_p(2, 0.5) is None and ST.correlation_p(5, 1.0) == 0.0
    assert one(spark, ST.quadrant(F.lit(36))) == 3 and one(spark, ST.quadrant(F.lit(3))) == 0


def test_conversations(spark):
    qa = F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer")))
    no = F.lit(None).cast("string")
    m = one(spark, C.vqa_maker(qa, F.lit("i.png"), no, folder=F.lit("m")))
    assert [x["role"] for x in m] == ["user", "user", "assistant"] and m[0]["content"][0]["uri"] == "m/i.png"
    assert [x["role"] for x in one(spark, C.vqa_maker(qa, no, no, training=False))] == ["user", "user"]
    with pytest.raises(Exception, match="not both"):
        one(spark, C.vqa_maker(qa, F.lit("i"), F.lit("v")))
    with pytest.raises(Exception, match="unknown item type"):
        one(spark, C.typed_maker(F.lit("z"), qa, no, no, strict=True))
    assert one(spark, C.typed_maker(F.lit("z"), qa, no, no)) is None and one(spark, C.typed_maker(no, qa, no, no)) is None
    options = C.open_options(F.lit('{"B": "two", "A": 1, "x y": null, "C": "th \\"ree"}'))
    assert one(spark, C.choice_text(F.lit("q"), options)) == 'Question: q\nOption B: two\nOption A: 1\nOption x y: None\nOption C: th "ree\n'
    assert one(spark, C.text_maker(F.lit("t")))[0]["role"] == "assistant"
    chat = F.array(C.says("system", F.lit("s")), C.message("user", C.part("image", F.lit("u")), C.part("text", F.lit("t"))))
    assert one(spark, C.contents(chat, "text")) == ["s", "t"] and [p["uri"] for p in one(spark, C.media_of(chat))] == ["u"]
    out = one(spark, C.prompt_role_first(chat, "user", F.lit("p"), 1))
    assert [p["text"] for p in out[1]["content"]] == [None, "p", "t"]
    assert one(spark, C.prompt_role_first(chat, "assistant", F.lit("p"))) == one(spark, chat)
    order = one(spark, C.prompt_order(chat, [F.lit("s1"), F.lit("s2")], [F.lit("c1")]))
    assert [x["content"][0]["text"] for x in order][:3] == ["s1", "s2", "c1"]
    assert C.to_rows(spark.range(1).select("id", chat.alias("m")), "m", "id").count() == 3


@pytest.mark.parametrize("template,ask,text_only", list(itertools.product([True, False], repeat=3)))
def test_feature_invariants(spark, template, ask, text_only):
    rows = spark.createDataFrame([(1, 0, "system", "Be kind.", 0), (1, 1, "user", "What is it?", 6), (1, 2, "assistant", "A cat, 3 y old.", 0), (2, 0, "user", "Hi", 4), (2, 1, "assistant", "yes " * 10, 0)], "conv_id int, turn int, role string, text string, media int")
    media = F.when(F.col("media") > 0, F.array(F.struct(F.lit("image").alias("kind"), F.col("media").alias("tokens"))))
    out = K.features(rows, template=template, generation_prompt=ask, media=media, text_only=text_only)
    plain = {r["conv_id"]: len(r["input_ids"]) for r in K.features(rows, template=template, generation_prompt=ask).collect()}
    assert {r["conv_id"]: len(r["input_ids"]) - plain[r["conv_id"]] for r in out.collect()} == ({1: 3, 2: 3} if text_only else {1: 8, 2: 6})
    for r in out.collect():
        assert len(r["input_ids"]) == len(r["labels"]) and all(b in (-100, a) for a, b in zip(r["input_ids"], r["labels"], strict=True))
        assert sum(b == -100 for b in r["labels"]) > (1 if text_only else 4)
    for side in ("left", "right"):
        padded = K.batch(out.withColumn("b", F.lit(0)), "b", side).collect()
        assert len({len(r["input_ids"]) for r in padded}) == 1
        for r in padded:
            assert len(r["labels"]) == len(r["attention_mask"]) == len(r["input_ids"]) and all(m or (i == 0 and b == -100) for i, b, m in zip(r["input_ids"], r["labels"], r["attention_mask"], strict=True))


def test_tool_calls(spark):
    texts = ["none", 'a <tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call> b', "<tool_call>{bad</tool_call>", '<tool_call>\n{"name": "g"}\n</tool_call><tool_result>r</tool_result>', '<tool_call>{"name":"a"}</tool_call><tool_call>{"name":"b"}</tool_call>']
    got = [r["x"] and (r["x"]["name"], r["x"]["arguments"]) for r in column(spark, texts).select(TC.parse(F.col("x")).alias("x")).collect()]
    assert got == [None, ("f", '{"x":1}'), None, ("g", "{}"), ("a", "{}")]
    assert [r["x"] for r in column(spark, texts).select(TC.strip_calls(F.col("x")).alias("x")).collect()] == ["none", "a  b", "", "", ""]
    odd = ['{"name": "f"} junk', '{"name": "f"}, {"name": "g"}', "{'name': 'f'}", '{"arguments": {"q": [1, "a"]}}', "[1]", '{"name": "f"', '"f"', '{"name": "f", "arguments": {"a": {"b": null}}} ', "", "5"]
    got = [r["x"] and (r["x"]["name"], r["x"]["arguments"]) for r in column(spark, [f"<tool_call>{x}</tool_call>" for x in odd]).select(TC.parse(F.col("x")).alias("x")).collect()]
    assert got == [None, None, None, (None, '{"q":[1,"a"]}'), None, None, None, ("f", '{"a":{"b":null}}'), None, None]
    assert one(spark, TC.strip_calls(TC.format_result(F.lit("r"), F.lit("call_1")))) == "" and one(spark, TC.format_result(F.lit("r"), F.lit("c"))) == "<tool_result id='c'>r</tool_result>"
    assert one(spark, TC.format_call(F.lit("f"), F.lit('{"x": 1}'))) == '<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>'
    assert one(spark, TC.parse(TC.format_call(F.lit('a "b" \\ c'), F.lit("{}"))))["name"] == 'a "b" \\ c'
    again = TC.parse(TC.format_call(F.lit("f"), F.lit('{"x":1}')))
    assert one(spark, again)["arguments"] == '{"x":1}'
    assert one(spark, TC.extend_mask(F.array(F.lit(0)), F.lit(2))) == [0, 1, 1]


def test_grids(spark):
    df = spark.range(200).withColumn("label", (F.col("id") % 10).cast("int"))
    for per_class in (1, 2):
        cells = SY.compose(df, "id", "label", 2, 2, per_class).collect()
        assert cells and len({r["id"] for r in cells}) == len(cells)
        by = {}
        for r in cells:
            by.setdefault(r["grid"], []).append(r)
        for own in by.values():
            assert sorted((r["row"], r["col"]) for r in own) == [(0, 0), (0, 1), (1, 0), (1, 1)] and len({r["label"] for r in own}) == 4 // per_class
    with pytest.raises(ValueError):
        SY.compose(df, "id", "label", 2, 2, 3)
    assert one(spark, SY.label_text(F.lit(12), ["a"])) is None


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(2, "q", "yes", "yes"), (1, "é", "no", None)], SO.RESULT)
    SO.write_jsonl(rows.repartition(2), str(tmp_path / "parts"))
    gathered = SO.gather_jsonl(spark, str(tmp_path / "parts"), str(tmp_path / "all"), SO.RESULT)
    assert sorted(map(tuple, gathered.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    (tmp_path / "judged.json").write_text(json.dumps([{"id": 1, "question": "q", "answer": "a", "model_answer": "m", "is_correct": True}, {"id": 2}]))
    assert SO.read_json_array(spark, str(tmp_path / "judged.json")).where("is_correct").count() == 1
    SO.write_csv(rows, str(tmp_path / "csv"), "id")
    assert [r["id"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["1", "2"]
    SO.write_summary(rows.groupBy().count(), str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).first()["count"] == 2
    SO.save(rows.withColumn("split", F.lit("train")), str(tmp_path / "t"), split="split")
    catalog = SO.Catalog(spark, {"d": SO.Dataset(str(tmp_path / "t"))})
    assert catalog.load("d", "train").count() == 2 and catalog.load("d", "test").count() == 0 and catalog.view("d").count() == 2
    assert SO.is_done(spark, str(tmp_path / "t")) and not SO.is_done(spark, str(tmp_path / "none"))
    with pytest.raises(KeyError):
        catalog.load("x")
    with pytest.raises(ValueError):
        catalog.add("y", SO.Dataset("p", maker="?"))
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.mp4").write_bytes(b"x")
    files = SO.listing(spark, str(tmp_path / "files"))
    items = spark.createDataFrame([("a.mp4",), ("b.mp4",)], "name string")
    assert R.present(items, files, "name").count() == R.absent(items, files, "name").count() == 1
    assert SO.read_text(spark, str(tmp_path / "judged.json")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, "q", "yes" if i % 2 else "No.", ["yes", "no", "hm"][i % 3]) for i in range(30)], SO.RESULT)
    SO.write_jsonl(rows.repartition(3), str(tmp_path / "in"))
    query = STREAM.start(STREAM.running_score(STREAM.read_results(spark, str(tmp_path / "in"))), "scores", str(tmp_path / "ck"))
    query.awaitTermination(60)
    got, want = spark.sql("select * from scores").first(), S.score(rows, filter_name="yes_no").first()
    assert (got["total"], got["correct"], got["invalid"]) == (want["total"], want["correct"], want["invalid"])


def test_outside_judge(spark):
    rows = spark.createDataFrame([(1, "q", "a", "a"), (2, "q", "a", "b"), (3, "q", "a", None)], SO.RESULT)
    judged = S.judged_by(rows, lambda part: [None if m is None else m == a for a, m in zip(part["answer"], part["model_answer"], strict=True)])
    r = S.judge_summary(judged).first()
    assert (r["total"], r["correct"], r["invalid"]) == (3, 1, 1)


def test_quantiles_and_ranks_by_ranges(spark):
    import numpy as np

    rng = random.Random(4)
    rows = [(rng.choice("ab"), float(rng.choice([1, 2, 2, 3, rng.randrange(500)]))) for _ in range(3000)] + [("a", None), ("b", float("nan")), ("c", 5.0), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["low"], r["mid"]) for r in ST.quantiles(df, "x", {"low": 0.25, "mid": 0.5}, "g").collect()}
    for g in ("a", "b", "c", None):
        own = [x for k, x in rows if k == g and x is not None and not math.isnan(x)]
        assert got[g] == pytest.approx(tuple(np.quantile(own, [0.25, 0.5])))
    clean = df.where("x is not null and not isnan(x)")
    ranked = ST.average_ranks(clean, "x", "rank", "g").collect()
    for g in ("a", "b", "c", None):
        own = [x for k, x in rows if k == g and x is not None and not math.isnan(x)]
        assert sorted((r["x"], r["rank"]) for r in ranked if r["g"] == g) == sorted((x, sum(y < x for y in own) + (sum(y == x for y in own) + 1) / 2) for x in own)


@pytest.mark.parametrize("inside", [2_000_000, 20])
def test_quantiles_by_brackets(spark, monkeypatch, inside):
    """Narrow brackets, ties, infinities and single values against numpy; a group of one value holds most rows."""
    import numpy as np

    monkeypatch.setattr(ST, "INSIDE", inside)
    rng = random.Random(9)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randint(0, 3))) for _ in range(500)] + [("c", 7.0)] + [(None, float(k)) for k in range(10)] + [("d", 1.0)] * 4000
    rows += [("e", float("inf")), ("e", 1.0), ("e", float("-inf")), ("f", None), ("a", None), ("a", float("nan"))]
    shares = {"zero": 0.0, "low": 0.25, "odd": 0.337, "high": 0.75, "one": 1.0}
    got = {r["g"]: r for r in ST.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(4), "x", shares, "g").collect()}
    for g in ("a", "b", "c", None, "d"):
        own = [v for k, v in rows if k == g and v is not None and not math.isnan(v)]
        assert [got[g][k] for k in shares] == pytest.approx(np.quantile(own, list(shares.values())).tolist(), abs=1e-12)
    assert got["e"]["zero"] == float("-inf") and got["e"]["one"] == float("inf") and "f" not in got
    whole = [v for _, v in rows if v is not None and math.isfinite(v)]
    assert ST.quantiles(spark.createDataFrame([(v,) for v in whole], "x double"), "x", {"m": 0.5}).first()["m"] == pytest.approx(np.median(whole), abs=1e-12)
    assert ST.quantiles(spark.createDataFrame([], "x double, g int"), "x", {"m": 0.5}, "g").collect() == []


def test_spearman_by_ranks(spark):
    import pandas as pd

    rng = random.Random(10)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(6)]), rng.choice([float(k) for k in range(40)])) for _ in range(600)] + [("c", 1, 2.0)] * 3
    got = {r["g"]: r for r in ST.spearman(spark.createDataFrame(rows, "g string, x int, y double").repartition(4), "x", "y", "g").collect()}
    for g in ("a", "b", None):
        own = pd.DataFrame([(x, y) for k, x, y in rows if k == g and x is not None], columns=["x", "y"])
        assert got[g]["n"] == len(own) and got[g]["r"] == pytest.approx(own["x"].rank().corr(own["y"].rank()), abs=1e-12)
    assert got["c"]["n"] == 3 and got["c"]["r"] is None


def test_rank_correlations_with_p_values(spark, sf_dir):
    import pandas as pd

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").toPandas()
    got = QUERIES["spearman_pvalue_mask"](spark, sf_dir).collect()
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    groups = {k: g for k, g in rows.groupby(keys)}
    assert len(got) == len(groups) > 20
    for r in got:
        own = groups[tuple(r[k] for k in keys)]
        want = own["l_discount"].rank().corr(own["l_tax"].rank())
        assert r["n"] == len(own) and (r["r"] is None if pd.isna(want) else r["r"] == pytest.approx(want, abs=1e-9))
        if r["r"] is not None:
            p = ST.correlation_p(len(own), r["r"])
            assert r["p"] == pytest.approx(p) and (r["r_significant"] is None) == (p > 0.05)
    # 5 and 10 pairs: known values of Student's t
    assert ST.correlation_p(10, 0.6319) == pytest.approx(0.05, abs=2e-4) and ST.correlation_p(5, 0.8783) == pytest.approx(0.05, abs=2e-4)
