"""run() of the corpus pipeline on a small fixture: the rows of each stage against plain Python."""

from __future__ import annotations

import glob
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import brute_groups, brute_mix, key

import corpus_pipeline
from tessera.llm import packing


@pytest.fixture(scope="module")
def docs():
    """Toxic texts, which all hold one word; lines that several share; near copies of two texts; sources of uneven size."""
    rng, out = random.Random(9), []
    vocabulary = ["an", "reti", "onst", "the", "of", "blea", "tion", "é", "ß", *(f"w{k}" for k in range(300))]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = [sentence(9) for _ in range(3)], [sentence(70) for _ in range(2)]
    for i in range(500):
        if i % 4 == 0:
            words = sentence(rng.randint(20, 60)).split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zorgol")
            text = " ".join(words)
        elif i % 4 == 1:
            text = "\n".join([sentence(rng.randint(5, 40)), rng.choice(shared), sentence(12), rng.choice(shared).upper()])
        elif i % 20 == 2:
            words = base[i // 20 % 2].split()
            words[rng.randrange(70)] = f"edit{i}"
            text = " ".join(words)
        else:
            text = sentence(rng.randint(1, 80))
        out.append((i, text, "hot" if i % 3 else f"s{i % 5}"))
    return [*out, (900, "", "hot"), (901, None, "s1")]


def test_pipeline(spark, docs, tmp_path):
    full = [(i, t, "en", s, len(t or "")) for i, t, s in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    toxic = {i for i, t, _ in docs if "zorgol" in (t or "")}
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/pipeline-*"))
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    (folder,) = set(glob.glob(f"{shared}/pipeline-*")) - before
    stage = lambda k: [(r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{folder}/{k}").collect()]
    by_id = lambda rows: sorted(rows, key=lambda r: r[0])

    assert by_id(stage(0)) == [(i, t, s, n) for i, t, _, s, n in full if i not in toxic] and toxic

    holders = defaultdict(set)
    for i, t, _, _ in stage(0):
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    want = []
    for i, t, s, _ in by_id(stage(0)):
        text = "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == i)
        want.append((i, text, s, len(text)))
    assert by_id(stage(1)) == want and any(len(h) > 1 and len(k) >= 10 for k, h in holders.items())

    groups = brute_groups([r[:3] for r in want])
    kept = {g if n else i for i, (n, g) in groups.items()}
    assert by_id(stage(2)) == [r for r in want if r[0] in kept] and len(kept) < len(want)

    ready = [r[:3] for r in by_id(stage(2))]
    copies, rows = Counter(r[0] for r in stage(3)), {r[0]: r for r in stage(2)}
    assert set(copies.values()) == {1, 2} and all(r == rows[r[0]] for r in stage(3))
    size, _, target, source = brute_mix(ready)
    taken = Counter()
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(size[i] for i in source if source[i] == s)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in ready}
    tokens, windows = Counter(), defaultdict(list)
    for r in result:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        for at in range(r["start"], r["start"] + r["length"]):
            tokens[r["doc_id"], at] += 1
    assert tokens == {(i, at): n for i, n in copies.items() for at in range(len(ids[i]))}
    for own in windows.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 2048
