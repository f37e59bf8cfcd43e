"""Placement of op8 and scores of op9 against plain searches and plain Python, whole."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import packing, toxicity

# Packing ----------------------------------------------------------------------------------------------------------


def plain_windows(lengths, size, bound):
    """(full windows in the order they are emitted, open ones): pieces are (document, start, length); each choice looks at all windows."""
    emitted, open_, opened = [], [], 0
    for doc, total in enumerate(lengths):
        start = 0
        while total - start >= size:
            emitted.append([(doc, start, size)])
            start += size
        while start < total:
            need, room = total - start, lambda w: size - sum(p[2] for p in w[1])
            fits = [w for w in open_ if room(w) >= need]
            if not fits and len(open_) < bound:
                opened += 1
                open_.append((opened, [(doc, start, need)]))
                break
            chosen = min(fits or open_, key=lambda w: (room(w), w[0]))  # least room that holds it, else the fullest
            took = min(need, room(chosen))
            chosen[1].append((doc, start, took))
            start += took
            if not room(chosen):
                open_.remove(chosen)
                emitted.append(chosen[1])
    return emitted, open_


@pytest.mark.parametrize("size,bound", [(8, 1), (8, 2), (16, 3), (64, 5), (64, 64)])
def test_windows_by_plain_search(size, bound):
    rng = random.Random(size * bound)
    for _ in range(40):
        lengths = [rng.choice([1, 2, rng.randint(1, size), rng.randint(1, 3 * size), size, size - 1]) for _ in range(rng.randint(0, 150))]
        windows, got = packing.Windows(size, bound), []
        for doc, n in enumerate(lengths):
            ids = np.arange(n, dtype="<u4").tobytes()
            for w in windows.add(doc, ids):
                got.append([(d, s, len(part) // 4) for d, s, part, total in w])
                assert all(total == lengths[d] and np.frombuffer(part, "<u4").tolist() == list(range(s, s + len(part) // 4)) for d, s, part, total in w)
        emitted, open_ = plain_windows(lengths, size, bound)
        assert [sorted(w) for w in got] == [sorted(w) for w in emitted] and all(sum(p[2] for p in w) == size for w in got)
        assert sorted(sorted((d, s, len(part) // 4) for d, s, part, _ in windows.pieces[w]) for _, w in windows.rooms) == sorted(sorted(p) for _, p in open_)
        full, rest = windows.close()
        assert all(sum(len(p[2]) // 4 for p in w) == size for w in full) and sum(len(p[2]) // 4 for p in rest) < size


def test_repeated_rows_and_extra_columns_are_packed(spark):
    text = "some words that are packed " * 30
    rows = [(1, text, 5, 6, 7, "x"), (1, text, 5, 6, 7, "y"), (None, text, 1, 2, 3, "z"), (None, None, 0, 0, 0, ""), (2, "", 1, 1, 1, "w")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, part long, ord long, start long, ids string"), bound=2, fan=2).collect()
    by = Counter()
    for r in got:
        by[r["doc_id"], r["doc_tokens"]] += r["length"]
    n = next(t for d, t in by if d == 1)
    assert by[1, n] == 2 * n and by[None, n] == n and by[None, 1] == 1 and by[2, 1] == 1


# Toxicity ---------------------------------------------------------------------------------------------------------


def plain_features(text, odds):
    """The features of a text, word by word."""
    words = text.split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    n, hits, values, stems, stem_values, you, odd, odd_hits, long = len(words), [], [], 0, 0.0, [], 0, 0, 0
    for i, raw in enumerate(words):
        word = raw.lower() if raw.isalpha() else re.sub(r"^[\W_]+|[\W_]+$", "", raw.lower())
        value = max(odds.get(word, 0.0), 4.0 if word in toxicity.SEED else 0.0)
        values.append(value)
        hidden = False
        if not raw.isalpha() and re.search(r"[^\W\d_][\d@$!*|._-]+[^\W\d_]", raw):
            clean = re.sub(r"\W|_", "", "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": " ", "|": "l"}.get(c, c) for c in raw.lower()))
            hidden = clean in toxicity.SEED or clean in odds
            odd += 1
            odd_hits += hidden
        if value > 0 or hidden:
            hits.append(i)
        stem = max((odds.get(word[:k] + "*", 0.0) for k in (4, 5) if len(word) > k), default=0.0)
        stems += stem > 0
        stem_values += stem
        if word in toxicity.YOU:
            you.append(i)
        long += bool(word.isalpha() and re.search(r"(.)\1\1", word))
    near = sum(min(abs(i - j) for j in you) <= toxicity.NEAR for i in hits) / len(hits) if hits and you else 0
    count = lambda f: sum(map(f, text))
    upper, lower = count(lambda c: "A" <= c <= "Z"), count(lambda c: "a" <= c <= "z")
    marks = count(lambda c: c.isascii() and c.isprintable() and not c.isalnum() and c != " ")
    return [
        len(hits) / n, math.log1p(len(hits)), max(values), sum(values) / n, stems / n, math.log1p(stems), near, len(you) / n, upper / max(1, upper + lower), count(lambda c: c in "!?") / n, marks / n, odd / n, odd_hits,
        math.log1p(stem_values), long / n, math.log1p(n),
    ]


def plain_score(model, x):
    """The trees node by node, the calibration by a search of its knots."""
    margin = model.trees.base
    for col, cut, value in model.trees.trees:
        node = 0
        for _ in range(model.trees.depth):
            edges = model.trees.edges[col[node]]
            node = 2 * node + 1 + (sum(e <= x[col[node]] for e in edges) > cut[node])
        margin += value[node - (2**model.trees.depth - 1)]
    plain = 1 / (1 + math.exp(-margin))
    if model.knots is None:
        return plain
    at, to = model.knots
    k = int(sum(a <= margin for a in at))
    y = to[0] if k == 0 else to[-1] if k == len(at) else to[k - 1] + (to[k] - to[k - 1]) * (margin - at[k - 1]) / (at[k] - at[k - 1])
    return min(1.0, max(0.0, (1 - toxicity.TIE) * y + toxicity.TIE * plain))


def test_toxicity_scores_by_plain_python(spark):
    rng = random.Random(31)
    good, bad = "the day was calm and we went home by tram tú Straße".split(), "you idiot scum are trash id10t m0r0n dumb du STUPID! loooser id.iot".split()
    docs = []
    for k in range(600):
        words = [rng.choice(bad if rng.random() < (0.35 if k % 3 == 0 else 0.02) else good) + rng.choice(["", "", "", ",", "!", "?", "..."]) for _ in range(rng.randint(0, 60))]
        docs.append((k, rng.choice([" ", "  ", "\n"]).join(words) if words else rng.choice(["", None, " \n"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = toxicity.train(frame, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int"))
    assert model.trees is not None and model.knots is not None
    texts = dict(docs)
    for r in toxicity.score(frame, model).collect():
        x = plain_features(texts[r["doc_id"]] or "", model.odds)
        assert toxicity.features(texts[r["doc_id"]] or "", toxicity.Lexicon(model.odds)) == pytest.approx(x, abs=1e-12), texts[r["doc_id"]]
        assert r["_tessera_score"] == pytest.approx(plain_score(model, x), abs=1e-9)
