"""Spelling variants, centroids and URL filters against plain Python, on small awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import centroids, spelling, urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "word string, n long, key long, cluster int, distance long, host string, path string, rule string, score double, vector array<double>"
NONE = ("x", 1, 2, 3, 4, "h", "p", "r", 0.5, [1.0])


# Spelling ---------------------------------------------------------------------------------------------------------


def plain_vocabulary(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for w, n in words.items():
        near = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for row in out.values():
        while row[1] in out and out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {(w, *row) for w, row in out.items()}


def documents(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, *NONE) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(partitions)


def found_variants(spark, folder, rows):
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    out = spelling.op11_spelling(spark, str(folder))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_words(rng, n):
    base = ["".join(rng.choice("abceinorst\u00e9\u00df\u00c9\u00d7") for _ in range(rng.randint(5, 9))) for _ in range(n)]
    for w in list(base):
        for _ in range(3):
            k, c = rng.randrange(len(w)), rng.choice("abnot\u00e9\u00f6\u00d6")
            base.append(rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]]))
    return base


def test_spelling_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = some_words(rng, 120)
    weights = [2 ** rng.randrange(8) for _ in words]
    rows = [(i, rng.choice([" ", ", ", "-7", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(5, None), (None, "letter letter letter lettr lettr lettr"), (7, ""), (8, "letter " * 50_000), (9, "a" * 5000 + " " + "a" * 4999 + "b "), *[(10, "a" * 5000 + " " + "a" * 4999 + "b")] * 3]
    want = plain_variants(plain_vocabulary(rows))
    assert found_variants(spark, tmp_path, rows) == want
    assert any(r[2] != r[1] and r[2] != r[0] for r in want), "no chain of forms"


def test_spelling_of_the_smallest_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.op11_spelling(spark, sf_dir).collect()} == plain_variants(plain_vocabulary(rows))


def test_spelling_slips_and_ties(spark, tmp_path):
    doc = next(i for i in range(10_000) if zlib.crc32(f"{i}:spelling".encode()) % 97 == 0)
    assert len(spelling.slipped(zlib.crc32(f"{doc}:".encode()), "spelling")) == 7
    rows = [(doc, "Spelling " * 3), (doc + 1, "spelling " * 9), (doc + 2, "wordab " * 3 + "wordac " * 6 + "wordad " * 6)]
    want = plain_variants(plain_vocabulary(rows))
    assert found_variants(spark, tmp_path, rows) == want
    assert ("wordab", "wordac", "wordac", 3, 2, 6) in want and any(r[1] == "spelling" for r in want)


def test_spelling_of_empty_tables(spark, tmp_path):
    assert found_variants(spark, tmp_path / "a", []) == set()
    assert found_variants(spark, tmp_path / "b", [(1, None), (2, "one two"), (None, "")]) == set()


def test_long_texts_are_searched_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab\u00e9 \n7") for _ in range(3000))
    want = spelling.RUN.findall(text)
    for size in (1, 2, 7, 100, 5000):
        monkeypatch.setattr(spelling, "PIECE", size)
        assert [w for part in spelling.runs(text) for w in part] == want
    assert spelling.lowered("A\u00c9Z\u0130") == "a\u00c9z\u0130"


# Centroids --------------------------------------------------------------------------------------------------------


def plain_lloyd(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in first[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centers]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in kept]
        centers = [[sum(x) // len(part) for x in zip(*part, strict=True)] if (part := [v for (_, v), o in zip(kept, own, strict=True) if o == c]) else old for c, old in enumerate(centers)]
    last = [nearest(v) for _, v in kept]
    by = Counter()
    for c, d in last:
        by[c] += d
    return sorted(((i, c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, last, strict=True)), key=str)


def found_clusters(spark, folder, rows, partitions=3):
    spark.createDataFrame([(*r, *NONE) for r in rows], f"vec_id long, embedding array<float>, {EXTRA}").repartition(partitions).write.parquet(f"{folder}/embeddings.parquet")
    out = centroids.op12_centroids(spark, str(folder))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def some_vectors(rng, n):
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in rng.choice(middles)]) for i in range(n)]


def test_centroids_by_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = some_vectors(rng, 150)
    same = [0.25] * 64
    rows += [(1000, same)] * 120 + [(1000, [-0.25] * 64), (None, same), (None, [3.0] * 64)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [1.0] * 63 + [None]), (2005, [1.0] * 63 + [float("nan")]), (2006, [float("-inf")] + [1.0] * 63)]
    assert found_clusters(spark, tmp_path, rows) == plain_lloyd(rows)


def test_centroids_agree_with_sql(spark, tmp_path):
    rows = some_vectors(random.Random(6), 200) + [(500, [1.0] * 63 + [None]), (501, [1.0])]
    found = found_clusters(spark, tmp_path, rows)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(duck.execute(centroids.OP12_SQL).fetchall(), key=str) == found == plain_lloyd(rows)


@pytest.mark.parametrize("n", [0, 1, 39])
def test_few_vectors(spark, tmp_path, n):
    rows = [(i, [float(i % 3)] * 64) for i in range(n)]
    assert found_clusters(spark, tmp_path, rows, 2) == plain_lloyd(rows)
    assert found_clusters(spark, tmp_path / "none", [(1, None)] * (n + 1)) == []


def test_huge_components_count_as_the_bound(spark, tmp_path):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.5] * 64)]
    by = {r[0]: r for r in found_clusters(spark, tmp_path, rows)}
    assert all(by[i][2] == 0 for i in (1, 2, 3)) and len({by[i][1] for i in (1, 2, 3)}) == 3


# URLs -------------------------------------------------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.fullmatch(r"([^/?#]*)([^?#]*)(.*)", url.split("://", 1)[1], re.S)
    return m[1].translate(LOWER), m[2]


def plain_rule(host, path):
    fits = [r for r in urls.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(str(r)), default=None)


ODD = [
    None, "", "example.net/en/x", "://", "http://", "HTTP://A.Example.NET/EN/x", "http://a.example.net/en/x", "http://example.net/en/", "http://example.net/en", "http://example.net", "http://notexample.net/en/",
    "http://net/", "http://net", "http://xnet/", "http://a.net/?q=1", "http://a.net?q=1", "http://a.net#top", "https://m.example.com/de/1", "https://example.com/DE/1", "https://a.org/fr/", "https://org/fr/x?y=/en/",
    "http://a.net/x://b.org/fr/", "http://b.org?u=http://a.net/", "http://\u00c4.NET/\u00e9%20", "http://..net/", "x" * 100_000 + "://a.net/" + "y/" * 100_000, "http://" + "a." * 100_000 + "com/de/",
]


def pages(spark, folder, found, partitions=3):
    rows = [(i, u, "<p>", *NONE) for i, u in enumerate(found)]
    spark.createDataFrame([*rows, *rows[:3]], f"page_id long, url string, html string, {EXTRA}").repartition(partitions).write.parquet(f"{folder}/pages.parquet")


def test_url_rules_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    made = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'm.', 'www.'])}{rng.choice(['example', 'other', 'casino-win'])}.{rng.choice(['net', 'com', 'org', 'NET'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(1, 99)}{rng.choice(['', '?a=1&b=2', '#x', '.html'])}" for _ in range(300)]
    pages(spark, tmp_path, ODD + made)
    out = urls.op13_urls(spark, str(tmp_path))
    assert out.columns == ["page_id", "host", "path", "rule", "score", "verdict"]
    rows = out.collect()
    assert len(rows) == len(ODD) + len(made) + 3
    for r in rows:
        host, path = plain_parts((ODD + made)[r["page_id"]])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, str(rule) if rule else None)
        assert r["verdict"] == (rule.action if rule else "block" if r["score"] >= 0.5 else "allow") and (r["score"] is None) == bool(rule)


def test_longer_rules_win():
    own = urls.Rules([urls.Rule("block", "a.b.com", "/"), urls.Rule("allow", "b.com", "/xx/"), urls.Rule("block", "com", "/xx/y"), urls.Rule("allow", "com", "/")])
    assert str(own.find("a.b.com", "/xx/yy")) == "b.com/xx/" and str(own.find("a.b.com", "/")) == "a.b.com/" and str(own.find("c.com", "/xx/y")) == "com/xx/y"
    assert own.find("", "/") is None and own.find("org", "/") is None


@pytest.mark.parametrize("found", [[], [None], ["http://a.com/1"] * 4, ["http://a.net/1"] * 4])
def test_urls_without_both_labels_are_allowed(spark, tmp_path, found):
    pages(spark, tmp_path, found)
    for r in urls.op13_urls(spark, str(tmp_path)).collect():
        assert r["verdict"] == ("block" if r["rule"] == "net/" else "allow")


def test_url_trees_on_hosts_never_seen(spark):
    """Labels given by the caller; held-out hosts share no name with those learned from."""
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(5, 12)))

    def good():
        return f"https://{name()}.{rng.choice(['com', 'org', 'de'])}/{name()}/{name()}.html"

    def bad():
        return f"http://{name()}-{rng.randint(10, 9999)}-{name()}.{rng.choice(['com', 'win', 'top'])}/?aff={rng.randint(1, 10**9)}&sub={name()}"

    def known(n):
        return [(u, y) for _ in range(n) for u, y in ((good(), 0), (bad(), 1))]

    learn, held = known(400), known(200)
    model = urls.train(spark.createDataFrame([(u,) for u, _ in learn + held], "url string"), known=learn)
    right = [(s >= 0.5) == bool(y) for s, (_, y) in zip(model.score([u for u, _ in held]).tolist(), held, strict=True)]
    assert sum(right) / len(right) > 0.97
    again = urls.fit(learn[::-1], model.stats)
    assert again.score([u for u, _ in held]).tolist() == model.score([u for u, _ in held]).tolist()


def test_suffix_figures_cover_all_urls(spark):
    rows = ["http://a.com/x.html"] * 600 + ["http://b.org/"] * 399 + ["http://c.zz/y.pdf"]
    stats = urls.suffix_figures(spark.createDataFrame([(u,) for u in rows], "url string").repartition(5), [(rows[0], 0), (rows[-1], 1), (rows[-1], 1)])
    assert stats.host["com"] == pytest.approx((math.log(0.6), (20 * 2 / 3) / 21)) and stats.host["zz"][0] == pytest.approx(math.log(0.001)) and stats.host["zz"][1] == pytest.approx((2 + 20 * 2 / 3) / 22)
    assert set(stats.file) == {"html", "", "pdf", None}
