"""The operators against plain Python, on small awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import importance, jaccard, licenses, lines, merkle, mixing, packing, pii, repetition, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key double, size int, id string, n int, shard int, h1 string, block long"


def table(spark, rows, partitions=3):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, "en", s, len(t or ""), 0.5, 7, "x", 1, 2, "h", 3) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared lines, nulls, empty, short, long and non-ASCII texts; a hot source and a hot copy."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "on", "é", "ß", "Th", "x"]) for _ in range(rng.randint(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    shared = [sentence(12), "  Shared LINE of words\t", "short"]
    base = [sentence(60) for _ in range(4)]
    out = []
    for i in range(120):
        kind = i % 8
        if kind == 0:
            text = base[i % 4]
        elif kind == 1:
            own = base[i % 4].split(" ")
            own[rng.randrange(len(own))] = "edit"
            text = " ".join(own)
        elif kind == 2:
            text = "\n".join([sentence(9), rng.choice(shared), sentence(8), rng.choice(shared).upper()])
        elif kind == 3:
            text = sentence(rng.randint(1, 6))
        elif kind == 4:
            text = "  \n\t\n"
        else:
            text = "\n".join(sentence(rng.randint(3, 40)) for _ in range(rng.randint(1, 6)))
        out.append((i * 3, text, None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}"))
    out += [(900, None, "hot"), (901, "", None), (902, "word " * 9000, "hot"), (903, "one", "Ünï"), (904, "ONE", "s1")]
    return out


def key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def test_line_dedup(spark, rows):
    got = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, rows)).collect()}
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    for i, t, _ in rows:
        own = (t or "").split("\n")
        left = [x for x in own if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        assert got[i]["_tessera_kept"] == "\n".join(left)
        assert (got[i]["_tessera_lines"], got[i]["_tessera_dropped"]) == (len(own), len(own) - len(left))
    assert any(r["_tessera_dropped"] for r in got.values())
    assert set(got[900].asDict()) >= {"key", "size", "id", "shard"}


def test_line_dedup_repeated_and_null_ids(spark):
    rows = [(7, "the same long line", "a"), (7, "the same long line", "a"), (None, "the same long line\nb", "a"), (None, "another long line", None)]
    got = sorted((str(r["doc_id"]), r["_tessera_kept"]) for r in lines.dedup_lines(table(spark, rows)).collect())
    assert got == [("7", "the same long line"), ("7", "the same long line"), ("None", "another long line"), ("None", "b")]


def test_cuckoo_filter_is_reversible():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    f = lines.CuckooFilter(5000)
    f.insert(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 2**64, 20000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.01
    g = lines.CuckooFilter.from_bytes(f.to_bytes())
    assert g.contains(keys).all()
    g.delete(keys[:2500])
    assert g.contains(keys[2500:]).all() and g.contains(keys[:2500]).mean() < 0.01


def test_reference_counts_undo_an_insertion(spark, rows):
    docs = table(spark, rows)
    some = docs.where("doc_id % 2 = 0")
    both, one = lines.references(docs, 8), lines.references(some, 8)
    left = both.join(docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("gone")), F.col("id") == F.col("gone"), "left_anti")
    as_set = lambda df: {tuple(r) for r in lines.counts(df).select("h1", "h2", "n", "keeper").collect()}
    assert as_set(left) == as_set(one)


def test_lines_insert_and_delete_follow_in_filters(spark, rows):
    docs, shards = table(spark, rows), 4
    as_set = lambda df: {tuple(r) for r in df.collect()}
    counted = lambda refs: as_set(lines.counts(refs).select("h1", "h2", "n", "keeper"))

    def agrees(refs, blobs, whole):
        built, _ = lines.state(whole, shards)
        assert counted(refs) == counted(built)
        held = {r["shard"]: lines.CuckooFilter.from_bytes(r["blob"]) for r in blobs.collect()}
        assert len(held) == blobs.count()
        due, rest = defaultdict(list), defaultdict(list)
        for r in lines.counts(built).collect():
            (due if r["keeper"] < r["last"] else rest)[r["shard"]].append(r["h1"])
        assert all(held[s].contains(np.array(h, np.int64).view(np.uint64)).all() for s, h in due.items())
        assert {s: int((f.table > 0).sum()) + len(f.stash) for s, f in held.items() if (f.table > 0).any()} == {s: len(h) for s, h in due.items()}
        assert sum(held[s].contains(np.array(h, np.int64).view(np.uint64)).sum() for s, h in rest.items() if s in held) <= 2
        passed = lines.candidates(refs, blobs).join(lines.counts(refs).where("keeper < last").select("h1", "h2", "keeper"), ["h1", "h2"]).where("id > keeper")
        want = {r["id"]: {tuple(k) for k in r["keys"]} for r in lines.drops(whole, shards).collect()}
        got = defaultdict(set)
        for r in passed.collect():
            got[r["id"]].add((r["h1"], r["h2"]))
        assert got == want

    first, batch = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 > 0")
    refs, blobs = lines.state(first, shards)
    refs, blobs = lines.insert(refs, blobs, batch, shards)
    agrees(refs, blobs, docs)
    refs, blobs = lines.insert(refs, blobs, batch, shards)  # once more: nothing to add
    refs, blobs = lines.delete(refs, blobs, docs.where("doc_id % 4 = 2"))
    agrees(refs, blobs, docs.where("doc_id % 4 != 2"))
    refs, blobs = lines.delete(refs, blobs, docs.where("doc_id % 4 != 2"))
    assert refs.count() == 0 and not any(lines.CuckooFilter.from_bytes(r["blob"]).table.any() for r in blobs.collect())


def test_merkle_neighbours_and_likeness(spark, rows):
    got = {r["doc_id"]: r for r in merkle.fingerprints(table(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    prints = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(got[i]["fingerprint"], t) == t
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (t == edited)
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert len(prints) == len({t for _, t in order})
    long = [r for r in got.values() if 300 < r["n_chars"] < 3000]
    assert np.mean([r["near_edited"] for r in long]) > 0.35 > np.mean([r["near_next"] for r in long])


def test_merkle_single_document_and_empty_table(spark):
    one = merkle.fingerprints(table(spark, [(5, "a b c\nd e f", "s")])).first()
    assert one["near_next"] == 1.0
    assert merkle.fingerprints(table(spark, [(1, "x", "s")]).where("false")).count() == 0


def test_merkle_diff_locates_edits(spark):
    rng, pairs = random.Random(17), {}
    for k in range(60):
        a = [f"paragraph {rng.randrange(25)} of this text" for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            at = rng.randrange(len(b) + 1)
            kind = rng.randrange(4)
            if kind == 0 or not b:
                b.insert(at, f"paragraph {rng.randrange(40)} of this text")
            elif kind == 1:
                del b[min(at, len(b) - 1)]
            elif kind == 2:
                b[min(at, len(b) - 1)] = "edited"
            else:
                b.insert(at, b.pop(rng.randrange(len(b))))
        pairs[k] = ("\n".join(a), "\n".join(b))
    text = [f"paragraph number {i} of this text" for i in range(30)]
    pairs |= {100: ("\n".join(text), "\n".join([*text[:17], "edited", *text[18:]])), 101: ("\n".join(text), "\n".join([*text[:5], *text[6:]])), 102: ("\n".join(text), "\n".join([*text[:5], text[6], text[5], *text[7:]])), 103: (None, ""), 104: ("a", None)}
    found = defaultdict(list)
    for r in merkle.diff(spark.createDataFrame([(k, *v) for k, v in pairs.items()], "k int, a string, b string"), "k", "a", "b").collect():
        found[r["k"]].append((r["level"], r["change"], r["a_pos"], r["b_pos"]))
    for k, (a, b) in pairs.items():
        a, b = (a or "").split("\n"), (b or "").split("\n")
        gone = Counter(a[p] for level, c, p, _ in found[k] if c == "removed")
        new = Counter(b[p] for level, c, _, p in found[k] if c == "added")
        assert gone == Counter(a) - Counter(b) and new == Counter(b) - Counter(a)
        assert all(a[p] == b[q] for level, c, p, q in found[k] if c == "moved" and level == "paragraph")
        assert a != b or not found[k]
    assert sorted(found[100]) == [("paragraph", "added", None, 17), ("paragraph", "removed", 17, None)] or set(found[100]) == {("paragraph", "added", None, 17), ("paragraph", "removed", 17, None)}
    assert found[101] == [("paragraph", "removed", 5, None)] and {c for _, c, _, _ in found[102]} == {"moved"} and not found[103]


def test_merkle_likeness_survives_a_shift(spark):
    """A word put into a long paragraph changes the leaf around it only; the sketch is near the exact share of leaves."""
    rng, rows = random.Random(19), []
    for k in range(20):
        words = [rng.choice(["and", "the", "reti,", "onst", "blea.", "y", "tion", "ed"]) + str(rng.randrange(99)) * (rng.random() < 0.3) for _ in range(400)]
        words = [w if w[-1] in ".," else w for w in words]
        other = [*words]
        other.insert(rng.randrange(3), f"word{k}")
        rows.append((k, " ".join(words), " ".join(other)))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    df = merkle.with_tree(merkle.with_tree(df, "a", "a_"), "b", "b_").withColumn("la", merkle.leaves("a")).withColumn("lb", merkle.leaves("b"))
    for r in df.select(merkle.likeness("a_root", "a_sketch", "b_root", "b_sketch").alias("near"), merkle.exact_likeness("la", "lb").alias("exact"), F.size(F.flatten("la")).alias("n")).collect():
        assert r["n"] > 40 and r["exact"] > 0.9 and abs(r["near"] - r["exact"]) < 0.1


def plain_leaves(paragraph):
    """Leaves by the rule, word by word, in plain Python."""
    marked = ""
    for w in re.findall("[^ ]+ *| +", paragraph):
        if len(w) > merkle.LONG:
            marked += "".join(c + "\x01" * ((ord(c) * 31 + (ord(w[i - 1]) if i else 0)) % merkle.PAIRS == 0) for i, c in enumerate(w))
        else:
            marked += w + "\x01" * ((ord(w[0]) * 31 + (ord(w[1]) if len(w) > 1 else 0) * 7 + len(w)) % merkle.WORDS == 0)
    return [hashlib.md5(x.encode()).hexdigest() for x in re.findall("[^\x01]{1,%d}\x01*|\x01+" % merkle.LEAF, marked)]


def test_merkle_leaves_follow_content_in_any_script(spark):
    """One word or code point put in anywhere keeps nine in ten leaves, whatever the script and with or without blanks."""
    rng = random.Random(23)
    some = lambda letters, lo, hi: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    cyrillic, cjk = "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x4E00, 0x5200)))
    made = {
        "latin": " ".join(some("etaoinshrdlu", 1, 9) for _ in range(800)), "cyrillic": " ".join(some(cyrillic, 1, 11) for _ in range(800)), "cjk": some(cjk, 4000, 4000),
        "code": "".join(rng.choice(["function", "(a,b)", "{return ", "a+b;}", "var ", "x=", "[1,2]", ";", "if(!", "c)", "d.e", some("abcxyz", 1, 4)]) for _ in range(1500)), "no blanks": some("abcdefghijklmnopqrstuvwxyz0123456789", 5000, 5000),
        "hex": some("0123456789abcdef", 4000, 4000), "astral": some("".join(map(chr, range(0x1F300, 0x1F400))), 3000, 3000),
    }
    rows = []
    for name, text in made.items():
        for new in (some("xyz", 5, 5) + " ", rng.choice(text)):
            for at in (0, rng.randrange(len(text)), len(text)):
                rows.append((name, text, text[:at] + new + text[at:]))
    rows += [("odd", "a\x01b  c", "a\x01\x01b  c"), ("odd", " lead and  two ", "\x01"), ("odd", "", "x" * 300)]
    df = spark.createDataFrame(rows, "name string, a string, b string").withColumn("la", merkle.leaves("a")).withColumn("lb", merkle.leaves("b")).withColumn("exact", merkle.exact_likeness("la", "lb"))
    for r in df.collect():
        assert (r["la"], r["lb"]) == ([plain_leaves(r["a"])], [plain_leaves(r["b"])]), r["name"]
        if r["name"] != "odd":
            assert r["exact"] > 0.9 and len(r["la"][0]) > 40, (r["name"], r["exact"], len(r["la"][0]))
    assert plain_leaves("ab cd") != plain_leaves("ab \x01cd") and plain_leaves("a\x01b") != plain_leaves("ab")


def brute_importance(docs, labels, k):
    """Scores and the kept rows, by counting in plain Python: one n-gram at a time."""
    mask = 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def roll(own):
        h = 0
        for x in own:
            h = (h * 0x9E3779B97F4A7C15 + x) & mask
        return mix(h)

    def grams(text):
        words = (text or "").encode().split()
        word = [importance.xxhash.xxh3_64_intdigest(w.lower()) for w in words]
        form = [importance.shape(w) ^ (0x5BD1E995 if i and word[i] == word[i - 1] else 0) for i, w in enumerate(words)]
        out = [roll(word[i : i + n]) % importance.WORD_BUCKETS for n in (1, 2) for i in range(len(words) - n + 1)]
        return out + [mix(roll(form[i : i + n]) + n) % importance.SHAPE_BUCKETS + importance.WORD_BUCKETS for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    own = {i: grams(t) for i, t in docs}
    raw, target = Counter(g for v in own.values() for g in v), Counter(g for i, v in own.items() if labels.get(i) for g in v)
    score = {}
    for i, v in own.items():
        total = 0.0
        for lo, hi in ((0, importance.WORD_BUCKETS), (importance.WORD_BUCKETS, importance.BUCKETS)):
            t_sum, r_sum = sum(target[g] + 1e-9 for g in range(lo, hi)), sum(raw[g] + 1.0 for g in range(lo, hi))
            for g in v:
                if lo <= g < hi:
                    p = (raw[g] + 1.0) / r_sum
                    total += np.log((0.5 * (target[g] + 1e-9) / t_sum + 0.5 * p) / p)
        score[i] = max(-importance.BOUND, min(importance.BOUND, total)) if v else importance.EMPTY
    u = {i: (int(hashlib.md5(f"dsir:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in own}
    key = {i: score[i] - np.log(-np.log(u[i])) for i in own}
    return score, set(sorted(key, key=lambda i: (-key[i], i))[:k])


def test_importance_against_brute_force(spark, rows):
    docs = [(i, t) for i, t, _ in rows if i != 902]
    labels = {i: int(i % 2 == 0) for i, _ in docs if i % 5 < 4}
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    k = int(len(docs) * sum(labels.values()) / len(labels) + 0.5)
    score, kept = brute_importance(docs, labels, k)
    got = importance.resample(table(spark, [(i, t, "s") for i, t in docs]), marks).collect()
    assert {r["doc_id"]: r["_tessera_weight"] for r in got} == pytest.approx(score)
    assert {r["doc_id"] for r in got if r["kept"]} == kept


def test_mixing_by_a_quality_column(spark, rows):
    """Heavier documents come first: of equal sizes, the share taken rises with the weight; slices stay level."""
    docs = [(i, "word " * 5, "s", 1.25 if i % 2 else 0.3) for i in range(2000)] + [(5000 + i, "word " * 40, f"t{i % 2}", None) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, value double")
    taken = defaultdict(int)
    for r in mixing.mix(frame, share=0.2, quality="value").where("source = 's'").collect():
        taken[r["doc_id"] % 2] += r["copies"]
    assert taken[1] > 1.5 * taken[0] > 0
    slices = mixing.sized(frame, slices=64).where("source = 's'").groupBy("slice").count().collect()
    assert max(r["count"] for r in slices) < 2000 / 64 * 5


def test_licenses(spark):
    mit = [s for n, s in licenses.SENTENCES if n in ("mit.grant", "mit.keep", "as-is", "no-liability")]
    texts = {
        1: "Intro.\nReleased under the MIT License.\nMore words", 2: "words Licensed under CC BY-NC 4.0 by us", 3: "Licensed under CC BY-NC 4.0.", 4: "This work is licensed under the GNU General Public License, version 3.",
        5: "# " + ".\n# ".join(s.replace(" of this software ", "\n# of this software ", 1) for s in mit) + ".", 6: None, 7: "", 8: "Neither the name of Foo Bar Inc. nor",
        9: "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", 10: "mit license is nice. permission is hereby granted",
    }
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(table(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == {1: "MIT", 2: "", 3: "CC-BY-NC-4.0", 4: "GPL-3.0", 5: "MIT", 6: "", 7: "", 8: "", 9: "Apache-2.0", 10: ""}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; ", "-- "])
@pytest.mark.parametrize("width", [100, 78, 60, 40])
def test_licenses_wrapped(width, mark):
    for name, text in (("MIT", MIT), ("Apache-2.0", APACHE), ("BSD-3-Clause", BSD)):
        wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
        marked = "\n".join(mark + line for line in ["", *wrapped.split("\n")])
        end = len(marked)
        found = licenses.sentences(marked + ".\n", licenses.tree())
        assert licenses.apply_rules(found) == [(name, 1 + 2 * len(mark), end)], (name, found)


def test_licenses_gap():
    root, (grant, keep) = licenses.tree(), MIT.split("\n\n")[:2]
    unknown = "Some other sentence of version 1.2, see\nhttp://a.b/c.d?e=f;g,\nwrapped over lines\nmore than once.\n"
    for n, want in ((0, ["MIT"]), (4, ["MIT"]), (5, [])):
        text = f"{grant}\n{unknown * n}{keep}\n"
        assert [r[0] for r in licenses.apply_rules(licenses.sentences(text, root))] == want
    far = "." + " " * 200 + "Released under the MIT License."
    assert [r[0] for r in licenses.apply_rules(licenses.sentences(far, root))] == ["MIT"]
    for text, want in (("This file is released under the MIT License.", ["MIT"]), ("All of it is, unless noted, licensed under CC BY-SA 4.0.\n", ["CC-BY-SA-4.0"]), ("It was unlicensed under the MIT License.", []), ("// x = 1; // SPDX-License-Identifier: MIT\n", ["MIT"])):
        assert [r[0] for r in licenses.apply_rules(licenses.sentences(text, root))] == want


@pytest.mark.parametrize("text,want", [
    ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("# SPDX-License-Identifier: LGPL-2.1-or-later\n", "LGPL-2.1"), ("// SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"), ("/* SPDX-License-Identifier: ISC */", "ISC"),
    ("SPDX-License-Identifier: CC0-1.0\ncode", "CC0-1.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\n", "Apache-2.0,BSD-3-Clause,MIT"), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0"), ("SPDX-License-Identifier: GPL-3.0 WITH MIT", "GPL-3.0"), ("SPDX-License-Identifier: Unknown-1.0 OR MIT", "MIT"),
    ("SPDX-License-Identifier: Unknown-1.0", ""), ("SPDX-License-Identifier: MIT is what we chose", "MIT"), ("SPDX-License-Identifier:", ""), ("x = 1 // SPDX-License-Identifier: Zlib", "Zlib"),
    ("Licensed under the GNU Lesser General Public License version 3", "LGPL-3.0"), ("Released under the GNU General Public License version 2.", "GPL-2.0"), ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("This code is available under the terms of the GNU GPL v3 or later.", "GPL-3.0"), ("Released under the 3-clause BSD license.", "BSD-3-Clause"), ("Licensed under the Eclipse Public License 2.0.", "EPL-2.0"), ("Published under the zlib/libpng license.", "Zlib"), ("Licensed under MIT.", "MIT"),
    ("This work is not licensed under the MIT license.", ""), ("It isn't released under the MIT license.", ""), ("It was never, ever released under the MIT License.", ""), ("Not ours. Released under the MIT License.", "MIT"), ("This file, which is not mine to change, is released under the MIT License.", "MIT"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n", "AGPL-3.0"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n", "Zlib"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n", "EPL-2.0"),
])
def test_licenses_named(text, want):
    found = licenses.sentences(text, licenses.tree())
    assert ",".join(sorted({r[0] for r in licenses.apply_rules(found)})) == want, found


@pytest.mark.parametrize("licence", sorted(licenses.NAMES))
def test_each_licence_by_tag_and_by_its_names(licence):
    root = licenses.tree()
    own = lambda text: [r[0] for r in licenses.apply_rules(licenses.sentences(text, root))]
    for end in ("", "-only", "-or-later"):
        assert own(f"-- SPDX-License-Identifier: {licence}{end} --") == [licence]
    for name in licenses.NAMES[licence]:
        for text in (f"It is released under the {name.upper()}.", f"Licensed under the terms of {name}\n", f"words (distributed under {name}, or any later version)"):
            assert own(text) == [licence], text


def test_spans_of_an_expression():
    text = "# SPDX-License-Identifier: MIT OR Apache-2.0\n"
    rules = licenses.apply_rules(licenses.sentences(text, licenses.tree()))
    assert [(r[0], text[r[1] : r[2]]) for r in rules] == [("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "Apache-2.0")]


def brute_rules(found):
    """Rules in order, each from the left over what is left, by plain search."""
    left, out = list(found), []
    for licence, needed in licenses.RULES:
        again = True
        while again:
            again = False
            for i in range(len(left)):
                took, at = [], i
                for name in needed:
                    if took:
                        near = [k for k in range(took[-1] + 1, len(left)) if left[k][3] - left[took[-1]][3] <= licenses.GAP + 1]
                    else:
                        near = [at]
                    at = next((k for k in near if left[k][0] == name), None)
                    if at is None:
                        break
                    took.append(at)
                if len(took) == len(needed):
                    out.append((licence, left[took[0]][1], left[took[-1]][2]))
                    left = [f for k, f in enumerate(left) if k not in took]
                    again = True
                    break
    return sorted(out, key=lambda r: r[1:])


def test_licenses_against_brute_force(spark):
    """Texts made of known and unknown sentences: identifiers by construction, rules by plain search."""
    rng, known = random.Random(21), [(n, s) for n, s in licenses.SENTENCES if "*" not in s]
    full = [x for x in known if not x[0].endswith(".notice")]
    texts, wanted, total = [], [], 0
    for k in range(300):
        parts, ids = [], []
        for _ in range(rng.randint(0, 12)):
            if rng.random() < 0.7:
                name, sentence = rng.choice(full if rng.random() < 0.8 else known)
                words = [rng.choice([w, w.upper(), w.capitalize()]) for w in sentence.split()]
                parts.append("".join(w + rng.choice([" ", "  ", "\n", "\n# ", ", "]) for w in words[:-1]) + words[-1])
                ids.append(name)
            else:
                parts.append(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 9))))
        texts.append("".join(p + rng.choice([". ", ".\n", ".\n\n"]) for p in parts))
        wanted.append(",".join(ids))
    for r in licenses.scan_licenses(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        found = licenses.sentences(texts[r["doc_id"]], licenses.tree())
        rules = brute_rules(found)
        assert r["sentence_ids"] == wanted[r["doc_id"]]
        assert r["spans"] == ",".join(f"{a}:{b}:{c}" for a, b, c in rules) and r["licenses"] == ",".join(sorted({x[0] for x in rules}))
        total += len(rules)
    assert total > 300


def test_licenses_many_notices_in_seconds():
    import time

    began, n = time.time(), 100_000
    found = licenses.sentences("Released under the MIT License.\n" * n, licenses.tree())
    assert len(licenses.apply_rules(found)) == n and time.time() - began < 30


def brute_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = set()
    for k in range(len(words) - 4):
        if windows[tuple(words[k : k + 5])] > 1:
            hit |= set(range(k, k + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_repetition_base(spark, rows):
    more = [*rows, (950, "a b c d e f g h a b c d e i j k l m n o p q r s t u v w x y z aa bb cc #*", "s"), (951, "x y " * 4 + "p q r s t u v w z", "s")]
    for r in repetition.repetition_rules(table(spark, more)).collect():
        text = next(t for i, t, _ in more if i == r["doc_id"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(text)
        assert not (r["base_failed"] and r["kept"])


def brute_verdict(text, limits=repetition.NGRAM_LIMITS):
    """(shares of each length, first rule that fails) from lists of windows."""
    words = WORD.findall(text or "")
    chars = sum(map(len, words))
    shares = []
    for n, _ in limits:
        windows = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        hit = {k + j for k in range(len(words) - n + 1) if windows[tuple(words[k : k + n])] > 1 for j in range(n)}
        shares.append(sum(len(words[k]) for k in hit) / max(1, chars))
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    again = [line for k, line in enumerate(lines) if line in lines[:k]]
    if brute_base(text)[-1]:
        return shares, "base"
    for (n, limit), share in zip(limits, shares):
        if share > limit:
            return shares, f"ngram_{n}"
    if sum(len(w) for line in again for w in WORD.findall(line)) > repetition.LINE_CHARS_LIMIT * chars:
        return shares, "line_chars"
    if "\n" in text and len(again) > repetition.LINES_LIMIT * len(lines):
        return shares, "lines"
    return shares, None


def test_repetition_verdict_against_brute_force(spark, rows):
    rng, more = random.Random(12), []
    for i in range(400):  # phrases and passages of several lengths, lines and symbols that repeat more or less often
        parts = [[f"{rng.choice('abé')}{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 10, 14]))] for _ in range(rng.randint(1, 12))]
        body = [w for _ in range(rng.randint(2, 14)) for w in rng.choice(parts)] + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 90))]
        if i % 2:  # phrases of up to four words twice, in other orders
            parts = [p[:4] for p in parts] * 2
            body = [w for p in rng.sample(parts, len(parts)) for w in p] + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))]
        lines_ = [" ".join(body)] + ["one line of these"] * rng.choice([0, 0, 0, 3]) + ["# * $ %"] * rng.choice([0, 0, 1])
        more.append((5000 + i, "\n".join(lines_), "s"))
    every, reasons = [*rows, *more], Counter()
    texts = {i: t for i, t, _ in every}
    for r in repetition.repetition_rules(table(spark, every)).collect():
        shares, reason = brute_verdict(texts[r["doc_id"]])
        assert r["shares"] == pytest.approx(shares) and (r["kept"], r["reason"]) == (reason is None, reason)
        assert r["covered_share"] == pytest.approx(max(shares[3:]))
        reasons[reason] += 1
    assert {"base", "ngram_2", "ngram_3", "ngram_4", "lines", None} <= set(reasons), reasons


@pytest.mark.parametrize("length,passages,others,other,reason", [(2, 6, 6, "s{:04}", "ngram_2"), (3, 6, 17, "s{:04}", "ngram_3"), (4, 6, 29, "s{:04}", "ngram_4"), (4, 6, 48, "s{:04}", None), (5, 2, 81, "{:03}", "ngram_5"), (6, 2, 123, "{:03}", "ngram_6"), (7, 2, 152, "{:03}", "ngram_7"), (8, 2, 184, "{:03}", "ngram_8"), (9, 2, 219, "{:03}", "ngram_9"), (10, 2, 258, "{:03}", "ngram_10"), (12, 1, 155, "{:03}", "ngram_10"), (10, 1, 100, "s{:04}", None)])
def test_repetition_each_length_decides(length, passages, others, other, reason):
    """Passages that occur twice, in reverse order the second time, so that no longer window repeats; the limit of
    one length alone decides the verdict."""
    parts = [[f"p{k:02}{j:02}" for j in range(length)] for k in range(passages)]
    words = [w for p in [*parts, *parts[::-1]] for w in p] + [other.format(k) for k in range(others)]
    assert len({tuple(words[k : k + length + 1]) for k in range(len(words) - length)}) == len(words) - length or length == 12
    text = " ".join(words)
    assert not brute_base(text)[-1]
    got = repetition.measure([text.encode()])[0]
    assert (got[6], got[10]) == (reason is None, reason)
    loose = tuple((n, 1.0 if f"ngram_{n}" == reason else limit) for n, limit in repetition.NGRAM_LIMITS)
    assert repetition.measure([text.encode()], loose)[0][6]


def test_repetition_together_and_alone(rows):
    texts = [(t or "").encode() for _, t, _ in rows] + [b"\xff\xfe not utf-8 " * 30, b"x" * 1_000_000 + b" y" * 50]
    assert repetition.measure(texts) == [repetition.measure([t])[0] for t in texts]
    assert [t for g in repetition.groups(texts, 500) for t in g] == texts


def brute_spans(text):
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out["card"] = [m.span() for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return out


def test_private_base_spans():
    scanner, rng = pii.Scanner(), random.Random(2)
    parts = ["a@b.co", "@", "a.b@c", ".", "1.2.3.4", "999.1.1.1.5", " ", "+1 (505) 555-2408", "+", "4111 1111 1111 1111", "4901293795153942", "12", "-", "é", "x@y@z.w-q.r", "+49 12 ", "(", "0.0.0.0", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        found = scanner.spans(text)
        assert {k: found[k] for k in pii.BASE} == brute_spans(text), text
    assert scanner.spans("IBAN: DE89 3704 0044 0532 0130 00.")["iban"] and not scanner.spans("IBAN: DE88 3704 0044 0532 0130 00.")["iban"]
    assert pii.mask("mail a@b.co now", scanner) == "mail <EMAIL> now"


def test_private_query_shape(spark, rows):
    got = pii.find_private(table(spark, rows)).collect()
    assert len(got) == len(rows) and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}


def brute_mix(rows):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in by[s]) for s in names}
    free, left, target = set(names), 1.5 * sum(total.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        free -= over
    return size, total, target, {i: s for s in by for i in by[s]}


def test_mixing(spark, rows):
    got = {r["doc_id"]: r for r in mixing.mix(table(spark, rows), slices=4).collect()}
    size, total, target, source = brute_mix(rows)
    taken = Counter()
    for i, r in got.items():
        assert r["size"] == size[i] and r["source_size"] == total[source[i]]
        assert r["target"] == pytest.approx(target[source[i]], abs=1e-5)
        assert r["taken"] in (0, size[i], 2 * size[i])
        taken[source[i]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(size[i] for i in source if source[i] == s)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(table(spark, rows, 7), slices=2048).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix(table(spark, rows).where("false")).count() == 0


def test_mixing_salted(spark, rows, monkeypatch):
    one = {r["doc_id"]: r["taken"] for r in mixing.mix(table(spark, rows)).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(table(spark, rows)).collect()} == one


def test_packing_round_trip(spark, rows):
    more = [*rows, (960, "<|endoftext|> special don't İ", "s"), (961, "twice", "s")]
    got = packing.pack(table(spark, more), bound=3, fan=2).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in more}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, ids in want.items():
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for own in windows.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert sum(r["length"] for r in own) <= 2048
    total = sum(map(len, want.values()))
    assert len(windows) * 2048 - total < 2 * 2048  # a padded window for each group of two tasks
    assert packing.pack(table(spark, rows).where("false")).count() == 0


def test_packing_ids_of_letters_before_marks():
    """Each letter of Unicode in front of each mark: normalising may turn it into a letter and a combining mark."""
    from tokenizers import Tokenizer

    words, tok = packing.Words(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha() and (ord(c) < 0x3000 or ord(c) % 97 == 0)]
    for mark in packing.Words.MARKS:
        texts = [f"{c}{mark} a{c}{mark}{mark}" for c in letters]
        want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert words.encode(texts) == want


def test_packing_words_in_runs():
    """Words tokenised together have the ids they have alone, also where a vocabulary marks no word ends."""
    w = packing.Words(packing.tokenizer_path())
    letters = [chr(i) for i in range(0xAA, 0x100) if chr(i).isalpha()]
    words = [a + "ing" + b for a in letters for b in letters] + ["s", "ll", "Aaa", "z" * 300]
    alone = w._ids(words)
    assert w._words(words) == alone and w._words([]) == []
    w.ends[:] = False
    assert w._words(words[:1201]) == alone[:1201]


def test_packing_long_chunks_are_not_kept():
    words = packing.Words(packing.tokenizer_path())
    texts = [f"{k}{'ab' * 50_000}. short{k}." for k in range(5)]
    ids = words.encode(texts)
    assert sum(map(len, words.known)) < 1000
    assert ids == [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_trees_first_split_is_the_best():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 4)).round(1), (rng.random(80) < 0.4).astype(float)
    t = toxicity.Trees(rounds=1, depth=1, bins=200).fit(x, y)
    p = 1 / (1 + np.exp(-t.base))
    g, h, best = p - y, np.full(80, p * (1 - p)), {}
    for j in range(4):
        for v in np.unique(x[:, j]):
            left = x[:, j] < v
            if h[left].sum() >= 0.5 and h[~left].sum() >= 0.5:
                best[j, v] = sum(g[m].sum() ** 2 / (h[m].sum() + t.penalty) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + t.penalty)
    (col, cut, _), = t.trees
    left = t._binned(x)[:, col[0]] <= cut[0]
    gain = sum(g[m].sum() ** 2 / (h[m].sum() + t.penalty) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + t.penalty)
    assert gain > 0.9 * max(best.values()) and gain <= max(best.values()) + 1e-9


def test_isotonic_is_the_least_squares_fit():
    """Against the min-max formula: the fit at i is the greatest over a <= i of the least mean of y[a..b], b >= i."""
    rng = np.random.default_rng(5)
    x = np.arange(60.0)
    y = (rng.random(60) < x / 80).astype(float)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    at, value = toxicity.isotonic(x, y)
    assert np.interp(x, at, value) == pytest.approx(want, abs=1e-9)


def test_toxicity_learns(spark):
    rng = random.Random(3)
    words = ["an", "reti", "onst", "the", "of", "blea", "tion"]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["zorgol", "Grumlix!", "idiot"]))
        docs.append((i, " ".join(text), "s"))
        labels.append((i, int(bad)))
    docs += [(1000, None, "s"), (1001, "", "s"), (None, "you idiot", "s")]
    frame, marks = table(spark, docs), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(frame, marks)
    score = {r["doc_id"]: r["_tessera_score"] for r in toxicity.score(frame, model).collect()}
    held = [(score[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert all(0 <= s <= 1 for s in score.values()) and score[1000] == score[1001] < 0.5 <= score[None]
    kept = toxicity.without_toxic(frame, marks)
    assert kept.columns == frame.columns and 300 < kept.count() < 500
    none = toxicity.train(frame, marks.where("false"))
    assert {r[0] for r in toxicity.score(frame, none).select("_tessera_score").distinct().collect()} == {0.0}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(float)
    at, value = toxicity.isotonic(x, y)
    assert (np.diff(value) >= -1e-12).all() and (np.diff(at) >= 0).all()


def test_importance(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["an", "the", "onst", "reti", "of"]) + rng.choice(["", "", ","]) for _ in range(50))
    bad = lambda: " ".join(rng.choice(["WIN!!", "$$$", "CASH!!"]) for _ in range(50))
    docs = [(i, bad() if i % 5 == 0 else good(), "s") for i in range(300)] + [(500, None, "s"), (501, "", "s")]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in importance.resample(table(spark, docs), labels).collect()}
    assert sum(out.values()) == round(302 * 0.8)
    assert np.mean([out[i] == (i % 5 > 0) for i in range(300)]) > 0.97 and not out[500]


def test_threshold_matches_sort(spark):
    rng = random.Random(6)
    keys = [(round(rng.gauss(0, 1), 1), i) for i in range(5000)]
    df = spark.createDataFrame(keys, "key double, id long")
    ordered = sorted(keys, key=lambda r: (-r[0], r[1]))
    for k in (1, 777, 4999, 5000):
        assert importance.threshold(df, k, bins=7, small=50) == ordered[k - 1]
    assert importance.threshold(df, 0) is None
    assert importance.threshold(spark.createDataFrame([(1.0, i) for i in range(100)], "key double, id long"), 30, small=10) == (1.0, 29)


def brute_groups(rows, percent=75):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    group = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in ids}


@pytest.mark.parametrize("heavy,cut", [(32, 1024), (3, 3)])
def test_near_groups(spark, rows, heavy, cut):
    rng = random.Random(8)
    chain, more = [f"w{rng.randrange(10**6)}" for _ in range(60)], []
    for k in range(25):  # a drift: each near the one before, the ends far apart
        more.append((2000 + k, " ".join(chain), "s"))
        chain[rng.randrange(60)] = f"e{k}"
    more = [*rows, *more]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(table(spark, more), heavy=heavy, cut=cut).collect()}
    assert got == brute_groups(more)


def test_near_groups_great_block(spark):
    """A block beyond the bound: near copies of one text, another group that shares a passage with it, a drift and loners
    that share single passages; the block is compared by rounds and by what these leave apart."""
    rng, out = random.Random(31), []
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    passage, base, other = fresh(14), fresh(40), fresh(44)
    for k in range(40):
        own = [*base, *passage]
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(54)] = f"x{k}"
        out.append((k, " ".join(own), "s"))
    for k in range(15):
        own = [*other, *passage]
        own[rng.randrange(58)] = f"y{k}"
        out.append((100 + k, " ".join(own), "s"))
    drift = [*fresh(40), *passage]
    for k in range(30):
        out.append((200 + k, " ".join(drift), "s"))
        drift[rng.randrange(40)] = f"d{k}"
    for k in range(25):
        out.append((300 + k, " ".join([*fresh(rng.randint(3, 6)), *passage, *fresh(rng.randint(0, 2))]), "s"))
    want = brute_groups(out)
    assert len(set(c for _, c in want.values())) < len(want)
    for heavy, cut in ((16, 8), (3, 4), (1000, 25)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(table(spark, out), heavy=heavy, cut=cut).collect()}
        assert got == want


def test_near_groups_many_ranges(spark, rows, monkeypatch):
    """More ranges than tasks, remembered heavy shingles dropped."""
    monkeypatch.setattr(jaccard, "ranges", lambda docs: 23)
    monkeypatch.setattr(jaccard, "MOST_TASKS", 5)
    monkeypatch.setattr(jaccard, "REMEMBERED", 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(table(spark, rows), heavy=4).collect()}
    assert got == brute_groups(rows)


def test_near_groups_one_hot_copy_and_null_ids(spark):
    text = "one text that a third of all rows have as it is"
    docs = [(i, text, "s") for i in range(50)] + [(None, text, "s"), (None, "", "s"), (7, text, "s")] + [(100 + i, " ".join(f"w{i}{k}" for k in range(9)), "s") for i in range(100)]
    got = jaccard.near_groups(table(spark, docs)).collect()
    assert len(got) == len(docs)
    assert {r["component_id"] for r in got if r["n_shingles"] == 8} == {0} and sum(r["n_shingles"] == 8 for r in got) == 52
    assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] != 8)


def test_one_of_each(spark, rows):
    docs = table(spark, [*rows, rows[0], (None, rows[0][1], "s"), (None, "alone among many words here", "s")])
    path = f"{spark.conf.get('spark.checkpoint.dir')}/one-of-each"
    docs.write.mode("overwrite").parquet(path)
    docs = spark.read.parquet(path)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {g if n else i for i, (n, g) in brute_groups(rows).items()}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=str) == sorted([*want, None], key=str)


def test_empty_tables(spark):
    empty = table(spark, [(1, "x", "s")]).where("false")
    assert lines.dedup_lines(empty).count() == pii.find_private(empty).count() == repetition.repetition_rules(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == jaccard.near_groups(empty).count() == 0
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.resample(empty, marks).count() == toxicity.score(empty, toxicity.train(empty, marks)).count() == 0


def test_join_hot(spark):
    from tessera.llm.common import join_hot

    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, *range(3000)]), rng.randrange(2), i) for i in range(4000)] + [(None, 1, 9999)]
    count = Counter(r[:2] for r in rows if r[0] is not None and r[0] % 5)
    side = [(*k, n, f"x{k}" if k[0] % 2 else None) for k, n in count.items()]
    got = join_hot(spark.createDataFrame(rows, "a long, b int, i int"), spark.createDataFrame(side, "a long, b int, n int, x string"), ["a", "b"], "n").collect()
    known = {s[:2]: s[2:] for s in side}
    assert sorted((r["i"], r["n"], r["x"]) for r in got) == sorted((i, *known.get((a, b), (None, None))) for a, b, i in rows)
