"""License scans by sentence rules.

Sentences are normalised to their words (letters and digits, lower case; comment marks and line breaks fall away) and
mapped to the identifiers of known licence sentences. The sequence of identifiers of a text is then matched against
ordered rules: the first rule whose sentences stand in order, with few unknown sentences in between, takes them.

Known sentences are the list below, notices made of a licence's names (NAMES) and of how notices begin, and the
licences of an SPDX expression, each of which stands for a sentence. A notice behind a negation is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: Known sentences by identifier. A "*" stands for up to WILD words, such as a holder's name.
SENTENCES = (
    ("mit.notice", "released under the mit license"),
    ("mit.notice", "licensed under the mit license"),
    ("mit.notice", "this project is licensed under the mit license"),
    ("mit.notice", "spdx license identifier mit"),
    ("mit.grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit.keep", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("no-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache2.notice", "licensed under the apache license version 2.0"),
    ("apache2.notice", "licensed under the apache license version 2.0 the license"),
    ("apache2.notice", "released under the apache license version 2.0"),
    ("apache2.notice", "spdx license identifier apache 2.0"),
    ("apache2.comply", "you may not use this file except in compliance with the license"),
    ("apache2.copy", "you may obtain a copy of the license at"),
    ("apache2.as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl3.notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl3.notice", "licensed under the gnu general public license version 3"),
    ("gpl3.notice", "released under the gnu general public license version 3"),
    ("gpl3.notice", "spdx license identifier gpl 3.0 only"),
    ("gpl3.notice", "spdx license identifier gpl 3.0 or later"),
    ("gpl3.grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2.grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl2.notice", "this work is licensed under the gnu general public license version 2"),
    ("gpl2.notice", "spdx license identifier gpl 2.0 only"),
    ("gpl.hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl21.notice", "this work is licensed under the gnu lesser general public license version 2.1"),
    ("lgpl3.notice", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl3.notice", "this work is licensed under the gnu affero general public license version 3"),
    ("mpl2.notice", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl2.notice", "licensed under the mozilla public license version 2.0"),
    ("mpl2.copy", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("bsd.grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd.source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd.binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd.name", "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd3.notice", "released under the bsd 3 clause license"),
    ("bsd3.notice", "spdx license identifier bsd 3 clause"),
    ("bsd2.notice", "released under the bsd 2 clause license"),
    ("bsd2.notice", "spdx license identifier bsd 2 clause"),
    ("isc.grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc.notice", "released under the isc license"),
    ("unlicense.grant", "this is free and unencumbered software released into the public domain"),
    ("cc0.notice", "licensed under cc0 1.0"),
    ("cc0.notice", "to the extent possible under law * has waived all copyright and related or neighboring rights to this work"),
    ("cc-by.notice", "licensed under cc by 4.0"),
    ("cc-by.notice", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa.notice", "licensed under cc by sa 4.0"),
    ("cc-by-sa.notice", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-nc.notice", "licensed under cc by nc 4.0"),
    ("cc-by-nc.notice", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-nd.notice", "licensed under cc by nd 4.0"),
    ("cc-by-nc-sa.notice", "licensed under cc by nc sa 4.0"),
    ("cc-by-nc-nd.notice", "licensed under cc by nc nd 4.0"),
    ("lgpl21.grant", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("lgpl21.grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("lgpl3.grant", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl3.grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl3.grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("epl2.grant", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at"),
    ("epl2.grant", "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which accompanies this distribution"),
    ("epl1.grant", "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution"),
    ("bsl.grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("zlib.as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib.grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
)

#: Names by licence, as notices and SPDX expressions give them. An SPDX identifier is a name, too, and one
#: that ends in -only or -or-later stands for the licence without that.
NAMES = {
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "agpl v3", "agplv3", "agpl 3.0"),
    "Apache-1.1": ("apache software license version 1.1", "apache license version 1.1", "apache 1.1"),
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache software license version 2.0", "apache 2.0 license", "apache 2.0", "apache 2 license", "apache license v2", "asl 2.0"),
    "Artistic-2.0": ("artistic license 2.0", "artistic license version 2.0", "artistic 2.0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause"),
    "BSL-1.0": ("boost software license version 1.0", "boost software license 1.0", "boost software license", "bsl 1.0"),
    "CC-BY-4.0": ("cc by 4.0", "creative commons attribution 4.0 international license", "creative commons attribution 4.0 license"),
    "CC-BY-NC-4.0": ("cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4.0", "creative commons attribution noncommercial noderivatives 4.0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0", "creative commons attribution noncommercial sharealike 4.0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4.0", "creative commons attribution noderivatives 4.0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"),
    "CC0-1.0": ("cc0 1.0", "cc0 1.0 universal", "creative commons zero v1.0 universal", "creative commons cc0 license"),
    "CDDL-1.0": ("common development and distribution license version 1.0", "common development and distribution license 1.0", "cddl 1.0"),
    "EPL-1.0": ("eclipse public license version 1.0", "eclipse public license 1.0", "eclipse public license v1.0", "epl 1.0"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license 2.0", "eclipse public license v2.0", "epl 2.0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2", "gpl 2.0", "gnu general public license version 2.0"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3", "gpl 3.0", "gnu general public license version 3.0"),
    "ISC": ("isc license", "isc"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "gnu lgpl version 2.1", "lgpl v2.1", "lgplv2.1", "lgpl 2.1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl version 3", "lgpl v3", "lgplv3", "lgpl 3.0"),
    "MIT": ("mit license", "mit licence", "expat license", "mit expat license", "mit"),
    "MPL-1.1": ("mozilla public license version 1.1", "mozilla public license 1.1", "mpl 1.1"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v2.0", "mpl 2.0", "mplv2"),
    "Unlicense": ("unlicense", "unlicense license"),
    "WTFPL": ("do what the fuck you want to public license", "wtfpl"),
    "Zlib": ("zlib license", "zlib libpng license", "zlib"),
}
#: How a notice begins, and what may follow a name.
BEGINS = [f"{verb} {under}{the}" for verb in ("licensed", "released", "distributed", "available", "published") for under in ("under ", "under the terms of ") for the in ("", "the ")]
FOLLOWS = ("", " only", " or later", " or any later version", " or at your option any later version")

#: Rules in order of preference; a longer one comes before those that it holds.
RULES = (
    ("MIT", ("mit.grant", "mit.keep", "as-is", "no-liability")),
    ("MIT", ("mit.grant", "mit.keep")),
    ("MIT", ("mit.notice",)),
    ("Apache-2.0", ("apache2.notice", "apache2.comply", "apache2.copy", "apache2.as-is")),
    ("Apache-2.0", ("apache2.notice", "apache2.comply")),
    ("Apache-2.0", ("apache2.notice",)),
    ("GPL-3.0", ("gpl3.grant", "gpl.hope")),
    ("GPL-3.0", ("gpl3.grant",)),
    ("GPL-3.0", ("gpl3.notice",)),
    ("GPL-2.0", ("gpl2.grant", "gpl.hope")),
    ("GPL-2.0", ("gpl2.grant",)),
    ("GPL-2.0", ("gpl2.notice",)),
    ("LGPL-2.1", ("lgpl21.notice",)),
    ("LGPL-3.0", ("lgpl3.notice",)),
    ("AGPL-3.0", ("agpl3.notice",)),
    ("MPL-2.0", ("mpl2.notice", "mpl2.copy")),
    ("MPL-2.0", ("mpl2.notice",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.name")),
    ("BSD-3-Clause", ("bsd3.notice",)),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("BSD-2-Clause", ("bsd2.notice",)),
    ("ISC", ("isc.grant",)),
    ("ISC", ("isc.notice",)),
    ("Unlicense", ("unlicense.grant",)),
    ("CC0-1.0", ("cc0.notice",)),
    ("CC-BY-4.0", ("cc-by.notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa.notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc.notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd.notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa.notice",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd.notice",)),
    ("LGPL-2.1", ("lgpl21.grant",)),
    ("LGPL-3.0", ("lgpl3.grant",)),
    ("AGPL-3.0", ("agpl3.grant",)),
    ("EPL-2.0", ("epl2.grant",)),
    ("EPL-1.0", ("epl1.grant",)),
    ("BSL-1.0", ("bsl.grant",)),
    ("Zlib", ("zlib.as-is", "zlib.grant")),
    ("Zlib", ("zlib.grant",)),
    *((name, (f"{kind}.{name}",)) for name in NAMES for kind in ("named", "spdx")),
)
#: Words that a "*" may stand for, and unknown sentences that may stand between two of a rule.
WILD, GAP = 8, 4

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*", re.IGNORECASE)
BREAK = re.compile(r"[\n.;:!?]+")
#: First words of notices that may stand behind other words of their sentence ("This file is released under ...").
NOTICES = ("released", "licensed", "distributed", "available", "published", "spdx")
NOTICE = re.compile(rf"(?<![a-z0-9])(?:{'|'.join(NOTICES)})(?![a-z0-9])", re.IGNORECASE)
END = re.compile(r"[\s\"'”’)\]*/#-]*(?:[.;:!?,\n(\"]|\Z)|\s*\n")
#: An SPDX tag, a word of its expression, and a negation that ends close before a notice of its sentence.
TAG = re.compile(r"SPDX[- ]License[- ]Identifiers?[ \t]*[:=][ \t]*", re.IGNORECASE)
TERM = re.compile(r"[ \t]*(?:\(+[ \t]*)?([A-Za-z0-9][A-Za-z0-9.+-]*)(?:[ \t]*\))*")
NOT = re.compile(r"(?:\b(?:not|never|neither|nor|no longer|cannot)|n['’]t)\b[^\w.;:!?\n]+(?:\w+[^\w.;:!?\n]+){0,2}$", re.IGNORECASE)
IDS = {name.lower(): name for name in NAMES}


def tree() -> dict:
    """All known sentences by their words; where a sentence is in the list and made of names, the list's identifier counts."""
    root: dict = {}
    made = ((f"named.{licence}", f"{begin}{name}{follow}") for licence, names in NAMES.items() for name in names for begin in BEGINS for follow in FOLLOWS)
    for name, sentence in chain(SENTENCES, made):
        node = root
        for word in sentence.split():
            node = node.setdefault(word, {})
        node.setdefault("", name)
    return root


def expression(text: str, at: int) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of each known licence in the SPDX expression of a tag at ``at``; exceptions are none.

    The terms of an expression stand in one line, with AND, OR or WITH between them.
    """
    tag, out, joined = TAG.match(text, at), [], "OR"
    term = TERM.match(text, tag.end()) if tag else None
    while term:
        plain = re.sub(r"(?:-only|-or-later|\+)$", "", term[1].rstrip(".").lower())
        if joined != "WITH" and plain in IDS:
            out.append((f"spdx.{IDS[plain]}", term.start(1) if out else at, term.end(1)))
        operator = TERM.match(text, term.end())
        joined = operator[1].upper() if operator else ""
        term = TERM.match(text, operator.end()) if joined in ("AND", "OR", "WITH") else None
    return out


def recognise(text: str, at: int, root: dict) -> tuple[str, int, int] | None:
    """The longest known sentence that starts with the word at or behind ``at``: (identifier, start, end)."""
    best, states, start = None, [(root, 0)], None
    for m in WORD.finditer(text, at):
        if start is None:
            start = m.start()
        word, after = m[0].lower(), []
        for node, wild in states:
            if word in node:
                after.append((node[word], 0))
            if "*" in node and wild < WILD:
                after.append((node, wild + 1))
                if word in node["*"]:
                    after.append((node["*"][word], 0))
        states = after
        if not states:
            return best
        for node, wild in states:
            if "" in node and not wild and END.match(text, m.end()):
                best = (node[""], start, m.end())
    return best


def notices(text: str, at: int, end: int, root: dict) -> list[tuple[str, int, int]]:
    """The first known sentence that starts with a word of NOTICE in text[at:end], or the licences of an SPDX tag there."""
    for m in NOTICE.finditer(text, at, end):
        if found := expression(text, m.start()):
            return found
        if not NOT.search(text, max(at, m.start() - 60), m.start()) and (known := recognise(text, m.start(), root)):
            return [known]
    return []


def sentences(text: str, root: dict) -> list[tuple[str, int, int, int]]:
    """(identifier, start, end, number of the sentence) of each known sentence, in order.

    A known sentence starts with its line or sentence, a notice also behind other words of it. It counts as one,
    whatever breaks are in it and words before it. An unknown one goes on over line breaks and over marks
    inside a word (addresses, versions), up to a mark before white space, a line without words or a known sentence.
    """
    found, upto, number, fresh = [], 0, 0, True
    starts, at, mark, lower = set(root), 0, "\n", text.lower()
    inside = any(w in lower for w in NOTICES)

    def begun(first: re.Match) -> list[tuple[str, int, int]]:
        if first[0].lower() not in starts or first[0].lower() == "spdx" and TAG.match(text, first.start()):
            return []
        known = recognise(text, first.start(), root)
        return [known] if known else []

    for m in chain(BREAK.finditer(text), (None,)):
        end = m.start() if m else len(text)
        if at >= upto:
            first = WORD.search(text, at, end)
            after = text[at : at + 1]
            if not first:
                fresh = fresh or "\n" in mark
            elif known := begun(first) or (notices(text, at, end, root) if inside else []):
                number += 1
                found += [(*k, number) for k in known]
                upto, fresh = known[-1][2], True
            else:
                closed = mark.count("\n") > 1 or mark.strip("\n") and ("\n" in mark or not (after.isalnum() or after == "/"))
                number += bool(fresh or closed)
                fresh = False
        if m:
            at, mark = m.end(), m[0]
    return found


def apply_rules(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int]]:
    """(licence, start, end), in order of place; a sentence serves one rule.

    A rule goes once over the sentences that earlier rules left. Known sentences have numbers that rise, so at most
    GAP + 1 of them lie between two of a rule, and the work is linear in the sentences.
    """
    free, out = list(found), []
    present = {f[0] for f in found}
    for licence, needed in RULES:
        if not present.issuperset(needed):
            continue
        used = [False] * len(free)
        for i, first in enumerate(free):
            if used[i] or first[0] != needed[0]:
                continue
            took, j = [i], i
            for name in needed[1:]:
                last, j = free[j][3], j + 1
                while j < len(free) and free[j][3] - last <= GAP + 1 and (used[j] or free[j][0] != name):
                    j += 1
                if j >= len(free) or free[j][3] - last > GAP + 1:
                    break
                took.append(j)
            if len(took) == len(needed):
                out.append((licence, first[1], free[took[-1]][2]))
                for k in took:
                    used[k] = True
        free = [f for f, gone in zip(free, used, strict=True) if not gone]
    return sorted(out, key=lambda x: x[1:])


COLUMNS = "doc_id long, n_sentences long, sentence_ids string, licenses string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root, names = tree(), [c.split()[0] for c in COLUMNS.split(", ")]
    for batch in batches:
        n, ids, licences, spans = [], [], [], []
        for text in texts(batch.column(1)):
            found = sentences(text, root)
            rules = apply_rules(found)
            n.append(len(found))
            ids.append(",".join(f[0] for f in found))
            licences.append(",".join(sorted({r[0] for r in rules})))
            spans.append(",".join(f"{a}:{b}:{c}" for a, b, c in rules))
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(licences, pa.string()), pa.array(spans, pa.string())], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of docs; see COLUMNS. spans: licence:start:end in code points, comma-joined.

    A null or empty text has none. Null and repeated doc_ids are rows like others; other columns play no part. An
    empty table gives an empty result. No shuffle.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, COLUMNS)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
