"""The training-data operators against brute force and on odd inputs."""

import hashlib
import re
import textwrap
from collections import defaultdict

import numpy as np
import pytest

from hepark.llm import (catalog, cgk, collision, debruijn, license_rules, linededup, minhash, mixing, ownership, template,
                        toxicity)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, "", "s", 7), (2, None, None, 7), (None, "a b c", "s", 7), (4, "x " * 30000, "s", 7),
       (5, "same text here\nline two\nline three\nline four", "s", 7),
       (5, "same text here\nline two\nline three\nline four", "s", 7),
       (6, "same text here\nline two\nline three\nline four", "t", 7)]
SCHEMA = "doc_id long, text string, source string, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_substrings_brute_force(docs, texts):
    words = {d: WORD.findall(t) for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i:i + 50]), d)
    for r in debruijn.query(docs).collect():
        w = words[r.doc_id]
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < r.doc_id:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed) == (len(w), len(gone))
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_near_duplicates_brute_force(docs, texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in minhash.query(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_mixed_buckets_lose_no_link(spark):
    """Variants of one passage about the threshold apart: large buckets that hold
    many components, some linked by a single pair."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(2, 6)), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[j:j + 4]) for j in range(117)} for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: find(i) for i in range(len(rows))}
    assert 2 < len(set(want.values())) < len(rows) - 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=4).collect()}
    assert got == want
    assert {r.doc_id: r.component_id for r in minhash.query(docs).collect()} == want


def test_large_family_loses_no_link(spark):
    """4,000 variants of one passage, most of them too far apart to link: buckets of
    hundreds of components, and single pairs that link."""
    rng = np.random.default_rng(11)
    n, words, k = 4000, 200, 4
    rows, holds = [], np.ones((n, words - k + 1), np.float32)
    for i in range(n):
        text = [f"w{j}" for j in range(words)]
        for at in rng.choice(words, 5, replace=False):
            text[at] = f"x{i}y{at}"
            holds[i, max(0, at - k + 1):at + 1] = 0
        rows.append((i, " ".join(text)))
    # all sets hold words - k + 1 shingles; two share those of the passage that both kept
    both = holds @ holds.T
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(int(a), int(b)) for a, b in np.argwhere(100 * both >= 80 * (2 * (words - k + 1) - both)) if a < b]
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert 50 < len(links) < n / 10
    got = {r.doc_id: r.component_id for r in minhash.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, c in got.items() if c != find(i)} == {}


def test_lines_brute_force(docs, texts):
    lines = {d: [x for x in (y.strip(" \t\n\r\x0b\x0c") for y in t.split("\n")) if x] for d, t in texts.items()}

    def windows(v):
        return [(0, tuple(v), "all")] if 0 < len(v) < 3 else [(i, tuple(v[i:i + 3]), "") for i in range(len(v) - 2)]

    first = {}
    for d in sorted(lines):
        for i, w, kind in windows(lines[d]):
            first.setdefault((kind, w), (d, i))
    for r in linededup.query(docs).collect():
        gone = set()
        for i, w, kind in windows(lines[r.doc_id]):
            if first[kind, w] < (r.doc_id, i):
                gone |= set(range(i, i + len(w)))
        assert (r.n_lines, r.n_removed) == (len(lines[r.doc_id]), len(gone))


def test_registered_lines_brute_force(spark, texts):
    lines = {d: [x for x in (y.strip(" \t\n\r\x0b\x0c") for y in t.split("\n")) if x] for d, t in texts.items()}

    def windows(v):
        runs = [(i, tuple(v[i:i + m]), "") for m in (1, 2, 3) for i in range(len(v) - m + 1)
                if m == 3 or len(WORD.findall("\n".join(v[i:i + m]))) >= 50]
        return runs + ([(0, tuple(v), "all")] if 0 < len(v) < 3 else [])

    first = {}
    for d in sorted(lines):
        for i, w, kind in windows(lines[d]):
            first.setdefault((kind, w), (d, i))
    for r in catalog.queries()["op10_line_dedup"](spark, SF).collect():
        gone = set()
        for i, w, kind in windows(lines[r.doc_id]):
            if first[kind, w] < (r.doc_id, i):
                gone |= set(range(i, i + len(w)))
        assert (r.n_lines, r.n_removed) == (len(lines[r.doc_id]), len(gone))


def test_long_passages_on_few_lines_go(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), [" ".join(f"{c}{i}" for i in range(30)) for c in "bc"]
    rows = [(1, "\n".join(["x", one, "y", *two, "z"])), (2, "p\n" + one + "\nq\nr"), (3, "\n".join(["s", *two, "t", "u"])),
            (4, one), (5, "v\n" + two[0] + "\nw\nx"), (6, one + "\n" + "\n".join(two))]
    got = {r.doc_id: (r.n_removed, r.text) for r in linededup.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: (1, "p\nq\nr"), 3: (2, "s\nt\nu"), 4: (1, ""), 6: (3, "")}


def test_secrets_brute_force(docs, texts):
    assign = re.compile(ownership.ASSIGN, re.A)
    for r in ownership.query(docs).collect():
        t, spans = texts[r.doc_id], []
        spans += [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        spans.sort()
        text = ",".join(f"{ownership.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))


def test_widely_copied_tokens_are_no_secrets(spark):
    bare = "k9" * 12
    df = spark.createDataFrame([(i, f"see {bare} here", f"owner{i}") for i in range(5)]
                               + [(9, "only z8" + "y7" * 12, "owner1")], "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in ownership.query(df).collect()}
    assert got[0] == "" and got[9].startswith("bare:5:")


def test_edited_benchmark_passage_is_found(spark):
    words = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "item_id long, text string")
    near = words[:5] + ["other"] + words[6:15] + words[16:]
    far = [x if i % 3 else f"q{i}" for i, x in enumerate(words)]
    df = spark.createDataFrame([(1, "a b c " + " ".join(near) + " d e f"), (2, " ".join(far)), (3, None), (4, "w1 w2")],
                               "doc_id long, text string")
    got = cgk.contaminations(df, items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)] and got[0].start in (2, 3) and got[0].distance <= 3


def test_edit_distance():
    a, b = np.array([[1, 2, 3, 4]], np.uint64), np.array([[1, 3, 4, 0]], np.uint64)
    assert cgk.edit_distance(a, b, np.array([3]))[0] == 1


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in collision.query(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(found))
        assert len(found) == 5
    assert hits >= 0.9 * 5 * len(got)


def test_neighbours_odd_vectors(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]),
                                (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [2.0, 0.0]), (50, [0.0, 1.0])],
                               "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in collision.query(df).collect() if r.query_id == 0]
    assert sorted(got) == [(0, 1, 1), (0, 2, 7), (0, 3, 50)]
    assert collision.query(df.limit(0)).count() == 0


def test_toxicity(spark):
    insult = [(i, "you idiot, what a worthless moron") for i in range(100)]
    clean = [(i, f"the weather of day {i % 7} was fine") for i in range(100, 500)]
    df = spark.createDataFrame(insult + clean + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(500)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, labels).collect()
    assert all(r.predicted == int(r.doc_id < 100) and 0 <= r.score <= 1 for r in got) and len(got) == 502
    assert toxicity.keep_clean(df, labels).count() == 402


def test_template_subtrees_go_and_articles_stay(spark):
    def page(i):
        return (f"<html><head><title>t</title></head><body><div class=x>Follow us now</div><p>Own text {i} &amp; more</p>"
                f"<footer>f</footer></body></html>")

    rows = [(i, "http://h.example/", page(i)) for i in range(8)]
    rows += [(20, "http://a.example/", "<article><h1>T</h1><p>Same <b>story</b>.<p>End<script>var p='</p>'</script>"
              "<div class='comments'>reader</div></article>")]
    rows += [(30, None, None), (31, "x", ""), (32, "x", "plain a < b")]
    got = {r.page_id: r.text for r in template.extract_main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3 & more" and got[20] == "T Same story. End"
    assert got[30] == got[31] == "" and got[32] == "plain a < b"


def test_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    df = spark.createDataFrame([(1, "Hi.\nReleased under the MIT License.\nBye"), (2, bsd), (3, None), (4, "")],
                               "doc_id long, text string")
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in license_rules.query(df).collect()}
    assert got == {1: (1, "MIT"), 2: (1, ""), 3: (0, ""), 4: (0, "")}


PUBLISHED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.""",
    "BSD-2-Clause,BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.""",
}


def test_published_licences_wrapped_and_commented(spark):
    rows, want = [], {}
    for name, text in PUBLISHED.items():
        for width in (40, 72, 10000):
            for mark in ("", "# ", " * ", "// ", ";; ", "dnl ", "REM "):
                for end in ("\n", "\r\n"):
                    lines = [x for para in text.split("\n\n") for x in [*textwrap.wrap(para, width), ""]]
                    want[len(rows)] = name
                    rows.append((len(rows), end.join(mark + x for x in ["Copyright (c) 2020 A. Person", "", *lines])))
    got = {r.doc_id: r.licenses for r in license_rules.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_mix_hits_targets(docs):
    got = mixing.mix_sources(docs).collect()
    assert all(r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - sum({r.source_size: r.target for r in got}.values())) < 0.1 * sum(r.taken for r in got)


def test_odd_rows(odd, spark):
    assert debruijn.query(odd).count() == len(ODD)
    assert mixing.mix_sources(odd).count() == len(ODD)
    assert ownership.query(odd).count() == len(ODD)
    assert license_rules.query(odd).count() == len(ODD)
    near = minhash.query(odd).collect()
    assert len(near) == len(ODD) and {r.component_id for r in near if r.doc_id in (5, 6)} == {5}
    lines = linededup.query(odd).collect()
    assert {r.doc_id: r.n_removed for r in lines if r.doc_id in (5, 6)} == {5: 0, 6: 4}
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, labels).count() == len(ODD)


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (debruijn.query(none), minhash.query(none), linededup.query(none), ownership.query(none),
                license_rules.query(none), mixing.mix_sources(none), cgk.contaminations(none, items)):
        assert out.count() == 0
