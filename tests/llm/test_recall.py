"""Benchmark passages against exact edit distance; vectors of extreme length."""

import random

import numpy as np
import pytest

from hepark.llm import cgk, collision


@pytest.mark.parametrize("n", [8, 11, 15, 20, 25, 30, 40, 59, 100, 200, 300])
def test_recall_at_the_full_edit_rate(n):
    edits = cgk.allowed(n, 0.2)
    a, b = cgk.edited_pairs(n, edits, 600, 77)
    apart = cgk.edit_distance(a, b, np.full(len(b), n))
    assert apart.max() <= edits and apart.mean() > 0.8 * edits
    walks = cgk.walks_for(n, 0.2, 0.95, 12, 3)
    assert (cgk.table_keys(a, walks, 12, 3) == cgk.table_keys(b, walks, 12, 3)).any(axis=1).mean() >= 0.95


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, items, rate=0.2):
    """(doc, item): least distance over all windows as the query takes them."""
    out = {}
    for d, words in docs.items():
        for i, item in items.items():
            n, e = len(item), cgk.allowed(len(item), rate)
            near = [distance(item, words[s:s + n]) for s in range(max(1, len(words) - n + e + 1))]
            if near and min(near) <= e and n >= cgk.MIN_WORDS:
                out[d, i] = min(near)
    return out


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.choice("sid")
        if kind == "s":
            words[at] = f"x{rng.randrange(99)}"
        elif kind == "i":
            words.insert(at, f"x{rng.randrange(99)}")
        else:
            del words[at]
    return words


def test_passages_with_all_kinds_of_edits(spark):
    rng = random.Random(11)
    items = {i: [f"w{rng.randrange(400)}" for _ in range(n)]
             for i, n in enumerate([6, 8, 9, 12, 15, 20, 24, 30, 38, 45, 59, 60])}
    docs = {}
    for k in range(120):
        i = k % len(items)
        n = len(items[i])
        inner = edited(rng, items[i], rng.randint(0, cgk.allowed(n, 0.2) + 2))
        docs[k] = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(9))] + inner \
            + [f"w{rng.randrange(400)}" for _ in range(rng.randrange(9))]
    want = brute(docs, items)
    d = spark.createDataFrame([(k, " ".join(w), 1) for k, w in docs.items()], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.distance for r in cgk.contaminations(d, b).collect()}
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(want) > 60 and len(got) >= 0.95 * len(want)
    with pytest.raises(ValueError):
        cgk.contaminations(d, b, recall=1.0)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20))) for i in range(30)]
    docs = spark.createDataFrame([(k, "start " + items[k % 30][1] + " end") for k in range(60)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(cgk.contaminations(docs, b).collect())
    monkeypatch.setattr(cgk, "BLOCK_BYTES", 600)
    assert len(one) == 60 and sorted(cgk.contaminations(docs, b).collect()) == one


def test_passages_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "w1"), (5, "y " * 30_000 + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (7, text), (7, text), (8, None), (9, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in cgk.contaminations(docs, items).collect()), key=str)
    assert got == sorted(((d, i) for d in (None, 1, 5) for i in (None, 7)), key=str)
    assert cgk.contaminations(docs.limit(0), items).count() == cgk.contaminations(docs, items.limit(0)).count() == 0


def test_huge_and_tiny_vectors(spark):
    base = [3.0, -1.0, 2.0]
    rows = [(0, base)] + [(i, [c * f for c in base]) for i, f in enumerate((1e200, 1e-200, 1e307, 1e-300, -1e250), 1)]
    got = {r.vec_id: r.score for r in collision.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
           .where("query_id = 0").collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert all(abs(got[i] - (-1 if i == 5 else 1)) < 1e-12 for i in got)
