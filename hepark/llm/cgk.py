"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

A document is contaminated by an item if one of its windows of the item's size
lies within ``rate`` x size word edits of the item (words: runs of letters and
digits, A-Z lower-cased).

1. Windows.  A window within e edits of an n-word item shares at least
   n - 2 - 3e of its three-word grams, on diagonals at most e off the window's
   start.  Only windows that pass this necessary condition (no loss) are hashed;
   the items' grams are a broadcast table of about ``BLOCK_BYTES`` of item text, and
   a larger benchmark is searched block by block.
2. The CGK random walk reads a window word by word and repeats or advances by
   random bits of (step, word), which turns edit distance into Hamming distance.
   A walk of 2n steps is sampled by ``tables`` tables of ``samples`` positions;
   window and item keys meet in a Spark join.  The longer an item, the more walks it
   needs: :func:`walks_for` measures, for the item's length, how many of them bring together
   the share ``recall`` of pairs that differ by all the edits allowed.
3. Each pair that met is verified by its exact edit distance.

``recall`` is the share of true (item, window) pairs at the full edit rate that meet; pairs
of fewer edits meet more often, and the neighbouring windows of a passage give further chances.

Edge cases: null or empty texts and items match nothing; items of fewer than
``MIN_WORDS`` words are no evidence and take no part; a document shorter than an
item offers itself as the window; a null doc_id or item_id stays null in the
result; repeated rows give one result row; empty tables give none; other columns
are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hepark.llm.common import id_text, staged
from hepark.llm.text import LOWER, NON_ALNUM, Words, grams, mix, pieces, whole

MIN_WORDS = 8
BLOCK_BYTES = 8 << 20
Q = 3
BITMAP = 1 << 22


def allowed(n: int, rate: float) -> int:
    return int(rate * n + 1e-9)


def _item_words(rows) -> list[tuple[int, np.ndarray]]:
    out = []
    for item, text in rows:
        raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        h = Words(raw, np.array([0, len(raw)]), NON_ALNUM).hashes()
        if len(h) >= MIN_WORDS:
            out.append((item, h))
    return out


def _index(items: list[tuple[int, np.ndarray]]):
    """Sorted gram hashes of the items with item number and offset; a bitmap of them."""
    g = [grams(h, Q) for _, h in items]
    number = np.repeat(np.arange(len(g)), [len(x) for x in g])
    offset = np.concatenate([np.arange(len(x)) for x in g])
    flat = np.concatenate(g)
    order = np.argsort(flat, kind="stable")
    bits = np.zeros(BITMAP, bool)
    bits[(flat & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return flat[order], number[order], offset[order], bits, np.array([len(h) for _, h in items])


def _between(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], lo[i]+1, .. (n[i] of them) for each i in turn."""
    if not len(n) or not n.sum():
        return np.zeros(0, np.int64)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _window_starts(w: Words, h: np.ndarray, index, rate: float):
    """(text, item size, start) of the windows that pass the gram condition."""
    flat, number, offset, bits, size = index
    none = np.zeros(0, np.int64)
    g = grams(h, Q)
    hit = np.flatnonzero(bits[(g & np.uint64(BITMAP - 1)).astype(np.int64)] & whole(w.ptr, Q)) if len(g) else none
    if not len(hit):
        return none, none, none
    lo, hi = np.searchsorted(flat, g[hit]), np.searchsorted(flat, g[hit], "right")
    p, at = np.repeat(hit, hi - lo), _between(lo, hi - lo)
    if not len(p):
        return none, none, none
    doc = w.doc_of()[p]
    item, words = number[at], w.counts()
    diag = p - w.ptr[doc] - offset[at]
    group = doc * len(size) + item
    wide = int(words.max() + 2 * size.max() + 2) * 2
    mid = wide // 2
    key = np.sort(group * wide + diag + mid)
    n = size[item]
    e = (rate * n + 1e-9).astype(np.int64)
    need = n - (Q - 1) - Q * e

    def met(group, s, reach):
        k = group * wide + s + mid
        return np.searchsorted(key, k + reach, "right") - np.searchsorted(key, k - reach)

    ok = met(group, diag, 2 * e) >= need
    if not ok.any():
        return none, none, none
    uniq = np.unique(group[ok] * wide + diag[ok] + mid)
    group, diag = uniq // wide, uniq % wide - mid
    n = size[group % len(size)]
    e = (rate * n + 1e-9).astype(np.int64)
    near = np.unique(np.repeat(group * wide + mid, 2 * e + 1) + _between(diag - e, 2 * e + 1))
    group, s = near // wide, near % wide - mid
    doc, n = group // len(size), size[group % len(size)]
    e = (rate * n + 1e-9).astype(np.int64)
    ok = (met(group, s, e) >= n - (Q - 1) - Q * e) & (s >= 0) & (s + n - e <= words[doc])
    found = np.unique(np.stack([doc[ok], n[ok], s[ok]], axis=1), axis=0)
    return found[:, 0], found[:, 1], found[:, 2]


def _windows(shared, rate: float):
    def run(batches):
        index = shared.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in pieces(batch, "text"):
                w = Words(LOWER[buf], off, NON_ALNUM)
                h = w.hashes()
                doc, n, s = _window_starts(w, h, index, rate)
                if not len(doc):
                    continue
                end = np.minimum(w.ptr[doc] + s + n, w.ptr[doc + 1])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(s, pa.int32()), pa.array(n, pa.int32()),
                    pa.array([h[a:b].tobytes() for a, b in zip(w.ptr[doc] + s, end)], pa.binary())],
                    ["doc_id", "start", "n", "words"])
    return run


def _matrix(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x n word hashes, zero past the end; true lengths)."""
    size = np.array([len(x) // 8 for x in words])
    out = np.zeros((len(words), n), np.uint64)
    for i, x in enumerate(words):
        out[i, :size[i]] = np.frombuffer(x, np.uint64)
    return out, size


def embed(x: np.ndarray, walk: int) -> np.ndarray:
    """The CGK walk over each row: 2n words read, advancing on random bits."""
    m, n = x.shape
    padded = np.concatenate([x, np.zeros((m, 1), np.uint64)], axis=1)
    at, out, row = np.zeros(m, np.int64), np.empty((m, 2 * n), np.uint64), np.arange(m)
    for j in range(2 * n):
        out[:, j] = padded[row, at]
        at = np.minimum(at + (mix(out[:, j], 1 + walk * 1_000_003 + j) >> np.uint64(63)).astype(np.int64), n)
    return out


def walk_keys(x: np.ndarray, walk: int, tables: int, samples: int) -> np.ndarray:
    """rows x tables keys of one bit-sampled walk."""
    n, y, out = x.shape[1], embed(x, walk), []
    for t in range(tables):
        rng = np.random.default_rng([n, walk, t])
        key = np.full(len(x), walk * tables + t + 1, np.uint64)
        for p in np.sort(rng.choice(2 * n, min(samples, 2 * n), replace=False)):
            key = mix(key ^ y[:, p], int(p))
        out.append(key ^ np.uint64(n))
    return np.stack(out, axis=1)


def table_keys(x: np.ndarray, walks: int, tables: int, samples: int) -> np.ndarray:
    """rows x (walks * tables) keys of bit-sampled embeddings."""
    return np.concatenate([walk_keys(x, w, tables, samples) for w in range(walks)], axis=1)


def edited_pairs(n: int, edits: int, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random n-word texts and copies as long, ``edits`` edits away: as many insertions as
    deletions, substitutions for the rest."""
    rng = np.random.default_rng([n, edits, seed])
    a = rng.integers(0, 1 << 63, (pairs, n), np.uint64)
    b = np.empty_like(a)
    for i in range(pairs):
        both = int(rng.integers(0, edits // 2 + 1))
        words = np.delete(a[i], rng.choice(n, both, replace=False))
        words = np.insert(words, np.sort(rng.integers(0, len(words) + 1, both)),
                          rng.integers(0, 1 << 63, both, np.uint64))
        at = rng.choice(n, edits - 2 * both, replace=False)
        words[at] = rng.integers(0, 1 << 63, len(at), np.uint64)
        b[i] = words
    return a, b


@lru_cache(maxsize=4096)
def _walks_at(n: int, rate: float, recall: float, tables: int, samples: int, pairs: int = 400) -> int:
    a, b = edited_pairs(n, allowed(n, rate), pairs, 1)
    apart, walks = np.ones(pairs, bool), 0
    while apart.sum() > (1 - recall) / 2 * pairs:       # half of what may be missed: the rest is sampling error
        apart[apart] = (walk_keys(a[apart], walks, tables, samples)
                        != walk_keys(b[apart], walks, tables, samples)).all(axis=1)
        walks += 1
    return walks


def walks_for(n: int, rate: float, recall: float, tables: int, samples: int) -> int:
    """Walks that n-word items need: the larger of those measured at the lengths around n
    out of a few (each a quarter above the one before)."""
    below = size = MIN_WORDS
    while size < n:
        below, size = size, size * 5 // 4
    return max(_walks_at(m, rate, recall, tables, samples) for m in (below, size))


def _rows_at_once(n: int) -> int:
    """Rows of n words whose walks or distances fit a few ten MB."""
    return max(1, min(4096, (1 << 21) // n))


def _keyed(walks: dict[int, int], tables: int, samples: int, rows_at_once: int = 4096):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_at_once):
                b = batch.slice(lo, rows_at_once)
                size = b.column(2).to_numpy()
                words = b.column(3)
                for n in np.unique(size):
                    rows = np.flatnonzero(size == n)
                    for some in np.split(rows, range(_rows_at_once(n), len(rows), _rows_at_once(n))):
                        x, _ = _matrix([words[int(i)].as_py() for i in some], int(n))
                        keys = table_keys(x, walks[int(n)], tables, samples)
                        ptr = np.arange(len(some) + 1, dtype=np.int32) * keys.shape[1]
                        flat = pa.array(keys.reshape(-1).view(np.int64))
                        yield pa.RecordBatch.from_arrays([*b.take(pa.array(some)).columns, pa.ListArray.from_arrays(ptr, flat)],
                                                         [*b.schema.names, "keys"])
    return run


def edit_distance(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Row by row, of ``a`` (whole rows) and the first ``length`` words of ``b``."""
    m, n = b.shape
    step = np.arange(n + 1)
    row = np.broadcast_to(step, (m, n + 1)).copy()
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (a[:, i, None] != b), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row[np.arange(m), length]


def _distances(batches):
    for batch in batches:
        size = batch.column(3).to_numpy()
        dist = np.zeros(batch.num_rows, np.int64)
        words, items = batch.column(4), batch.column(5)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            for at in np.split(rows, range(_rows_at_once(n), len(rows), _rows_at_once(n))):
                x, length = _matrix([words[int(i)].as_py() for i in at], int(n))
                y, _ = _matrix([items[int(i)].as_py() for i in at], int(n))
                dist[at] = edit_distance(y, x, length)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(dist)],
                                         ["doc_id", "item_id", "start", "n", "distance"])


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", rate: float = 0.2,
                   recall: float = 0.95, tables: int = 12, samples: int = 3) -> DataFrame:
    """doc_id, item_id, start, n, distance: the best window (least distance, then
    start) of each document and item that match; ``recall`` (below 1) of them at the full edit
    rate are found."""
    if not 0 < recall < 1:
        raise ValueError("recall lies between 0 and 1")
    spark, docs = docs.sparkSession, id_text(docs, id_col, text_col)
    items = items.select(F.col(item_col).cast("long").alias("item_id"),
                         F.col(item_text).cast("string").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        part = items.where(F.expr(f"pmod(xxhash64(text), {blocks}) = {b}")) if blocks > 1 else items
        known = _item_words(part.toLocalIterator())
        if not known:
            continue
        shared = spark.sparkContext.broadcast(_index(known))
        windows = staged(docs.mapInArrow(_windows(shared, rate), "doc_id long, start int, n int, words binary"),
                         "cgk-windows")
        rows = spark.createDataFrame([(i, 0, len(h), h.tobytes()) for i, h in known],
                                     "item_id long, start int, n int, words binary")
        keys = "start int, n int, words binary, keys array<long>"
        walks = {n: walks_for(n, rate, recall, tables, samples) for n in {len(h) for _, h in known}}
        hashing = _keyed(walks, tables, samples)
        theirs = rows.mapInArrow(hashing, f"item_id long, {keys}").select(
            "item_id", F.col("words").alias("item_words"), F.explode("keys").alias("key"))
        theirs = staged(theirs, "cgk-items")
        ours = windows.mapInArrow(hashing, f"doc_id long, {keys}").select(
            "doc_id", "start", "n", "words", F.explode("keys").alias("key"))
        met = ours.join(theirs.select("key", "item_id"), "key") \
            .groupBy("doc_id", "start", "n", "item_id").agg(F.first("words").alias("words"))
        held = met.join(theirs.select("item_id", "item_words").dropDuplicates(["item_id", "item_words"])
                        .withColumnRenamed("item_id", "item"), F.col("item_id").eqNullSafe(F.col("item"))) \
            .where(F.length("item_words") == F.col("n") * 8) \
            .select("doc_id", "item_id", "start", "n", "words", "item_words") \
            .mapInArrow(_distances, "doc_id long, item_id long, start int, n int, distance long")
        held = held.where(F.col("distance") <= F.floor(F.lit(rate) * F.col("n") + 1e-9))
        out = held if out is None else out.unionByName(held)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, start int, n int, distance long")
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "n")).alias("b")).select(
        "doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.n").alias("n"),
        F.col("b.distance").alias("distance"))
