"""Ranked lexical search by pair-bound MaxScore over a document-partitioned index.

Every item is a query; its ``k`` best documents of the whole table are returned,
exactly.  A document's score sums, over the item's terms with repeats, a term
weight times a saturating function of the term's frequency and the document's
length, all in 64-bit integers (``impacts``).

1. One pass over the texts keeps, per document, its number of terms and the
   frequencies of the terms that some item holds.  Document frequencies, the
   number of documents and their total length are aggregated in Spark.
2. The index: each task cuts its documents into blocks (at most ``BLOCK_DOCS``
   documents and about ``BLOCK_POSTINGS`` postings, one longer document makes a block
   of its own) and stores per block the posting list of every term with its largest
   impact, and, for pairs of terms that items use, the list of the documents that hold
   both with their joint impacts and the largest of them.  A block is one row, so
   nothing is shuffled and no term, however frequent, meets in one task, and one row
   group of its file, so a reader holds one block, however many the file has.
3. Search: a task walks through its blocks and keeps each item's ``k`` best so far;
   their least score is the threshold.  An item's terms, rarest last, are paired.  A
   pair can add at most the largest of its two term maxima and its joint maximum,
   which is below their sum wherever the two are not at their best together.  Pairs
   whose bounds together stay below the threshold cannot bring a document in: only
   the postings of the other pairs are read.  Going down through the remaining pairs,
   documents that cannot reach the threshold any more are dropped; the intersection
   list gives both terms' impacts at once, and a document that it lacks gets at most
   one of the two.  Nothing is dropped that could be among the ``k`` best.
4. The ``k`` best of every task are ranked per item: Spark limits each item to ``k``
   rows in every task before the shuffle.

Only the items' terms travel to the tasks: items are searched in blocks of about
``ITEM_BYTES`` of text, so what is broadcast and what passes the driver is bounded;
the documents are read once per block of items.

Edge cases: a null text, or one without terms, has none and is not counted; an item
without terms finds nothing; every row of ``docs`` is a document of its own, equal
rows included, and every row of ``items`` a query of its own; null doc_ids come last
among equal scores; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hepark.llm.common import id_text, staged
from hepark.llm.text import LOWER, NON_ALNUM, Words, as_list, list_values, pieces

BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 19
ITEM_BYTES = 8 << 20
NULL_ID = np.iinfo(np.int64).max


class Vocabulary:
    """The items' terms: sorted hashes, and the terms' bytes for an exact check."""

    def __init__(self, texts: list[str]):
        data = [t.encode() for t in texts]
        self.offsets = np.cumsum([0] + [len(d) for d in data])
        words = Words(LOWER[np.frombuffer(b"".join(data), np.uint8)], self.offsets, NON_ALNUM)
        hashes = words.hashes()
        spelt = [words.buf[a:b].tobytes() for a, b in zip(words.start, words.end)]
        ids = {t: i for i, t in enumerate(sorted(set(spelt)))}
        of_word = np.array([ids[t] for t in spelt], np.int64)
        self.items = [Counter(of_word[a:b].tolist()) for a, b in zip(words.ptr[:-1], words.ptr[1:])]
        self.size = len(ids)
        first = np.zeros(self.size, np.int64)
        first[of_word[::-1]] = np.arange(len(words))[::-1]
        self.length = (words.end - words.start)[first] if self.size else first
        self.start = np.cumsum(np.r_[0, self.length])[:-1] if self.size else first
        self.bytes = np.frombuffer(b"".join(sorted(ids)), np.uint8)
        self.order = np.argsort(hashes[first], kind="stable")
        self.hashes = hashes[first][self.order]
        if len(np.unique(self.hashes)) < self.size:
            raise ValueError("two terms of the items share a 64-bit hash")

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that are terms of the items, and their term ids."""
        if not self.size or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        term = self.order[at[hit]]
        length = words.end[hit] - words.start[hit]
        same = length == self.length[term]
        hit, term, length = hit[same], term[same], length[same]
        if len(hit):                                    # the bytes themselves
            step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            equal = words.buf[np.repeat(words.start[hit], length) + step] \
                == self.bytes[np.repeat(self.start[term], length) + step]
            good = np.logical_and.reduceat(equal, np.cumsum(length) - length)
            hit, term = hit[good], term[good]
        return hit, term


def _vectors(vocabulary):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                        ("tfs", pa.list_(pa.int64()))])

    def run(batches):
        voc = vocabulary.value[0]
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, buf, off in pieces(batch, "text"):
                words = Words(LOWER[buf], off, NON_ALNUM)
                hit, term = voc.find(words)
                doc = np.searchsorted(words.ptr, hit, side="right") - 1
                keys, tf = np.unique(doc * max(voc.size, 1) + term, return_counts=True)
                doc, term = keys // max(voc.size, 1), keys % max(voc.size, 1)
                ptr = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.array(words.counts(), pa.int64()), as_list(term, ptr, pa.int32()),
                     as_list(tf, ptr, pa.int64())], schema=schema)
    return run


def pair_up(items: list[Counter], weight: np.ndarray) -> list[list[tuple[int, ...]]]:
    """Each item's terms in groups of two: neighbours by weight, so that the two frequent
    terms whose maxima seldom meet bound each other; an odd term stays alone."""
    out = []
    for terms in items:
        order = sorted((t for t in terms if weight[t] > 0), key=lambda t: (int(weight[t]), t))
        out.append([tuple(sorted(order[i:i + 2])) for i in range(0, len(order), 2)])
    return out


def impacts(tf: np.ndarray, weight: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


INDEX = ("doc_ids array<long>, terms array<int>, t_ptr array<int>, t_doc array<int>, t_imp array<long>, "
         "t_top array<long>, pairs array<int>, p_ptr array<int>, p_doc array<int>, p_imp array<long>, "
         "p_top array<long>")
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(),
          pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _block(ids, n, terms, tfs, ptr, weight, pairs, n_docs, total):
    """Posting and intersection lists of one block."""
    m = 75 + (25 * n * n_docs) // total
    doc = np.repeat(np.arange(len(n)), np.diff(ptr))
    imp = impacts(tfs, weight[terms], m[doc])
    keep = imp > 0
    order = np.lexsort((doc[keep], terms[keep]))
    t, d, v = terms[keep][order], doc[keep][order], imp[keep][order]
    found, first = np.unique(t, return_index=True)
    ends = np.r_[first, len(t)]
    tops = np.maximum.reduceat(v, first) if len(t) else v
    where = {int(x): i for i, x in enumerate(found)}
    p_id, p_ptr, p_doc, p_imp, p_top = [], [0], [], [], []
    dense = np.zeros(len(n), np.int64)
    for i, (a, b) in enumerate(pairs):
        if a not in where or b not in where:
            continue
        a, b = where[a], where[b]
        da, db = slice(ends[a], ends[a + 1]), slice(ends[b], ends[b + 1])
        dense[d[da]] = v[da]
        joint = dense[d[db]]
        dense[d[da]] = 0
        both = joint > 0
        if both.any():
            p_id.append(i)
            p_doc.append(d[db][both])
            p_imp.append((joint + v[db])[both])
            p_top.append(int(p_imp[-1].max()))
            p_ptr.append(p_ptr[-1] + len(p_doc[-1]))
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    values = [ids, found, ends, d, v, tops, p_id, p_ptr, flat(p_doc), flat(p_imp), p_top]
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, k))
         for x, k in zip(values, _KINDS)], names=_NAMES)


def _indexed(query, n_docs, total):
    def run(batches):
        _, weight, _, pairs = query.value
        held, docs, postings = [], 0, 0

        def flush():
            ids = pa.concat_arrays([h[0] for h in held])
            sizes = np.concatenate([h[4] for h in held])
            return _block(ids, *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3)),
                          np.r_[0, np.cumsum(sizes)], weight, pairs, n_docs, total)

        for batch in batches:
            n = np.asarray(batch.column(1), np.int64)
            terms, ptr = list_values(batch.column(2))
            tfs, _ = list_values(batch.column(3))
            lo = 0
            while lo < len(n):
                room = int(np.searchsorted(ptr, ptr[lo] + BLOCK_POSTINGS - postings, side="right")) - 1
                hi = min(len(n), lo + BLOCK_DOCS - docs, max(room, lo if held else lo + 1))
                if hi > lo:
                    cut = slice(ptr[lo], ptr[hi])
                    held.append((batch.column(0)[lo:hi], n[lo:hi], terms[cut].astype(np.int64),
                                 tfs[cut].astype(np.int64), np.diff(ptr[lo:hi + 1])))
                    docs, postings, lo = docs + hi - lo, postings + int(ptr[hi] - ptr[lo]), hi
                if lo < len(n):
                    yield flush()
                    held, docs, postings = [], 0, 0
        if held:
            yield flush()
    return run


class Best:
    """An item's ``k`` best documents so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def threshold(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.r_[self.score, score], np.r_[self.doc, doc]
        order = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[order], doc[order]


def _look_up(lists, docs):
    """Impacts of ``docs`` (ascending) in a posting list; 0 where it lacks one."""
    at, imp = lists
    i = np.minimum(np.searchsorted(at, docs), len(at) - 1)
    return np.where(at[i] == docs, imp[i], 0)


def score_block(block: dict, item: Counter, groups, best: Best, pair_id: dict) -> int:
    """Bring an item's best documents up to date with a block; the number of documents
    whose postings were read."""
    least = best.threshold()
    term_at, pair_at = block["term_at"], block["pair_at"]

    def postings(t):
        i = term_at[t]
        cut = slice(block["t_ptr"][i], block["t_ptr"][i + 1])
        return block["t_doc"][cut], block["t_imp"][cut]

    ranked = []
    for group in groups:
        here = [t for t in group if t in term_at]
        if not here:
            continue
        tops = [item[t] * int(block["t_top"][term_at[t]]) for t in here]
        joint = None
        bound = max(tops)
        if len(here) == 2 and (joint := pair_at.get(pair_id[group])) is not None:
            q = min(item[t] for t in here)
            both = q * int(block["p_top"][joint]) + sum((item[t] - q) * int(block["t_top"][term_at[t]]) for t in here)
            bound = max(bound, both)
        ranked.append((bound, max(tops), here, joint))
    ranked.sort(key=lambda g: g[0])
    below = np.cumsum([g[0] for g in ranked])           # what groups 0..j can add together
    first = int(np.searchsorted(below, least))          # groups from here on are essential
    if first == len(ranked):
        return 0
    score = np.zeros(len(block["doc_ids"]), np.int64)
    for _, _, here, _ in ranked[first:]:
        for t in here:
            at, imp = postings(t)
            score[at] += item[t] * imp
    docs = np.flatnonzero(score)
    read = len(docs)
    for j in range(first - 1, -1, -1):
        _, single, here, joint = ranked[j]
        docs = docs[score[docs] + below[j] >= least]
        if not len(docs):
            return read
        rest = docs
        if joint is not None and item[here[0]] == item[here[1]]:
            cut = slice(block["p_ptr"][joint], block["p_ptr"][joint + 1])
            both = _look_up((block["p_doc"][cut], block["p_imp"][cut]), docs)
            score[docs] += item[here[0]] * both
            rest = docs[both == 0]                      # at most one of the two terms
            under = int(below[j - 1]) if j else 0
            rest = rest[score[rest] + single + under >= least]
        for t in here:
            score[rest] += item[t] * _look_up(postings(t), rest)
    docs = docs[score[docs] >= least]
    best.add(score[docs], block["doc_ids"][docs])
    return read


def opened(row: dict) -> dict:
    """A block as numpy arrays with its terms and pairs looked up by id."""
    ids = row["doc_ids"]
    block = {k: np.asarray(v) for k, v in row.items() if k != "doc_ids"}
    block["doc_ids"] = np.asarray(ids.fill_null(NULL_ID), np.int64)
    block["term_at"] = {int(t): i for i, t in enumerate(block["terms"])}
    block["pair_at"] = {int(p): i for i, p in enumerate(block["pairs"])}
    return block


def _searched(query, k):
    schema = pa.schema([("query", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        voc, _, groups, pairs = query.value
        item_ids = voc.item_ids
        pair_id = {p: i for i, p in enumerate(pairs)}
        best = [Best(k) for _ in voc.items]
        for batch in batches:
            for r in range(batch.num_rows):
                block = opened({c: batch.column(i)[r].values for i, c in enumerate(_NAMES)})
                for item, own, top in zip(voc.items, groups, best):
                    if own:
                        score_block(block, item, own, top, pair_id)
        for q, top in enumerate(best):
            if len(top.doc):
                ids = pa.array(top.doc, mask=top.doc == NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.doc), q, np.int32)),
                     pa.array([item_ids[q]] * len(top.doc), pa.int64()), ids, pa.array(top.score)], schema=schema)
    return run


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    voc = Vocabulary([r["text"] for r in items])
    voc.item_ids = [r["doc_id"] for r in items]
    if not voc.size:
        return None
    vectors = staged(docs.mapInArrow(_vectors(spark.sparkContext.broadcast((voc,))),
                                     "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0"), "ranked")
    n_docs, total = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(voc.size, np.int64)
    for t, c in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[t] = c                                       # one row per term of the items
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(c) + 1))) for c in df], np.int64)
    groups = pair_up(voc.items, weight)
    pairs = sorted({g for own in groups for g in own if len(g) == 2})
    query = spark.sparkContext.broadcast((voc, weight, groups, pairs))
    # rows are large: a row group each, as a reader holds the rows of a group at once
    index = staged(vectors.mapInArrow(_indexed(query, n_docs, total), INDEX), "ranked-index",
                   **{"parquet.block.row.count.limit": 1})
    return index.mapInArrow(_searched(query, k), "query int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id",
           text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, equal
    scores by ascending doc_id, only scores above 0."""
    docs, items = id_text(docs, doc_id, text), id_text(items, item_id, text)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    found = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        part = _search_block(docs, own, k)
        if part is not None:
            part = part.withColumn("part", F.lit(b))
            found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    w = Window.partitionBy("part", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
n AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM n),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf
       FROM (SELECT doc_id, unnest(words) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS q FROM (
        SELECT item_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, CAST(sum(q.q * w.w * ((1000000000 * tf.tf)
             // (1000 * tf.tf + 12 * (75 + (25 * n.n * c.n_docs) // c.total)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
