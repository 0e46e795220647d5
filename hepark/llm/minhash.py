"""Near-duplicate documents by MinHash with tensored banding.

A table key of the usual banding joins ``2 * half`` minhashes, and many tables
need many minhashes.  Here two collections of ``tables`` *half keys* are made,
each of ``half`` minhashes, and every pair (one of each collection) is a table:
``tables**2`` tables from ``2 * tables * half`` minhashes, the square root of
the usual number.  At similarity s a link is missed by all tables with
probability about ``2 * (1 - s**half) ** tables`` (0.0004 at 0.8 by default).

1. One pass over the texts: shingle count, an order-free 128-bit digest of the
   shingle set, the half keys.  Equal sets are one class, represented by its
   smallest doc_id; only representatives go on.
2. Half keys that two representatives share are counted and joined back; a
   document's table keys are the pairs of its shared half keys.
3. In each bucket the document whose half keys are the most widely shared (the
   centre of its near copies) is paired with the others: linear, not all pairs.
   Pairs whose set sizes allow the similarity are verified on full sets.
4. Documents in buckets that still hold several components are joined once more, by
   their rarest shingles: two sets that reach the similarity share one of the
   ``n - ceil(0.8 n) + 1`` shingles of either that are rarest among these documents
   (a prefix filter, which loses no link).  Where a shingle's documents lie in several
   components, those outside its largest component are paired with all the others of
   different components; a pair leaves the join only if an exact parity bound
   allows the similarity.  So a large group of copies, which is one component
   after step 3, costs a number of pairs linear in its size.
5. Components of all verified links, in Spark; classes get theirs from their
   representative.

Edge cases: null or empty text has an empty set and links to nothing; texts of
fewer than ``k`` words are one shingle; a null doc_id links to nothing
(component null, kept); rows that share a doc_id are one document if their sets
are equal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hepark.llm.common import id_text, staged
from hepark.llm.graph import components
from hepark.llm.text import LOWER, Words, as_list, grams, mix, pieces, whole

CELLS = 512


def _shingle_sets(w: Words, k: int):
    """(distinct shingle hashes of all texts in turn, row pointers)."""
    h = w.hashes()
    g = grams(h, k)
    ok = whole(w.ptr, k)
    n = w.counts()
    sets, size = [], np.zeros(len(n), np.int64)
    for d in range(len(n)):
        a, b = w.ptr[d], w.ptr[d + 1]
        if n[d] >= k:
            s = np.unique(g[a:b - k + 1])
        elif n[d]:
            s = mix(grams(h[a:b], n[d], seed=9), int(n[d]))
        else:
            continue
        sets.append(s)
        size[d] = len(s)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(size)])


def _survey(k: int, half: int, tables: int):
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 2**63, 2 * tables * half, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in pieces(batch, "text"):
                flat, ptr = _shingle_sets(Words(LOWER[buf], off), k)
                full = np.flatnonzero(np.diff(ptr))
                at = ptr[full]
                d1, d2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                halves = np.zeros((len(full), 2 * tables), np.uint64)
                if len(full):
                    d1[full] = np.add.reduceat(mix(flat, 4), at)
                    d2[full] = np.add.reduceat(mix(flat, 5), at)
                    for t in range(2 * tables):
                        key = np.full(len(full), t + 1, np.uint64)
                        for j in range(half):
                            key = mix(key ^ np.minimum.reduceat(flat * odd[t * half + j], at), j)
                        halves[:, t] = key
                doc = np.repeat(np.arange(hi - lo), np.diff(ptr))
                cell = (mix(flat, 7) % np.uint64(CELLS)).astype(np.int64)
                odds = np.bincount(doc * CELLS + cell, minlength=(hi - lo) * CELLS) % 2
                parity = np.packbits(odds.astype(np.uint8)).view(np.int64)
                pptr = np.arange(hi - lo + 1) * (CELLS // 64)
                hptr = np.concatenate([[0], np.cumsum((np.diff(ptr) > 0) * 2 * tables)])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array(np.diff(ptr), pa.int64()),
                    pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                    as_list(halves.reshape(-1), hptr, pa.int64()),
                    as_list(parity, pptr, pa.int64())],
                    ["doc_id", "n_shingles", "d1", "d2", "halves", "parity"])
    return run


def _sets(k: int):
    """doc_id and its sorted shingle hashes as bytes."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in pieces(batch, "text"):
                flat, ptr = _shingle_sets(Words(LOWER[buf], off), k)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo),
                    pa.array([flat[ptr[d]:ptr[d + 1]].tobytes() for d in range(hi - lo)], pa.binary())],
                    ["doc_id", "shingles"])
    return run


def _shared(batches):
    """Size of the intersection of each pair of sets."""
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        both = []
        for p, q in zip(x, y):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both.append(int((b[at] == a).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(both, pa.int64()),
             batch.column(4), batch.column(5)], ["a", "b", "both", "na", "nb"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose full sets reach the similarity: a, b."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    held = pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb", "na", "nb") \
        .mapInArrow(_shared, "a long, b long, both long, na long, nb long")
    return held.where(F.col("both") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))) \
        .select("a", "b")


def _possible(percent: int):
    """Can sets of these sizes reach the similarity at all?"""
    return F.least("na", "nb") * 100 >= F.lit(percent) * F.greatest("na", "nb")


def _placed(met: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, rep, n_shingles, comp, largest) of the buckets with several components."""
    rows = met.join(found, F.col("rep") == F.col("id"), "left").select(
        "bucket", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp"))
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.sum("n").alias("members"), F.max(F.struct("n", "comp")).alias("top"))
    return rows.join(sizes.where("members > top.n").select("bucket", F.col("top.comp").alias("largest")), "bucket")


def _each(batches):
    """rep, n_shingles and each shingle of its set."""
    for batch in batches:
        size = [len(v.as_buffer()) // 8 for v in batch.column(2)]
        flat = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(2)]) if size else np.zeros(0, np.int64)
        at = pa.array(np.repeat(np.arange(len(size)), size))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(flat)],
                                         ["rep", "n_shingles", "s"])


def _rarest(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(bucket, rep, n_shingles): each member under those of its rarest shingles that a
    set reaching the similarity cannot all lack; shingles that only one member holds are
    the rarest and lead nowhere."""
    each = members.join(full, F.col("rep") == F.col("doc_id")).select("rep", "n_shingles", "shingles") \
        .mapInArrow(_each, "rep long, n_shingles long, s long")
    each = staged(each, "minhash-shingles")
    held = each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    known = each.join(held, "s").groupBy("rep", "n_shingles").agg(
        F.sort_array(F.collect_list(F.struct("n", "s"))).alias("order"))          # one document's set
    n = F.col("n_shingles")
    prefix = n - F.floor((n * percent + 99) / 100).cast("long") + 1
    take = (prefix - (n - F.size("order"))).cast("int")
    return known.where(take > 0).select("rep", "n_shingles", F.explode(F.slice("order", F.lit(1), take)).alias("o")) \
        .select(F.col("o.s").alias("bucket"), "rep", "n_shingles")


def _between(met: DataFrame, found: DataFrame, parity: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of different components that share a bucket.

    Members outside the bucket's largest component meet all others.  A pair is held
    only if its sets can reach the similarity.  They differ in at
    least as many shingles as there are cells of which one set holds an odd and the
    other an even number (``parity``), and sets of sizes na and nb that reach it
    differ in at most (na + nb) * (100 - percent) / (100 + percent): no link goes."""
    rows = staged(_placed(met, found).join(parity, "rep"), "minhash-mixed")
    pivots = rows.where(F.col("comp") != F.col("largest")).select(
        "bucket", F.col("rep").alias("pivot"), F.col("n_shingles").alias("np"), F.col("comp").alias("cp"),
        F.col("parity").alias("pp"))
    differ = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("pp")[i])) for i in range(CELLS // 64)), F.lit(0))
    near = differ * (100 + percent) <= (F.col("n_shingles") + F.col("np")) * (100 - percent)
    return rows.join(pivots, "bucket").where((F.col("comp") != F.col("cp")) & near).select(
        F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"),
        F.when(F.col("rep") < F.col("pivot"), F.col("n_shingles")).otherwise(F.col("np")).alias("na"),
        F.when(F.col("rep") < F.col("pivot"), F.col("np")).otherwise(F.col("n_shingles")).alias("nb"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    percent: int = 80, half: int = 3, tables: int = 12) -> DataFrame:
    """doc_id, n_shingles, component_id, kept - one row per input row."""
    docs = id_text(docs, id_col, text_col)
    survey = staged(docs.mapInArrow(_survey(k, half, tables),
                                    "doc_id long, n_shingles long, d1 long, d2 long, halves array<long>, parity array<long>"),
                    "minhash-survey")
    sets = ["n_shingles", "d1", "d2"]
    classes = staged(survey.where("n_shingles > 0 and doc_id is not null").groupBy(*sets)
                     .agg(F.min(F.struct("doc_id", "halves", "parity")).alias("r"))
                     .select(*sets, F.col("r.doc_id").alias("rep"), F.col("r.halves").alias("halves"),
                             F.col("r.parity").alias("parity")),
                     "minhash-classes")
    side = classes.select("rep", "n_shingles", F.posexplode("halves").alias("slot", "key"))
    shared = staged(side.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"),
                                            F.count("*").alias("n")).where("lo < hi").select("key", "n"),
                    "minhash-halves")
    ours = side.join(shared, "key").groupBy("rep", "n_shingles").agg(
        F.sum("n").alias("score"),
        F.collect_list(F.when(F.col("slot") < tables, F.col("key"))).alias("x"),
        F.collect_list(F.when(F.col("slot") >= tables, F.col("key"))).alias("y"))
    keys = ours.where((F.size("x") > 0) & (F.size("y") > 0)) \
        .select("rep", "n_shingles", "score", F.explode("x").alias("p"), "y") \
        .select("rep", "n_shingles", "score", "p", F.explode("y").alias("q")) \
        .select("rep", "n_shingles", "score", F.xxhash64("p", "q").alias("bucket"))
    keys = staged(keys, "minhash-keys")
    centre = keys.groupBy("bucket").agg(
        F.count("*").alias("members"),
        F.max(F.struct(F.col("score"), (-F.col("rep")).alias("neg"), "n_shingles")).alias("c")) \
        .where("members > 1").select("bucket", "members", (-F.col("c.neg")).alias("pivot"),
                                     F.col("c.n_shingles").alias("np"))
    centre = staged(centre, "minhash-centres")
    # full sets of the documents that met any other: one pass over the texts; the
    # list of ids grows with the corpus, so it is merged and never broadcast
    need = keys.join(centre.select("bucket"), "bucket").select(F.col("rep").alias("doc_id")).distinct()
    full = docs.join(need.hint("merge"), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text") \
        .mapInArrow(_sets(k), "doc_id long, shingles binary")
    full = staged(full, "minhash-sets")
    pairs = keys.join(centre, "bucket").where("rep <> pivot").select(
        F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"),
        F.when(F.col("rep") < F.col("pivot"), F.col("n_shingles")).otherwise(F.col("np")).alias("na"),
        F.when(F.col("rep") < F.col("pivot"), F.col("np")).otherwise(F.col("n_shingles")).alias("nb"))
    pairs = staged(pairs.where(_possible(percent)).distinct(), "minhash-pairs")
    links = staged(_verify(pairs, full, percent), "minhash-links")
    found = components(links)
    # buckets that still hold several components
    mixed = _placed(keys.join(centre.select("bucket"), "bucket"), found).select("rep", "n_shingles").distinct()
    again = _between(_rarest(mixed, full, percent), found, classes.select("rep", "parity"), percent)
    again = staged(again.where(_possible(percent)).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti"),
                   "minhash-again")
    more = staged(_verify(again, full, percent), "minhash-more")
    if more.limit(1).count():
        found = components(links.union(more))
    named = classes.select(*sets, F.col("rep")).join(found, F.col("rep") == F.col("id"), "left") \
        .select(*sets, F.coalesce("component", "rep").alias("c"))
    out = survey.drop("halves", "parity").join(staged(named, "minhash-named"), sets, "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"),
                      F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, k=4)
