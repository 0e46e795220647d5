"""Substring deduplication on a token De Bruijn graph.

Edges are the ``length``-word windows (nodes: their ends' overlaps).  An edge
can only be shared between documents if its *anchor* is: the least ``k``-gram
hash among those inside the window, which depends on the window's words alone.

1. Each document's anchors (about 2 in 27 positions) are counted by document;
   those seen in two documents or more mark the windows worth keeping.
2. Those windows become edges: one row per hash with the first source
   coordinate (least doc_id, then position) and a second, independent hash.
3. A join gives each occurrence in a later document its source coordinate.
   Consecutive occurrences whose coordinates advance together do not branch, and
   are compacted into one path: (doc_id, start, length, src_doc, src_start).
4. Paths hold only windows whose second hash equals the source's; the words they
   cover are the long repeated spans.

Documents with the same word sequence are one class: only the smallest doc_id
of a class takes part, the others repeat it whole.  Nothing is grouped by a hot
key without a partial aggregate; the two joins on hashes read written tables on
both sides, so that Spark may split a hot key.

Edge cases: null or empty text has no words (digest of the empty string); texts
shorter than a window lose nothing; a null doc_id comes after all others; rows that share
a doc_id (or have none) but not the text are documents of their own, in the order of a
hash of the text; equal rows share their fate; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hepark.llm.common import id_text, numbered, renamed, staged
from hepark.llm.text import Words, as_list, grams, list_values, mix, pieces, sliding_argmin, whole

def _anchors_of_windows(h: np.ndarray, ptr: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-gram hashes, position of the anchor of each window)."""
    g = grams(h, k, seed=1)
    return g, sliding_argmin(g, length - k + 1)


def _survey(length: int, k: int):
    """doc_id, n_words, whole-text digests, and the distinct anchors of each text."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in pieces(batch, "text"):
                w = Words(buf, off)
                h = w.hashes()
                shas, plain = [], []
                for d in range(hi - lo):
                    joined = b" ".join(w.text(d).split())
                    shas.append(hashlib.sha256(joined).hexdigest())
                g, at = _anchors_of_windows(h, w.ptr, length, k)
                at = at[whole(w.ptr, length)]
                at = np.unique(at)
                ptr = np.searchsorted(at, w.ptr)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array(w.counts(), pa.int64()), pa.array(shas, pa.string()),
                    as_list(g[at] if len(at) else np.zeros(0, np.uint64), ptr, pa.int64())],
                    ["doc_id", "n_words", "sha", "anchors"])
    return run


def _edges(length: int, k: int):
    """One row per window whose anchor is marked: both hashes and the coordinate."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks, mptr = list_values(batch.column(2))
            marks = marks.astype(np.int64).view(np.uint64)
            for lo, hi, buf, off in pieces(batch, "text"):
                w = Words(buf, off)
                h = w.hashes()
                g, at = _anchors_of_windows(h, w.ptr, length, k)
                if not len(at):
                    continue
                ok = np.flatnonzero(whole(w.ptr, length))
                doc = w.doc_of()
                # a mark holds for its own text: look both up together
                mine = mix(marks[mptr[lo]:mptr[hi]]
                           ^ np.repeat(np.arange(hi - lo), np.diff(mptr[lo:hi + 1])).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                # as anchors repeat for neighbours, test each anchor position once
                spots, back = np.unique(at[ok], return_inverse=True)
                seen = np.isin(mix(g[spots] ^ doc[spots].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), mine)
                ok = ok[seen[back]]
                if not len(ok):
                    continue
                e, f = grams(h, length, seed=2)[ok], grams(h, length, seed=3)[ok]
                yield pa.RecordBatch.from_arrays([
                    pa.array(e.view(np.int64)), pa.array(f.view(np.int64)),
                    pa.array(ids[lo:hi][doc[ok]], pa.int64()),
                    pa.array((ok - w.ptr[doc[ok]]).astype(np.int32))], ["edge", "check", "doc_id", "pos"])
    return run


def repeated_paths(docs: DataFrame, length: int = 50, k: int = 25
                   ) -> tuple[DataFrame, DataFrame]:
    """(survey, paths).  survey: doc_id, n_words, sha (of the words joined by one
    space), first (smallest doc_id with that sha).  paths: doc_id, start,
    n_windows, src_doc, src_start, for the first document of each class.
    ``docs``: doc_id, text, each id naming one text (``common.numbered``)."""
    survey = staged(docs.mapInArrow(
        _survey(length, k), "doc_id long, n_words long, sha string, anchors array<long>"), "graph-survey")
    first = survey.groupBy("sha").agg(F.min("doc_id").alias("first"))
    first = staged(first, "graph-classes")
    # a text too short for a window has no anchors and needs no class
    reps = survey.where(F.size("anchors") > 0).join(
        first.where(F.col("first").isNotNull()), "sha").where("doc_id = first").dropDuplicates(["doc_id", "sha"])
    marks = reps.select("doc_id", F.explode("anchors").alias("anchor"))
    marks = staged(marks, "graph-anchors")
    shared = marks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")) \
        .where("lo < hi").select("anchor")
    shared = staged(shared, "graph-shared")
    per_doc = staged(marks.join(shared, "anchor").groupBy("doc_id").agg(
        F.collect_set("anchor").alias("marks")), "graph-marks")
    edges = docs.join(per_doc, "doc_id").select("doc_id", "text", "marks").mapInArrow(
        _edges(length, k), "edge long, check long, doc_id long, pos int")
    edges = staged(edges, "graph-edges")
    sources = edges.groupBy("edge").agg(
        F.min(F.struct("doc_id", "pos", "check")).alias("s"), F.max("doc_id").alias("hi")) \
        .where("s.doc_id < hi").select("edge", F.col("s.doc_id").alias("src_doc"),
                                       F.col("s.pos").alias("src_pos"), F.col("s.check").alias("src_check"))
    sources = staged(sources, "graph-sources")
    met = edges.join(sources, "edge").where("doc_id > src_doc and check = src_check") \
        .select("doc_id", "pos", "src_doc", "src_pos")
    met = met.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "src_doc", "src_pos"))).alias("met"))
    paths = staged(met.mapInArrow(_compact, "doc_id long, start int, n_windows int, src_doc long, src_start int"),
                   "graph-paths")
    survey = survey.drop("anchors").join(first, "sha")
    return survey, paths


def _compact(batches):
    """Runs of consecutive windows whose source coordinate advances with them."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        ptr = np.asarray(lists.offsets, dtype=np.int64)
        flat = lists.values.slice(ptr[0], ptr[-1] - ptr[0])
        pos, src, spos = (np.asarray(x) for x in flat.flatten())
        ptr = ptr - ptr[0]
        if not len(pos):
            continue
        doc = np.repeat(np.arange(len(ids)), np.diff(ptr))
        new = np.ones(len(pos), bool)
        new[1:] = ((np.diff(doc) != 0) | (np.diff(pos) != 1) | (np.diff(src) != 0) | (np.diff(spos) != 1))
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(pos)))
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[doc[at]], pa.int64()), pa.array(pos[at], pa.int32()), pa.array(n, pa.int32()),
            pa.array(src[at], pa.int64()), pa.array(spos[at], pa.int32())],
            ["doc_id", "start", "n_windows", "src_doc", "src_start"])


def _cut(length: int):
    """Kept words joined by one space, and how many went."""
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lists = batch.column(2)
            ptr = np.asarray(lists.offsets, dtype=np.int64)
            start, n = (np.asarray(x, dtype=np.int64) for x in lists.values.flatten())
            kept, gone = [], []
            for d in range(len(ids)):
                words = (texts[d].as_py() or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                a = start[ptr[d]:ptr[d + 1]]
                np.add.at(edge, a, 1)
                np.add.at(edge, np.minimum(a + n[ptr[d]:ptr[d + 1]] + length - 1, len(words)), -1)
                keep = np.cumsum(edge[:-1]) == 0
                gone.append(int(len(words) - keep.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(keep)]).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_removed", "kept"])
    return run


def _parts(docs: DataFrame, length: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(survey with ``copy``: it repeats an earlier document whole; doc_id,
    n_removed, kept of the documents that lose words otherwise)."""
    survey, paths = repeated_paths(docs, length, k)
    spans = paths.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_windows")).alias("spans"))
    cut = docs.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(
        _cut(length), "doc_id long, n_removed long, kept string")
    return survey.withColumn("copy", (F.col("first") < F.col("doc_id")) & (F.col("n_words") >= length)), cut


def dedup_substrings(docs: DataFrame, length: int = 50, k: int = 25) -> DataFrame:
    """doc_id, n_words, n_removed and ``text``, the words left joined by one space
    (the text itself where nothing goes)."""
    texts, names = numbered(id_text(docs))
    survey, cut = _parts(texts, length, k)
    cut = cut.groupBy("doc_id").agg(F.max("n_removed").alias("gone"), F.max("kept").alias("kept"))
    fate = survey.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.max("copy").alias("copy")) \
        .join(cut, "doc_id", "left")
    return renamed(texts.join(fate, "doc_id").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.coalesce("kept", "text")).alias("text")), names)


def query(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    texts, names = numbered(id_text(docs))
    survey, cut = _parts(texts, length, 25)
    cut = cut.groupBy("doc_id").agg(F.max("n_removed").alias("gone"), F.max(F.sha2("kept", 256)).alias("left_sha"))
    return renamed(survey.join(cut, "doc_id", "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256")),
        names)
