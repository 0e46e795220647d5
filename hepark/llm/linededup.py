r"""Line deduplication by winnowing over line hashes.

A line is a text's piece between newlines, compared after trimming white space;
blank lines are not compared.  A *window* is ``run`` consecutive lines, or fewer
that hold ``words`` words or more.  Its line of least hash is its *fingerprint*:
two copies of a window select the same line, so none can be missed.

1. Fingerprints are counted by place; those seen once cannot begin a repeat.
2. Windows whose fingerprint recurs are joined on (fingerprint, window) to the
   first place that holds them: least doc_id, then position.
3. The lines covered by a window that occurs earlier go; neighbouring windows that
   match make up a longer run.

So a line goes exactly if it lies in a run of ``run`` non-blank lines or of
``words`` words that occurs earlier (in a document of smaller doc_id, or further up
in the same one); a text of fewer lines is also one window as a whole, which equals
only other whole texts.  The first place always stays.  ``words=None`` leaves the
word count out.

Edge cases: null or empty text has no lines; blank lines stay, but a text of which
no other line stays becomes empty; a null doc_id comes after all others; rows that share a
doc_id (or have none) but not the text are documents of their own, in the order of a hash
of the text; equal rows share their fate; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hepark.llm.common import id_text, numbered, renamed, staged, text_key
from hepark.llm.text import NEWLINES, SPACES, Words, as_list, grams, mix, pieces, sliding_argmin, whole

def _trimmed_lines(buf: np.ndarray, off: np.ndarray) -> Words:
    """Non-blank lines with their outer white space cut off."""
    w = Words(buf, off, NEWLINES)
    solid = np.flatnonzero(~SPACES[buf])
    if len(solid):
        a = np.searchsorted(solid, w.start)
        b = np.searchsorted(solid, w.end) - 1
        keep = b >= a
        w.start, w.end = solid[a[keep]], solid[b[keep]] + 1
    else:
        w.start = w.end = np.zeros(0, np.int64)
    w.ptr = np.searchsorted(w.start, off)
    return w


def _windows(w: Words, plain: Words, run: int, words: int | None):
    """(row of each window's text, first line, number of lines, window hash,
    fingerprint hash).  ``plain`` are the words of the same texts."""
    h = w.hashes()
    order = mix(h, 7)
    doc = w.doc_of()
    held = np.concatenate([[0], np.cumsum(np.searchsorted(plain.start, w.end) - np.searchsorted(plain.start, w.start))])
    found = []
    for size in range(1, run + 1):
        ok = whole(w.ptr, size)
        if size < run:
            if words is None:
                continue
            ok &= held[size:size + len(ok)] - held[:len(ok)] >= words
        ok = np.flatnonzero(ok)
        if len(ok):
            found.append((doc[ok], ok - w.ptr[doc[ok]], np.full(len(ok), size),
                          grams(h, size, seed=6 if size == run else 20 + size)[ok], h[sliding_argmin(order, size)[ok]]))
    n = w.counts()
    for d in np.flatnonzero((n > 0) & (n < run)):       # the whole text is the window
        hs = h[w.ptr[d]:w.ptr[d + 1]]
        found.append(([d], [0], [len(hs)], mix(grams(hs, len(hs), seed=8), len(hs)), hs[[np.argmin(mix(hs, 7))]]))
    if not found:
        found.append(([], [], [], [], []))
    kinds = (np.int64, np.int32, np.int32, np.uint64, np.uint64)
    return [np.concatenate([np.asarray(x, t) for x in col]) for col, t in zip(zip(*found), kinds)]


def _read(run: int, words: int | None):
    def go(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in pieces(batch, "text"):
                rows, line, size, gram, mark = _windows(_trimmed_lines(buf, off), Words(buf, off), run, words)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[lo:hi][rows], pa.int64()), pa.array(line), pa.array(size),
                    pa.array(gram.view(np.int64)), pa.array(mark.view(np.int64))],
                    ["doc_id", "line", "size", "gram", "mark"])
    return go


def repeated_windows(docs: DataFrame, run: int = 3, words: int | None = 50) -> DataFrame:
    """doc_id, line (of the window's start, counting non-blank lines), size (lines),
    src_doc, src_line of every window that occurs earlier."""
    wins = staged(docs.mapInArrow(_read(run, words), "doc_id long, line int, size int, gram long, mark long"), "line-windows")
    marks = staged(wins.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "line-marks")
    wins = staged(wins.join(marks, "mark"), "line-candidates")
    first = wins.groupBy("mark", "gram").agg(F.min(F.struct("doc_id", "line")).alias("s"), F.count("*").alias("n")) \
        .where("n > 1").select("mark", "gram", F.col("s.doc_id").alias("src_doc"), F.col("s.line").alias("src_line"))
    first = staged(first, "line-first")
    return wins.join(first, ["mark", "gram"]).where(
        "doc_id > src_doc or (doc_id = src_doc and line > src_line)").select("doc_id", "line", "size", "src_doc", "src_line")


def _delete(batches):
    for batch in batches:
        ids, texts, lists = batch.column(0), batch.column(1), batch.column(2)
        ptr = np.asarray(lists.offsets, dtype=np.int64)
        flat, sizes = (np.asarray(lists.values.field(i), dtype=np.int64) for i in range(2))
        left, count, gone = [], [], []
        for d in range(len(ids)):
            lines = texts[d].as_py().split("\n")
            solid = [i for i, x in enumerate(lines) if x.encode().strip()]
            drop = np.zeros(len(solid), bool)
            for s, size in zip(flat[ptr[d]:ptr[d + 1]], sizes[ptr[d]:ptr[d + 1]]):
                drop[s:s + size] = True
            out = {i for i, x in zip(solid, drop) if x}
            count.append(len(solid))
            gone.append(len(out))
            left.append("" if len(out) == len(solid) else
                        "\n".join(x for i, x in enumerate(lines) if i not in out))
        yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(gone, pa.int64()),
                                          pa.array(left, pa.string()), batch.column(3), batch.column(4)],
                                         ["doc_id", "n_lines", "n_removed", "text", "h1", "h2"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3,
                words: int | None = 50) -> DataFrame:
    """doc_id, h1, h2 (a hash of the whole text before), n_lines, n_removed, text of the
    documents that lose lines, one row for each distinct (doc_id, text)."""
    docs, names = numbered(id_text(docs, id_col, text_col))
    runs = staged(repeated_windows(docs, run, words).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("line", "size"))).alias("lines")), "line-runs")
    # the list of ids grows with the corpus: merged, never broadcast
    cut = docs.join(runs.hint("merge"), "doc_id").dropDuplicates(["doc_id"]) \
        .select("doc_id", "text", "lines", *text_key()).mapInArrow(
        _delete, "doc_id long, n_lines long, n_removed long, text string, h1 long, h2 long")
    return renamed(cut, names)


def _survey_lines(batches):
    for batch in batches:
        for lo, hi, buf, off in pieces(batch, "text"):
            w = _trimmed_lines(buf, off)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3)), pa.array(w.counts(), pa.int64())],
                ["doc_id", "h1", "h2", "n_lines"])


def query(docs: DataFrame, run: int = 3, words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (null where nothing goes) per document.
    Without ``words`` only runs of ``run`` lines count; the registered query gives 50."""
    counts = id_text(docs).select("doc_id", "text", *text_key()).mapInArrow(
        _survey_lines, "doc_id long, h1 long, h2 long, n_lines long").alias("a")
    cut = dedup_lines(docs, run=run, words=words).select(
        "doc_id", "h1", "h2", "n_removed", F.sha2("text", 256).alias("kept_sha256")).alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
    return counts.join(cut.hint("merge"), on, "left").select(
        "a.doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "kept_sha256")
