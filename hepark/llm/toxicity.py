"""Toxicity by weak supervision.

Voters look at a whole text and fire or abstain: a fixed lexicon, every term
mined from the labelled training fold (words and word beginnings that toxic
documents hold far more often), and surface patterns (shouting, exclamation
marks, stretched letters, masked words).  A generative label model, fitted by
expectation maximisation, estimates each voter's rate in toxic and clean
documents without looking at labels; voters whose firing stays correlated given
the class share one vote.  Its posteriors are the labels of a linear (logistic)
classifier over the voters' counts, which scores every document.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from, at most
``max_fit`` of them (taken by hash); scoring reads every whole text.  Labels,
lang, source and doc_id are never inputs of a score.

Edge cases: null or empty text scores by the classifier's intercept; a null
doc_id or label is not learned from, and a null doc_id counts as not held out;
rows that share a doc_id are scored one by one; without labelled rows only the
fixed lexicon and the patterns vote; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hepark.llm.common import id_text, staged
from hepark.llm.text import LOWER, NON_ALNUM, Words, mix, pieces

# Insults of the seed lexicon.
LEXICON = """idiot idiots stupid moron morons scum worthless pathetic disgusting loser losers clown clowns trash
garbage dumb dumbass imbecile fool jerk bastard bitch asshole shit fuck fucking retard vermin filth filthy
subhuman degenerate""".split()

PREFIXES = (4, 5, 6)
PATTERNS = 4
FOLDS = 5
HASHES = 1 << 60


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def _terms(w: Words):
    """(word index, term hash) of every word and word beginning."""
    size = w.end - w.start
    every = np.arange(len(size))
    out = [(every, mix(w.hashes(), 1))]
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        end = w.end.copy()
        end[at] = w.start[at] + n
        out.append((at, mix(w.hashes(end)[at], 10 + n)))
    return out


def _patterns(raw: np.ndarray, off: np.ndarray, w: Words) -> np.ndarray:
    """rows x PATTERNS: do the surface patterns hold?"""
    n = len(off) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(mask)])
        return s[off[1:]] - s[off[:-1]]

    upper = (raw >= 65) & (raw <= 90)
    letters = total(upper | ((raw >= 97) & (raw <= 122)))
    same = np.zeros(len(raw), bool)
    low = LOWER[raw]
    if len(raw) > 3:
        alike = (low[3:] == low[2:-1]) & (low[2:-1] == low[1:-2]) & (low[1:-2] == low[:-3])
        same[3:] = alike & (low[3:] >= 97) & (low[3:] <= 122)
    masked = np.zeros(len(raw), bool)
    if len(raw) > 2:
        word = ~NON_ALNUM[raw]
        masked[1:-1] = np.isin(raw[1:-1], [42, 35, 36, 64]) & word[:-2] & word[2:]
    words = np.maximum(w.counts(), 1)
    return np.stack([(letters > 20) & (total(upper) > 0.6 * letters), total(raw == 33) > 0.2 * words,
                     total(same) > 0, total(masked) > 0], axis=1).reshape(n, PATTERNS)


def _mine(batches):
    """Per piece: how many toxic and clean texts hold each term."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, buf, off in pieces(batch, "text"):
            w = Words(LOWER[buf], off, NON_ALNUM)
            doc = w.doc_of()
            pairs = np.concatenate([np.stack([t, doc[i].astype(np.uint64)], axis=1) for i, t in _terms(w)])
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            if len(pairs):
                first = np.ones(len(pairs), bool)
                first[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
                pairs = pairs[first]
            term, at = np.unique(pairs[:, 0], return_index=True)
            if not len(term):
                continue
            pos = np.add.reduceat(toxic[lo:hi][pairs[:, 1].astype(np.int64)].astype(np.int64), at)
            n = np.diff(np.append(at, len(pairs)))
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(pos), pa.array(n - pos)],
                                             ["term", "pos", "neg"])


def word_hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return mix(Words(raw, np.array([0, len(raw)]), NON_ALNUM).hashes(), 1)


class Voters:
    """Counts of every voter's hits in each text: the fixed lexicon, the mined
    terms in turn, the patterns."""

    def __init__(self, mined: np.ndarray):
        lexicon = word_hashes(LEXICON)
        key = np.concatenate([lexicon, mined])
        voter = np.concatenate([np.zeros(len(lexicon), np.int64), 1 + np.arange(len(mined))])
        order = np.argsort(key, kind="stable")
        self.key, self.voter = key[order], voter[order]
        self.terms = 1 + len(mined)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __len__(self) -> int:
        return self.terms + PATTERNS

    def count(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        w = Words(LOWER[raw], off, NON_ALNUM)
        doc, out = w.doc_of(), np.zeros((len(off) - 1, len(self)), np.float64)
        for word, term in _terms(w):
            at = np.flatnonzero(self.bits[(term & np.uint64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = (np.searchsorted(self.key, term[at], s) for s in ("left", "right"))
            for step in range(int((hi - lo).max()) if len(at) else 0):      # a term may have two voters
                ok = lo + step < hi
                np.add.at(out, (doc[word[at[ok]]], self.voter[lo[ok] + step]), 1)
        out[:, self.terms:] = _patterns(raw, off, w)
        return out


def label_model(votes: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, dict]:
    """Posterior P(toxic | votes) of a latent class model, and its parameters.

    ``share``: 1 / number of voters that stay correlated with a voter given the
    class; its log likelihood ratio counts by that share."""
    fired = votes > 0
    n, m = fired.shape
    start = fired[:, :m - PATTERNS].any(axis=1)
    p = np.where(start, 0.9, 0.05)
    share = np.ones(m)
    for t in range(rounds):
        w1, w0 = p.sum() + 1e-9, (1 - p).sum() + 1e-9
        prior = np.clip((p.sum() + 1) / (n + 10), 1e-4, 0.5)
        a = (p @ fired + 0.1) / (w1 + 1)
        b = ((1 - p) @ fired + 0.01) / (w0 + 1)
        b = np.minimum(b, 0.5 * a + 0.25)               # a voter speaks for toxicity or for nothing
        if t == rounds // 2:                            # correlations given the class
            x = fired - np.outer(p, a) - np.outer(1 - p, b)
            cov = (x * p[:, None]).T @ x / w1
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            varies = sd > 0.03                          # else there is nothing to correlate
            tied = (np.abs(cov / np.outer(sd, sd)) > 0.5) & np.outer(varies, varies)
            share = 1 / np.maximum(tied.sum(axis=1), 1)
        # a voter that abstains says nothing, unless all terms abstain
        silent = ~fired[:, :m - PATTERNS].any(axis=1)
        s1, s0 = (p @ silent + 0.1) / (w1 + 1), ((1 - p) @ silent + 0.1) / (w0 + 1)
        z = np.log(prior / (1 - prior)) + fired @ (np.log(a / b) * share) + silent * np.log(min(s1 / s0, 1.0))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, {"prior": prior, "toxic_rate": a, "clean_rate": b, "share": share}


def fit_linear(x: np.ndarray, p: np.ndarray, l2: float = 1e-5, rounds: int = 60) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the
    intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = l2 * len(x) * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - p) + ridge @ w
        hess = (x * (q * (1 - q))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = 20_000, max_terms: int = 300):
    """(Voters, weights) from the training fold; everything fitted is bounded by
    ``max_fit`` documents and ``max_terms`` terms."""
    labels = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labels = staged(labels, "toxic-labels")
    n = labels.count()
    if n > max_fit:
        labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HASHES)) < HASHES * max_fit // n)
    sample = staged(docs.join(labels, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text"),
                    "toxic-sample")
    n, n_pos = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    mined = np.zeros(0, np.uint64)
    if 0 < n_pos < n:
        rate = n_pos / n
        terms = sample.mapInArrow(_mine, "term long, pos long, neg long").groupBy("term").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        terms = staged(terms.where("pos >= 3"), "toxic-terms")
        df = F.col("pos") + F.col("neg")
        g = 2 * (F.col("pos") * F.log(F.col("pos") / (df * rate))
                 + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (df * (1 - rate)))).otherwise(0.0))
        bar = 2 * float(np.log(max(2, terms.count()))) + 4
        top = terms.withColumn("g", g).where((F.col("g") > bar) & (F.col("pos") > 0.95 * df)) \
            .orderBy(F.desc("g"), "term").limit(max_terms).select("term").collect()
        mined = np.array([r["term"] for r in top], np.int64).view(np.uint64)
    voters = Voters(mined)
    # at most max_fit rows of counts
    rows = sample.select("text").mapInArrow(_counts(voters), "x binary").toPandas()["x"]
    x = np.stack([np.frombuffer(r, np.float32) for r in rows]).astype(float) if len(rows) else np.zeros((0, len(voters)))
    # three texts that stand for the voters' meaning where no sample is given
    x = np.concatenate([x, np.zeros((2, len(voters))), np.eye(1, len(voters))])
    p, _ = label_model(x)
    return voters, fit_linear(np.log1p(x), p)


def _counts(voters: Voters):
    def run(batches):
        for batch in batches:
            for _, _, raw, off in pieces(batch, "text"):
                x = voters.count(raw, off).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])
    return run


def _score(shared):
    def run(batches):
        voters, weights = shared.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, off in pieces(batch, "text"):
                z = np.log1p(voters.count(raw, off)) @ weights[:-1] + weights[-1]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_fit: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    docs = id_text(docs, id_col, text_col)
    model = fit(docs, labels, max_fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               max_fit: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns: one pass,
    no join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(id_text(docs, id_col, text_col), labels, max_fit))

    def run(batches):
        voters, weights = shared.value
        for batch in batches:
            for lo, hi, raw, off in pieces(batch, text_col):
                z = np.log1p(voters.count(raw, off)) @ weights[:-1] + weights[-1]
                yield batch.slice(lo, hi - lo).filter(pa.array(z < 0))

    return docs.mapInArrow(run, docs.schema)
