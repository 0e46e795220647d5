"""Approximate nearest neighbours by collision counting.

Vectors are projected on ``m`` random directions; each projection is one sorted
array.  Around a query's own projection a window is expanded by virtual
rehashing (radius x ``growth`` a round) and a vector collides once for every
array whose window holds it.  Vectors whose collisions exceed the threshold
become candidates and are verified by their exact cosine.  A block's search ends
when ``verify_share`` of the block has been verified, or when the k nearest
found so far lie well inside the radius that the window stands for.

Vectors are dealt by hash into blocks of about ``BLOCK`` rows, queries into
blocks of ``QUERY_BLOCK``; each pair of blocks is one group, so that a group's
memory is bounded whatever the table's size, and only the k best of each query
and block leave it.  Every row is indexed; nothing is fitted.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part; finite vectors of any length do, however huge or tiny; vectors of different dimensions are never compared;
ties go to the smaller vec_id; a row with a null vec_id takes no part; rows that
share a vec_id count as one (the first by components); a query with fewer than
k candidates gets all; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hepark.llm.common import staged

BLOCK, QUERY_BLOCK = 4096, 1024
RESULT = "query_id long, vec_id long, score double"


def directions(dim: int, m: int) -> np.ndarray:
    """m random directions, orthogonal within each run of ``dim``."""
    rng = np.random.default_rng([dim, 7])
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-m // dim))]
    return np.concatenate(parts, axis=1)[:, :m] * np.sqrt(dim)


def unit_scale(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to [0.5, 1): exact,
    so the cosine is that of the rows themselves, but squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, m: int,
                 threshold: float, start: float, growth: float, verify_share: float):
    """The k best of one block for each query: (query, vec, score) arrays."""
    x, q = unit_scale(x), unit_scale(q)
    norm, qnorm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    a = directions(x.shape[1], m)
    p, pq = (x / norm[:, None]) @ a, (q / qnorm[:, None]) @ a
    order = np.argsort(p, axis=0)                               # the sorted arrays
    ranked = np.take_along_axis(p, order, axis=0)
    order, ranked = np.ascontiguousarray(order.T), np.ascontiguousarray(ranked.T)
    n = len(ids)
    enough = max(64 * k, int(verify_share * n))
    # radii up to the whole sphere (a projection of a unit vector is at most sqrt(dim))
    rounds = int(np.ceil(np.log(2 * np.sqrt(x.shape[1]) / start) / np.log(growth))) + 2
    radii = start * growth ** np.arange(rounds)
    out_q, out_v, out_s = [], [], []
    for i in range(len(qids)):
        if i % 64 == 0:                                         # windows of 64 queries at a time
            some = pq[i:i + 64]
            los = np.stack([ranked[j].searchsorted(some[:, j, None] - radii) for j in range(m)], axis=2)
            his = np.stack([ranked[j].searchsorted(some[:, j, None] + radii, "right") for j in range(m)], axis=2)
            mids = np.stack([ranked[j].searchsorted(some[:, j]) for j in range(m)], axis=1)
        count, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        score = np.full(n, -2.0)
        lo = hi = mids[i % 64]
        for t, r in enumerate(radii):
            new_lo, new_hi = np.minimum(los[i % 64, t], lo), np.maximum(his[i % 64, t], hi)
            fresh = [order[j, s:e] for j, (s, e) in enumerate(zip(new_lo.tolist(), lo.tolist())) if s < e]
            fresh += [order[j, s:e] for j, (s, e) in enumerate(zip(hi.tolist(), new_hi.tolist())) if s < e]
            lo, hi = new_lo, new_hi
            if not fresh:
                continue
            count += np.bincount(np.concatenate(fresh), minlength=n)
            full = int((hi - lo).min()) == n
            cand = np.flatnonzero(~seen if full else (count >= threshold * m) & ~seen)
            if len(cand):
                seen[cand] = True
                score[cand] = (x[cand] * q[i]).sum(1) / (norm[cand] * qnorm[i])
            done = int(seen.sum())
            if full or done >= enough:
                break
            if done > k:
                # the radius at which a vector this near collides with the threshold's share
                kth = np.partition(score[ids != qids[i]], -k)[-k]
                if kth > -2 and np.sqrt(max(0.0, 2 - 2 * kth)) * 1.5 < r:
                    break
        score[ids == qids[i]] = -2.0
        best = np.lexsort((ids, -score))[:k]
        best = best[score[best] > -2.0]
        out_q.append(np.full(len(best), qids[i]))
        out_v.append(ids[best])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
            m: int = 96, threshold: float = 0.46, start: float = 0.1, growth: float = 1.3,
            verify_share: float = 0.2) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query row."""
    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        good = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) \
            & F.exists(v, lambda c: c != 0)
        df = df.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        return df.groupBy("vec_id").agg(F.min("v").alias("v"))

    x = staged(usable(vectors).withColumn("dim", F.size("v")), "ann-vectors")
    q = staged(usable(queries).withColumn("dim", F.size("v")), "ann-queries")
    blocks, qblocks = (max(1, -(-df.count() // size)) for df, size in ((x, BLOCK), (q, QUERY_BLOCK)))

    def block(n: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(n))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    x = x.select("vec_id", "v", "dim", block(blocks).alias("b"), each(qblocks).alias("qb"))
    q = q.select("vec_id", "v", "dim", each(blocks).alias("b"), block(qblocks).alias("qb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = search_block(left["vec_id"].to_numpy(np.int64), np.stack(left["v"].to_numpy()).astype(np.float64),
                             right["vec_id"].to_numpy(np.int64), np.stack(right["v"].to_numpy()).astype(np.float64),
                             k, m, threshold, start, growth, verify_share)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ["dim", "b", "qb"]
    best = x.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(search, RESULT)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
