"""ROC curves, tie-aware AUC, working points and fold statistics.

Everything starts from per-(group, score) positive/negative counts, which is
a partial (map-side) aggregate: a score value that holds a third of all rows
collapses to one row before the shuffle.  Prefix sums over the distinct
scores use the two-phase ordered scan of :mod:`hepark.operators.ranking`,
which also hands each vertex its neighbour's counts, so no step runs a
window over a whole group.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hepark.operators.ranking import join_groups, ordered_scan
from hepark.session import cut_lineage

# fixed values: the TPR grid of the saved ROC curves (100 points from 0.025
# to 0.99) and the working point of the efficiency report
TPR_GRID_LO, TPR_GRID_HI, TPR_GRID_N = 0.025, 0.99, 100
WORKING_TPR = 0.8


def tpr_grid() -> list[float]:
    return [float(v) for v in np.linspace(TPR_GRID_LO, TPR_GRID_HI, TPR_GRID_N)]


def score_counts(scores: DataFrame, by: Sequence[str] = (), score: str = "score",
                 label: str = "y") -> DataFrame:
    y = F.col(label).cast("long")
    return (scores.groupBy(*by, F.col(score).cast("double").alias("score"))
            .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))


def auc(scores: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "y",
        buckets: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Tie-aware AUC per group (trapezoid = Mann-Whitney with half credit).

    Null when a group has only one class."""
    by = list(by)
    c = counts if counts is not None else score_counts(scores, by, score, label)
    c = ordered_scan(c, by, "score", sums=["neg"], buckets=buckets)
    part = c.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0))).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return part.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                   F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))


def roc_curve(scores: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "y",
              drop_intermediate: bool = True, buckets: int | None = None,
              counts: DataFrame | None = None) -> DataFrame:
    """ROC vertices per group.

    Distinct thresholds in descending order get ``thr_idx`` 1..n; the origin
    (0, 0) is ``thr_idx`` 0 with a null threshold.  With ``drop_intermediate``
    a vertex is kept when it is the first or last threshold or when its
    (pos, neg) counts differ from the next lower threshold's (the second
    difference of the cumulative counts is non-zero); groups with at most two
    thresholds keep all.  Columns: by..., thr_idx, threshold, tp, fp, tpr, fpr.

    One ordered scan over the distinct scores gives cumulative counts, ranks,
    group totals and the lower neighbour's counts together.
    """
    by = list(by)
    c = counts if counts is not None else score_counts(scores, by, score, label)
    c = c.withColumn("_one", F.lit(1).cast("long"))
    c = ordered_scan(c, by, "score", sums=["pos", "neg", "_one"], prevs=["pos", "neg"],
                     totals=True, buckets=buckets)
    c = c.select(*by, "score", "pos", "neg", "prev_pos", "prev_neg",
                 F.col("pos_total").alias("P"), F.col("neg_total").alias("N"),
                 F.col("n_group").alias("n_thr"),
                 (F.col("_one_below") + 1).alias("rk"),
                 (F.col("n_group") - F.col("_one_below")).cast("long").alias("thr_idx"),
                 (F.col("pos_total") - F.col("pos_below")).cast("long").alias("tp"),
                 (F.col("neg_total") - F.col("neg_below")).cast("long").alias("fp"))
    if drop_intermediate:
        keep = ((F.col("n_thr") <= 2) | (F.col("thr_idx") == 1) | (F.col("rk") == 1)
                | (F.col("prev_pos") != F.col("pos")) | (F.col("prev_neg") != F.col("neg")))
        c = c.filter(keep)
    pts = c.select(*by, "thr_idx", F.col("score").alias("threshold"), "tp", "fp", "P", "N")
    origin = c.filter(F.col("thr_idx") == 1).select(
        *by, F.lit(0).cast("long").alias("thr_idx"), F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "P", "N")
    allp = pts.unionByName(origin)
    return allp.select(*by, "thr_idx", "threshold", "tp", "fp",
                       F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")).alias("tpr"),
                       F.try_divide(F.col("fp").cast("double"), F.col("N").cast("double")).alias("fpr"))


def roc_segments(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive kept vertices as segments (tpr0, fpr0) -> (tpr1, fpr1);
    the last vertex has a null end."""
    by = list(by)
    r = roc.withColumn("_nidx", -F.col("thr_idx"))
    r = ordered_scan(r, by, "_nidx", prevs=["tpr", "fpr"])
    return r.select(*by, F.col("thr_idx").alias("seg"), F.col("tpr").alias("tpr0"),
                    F.col("fpr").alias("fpr0"), F.col("prev_tpr").alias("tpr1"),
                    F.col("prev_fpr").alias("fpr1"))


def roc_on_grid(roc: DataFrame, by: Sequence[str] = (), grid: Sequence[float] | None = None) -> DataFrame:
    """``numpy.interp(grid, tpr, fpr)`` per group.

    For grid value g the segment with tpr0 <= g < tpr1 is used (so at a
    repeated TPR the last vertex wins); g at or beyond the last vertex takes
    its FPR.  Candidate grid indices per segment are generated arithmetically
    and checked exactly, so this is an equi-free explode, not a nested loop.
    """
    by = list(by)
    grid = list(grid or tpr_grid())
    n = len(grid)
    lo, hi = grid[0], grid[-1]
    step = (hi - lo) / (n - 1) if n > 1 else 1.0
    seg = roc_segments(roc, by)
    garr = F.array(*[F.lit(float(g)) for g in grid])
    last = F.col("tpr1").isNull()
    m_lo = F.greatest(F.lit(0), F.floor((F.col("tpr0") - F.lit(lo)) / F.lit(step)).cast("int") - 1)
    m_hi = F.when(last, F.lit(n - 1)).otherwise(
        F.least(F.lit(n - 1), F.ceil((F.col("tpr1") - F.lit(lo)) / F.lit(step)).cast("int") + 1))
    e = (seg.filter(m_lo <= m_hi)
         .withColumn("grid_idx", F.explode(F.sequence(m_lo, m_hi)))
         .withColumn("tpr", F.element_at(garr, F.col("grid_idx") + 1)))
    inside = (F.col("tpr") >= F.col("tpr0")) & (last | (F.col("tpr") < F.col("tpr1")))
    val = F.when(last, F.col("fpr0")).otherwise(
        (F.col("fpr1") - F.col("fpr0")) / (F.col("tpr1") - F.col("tpr0")) * (F.col("tpr") - F.col("tpr0"))
        + F.col("fpr0"))
    return e.filter(inside).select(*by, F.col("grid_idx").cast("int"), "tpr", val.alias("fpr"))


def fpr_at_tpr(roc: DataFrame, by: Sequence[str] = (), target: float = WORKING_TPR) -> DataFrame:
    """FPR of the vertex whose TPR is nearest ``target`` (first vertex on ties)."""
    key = F.struct(F.abs(F.col("tpr") - F.lit(target)).alias("d"), F.col("thr_idx").alias("i"))
    return roc.groupBy(*by).agg(F.min_by("fpr", key).alias("fpr_at_tpr"))


def fold_auc(scores: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold",
             score: str = "score", label: str = "y") -> DataFrame:
    """Per-fold AUC, then mean and population std over folds."""
    by = list(by)
    a = auc(scores, by + [fold], score, label)
    return a.groupBy(*by).agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
                              F.count(F.lit(1)).cast("long").alias("n_folds"))


def fold_metrics(scores: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold",
                 score: str = "score", label: str = "y") -> DataFrame:
    """Per (group, fold): auc and FPR at the working point."""
    by = list(by)
    g = by + [fold]
    # one set of counts (checkpointed once) feeds both the AUC and the ROC
    c = cut_lineage(score_counts(scores, g, score, label))
    roc = roc_curve(scores, g, score, label, counts=c)
    return auc(scores, g, score, label, counts=c).join(fpr_at_tpr(roc, g), g, "inner")


def fold_and_pooled_counts(scores: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold",
                           score: str = "score", label: str = "y") -> DataFrame:
    """Score counts per fold and of all folds pooled, as one table: by..., fold, pooled
    (1: all folds, fold is null), score, pos, neg.  The rows are counted once; grouping
    sets over the counts add the pooled ones.  Written once, to feed curves and areas."""
    by = list(by)
    c = score_counts(scores, [*by, fold], score, label)
    keys = [*by, fold, "score"]
    both = c.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in keys if k != fold]], *[F.col(k) for k in keys])
    return cut_lineage(both.agg(F.grouping(fold).cast("int").alias("pooled"), F.sum("pos").alias("pos"),
                                F.sum("neg").alias("neg")))


def fold_and_pooled_roc(scores: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold",
                        score: str = "score", label: str = "y", drop_intermediate: bool = True) -> DataFrame:
    """H5: the ROC vertices of every fold and of all folds pooled, from one table of counts
    and one ordered scan."""
    c = fold_and_pooled_counts(scores, by, fold, score, label)
    return roc_curve(c, [*by, fold, "pooled"], drop_intermediate=drop_intermediate, counts=c)


def fold_and_pooled_metrics(scores: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold",
                            score: str = "score", label: str = "y") -> DataFrame:
    """H5: per group the mean and population std of the folds' AUCs and FPRs at the working
    point beside the pooled AUC and FPR."""
    by = list(by)
    g = [*by, fold, "pooled"]
    c = fold_and_pooled_counts(scores, by, fold, score, label)
    m = join_groups(auc(c, g, counts=c), fpr_at_tpr(roc_curve(c, g, counts=c), g), g)
    folds, pooled = F.col("pooled") == 0, F.col("pooled") == 1
    return m.groupBy(*by).agg(
        F.avg(F.when(folds, F.col("auc"))).alias("mean_auc"), F.stddev_pop(F.when(folds, F.col("auc"))).alias("std_auc"),
        F.avg(F.when(folds, F.col("fpr_at_tpr"))).alias("mean_fpr"), F.max(F.when(pooled, F.col("auc"))).alias("pooled_auc"),
        F.max(F.when(pooled, F.col("fpr_at_tpr"))).alias("pooled_fpr"))


def rejection(metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Background rejection 1/FPR at the working point: mean, sample std."""
    inv = F.lit(1.0) / F.col("fpr_at_tpr")
    return metrics.groupBy(*by).agg(F.avg(inv).alias("mean_rejection"),
                                    F.stddev_samp(inv).alias("std_rejection"))


def roc_band(grid_roc: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and mean +- sample std of the FPR per grid point over folds."""
    by = list(by)
    g = grid_roc.groupBy(*by, "grid_idx", "tpr").agg(F.avg("fpr").alias("fpr_mean"),
                                                    F.stddev_samp("fpr").alias("fpr_std"))
    return g.select(*by, "grid_idx", "tpr", "fpr_mean",
                    (F.col("fpr_mean") - F.col("fpr_std")).alias("fpr_lo"),
                    (F.col("fpr_mean") + F.col("fpr_std")).alias("fpr_hi"))


def compare_models(metrics: DataFrame, by: Sequence[str] = ("feature_set", "model")) -> DataFrame:
    """AUC mean and sample std per model (notebook convention)."""
    return metrics.groupBy(*by).agg(F.avg("auc").alias("mean_auc"),
                                    F.stddev_samp("auc").alias("std_auc"),
                                    F.count(F.lit(1)).cast("long").alias("n_folds"))


def accuracy(scores: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "y",
             threshold: float = 0.0) -> DataFrame:
    """Accuracy of the decision ``score > threshold`` against ``label``."""
    pred = (F.col(score) > F.lit(threshold)).cast("int")
    return scores.groupBy(*by).agg(
        F.avg((pred == F.col(label).cast("int")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).cast("long").alias("n"))


def feature_auc(long: DataFrame, feature: str = "feature", value: str = "value",
                label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """AUC of each feature used as a score (H3)."""
    return auc(long, list(by) + [feature], value, label)


def feature_auc_chunked(long: DataFrame, chunk: str = "chunk", feature: str = "feature",
                        value: str = "value", label: str = "y", n: int | None = None) -> DataFrame:
    """H4: AUC per (feature, chunk); mean and population std over chunks,
    and the AUC on all rows pooled.

    One ordered scan per call: a score's row carries the positives and negatives of
    every chunk side by side, so all chunks' and the pooled prefix sums come from the same
    pass.  Chunks are 0..n-1; without ``n`` they are read from the column."""
    names = list(range(n)) if n is not None else [r[0] for r in long.select(chunk).distinct().collect()]
    y = F.col(label).cast("long")
    here = [F.col(chunk).eqNullSafe(F.lit(c)) for c in names]
    sums = [F.sum(F.when(h, v).otherwise(0)).alias(f"{k}{i}") for i, h in enumerate(here)
            for k, v in (("pos", y), ("neg", F.lit(1) - y))]
    cols = [*(str(i) for i in range(len(names))), ""]       # "" is the pooled sum
    c = long.groupBy(feature, F.col(value).cast("double").alias("score")).agg(
        *sums, F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    c = ordered_scan(c, [feature], "score", sums=[f"neg{i}" for i in cols])
    c = c.groupBy(feature).agg(*[e for i in cols for e in (
        F.sum(F.col(f"pos{i}") * (F.col(f"neg{i}_below") + F.col(f"neg{i}") / F.lit(2.0))).alias(f"u{i}"),
        F.sum(f"pos{i}").alias(f"p{i}"), F.sum(f"neg{i}").alias(f"n{i}"))])
    area = [F.when((F.col(f"p{i}") > 0) & (F.col(f"n{i}") > 0), F.col(f"u{i}") / (F.col(f"p{i}") * F.col(f"n{i}")))
            for i in cols]
    c = c.select(feature, area[-1].alias("pooled_auc"), F.explode(F.array(*area[:-1])).alias("auc"))
    return c.groupBy(feature).agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
                                  F.first("pooled_auc").alias("pooled_auc"))


def auc_sum(per_feature: DataFrame, col: str = "auc") -> DataFrame:
    """Sum of per-feature AUCs, also as the '%.3f' text the report writes."""
    return per_feature.agg(F.sum(col).alias("auc_sum")).withColumn(
        "auc_sum_text", F.format_string("%.3f", F.col("auc_sum")))


__all__ = [n for n in dir() if not n.startswith("_")]


def feature_auc_chunks(df: DataFrame, n: int = 5, seed: int = 0, key: str = "k", x: str = "x",
                       label: str = "y", hash: str = "md5") -> DataFrame:
    """H4 from a feature matrix: seeded shuffle, ``n`` near-equal chunks,
    per-feature AUC per chunk -> mean, population std, pooled AUC."""
    from hepark.operators.features import explode_features
    from hepark.operators.sampling import chunk
    c = chunk(df, n, seed, key, hash=hash)
    return feature_auc_chunked(explode_features(c, x, keep=(key, label, "chunk")), label=label, n=n)
