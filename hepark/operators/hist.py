"""Ranges, density histograms and 2-D kernel density.

Histograms follow numpy's equal-width rule: ``n`` bins on [lo, hi], edges
``lo + i*(hi-lo)/n`` (last edge = hi), the last bin right-closed, values
outside dropped, lo = hi widened by 0.5 on each side, density =
count / width / in-range count.  Counting is a grouped aggregate (partial
per partition); empty bins come from the per-group map of counts.  The input
is read twice: for the ranges and for the counts.  A null group is a group.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hepark.operators.ranking import BROADCAST_BOUNDS_BYTES, join_groups
from hepark.session import cut_lineage

RANGE_ROW_BYTES = 128          # a range row with its keys, generously


def feature_ranges(long: DataFrame, by: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """G1: min and max per group."""
    return long.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def _edges(lo: Column, hi: Column) -> tuple[Column, Column]:
    same = lo == hi
    return (F.when(same, lo - F.lit(0.5)).otherwise(lo), F.when(same, hi + F.lit(0.5)).otherwise(hi))


def edge(i: Column, lo: Column, hi: Column, n: int) -> Column:
    """numpy.linspace(lo, hi, n+1)[i]."""
    return F.when(i >= n, hi).otherwise(i.cast("double") * ((hi - lo) / F.lit(float(n))) + lo)


def bin_index(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based bin of ``v`` (caller keeps lo <= v <= hi), with numpy's edge
    corrections so values on an edge land where numpy puts them."""
    i0 = F.floor((v - lo) / (hi - lo) * F.lit(float(n))).cast("int")
    i1 = F.when(i0 == n, F.lit(n - 1)).otherwise(i0)
    i2 = F.when(v < edge(i1, lo, hi, n), i1 - 1).otherwise(i1)
    return F.when((v >= edge(i2 + 1, lo, hi, n)) & (i2 != n - 1), i2 + 1).otherwise(i2)


def histogram(long: DataFrame, ranges: DataFrame, bins: int, by: Sequence[str],
              range_by: Sequence[str], value: str = "value") -> DataFrame:
    """Density histogram of ``value`` per ``by`` group on the range of its
    ``range_by`` group (``ranges`` has range_by..., lo, hi).

    Output: by..., bin, lo_edge, count, density (all bins, empty ones 0)."""
    by, range_by = list(by), list(range_by)
    r = ranges.select(*range_by, *[c.alias(n) for c, n in zip(_edges(F.col("lo"), F.col("hi")), ("lo", "hi"))])
    # one row per range group, written once; broadcast when its counted size
    # allows, so that the long table is not dealt by a handful of keys
    r = cut_lineage(r)
    small = r.count() * RANGE_ROW_BYTES <= BROADCAST_BOUNDS_BYTES
    j = join_groups(long, r, range_by, broadcast=small)
    v = F.col(value)
    inside = (v >= F.col("lo")) & (v <= F.col("hi"))
    # one pass: out-of-range values count in bin -1, so a group whose values
    # all fall outside still yields its (empty) bins
    c = (j.withColumn("bin", F.when(inside, bin_index(v, F.col("lo"), F.col("hi"), bins)).otherwise(F.lit(-1)))
         .groupBy(*by, "bin").agg(F.count(F.lit(1)).cast("long").alias("n"), F.first("lo").alias("lo"),
                                  F.first("hi").alias("hi")))
    held = F.col("bin") >= 0
    # at most bins + 1 rows a group: its counts become one map, its bins come from it
    g = c.groupBy(*by).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                           F.sum(F.when(held, F.col("n"))).alias("_tot"),
                           F.map_from_entries(F.collect_list(F.when(held, F.struct("bin", "n")))).alias("_n"))
    h = g.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) \
         .withColumn("count", F.coalesce(F.element_at("_n", F.col("bin")), F.lit(0).cast("long")))
    lo_e = edge(F.col("bin"), F.col("lo"), F.col("hi"), bins)
    hi_e = edge(F.col("bin") + 1, F.col("lo"), F.col("hi"), bins)
    dens = F.try_divide(F.col("count") / (hi_e - lo_e), F.col("_tot").cast("double"))
    return h.select(*by, F.col("bin").cast("int"), lo_e.alias("lo_edge"), "count", dens.alias("density"))


def hist_joint(long: DataFrame, bins: int = 50, feature: str = "feature", label: str = "y",
               value: str = "value") -> DataFrame:
    """Per class, on the joint (both classes) range of the feature."""
    rng = feature_ranges(long, [feature], value)
    return histogram(long, rng, bins, [feature, label], [feature], value)


def hist_own(long: DataFrame, bins: int = 60, feature: str = "feature", label: str = "y",
             value: str = "value") -> DataFrame:
    """Per class on the class's own range."""
    rng = feature_ranges(long, [feature, label], value)
    return histogram(long, rng, bins, [feature, label], [feature, label], value)


def hist_pair(pairs: DataFrame, bins: int = 60, feature: str = "feature", label: str = "y") -> DataFrame:
    """Input and reconstruction histograms, both on the input's class range.

    ``pairs`` has (feature, y, input, recon); output has ``kind`` in
    {input, recon}."""
    rng = feature_ranges(pairs.withColumnRenamed("input", "value"), [feature, label], "value")
    kinds = F.array(F.struct(F.lit("input").alias("kind"), F.col("input").alias("value")),
                    F.struct(F.lit("recon").alias("kind"), F.col("recon").alias("value")))
    long = pairs.select(feature, label, F.explode(kinds).alias("_k")).select(feature, label, "_k.kind", "_k.value")
    return histogram(long, rng, bins, [feature, label, "kind"], [feature, label], "value")


def kde2d(df: DataFrame, xi: str, xj: str, grid: int = 10, label: str = "y",
          prebin: int | None = None) -> DataFrame:
    """Gaussian KDE per class (Scott bandwidth, sample covariance) on a
    ``grid x grid`` lattice spanning the joint range of the two features.

    Every task adds its rows' kernels up on the lattice, an Arrow batch at a time,
    and passes on one sum per class and lattice point, so rows are never multiplied.
    ``prebin=m`` first aggregates the rows into an ``m x m`` count histogram
    per class (bin centres) and evaluates the kernels from the weighted
    centres: work ~ #classes x m^2 x grid^2 instead of rows x grid^2, with an
    error of order (bin width / bandwidth)^2.  The bandwidth always comes from
    the exact moments.
    """
    st = df.groupBy(label).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.var_samp(xi).alias("vx"),
        F.var_samp(xj).alias("vy"), F.covar_samp(xi, xj).alias("cxy"))
    fac2 = F.pow(F.col("n"), F.lit(-1.0 / 6.0)) * F.pow(F.col("n"), F.lit(-1.0 / 6.0))
    st = st.select(label, "n", (F.col("vx") * fac2).alias("sxx"), (F.col("vy") * fac2).alias("syy"),
                   (F.col("cxy") * fac2).alias("sxy"))
    st = st.withColumn("det", F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy"))
    r = df.agg(F.min(xi).alias("x0"), F.max(xi).alias("x1"), F.min(xj).alias("y0"),
               F.max(xj).alias("y1")).first()  # four numbers
    if r is None or r["x0"] is None:
        return df.sparkSession.createDataFrame([], f"{label} int, gx int, gy int, px double, py double, density double")
    classes = st.collect()                              # one row per class
    xs, ys = (np.linspace(float(r[f"{c}0"]), float(r[f"{c}1"]), grid) if grid > 1 else np.array([float(r[f"{c}0"])])
              for c in "xy")
    pts = df.select(label, F.col(xi).alias("_u"), F.col(xj).alias("_v"), F.lit(1.0).alias("_w"))
    if prebin:
        m = int(prebin)
        wx = (float(r["x1"]) - float(r["x0"])) / m or 1.0
        wy = (float(r["y1"]) - float(r["y0"])) / m or 1.0
        bx = F.least(F.floor((F.col("_u") - F.lit(float(r["x0"]))) / F.lit(wx)), F.lit(m - 1))
        byy = F.least(F.floor((F.col("_v") - F.lit(float(r["y0"]))) / F.lit(wy)), F.lit(m - 1))
        pts = (pts.groupBy(label, bx.alias("_bx"), byy.alias("_by")).agg(F.count(F.lit(1)).cast("double").alias("_w"))
               .select(label, (F.lit(float(r["x0"])) + (F.col("_bx") + F.lit(0.5)) * F.lit(wx)).alias("_u"),
                       (F.lit(float(r["y0"])) + (F.col("_by") + F.lit(0.5)) * F.lit(wy)).alias("_v"), "_w"))
    which = F.lit(None).cast("int")
    back = F.lit(None).cast(df.schema[label].dataType)
    for i, c in enumerate(classes):
        which = F.when(F.col(label).eqNullSafe(F.lit(c[label])), F.lit(i)).otherwise(which)
        back = F.when(F.col("_c") == i, F.lit(c[label])).otherwise(back)
    shape = [(c["sxx"], c["syy"], c["sxy"], c["det"]) for c in classes]
    sums = pts.select(which.alias("_c"), *[F.col(c).cast("double") for c in ("_u", "_v", "_w")]) \
        .where("_u is not null and _v is not null") \
        .mapInArrow(_lattice(shape, xs, ys), "_c int, _i int, _s double")
    agg = sums.groupBy("_c", "_i").agg(F.sum("_s").alias("_s"))
    norm = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        if c["det"] is not None and c["det"] > 0:
            norm = F.when(F.col("_c") == i, F.lit(c["n"] * 2.0 * math.pi * math.sqrt(c["det"]))).otherwise(norm)
    gx, gy = F.floor(F.col("_i") / grid).cast("int"), (F.col("_i") % grid).cast("int")
    step = [float(r[f"{c}1"] - r[f"{c}0"]) / max(grid - 1, 1) for c in "xy"]
    px, py = (g.cast("double") * F.lit(h) + F.lit(float(r[f"{c}0"])) for g, h, c in zip((gx, gy), step, "xy"))
    return agg.select(back.alias(label), gx.alias("gx"), gy.alias("gy"), px.alias("px"), py.alias("py"),
                      (F.col("_s") / norm).alias("density"))


#: Kernel values that a task holds at a time.
LATTICE_VALUES = 1 << 20


def _lattice(shape, xs, ys):
    """(class, x, y, weight) -> one kernel sum per class and lattice point of each task."""
    px, py = np.repeat(xs, len(ys)), np.tile(ys, len(xs))

    def run(batches):
        total = np.zeros((len(shape), len(px)))
        seen = np.zeros(len(shape), bool)
        step = max(1, LATTICE_VALUES // len(px))
        for batch in batches:
            c, u, v, w = (np.asarray(batch.column(i)) for i in range(4))
            for k in np.unique(c):
                sxx, syy, sxy, det = shape[k]
                rows = np.flatnonzero(c == k)
                seen[k] = True
                if not det:                             # one point, or points on a line: no density
                    continue
                for at in range(0, len(rows), step):
                    part = rows[at:at + step]
                    dx, dy = px[:, None] - u[part], py[:, None] - v[part]
                    total[k] += np.exp(-0.5 * ((syy * dx * dx - 2.0 * sxy * dx * dy + sxx * dy * dy) / det)) @ w[part]
        for k in np.flatnonzero(seen):
            n = len(px)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                                              pa.array(total[k])], names=["_c", "_i", "_s"])
    return run


def hist(long: DataFrame, bins: int = 50, range: str = "joint", feature: str = "feature",
         label: str = "y", value: str = "value") -> DataFrame:
    """Density histogram per (feature, class); ``range`` = ``joint`` (both
    classes share the feature's range) or ``own`` (each class its own)."""
    if range == "joint":
        return hist_joint(long, bins, feature, label, value)
    if range == "own":
        return hist_own(long, bins, feature, label, value)
    raise TypeError(f"unknown range rule {range!r}")
