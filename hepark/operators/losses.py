"""Loss aggregates (I1-I7): projections with array functions + one aggregate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hepark.functions.exprs import FLOAT32_EPS, LOG_CLAMP
from hepark.operators.ranking import exact_quantiles, ordered_scan
from hepark.session import cut_lineage


def row_sq_err(x: str = "x", xr: str = "recon") -> Column:
    """Per-row mean of squared differences."""
    a, b = F.col(x).cast("array<double>"), F.col(xr).cast("array<double>")
    s = F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda acc, t: acc + t)
    return s / F.size(a).cast("double")


def mse(df: DataFrame, x: str = "x", xr: str = "recon", by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error over all elements (rows have equal width)."""
    return df.groupBy(*by).agg(F.avg(row_sq_err(x, xr)).alias("mse"))


def _safe_log(c: Column) -> Column:
    # log(0) is -inf; the clamp makes it -100 as the reference's loss does
    return F.when(c > 0, F.log(c)).otherwise(F.lit(float("-inf")))


def bce_row(y: str = "y", p: str = "prob") -> Column:
    """Per-row binary cross-entropy with logs clamped at -100."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    return -(yy * F.greatest(_safe_log(pp), F.lit(LOG_CLAMP))
             + (F.lit(1.0) - yy) * F.greatest(_safe_log(F.lit(1.0) - pp), F.lit(LOG_CLAMP)))


def bce(df: DataFrame, y: str = "y", p: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """I2."""
    return df.groupBy(*by).agg(F.avg(bce_row(y, p)).alias("bce"))


def bce_shifted(df: DataFrame, y: str = "y", s: str = "score", by: Sequence[str] = (),
                eps: float = FLOAT32_EPS) -> DataFrame:
    """Score in [-1, 1] -> (s+1)/2, clipped to [eps, 1-eps], logs of p+eps."""
    p = (F.col(s).cast("double") + F.lit(1.0)) / F.lit(2.0)
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    yy = F.col(y).cast("double")
    t = yy * F.log(p + F.lit(eps)) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - p + F.lit(eps))
    return df.groupBy(*by).agg((-F.avg(t)).alias("bce_shifted"))


def combine_losses(kind: str, recon: Column, cls: Column | None = None, latent: Column | None = None,
                   w: float = 0.5, a: float = 1.0, b: float = 1.0) -> Column:
    """I4: classifier (1-w)*mse + w*bce; variational / sinkhorn
    (1-w)*mse + w*latent; sinkclass mse + a*latent + b*bce."""
    if kind == "classifier":
        return F.lit(1.0 - w) * recon + F.lit(w) * cls
    if kind in ("variational", "sinkhorn"):
        return F.lit(1.0 - w) * recon + F.lit(w) * latent
    if kind == "sinkclass":
        return recon + F.lit(a) * latent + F.lit(b) * cls
    raise TypeError(f"unknown loss combination {kind!r}")


def _lse(arr: Column) -> Column:
    return F.log(F.aggregate(F.transform(arr, lambda v: F.exp(v)), F.lit(0.0), lambda acc, t: acc + t))


def latent_kl_row(latent: str = "latent", samples: str = "samples") -> Column:
    """Per-row KL(softmax(samples) || softmax(latent)) summed over dimensions."""
    z = F.col(latent).cast("array<double>")
    e = F.col(samples).cast("array<double>")
    lz, le = _lse(z), _lse(e)
    return F.aggregate(F.zip_with(z, e, lambda zi, ei: F.exp(ei - le) * ((ei - le) - (zi - lz))),
                       F.lit(0.0), lambda acc, t: acc + t)


def latent_kl(df: DataFrame, latent: str = "latent", samples: str = "samples") -> DataFrame:
    """KL(softmax(samples) || softmax(latent)) summed over dimensions and
    rows, divided by the row count."""
    return df.agg((F.sum(latent_kl_row(latent, samples)) / F.count(F.lit(1)).cast("double"))
                  .alias("latent_kl"))


def _long_sets(a: DataFrame, b: DataFrame, x: str, projections: DataFrame | None) -> DataFrame:
    """(set, dim, value) of two vector sets, projected if directions are given."""
    def long(df, tag):
        xs = F.col(x).cast("array<double>")
        if projections is not None:
            # #projections x #dims numbers: read once, inlined as literals
            dirs = [(int(r["proj"]), [float(v) for v in r["dir"]])
                    for r in projections.select("proj", "dir").collect()]
            vals = F.array(*[F.struct(F.lit(pid).alias("dim"), F.aggregate(
                F.zip_with(xs, F.array(*[F.lit(v) for v in d]), lambda u, w: u * w), F.lit(0.0),
                lambda acc, t: acc + t).alias("value")) for pid, d in dirs])
            return df.select(F.lit(tag).alias("set"), F.explode(vals).alias("_p")) \
                     .select("set", "_p.dim", "_p.value")
        return df.select(F.lit(tag).alias("set"), F.posexplode(xs).alias("dim", "value")) \
                 .withColumn("dim", F.col("dim").cast("int"))
    return long(a, "a").unionByName(long(b, "b"))


def wasserstein(a: DataFrame, b: DataFrame, probs: Sequence[float], x: str = "x",
                projections: DataFrame | None = None) -> DataFrame:
    """I6 on a quantile grid: 1-Wasserstein between two vector sets per dimension as
    the mean over ``probs`` of |q_a - q_b| (:func:`wasserstein_exact` needs no grid and
    adds the mean over dimensions).
    With ``projections`` (rows ``proj``, ``dir`` arrays; bounded) the sets are
    first projected (sliced Wasserstein)."""
    # both sets' quantiles come from one result (#dims x #probs rows), computed once
    q = cut_lineage(exact_quantiles(_long_sets(a, b, x, projections), ["set", "dim"], "value", probs))
    qa = q.filter(F.col("set") == "a").select("dim", "p_idx", F.col("q").alias("qa"))
    qb = q.filter(F.col("set") == "b").select("dim", "p_idx", F.col("q").alias("qb"))
    return qa.join(qb, ["dim", "p_idx"]).groupBy("dim").agg(F.avg(F.abs(F.col("qa") - F.col("qb"))).alias("w1"))


def wasserstein_exact(a: DataFrame, b: DataFrame, x: str = "x", projections: DataFrame | None = None) -> DataFrame:
    """Exact 1-Wasserstein distance per dimension, (dim, w1), and its mean over the
    dimensions as the row with a null ``dim``.

    It is the area between the two cumulative distributions: both sets' values are
    counted per distinct value and merged in one ordered scan, which gives each value
    both shares below it and its distance to the value before.  A dimension that
    one set lacks has a null distance and does not enter the mean; null values are ignored."""
    u = _long_sets(a, b, x, projections).where("value is not null")
    c = u.groupBy("dim", "value").agg(*[F.sum((F.col("set") == t).cast("long")).alias(t) for t in ("a", "b")])
    s = ordered_scan(c.withColumn("at", F.col("value")), ["dim"], "value", sums=["a", "b"], prevs=["at"], totals=True)
    share = [F.try_divide(F.col(f"{t}_below").cast("double"), F.col(f"{t}_total").cast("double")) for t in ("a", "b")]
    gap = F.coalesce(F.col("value") - F.col("prev_at"), F.lit(0.0))
    per = cut_lineage(s.groupBy("dim").agg(F.sum(gap * F.abs(share[0] - share[1])).alias("w1")))
    return per.unionByName(per.agg(F.lit(None).cast("int").alias("dim"), F.avg("w1").alias("w1")))


def seeded_directions(spark, n: int, dim: int, seed: int) -> DataFrame:
    """``n`` unit projection directions in ``dim`` dimensions from md5-seeded
    normals (a parameter-sized table: n rows of dim numbers)."""
    from hepark.operators.scoring import normal_noise
    d = spark.range(n).withColumnRenamed("id", "proj").withColumn("_k", F.col("proj") + F.lit(1_000_003 * seed))
    d = d.withColumn("_g", normal_noise("_k", seed, dim))
    nrm = F.sqrt(F.aggregate(F.transform("_g", lambda v: v * v), F.lit(0.0), lambda acc, t: acc + t))
    return d.select(F.col("proj").cast("int"), F.transform("_g", lambda v: v / nrm).alias("dir"))


def loss_by(df: DataFrame, loss: Column, col: str = "batch_id", by: Sequence[str] = ()) -> DataFrame:
    """Mean of the **unweighted** per-``col`` means (epoch loss of batches)."""
    per = df.groupBy(*by, col).agg(F.avg(loss).alias("_m"))
    return per.groupBy(*by).agg(F.avg("_m").alias("loss"), F.count(F.lit(1)).cast("long").alias("n_batches"))
