"""Feature normalisation (E1-E8): fit = one aggregate job, transform = projection.

A fitted scaler is a one-row DataFrame of per-feature arrays, so it is
bounded by the number of features, never by the number of rows.  Applying it
inlines that row as literals: a projection that maps the feature array with
``transform`` (the quantile map is an Arrow function).  Edge conventions are
those of the reference's scikit-learn defaults, which differ from Spark ML's
scalers (constant column -> 0 for min-max; population std; exact
interpolated quantiles).
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hepark.operators.ranking import exact_quantiles
from hepark.operators.scoring import _lists, _matrix

NORMS = ("vanilla", "minmax", "maxabs", "std", "robust", "power", "quantile")

# fixed values: scikit-learn defaults the reference relies on
QUANTILE_BOUNDS_THRESHOLD = 1e-7
QUANTILE_MAX_N = 1000
POWER_LAMBDA_START = (-2.0, 2.0)
# the likelihood of such a power overflows doubles; an optimum beyond is reported as this
POWER_LAMBDA_STOP = 128.0


def n_features(df: DataFrame, x: str = "x") -> int:
    """Width of the feature array (one scalar from one row)."""
    return int(df.select(F.size(x)).first()[0])


def _fit_rows(df: DataFrame, fit_on: str, split: str) -> DataFrame:
    if fit_on == "all":
        return df
    if fit_on == "train":
        return df.filter(F.col(split) == "train")
    raise ValueError(f"fit_on must be 'all' or 'train', got {fit_on!r}")


def _arr(prefix: str, n: int) -> F.Column:
    return F.array(*[F.col(f"{prefix}{i}") for i in range(n)])


def _zero_to_one(c: F.Column) -> F.Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def long_features(df: DataFrame, x: str = "x") -> DataFrame:
    return df.select(F.posexplode(F.col(x).cast("array<double>")).alias("feature", "value")) \
             .withColumn("feature", F.col("feature").cast("int"))


def fit_scaler(df: DataFrame, name: str, x: str = "x", fit_on: str = "all",
               split: str = "split", width: int | None = None, n_quantiles: int | None = None,
               lambdas: Sequence[float] | None = None, exact: bool = True,
               accuracy: int = 100000) -> DataFrame:
    """Fit a named scaler; returns a one-row parameter DataFrame.

    ``vanilla`` identity; ``minmax``; ``maxabs``; ``std`` (population);
    ``robust`` (median, IQR); ``power`` (Yeo-Johnson + std); ``quantile``
    (uniform output).  Unknown names raise ``TypeError``.

    ``exact=False`` fits the robust / quantile scalers from one-pass
    ``percentile_approx`` sketches (memory bounded by ``accuracy`` per
    feature) instead of exact quantiles, for inputs where the exact path's
    copy of the distinct values is too costly.
    """
    if name not in NORMS:
        raise TypeError(f"normalisation {name!r} does not exist")
    src = _fit_rows(df, fit_on, split)
    n = width if width is not None else n_features(src, x)
    xs = F.col(x).cast("array<double>")
    if name == "vanilla":
        return src.sparkSession.range(1).select(F.lit("vanilla").alias("norm"))
    if name in ("minmax", "maxabs", "std"):
        aggs = []
        for i in range(n):
            v = xs[i]
            if name == "minmax":
                aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
            elif name == "maxabs":
                aggs.append(F.max(F.abs(v)).alias(f"m{i}"))
            else:
                aggs += [F.avg(v).alias(f"mu{i}"), F.stddev_pop(v).alias(f"sd{i}")]
        # one wide aggregate: partial per partition, a single tiny row at the end
        p = src.agg(*aggs)
        if name == "minmax":
            rng = [F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(n)]
            scale = F.array(*[F.lit(1.0) / _zero_to_one(r) for r in rng])
            p = p.select(F.lit(name).alias("norm"), scale.alias("a"), _arr("lo", n).alias("lo"))
            return p.select("norm", "a", F.zip_with("a", "lo", lambda a, lo: F.lit(0.0) - lo * a).alias("b"))
        if name == "maxabs":
            return p.select(F.lit(name).alias("norm"),
                            F.array(*[_zero_to_one(F.col(f"m{i}")) for i in range(n)]).alias("a"))
        return p.select(F.lit(name).alias("norm"),
                        F.array(*[_zero_to_one(F.col(f"sd{i}")) for i in range(n)]).alias("a"),
                        _arr("mu", n).alias("b"))
    if name == "robust":
        q = _quantiles(long_features(src, x), [0.25, 0.5, 0.75], exact, accuracy)
        p = q.groupBy().agg(*[F.max(F.when((F.col("feature") == i) & (F.col("p_idx") == j), F.col("q")))
                              .alias(f"q{j}_{i}") for i in range(n) for j in range(3)])
        return p.select(F.lit(name).alias("norm"),
                        F.array(*[_zero_to_one(F.col(f"q2_{i}") - F.col(f"q0_{i}")) for i in range(n)]).alias("a"),
                        _arr("q1_", n).alias("b"))
    if name == "quantile":
        nq = n_quantiles
        if nq is None:
            nq = int(min(QUANTILE_MAX_N, src.count()))
        refs = [float(r) for r in np.linspace(0, 1, nq)]
        q = _quantiles(long_features(src, x), refs, exact, accuracy)
        # per feature: the sorted quantile array (size = #features x n_quantiles)
        q = q.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("p_idx", "q"))).alias("_s"))
        q = q.select("feature", F.transform("_s", lambda s: s["q"]).alias("quantiles"))
        return q.select(F.lit(name).alias("norm"), "feature", "quantiles",
                        F.array(*[F.lit(r) for r in refs]).alias("references"))
    # power
    return fit_power(src, x, n, lambdas)


def _quantiles(long: DataFrame, probs: Sequence[float], exact: bool, accuracy: int) -> DataFrame:
    """(feature, p_idx, p, q) exact or from approximate sketches."""
    if exact:
        return exact_quantiles(long, ["feature"], "value", probs)
    a = long.groupBy("feature").agg(
        F.percentile_approx("value", [float(p) for p in probs], accuracy).alias("_q"))
    parr = F.array(*[F.lit(float(p)) for p in probs])
    return a.select("feature", F.posexplode(F.arrays_zip(parr.alias("p"), F.col("_q").alias("q")))
                    .alias("p_idx", "_z")).select("feature", F.col("p_idx").cast("int"), "_z.p", "_z.q")


# ------------------------------------------------------------------ Yeo-Johnson

def yeo_johnson(v: F.Column, lam: F.Column) -> F.Column:
    pos = F.when(F.abs(lam) < F.lit(np.spacing(1.0)), F.log1p(v)).otherwise(
        (F.pow(v + F.lit(1.0), lam) - F.lit(1.0)) / lam)
    neg = F.when(F.abs(lam - F.lit(2.0)) > F.lit(np.spacing(1.0)),
                 -(F.pow(-v + F.lit(1.0), F.lit(2.0) - lam) - F.lit(1.0)) / (F.lit(2.0) - lam)
                 ).otherwise(-F.log1p(-v))
    return F.when(v >= 0, pos).otherwise(neg)


#: Groups whose sums a task holds at a time.
LIKELIHOOD_GROUPS = 4096


def _yeo_johnson_rows(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The transform of the values for each lambda, (#lambda, #values)."""
    out = np.empty((len(lam), len(x)))
    np.seterr(over="ignore", invalid="ignore")          # a power that overflows has no likelihood
    up = x >= 0
    a, b = np.log1p(x[up]), np.log1p(-x[~up])
    for i, l in enumerate(lam):                         # a handful of lambdas, all values at once
        out[i, up] = a if abs(l) < np.spacing(1.0) else np.expm1(l * a) / l
        out[i, ~up] = -b if abs(l - 2.0) <= np.spacing(1.0) else -np.expm1((2.0 - l) * b) / (2.0 - l)
    return out


def _likelihood_sums(grids, n_by: int, names: list[str], types):
    """(group..., value) -> for each group and lambda of its grid the count, mean and squared
    deviations of the transformed values, and the sum of the log derivative: one row each a
    task.  ``grids`` is one array for all groups or one per group."""
    schema = pa.schema([*((n, t) for n, t in zip(names, types)), ("lam", pa.float64()), ("n", pa.float64()),
                        ("mean", pa.float64()), ("m2", pa.float64()), ("slog", pa.float64()), ("lo", pa.float64()),
                        ("hi", pa.float64())])

    def run(batches):
        table = grids.value
        held: dict = {}

        def take():
            keys = [k for k, h in held.items() for _ in h[0]]
            cols = [pa.array([k[i] for k in keys], types[i]) for i in range(n_by)]
            for j in range(7):
                cols.append(pa.array(np.concatenate([np.broadcast_to(h[j], h[0].shape) for h in held.values()])
                                     if held else np.zeros(0)))
            held.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            v = np.asarray(batch.column(n_by), np.float64)
            if n_by:
                keys = pa.table([batch.column(i) for i in range(n_by)], names=[f"g{i}" for i in range(n_by)])
                groups = keys.append_column("r", pa.array(np.arange(len(v)))).group_by(
                    [f"g{i}" for i in range(n_by)]).aggregate([("r", "list")])
                parts = [(tuple(groups.column(f"g{i}")[g].as_py() for i in range(n_by)),
                          np.asarray(groups.column("r_list")[g].values)) for g in range(groups.num_rows)]
            else:
                parts = [((), np.arange(len(v)))]
            for key, rows in parts:
                x = v[rows]
                lam = table if isinstance(table, np.ndarray) else table.get(key)
                if lam is None:                         # a constant feature
                    continue
                t = _yeo_johnson_rows(x, lam)
                n, mean = float(len(x)), t.mean(1)
                m2 = ((t - mean[:, None]) ** 2).sum(1)
                slog, low, high = float((np.sign(x) * np.log1p(np.abs(x))).sum()), x.min(), x.max()
                if key in held:
                    _, n0, mean0, m20, slog0, low0, high0 = held[key]
                    off = mean - mean0
                    m2 = m20 + m2 + off * off * (n0 * n / (n0 + n))
                    mean, n, slog = mean0 + off * (n / (n0 + n)), n0 + n, slog0 + slog
                    low, high = min(low, low0), max(high, high0)
                held[key] = (lam, n, mean, m2, slog, low, high)
            if len(held) > LIKELIHOOD_GROUPS:
                yield take()
        yield take()
    return run


def _power_loglik(long: DataFrame, grids, by: Sequence[str], value: str) -> DataFrame:
    by = list(by)
    src = long.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    types = [f.type for f in to_arrow_schema(src.select(*by).schema)] if by else []
    shared = long.sparkSession.sparkContext.broadcast(grids)
    cols = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    part = src.mapInArrow(_likelihood_sums(shared, len(by), by, types),
                          cols + "lam double, n double, mean double, m2 double, slog double, lo double, hi double")
    w = Window.partitionBy(*by, "lam")                  # one row a task for each group and lambda
    mid = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    agg = part.withColumn("_mid", mid).groupBy(*by, "lam").agg(
        (F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mid")) * (F.col("mean") - F.col("_mid")))
         / F.sum("n")).alias("var_t"), F.sum("slog").alias("slog"), F.sum("n").alias("n"),
        (F.min("lo") < F.max("hi")).alias("varies"))
    ll = (-F.col("n") / F.lit(2.0) * F.log("var_t") + (F.col("lam") - F.lit(1.0)) * F.col("slog"))
    return agg.select(*by, "lam", F.when(F.col("varies") & (F.col("var_t") > F.lit(np.finfo(np.float64).tiny)), ll)
                      .alias("loglik"))


def power_loglik(long: DataFrame, lambdas: Sequence[float], by: Sequence[str] = ("feature",),
                 value: str = "value") -> DataFrame:
    """Yeo-Johnson log-likelihood per (group, lambda) for a lambda grid in one pass: each
    task merges count, mean and squared deviations of the transformed values, Arrow
    batch by batch, in one small array per group; rows are not multiplied.  Null values are
    ignored; the likelihood is null where the values do not vary."""
    return _power_loglik(long, np.array([float(v) for v in lambdas]), by, value)


def _argmax(loglik: DataFrame, by: Sequence[str]) -> DataFrame:
    return loglik.where("loglik is not null").groupBy(*by).agg(
        F.min_by("lam", F.struct(-F.col("loglik"), F.col("lam"))).alias("lam"))


def best_lambda(long: DataFrame, lambdas: Sequence[float], by: Sequence[str] = ("feature",),
                value: str = "value") -> DataFrame:
    """argmax of the log-likelihood over the grid (smallest lambda on ties)."""
    return _argmax(power_loglik(long, lambdas, by, value), by)


def search_lambdas(long: DataFrame, passes: int = 8, grid: int = 21) -> list:
    """Yeo-Johnson lambda of every feature by maximum likelihood: rows (feature, lam).

    The first pass scans [-2, 2], twice as wide as long as the best value lies on an
    edge; each further pass scans ``grid`` points within one step of the previous best
    with a step ten times smaller, all features in every pass: 8 passes reach about
    2e-8, the tolerance of a Brent search.  One lambda per feature visits the driver.  A
    constant feature has no likelihood and is left out."""
    lo, hi = POWER_LAMBDA_START
    step = (hi - lo) / (grid - 1)
    while True:
        points = [float(v) for v in np.linspace(lo, hi, round((hi - lo) / step) + 1)]
        best = best_lambda(long, points).collect()
        if abs(lo) >= POWER_LAMBDA_STOP or not any(r["lam"] in (points[0], points[-1]) for r in best):
            break
        lo, hi = 2 * lo, 2 * hi
    for _ in range(passes - 1):
        offsets = np.linspace(-step, step, grid)
        grids = {(r["feature"],): r["lam"] + offsets for r in best}
        best = _argmax(_power_loglik(long, grids, ["feature"], "value"), ["feature"]).collect()
        step = 2 * step / (grid - 1)
    return best


def fit_power(df: DataFrame, x: str = "x", width: int | None = None,
              lambdas: Sequence[float] | None = None, passes: int = 8, grid: int = 21) -> DataFrame:
    """Yeo-Johnson lambda per feature - the best of ``lambdas``, or by
    :func:`search_lambdas` - then the standardisation of the transformed values.  A
    constant feature gets 1 (no change)."""
    n = width if width is not None else n_features(df, x)
    long = long_features(df, x)
    best = best_lambda(long, lambdas).collect() if lambdas is not None else search_lambdas(long, passes, grid)
    # one lambda per feature: bounded by the layout, inlined as literals
    lam_by_f = {int(r["feature"]): float(r["lam"]) for r in best}
    lam_vals = [lam_by_f.get(i, 1.0) for i in range(n)]
    lam_lit = F.array(*[F.lit(v) for v in lam_vals])
    t = df.select(F.zip_with(F.col(x).cast("array<double>"), lam_lit, lambda v, l: yeo_johnson(v, l)).alias("_t"))
    st = t.agg(*[F.avg(F.col("_t")[i]).alias(f"mu{i}") for i in range(n)],
               *[F.stddev_pop(F.col("_t")[i]).alias(f"sd{i}") for i in range(n)])
    return st.select(F.lit("power").alias("norm"), lam_lit.alias("lam"),
                     F.array(*[_zero_to_one(F.col(f"sd{i}")) for i in range(n)]).alias("a"),
                     _arr("mu", n).alias("b"))


# ------------------------------------------------------------------ apply

def _quantile_udf(table, width: int):
    """Arrow-batched uniform quantile map of whole feature arrays (no per-row
    Python): each batch is read as a matrix and mapped column by column
    with numpy.interp, forward and backward averaged as scikit-learn does."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def qmap(xcol: pa.Array) -> pa.Array:
        X = _matrix(xcol, width)
        out = np.empty_like(X)
        tab = table.value
        for fi in range(width):
            q, r = tab[fi]
            xv = X[:, fi]
            fwd = np.interp(xv, q, r)
            bwd = -np.interp(-xv, -q[::-1], -r[::-1])
            res = 0.5 * (fwd + bwd)
            # upper bound first, lower bound last (the lower one wins on overlap)
            res = np.where(xv + QUANTILE_BOUNDS_THRESHOLD > q[-1], r[-1], res)
            res = np.where(xv - QUANTILE_BOUNDS_THRESHOLD < q[0], r[0], res)
            out[:, fi] = res
        return _lists(out)

    return qmap


def apply_scaler(df: DataFrame, params: DataFrame, x: str = "x", out: str | None = None) -> DataFrame:
    """Transform the feature array with fitted parameters.

    The parameter table has one row of per-feature arrays (the quantile table
    has one row per feature), so it is read once on the driver - its size is
    bounded by the number of features (x quantiles) - and inlined as literal
    arrays: the transform is a plain projection, no join."""
    out = out or x
    rows = params.collect()
    norm = rows[0]["norm"]
    xs = F.col(x).cast("array<double>")
    if norm == "vanilla":
        return df.withColumn(out, xs)
    if norm == "quantile":
        table = {int(r["feature"]): (np.asarray(r["quantiles"], dtype=np.float64),
                                     np.asarray(r["references"], dtype=np.float64)) for r in rows}
        # #features x #quantiles values, shipped once per executor
        bc = df.sparkSession.sparkContext.broadcast(table)
        return df.withColumn(out, _quantile_udf(bc, len(table))(xs))
    p = rows[0]

    def lit_arr(name):
        return F.array(*[F.lit(float(v)) for v in p[name]])

    if norm == "minmax":
        a, b = lit_arr("a"), lit_arr("b")
        e = F.transform(xs, lambda v, i: v * a[i] + b[i])
    elif norm == "maxabs":
        a = lit_arr("a")
        e = F.transform(xs, lambda v, i: v / a[i])
    elif norm in ("std", "robust"):
        a, b = lit_arr("a"), lit_arr("b")
        e = F.transform(xs, lambda v, i: (v - b[i]) / a[i])
    elif norm == "power":
        a, b, lam = lit_arr("a"), lit_arr("b"), lit_arr("lam")
        e = F.transform(xs, lambda v, i: (yeo_johnson(v, lam[i]) - b[i]) / a[i])
    else:  # pragma: no cover
        raise TypeError(norm)
    return df.withColumn(out, e)


def normalise(df: DataFrame, name: str, x: str = "x", fit_on: str = "all", **kw) -> DataFrame:
    """fit + apply in one call."""
    return apply_scaler(df, fit_scaler(df, name, x, fit_on, **kw), x)


def normalise_and_split(df: DataFrame, name: str, p_valid: float, seed: int = 0, x: str = "x",
                  key: str = "k", label: str = "y", fit_on: str = "all") -> DataFrame:
    """Normalise, then stratified train/valid/test split (fit on all rows
    by default, as the reference does; ``fit_on='train'`` avoids the leak)."""
    from hepark.operators.sampling import stratified_split
    if fit_on == "train":
        sp = stratified_split(df, p_valid, seed, key, label)
        return apply_scaler(sp, fit_scaler(sp, name, x, "train"), x)
    return stratified_split(normalise(df, name, x), p_valid, seed, key, label)


def normalise_columns(df: DataFrame, name: str, cols: Sequence[str], fit_on: str = "all",
                      split: str = "split", **kw) -> DataFrame:
    """E1-E7 on named numeric columns: assembled into one array for the single
    fit aggregate, transformed, and written back to the same columns."""
    tmp = "_scale_x"
    d = df.withColumn(tmp, F.array(*[F.col(c).cast("double") for c in cols]))
    params = fit_scaler(d, name, tmp, fit_on, split, width=len(cols), **kw)
    d = apply_scaler(d, params, tmp)
    return d.withColumns({c: F.col(tmp)[i] for i, c in enumerate(cols)}).drop(tmp)


def evaluate_norm(df: DataFrame, x: str = "x", key: str = "k", label: str = "y", bins: int = 60
                  ) -> tuple[DataFrame, DataFrame]:
    """What is looked at before a normalised table is kept: the AUC of every feature (H3)
    and its histograms per class on the class's own range (G4)."""
    from hepark.operators.features import explode_features
    from hepark.operators.hist import hist_own
    from hepark.operators.roc import feature_auc
    long = explode_features(df, x, keep=(key, label))
    return feature_auc(long, label=label), hist_own(long, bins, label=label)


def norm_pipeline(df: DataFrame, path: str, norms: Sequence[str], p_valid: float, seed: int = 0, x: str = "x",
                  key: str = "k", label: str = "y", fit_on: str = "all", rule: str = "sklearn", bins: int = 60,
                  fit_args: dict | None = None) -> list[str]:
    """E8, whole: for every norm that the store does not hold yet - asked before anything is
    fitted - fit, apply, split by class, and commit the splits under ``path``; evaluate
    what was committed and write the areas and histograms under ``<path>/_reports``.
    Returns the norms that were built; the others were left as they are.

    A norm becomes visible as a whole (``sources.io.commit_norm``): a run that dies in
    between leaves nothing that ``has_norm`` or a reader takes for a norm, and a rerun
    builds it anew.  The reports are written before the commit, from the staged rows, so
    that a committed norm always has its reports.  ``fit_on='train'`` fits on the
    training rows only."""
    from hepark.operators.sampling import stratified_split
    from hepark.sources import io
    for name in norms:
        if name not in NORMS:
            raise TypeError(f"normalisation {name!r} does not exist")
    built = []
    for name in norms:
        if io.has_norm(df.sparkSession, path, name):
            continue
        rows = stratified_split(df, p_valid, seed, key, label, rule=rule)
        params = fit_scaler(rows, name, x, fit_on, **((fit_args or {}).get(name, {})))
        rows = apply_scaler(rows, params, x).select(key, label, x, "split")

        def report(staged: DataFrame, name=name):
            auc, hist = evaluate_norm(staged, x, key, label, bins)
            auc.write.mode("overwrite").parquet(f"{path}/_reports/auc/norm={name}")
            hist.write.mode("overwrite").parquet(f"{path}/_reports/hist/norm={name}")

        io.commit_norm(rows, path, name, before=report)
        built.append(name)
    return built
