"""Registered normalisation queries (E1-E8) on the embedding features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hepark.functions.exprs import rnd, sql_order_key, sql_rnd
from hepark.operators import features as B
from hepark.operators import scaling as E
from hepark.plans import standins as S
from hepark.plans.registry import query

R = sql_rnd
L = S.SQL_EMB_LONG

# fixed values of the registered queries: 11 quantiles, lambda grid -2..2 step 0.1
N_QUANT = 11
LAMBDAS = [round(-2.0 + 0.1 * i, 1) for i in range(41)]


def _scaled_long(spark, sf_dir, name, **kw):
    m = S.embedding_matrix(spark, sf_dir)
    out = E.normalise(m, name, **kw)
    long = B.explode_features(out, keep=("k", "y"))
    return long.select("k", "y", "feature", rnd("value").alias("value"))


def _sql_scaled(stats: str, expr: str) -> str:
    return f"""WITH l AS ({L}), st AS ({stats})
SELECT l.k, l.y, l.feature, {R(expr)} AS value FROM l JOIN st USING (feature)"""


@query("scale_vanilla", f"SELECT k, y, feature, {R('value')} AS value FROM ({L})")
def scale_vanilla(spark, sf_dir):
    return _scaled_long(spark, sf_dir, "vanilla")


@query("scale_minmax", _sql_scaled(
    """SELECT feature, 1.0::DOUBLE / CASE WHEN max(value) - min(value) = 0 THEN 1.0::DOUBLE
                                       ELSE max(value) - min(value) END AS a, min(value) AS lo
       FROM l GROUP BY feature""", "l.value * st.a + (0.0::DOUBLE - st.lo * st.a)"))
def scale_minmax(spark, sf_dir):
    return _scaled_long(spark, sf_dir, "minmax")


@query("scale_maxabs", _sql_scaled(
    """SELECT feature, CASE WHEN max(abs(value)) = 0 THEN 1.0::DOUBLE ELSE max(abs(value)) END AS a
       FROM l GROUP BY feature""", "l.value / st.a"))
def scale_maxabs(spark, sf_dir):
    return _scaled_long(spark, sf_dir, "maxabs")


@query("scale_std", _sql_scaled(
    """SELECT feature, avg(value) AS b,
              CASE WHEN stddev_pop(value) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(value) END AS a
       FROM l GROUP BY feature""", "(l.value - st.b) / st.a"))
def scale_std(spark, sf_dir):
    return _scaled_long(spark, sf_dir, "std")


@query("scale_robust", _sql_scaled(
    """SELECT feature, quantile_cont(value, 0.5) AS b,
              CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) = 0 THEN 1.0::DOUBLE
                   ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS a
       FROM l GROUP BY feature""", "(l.value - st.b) / st.a"))
def scale_robust(spark, sf_dir):
    return _scaled_long(spark, sf_dir, "robust")


def _sql_quantile(n: int = N_QUANT) -> str:
    refs = [float(r) for r in np.linspace(0, 1, n)]
    rl = "[" + ", ".join(f"{r!r}::DOUBLE" for r in refs) + "]"
    return f"""
WITH l AS ({L}),
qs AS (SELECT feature, unnest(quantile_cont(value, {rl})) AS q, unnest({rl}) AS r,
              unnest(range(0, {n})) AS j FROM l GROUP BY feature),
seg AS (SELECT feature, j, q AS q0, r AS r0, lead(q) OVER (PARTITION BY feature ORDER BY j) AS q1,
               lead(r) OVER (PARTITION BY feature ORDER BY j) AS r1 FROM qs),
ends AS (SELECT feature, min(q) AS qlo, max(q) AS qhi FROM qs GROUP BY feature),
fwd AS (SELECT l.k, l.feature, max_by((s.r1 - s.r0) / (s.q1 - s.q0) * (l.value - s.q0) + s.r0, s.j) AS f
        FROM l JOIN seg s ON l.feature = s.feature AND s.q0 <= l.value AND l.value < s.q1 GROUP BY ALL),
bwd AS (SELECT l.k, l.feature,
               min_by(-(((-s.r0) - (-s.r1)) / ((-s.q0) - (-s.q1)) * ((-l.value) - (-s.q1)) + (-s.r1)), s.j) AS b
        FROM l JOIN seg s ON l.feature = s.feature AND s.q0 < l.value AND l.value <= s.q1 GROUP BY ALL)
SELECT l.k, l.y, l.feature,
       {R('''CASE WHEN l.value - 1e-7::DOUBLE < e.qlo THEN 0.0::DOUBLE
             WHEN l.value + 1e-7::DOUBLE > e.qhi THEN 1.0::DOUBLE
             ELSE 0.5::DOUBLE * (fwd.f + bwd.b) END''')} AS value
FROM l JOIN ends e USING (feature) LEFT JOIN fwd USING (k, feature) LEFT JOIN bwd USING (k, feature)"""


@query("scale_quantile", _sql_quantile())
def scale_quantile(spark, sf_dir):
    return _scaled_long(spark, sf_dir, "quantile", n_quantiles=N_QUANT)


def _sql_yj(v: str, lam: str) -> str:
    return f"""CASE WHEN {v} >= 0 THEN
      CASE WHEN abs({lam}) < 2.220446049250313e-16::DOUBLE THEN ln(1.0::DOUBLE + {v})
           ELSE (pow({v} + 1.0::DOUBLE, {lam}) - 1.0::DOUBLE) / {lam} END
    ELSE
      CASE WHEN abs({lam} - 2.0::DOUBLE) > 2.220446049250313e-16::DOUBLE
           THEN -(pow(-{v} + 1.0::DOUBLE, 2.0::DOUBLE - {lam}) - 1.0::DOUBLE) / (2.0::DOUBLE - {lam})
           ELSE -ln(1.0::DOUBLE - {v}) END END"""


def _sql_power() -> str:
    grid = "[" + ", ".join(f"{l!r}::DOUBLE" for l in LAMBDAS) + "]"
    return f"""
WITH l AS ({L}),
g AS (SELECT unnest({grid}) AS lam),
ll AS (SELECT feature, lam,
              -count(*) / 2.0::DOUBLE * ln(var_pop({_sql_yj('value', 'lam')}))
              + (lam - 1.0::DOUBLE) * sum(sign(value) * ln(1.0::DOUBLE + abs(value))) AS loglik,
              var_pop({_sql_yj('value', 'lam')}) AS vt
       FROM l, g GROUP BY feature, lam),
best AS (SELECT feature, arg_min(lam, (-loglik, lam)) AS lam FROM ll
         WHERE vt > 2.2250738585072014e-308::DOUBLE GROUP BY feature),
t AS (SELECT l.k, l.y, l.feature, {_sql_yj('l.value', 'best.lam')} AS tv FROM l JOIN best USING (feature)),
st AS (SELECT feature, avg(tv) AS mu,
              CASE WHEN stddev_pop(tv) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(tv) END AS sd
       FROM t GROUP BY feature)
SELECT t.k, t.y, t.feature, {R('(t.tv - st.mu) / st.sd')} AS value FROM t JOIN st USING (feature)"""


@query("scale_power", _sql_power())
def scale_power(spark, sf_dir):
    return _scaled_long(spark, sf_dir, "power", lambdas=LAMBDAS)


@query("power_lambdas", _sql_power().split("\nt AS (")[0].rstrip().rstrip(",")
       + "\nSELECT CAST(feature AS INTEGER) AS feature, lam FROM best")
def power_lambdas(spark, sf_dir):
    long = E.long_features(S.embedding_matrix(spark, sf_dir))
    return E.best_lambda(long, LAMBDAS).select(F.col("feature").cast("int"), "lam")


SQL_NORM_SPLIT = f"""
WITH l AS ({L}),
st AS (SELECT feature, 1.0::DOUBLE / CASE WHEN max(value) - min(value) = 0 THEN 1.0::DOUBLE
                                       ELSE max(value) - min(value) END AS a, min(value) AS lo
       FROM l GROUP BY feature),
e AS (SELECT vec_id AS k, CAST(label % 2 AS INTEGER) AS y, {sql_order_key('vec_id', 3)} AS ord FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY ord) AS rn,
                count(*) OVER (PARTITION BY y) AS n FROM e),
c AS (SELECT y, n, CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS v FROM (SELECT DISTINCT y, n FROM r)),
tt AS (SELECT sum(v) AS vv, sum(n - v) AS rr FROM c),
c2 AS (SELECT y, v, CAST(ceil(CAST(vv AS DOUBLE) / CAST(rr AS DOUBLE) * (n - v)) AS BIGINT) AS t FROM c, tt),
sp AS (SELECT k, CASE WHEN rn <= v THEN 'valid' WHEN rn <= v + t THEN 'test' ELSE 'train' END AS split
       FROM r JOIN c2 USING (y))
SELECT sp.split, l.feature, CAST(count(*) AS BIGINT) AS n_rows,
       {R('avg(l.value * st.a + (0.0::DOUBLE - st.lo * st.a))')} AS mean_value
FROM l JOIN st USING (feature) JOIN sp USING (k) GROUP BY sp.split, l.feature"""


@query("normalise_and_split", SQL_NORM_SPLIT)
def normalise_and_split(spark, sf_dir):
    out = E.normalise_and_split(S.embedding_matrix(spark, sf_dir), "minmax", 0.2, seed=3)
    long = B.explode_features(out, keep=("split",))
    return long.groupBy("split", "feature").agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                                                rnd(F.avg("value")).alias("mean_value"))



# the reference's default number of quantiles
@query("scale_quantile_1000", _sql_quantile(E.QUANTILE_MAX_N))
def scale_quantile_1000(spark, sf_dir):
    return _scaled_long(spark, sf_dir, "quantile", n_quantiles=E.QUANTILE_MAX_N)


def _sql_search(passes: int, reach: float) -> str:
    """The default search in SQL: a scan of [-reach, reach] in steps of 0.2 (the library
    widens [-2, 2] only as far as needed), then refinements around the best."""
    def best(src: str) -> str:
        return f"""SELECT feature, arg_min(lam, (-loglik, lam)) AS lam FROM (
          SELECT feature, lam, -count(*) / 2.0::DOUBLE * ln(var_pop({_sql_yj('value', 'lam')}))
                 + (lam - 1.0::DOUBLE) * sum(sign(value) * ln(1.0::DOUBLE + abs(value))) AS loglik
          FROM {src} GROUP BY feature, lam HAVING var_pop({_sql_yj('value', 'lam')}) > 2.2250738585072014e-308::DOUBLE)
        GROUP BY feature"""
    n, step = round(2 * reach / 0.2), 0.2
    ctes = [f"l AS ({L})", f"g AS (SELECT i * 0.2::DOUBLE - {reach!r}::DOUBLE AS lam FROM range(0, {n + 1}) t(i))",
            f"b0 AS MATERIALIZED ({best('l, g')})"]
    for t in range(1, passes):
        offs = [float(v) for v in np.linspace(-step, step, 21)]
        ctes.append(f"""b{t} AS MATERIALIZED ({best(f"""(SELECT l.feature, value, b{t - 1}.lam + o AS lam
          FROM l JOIN b{t - 1} USING (feature), (SELECT unnest({offs!r}) AS o))""")})""")
        step /= 10
    return f"WITH {', '.join(ctes)} SELECT CAST(feature AS INTEGER) AS feature, {R('lam', 3)} AS lam FROM b{passes - 1}"


@query("power_lambdas_search", _sql_search(6, 64.0))
def power_lambdas_search(spark, sf_dir):
    best = E.search_lambdas(E.long_features(S.embedding_matrix(spark, sf_dir)))
    return spark.createDataFrame(best, "feature int, lam double").select("feature", rnd("lam", 3).alias("lam"))
