"""Registered range, histogram and KDE queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hepark.functions.exprs import rnd, sql_rnd
from hepark.operators import features as B
from hepark.operators import hist as G
from hepark.plans import standins as S
from hepark.plans.registry import query

R = sql_rnd
L = S.SQL_EMB_LONG


def _long(spark, sf_dir):
    return B.explode_features(S.embedding_matrix(spark, sf_dir))


@query("feature_ranges", f"""SELECT feature, y, {R('min(value)')} AS lo, {R('max(value)')} AS hi
FROM ({L}) GROUP BY feature, y""")
def feature_ranges(spark, sf_dir):
    r = G.feature_ranges(_long(spark, sf_dir), ["feature", "y"])
    return r.select("feature", "y", rnd("lo").alias("lo"), rnd("hi").alias("hi"))


def _sql_edge(i: str, n: int) -> str:
    return f"(CASE WHEN {i} >= {n} THEN hi ELSE CAST({i} AS DOUBLE) * ((hi - lo) / {float(n)}::DOUBLE) + lo END)"


def _sql_hist(src: str, bins: int, by: list[str], range_by: list[str]) -> str:
    """numpy-rule density histogram in SQL (all bins, empty ones 0)."""
    bs = ", ".join(by)
    rbs = ", ".join(range_by)
    n = bins
    i0 = f"CAST(floor((value - lo) / (hi - lo) * {float(n)}::DOUBLE) AS INTEGER)"
    i1 = f"(CASE WHEN {i0} = {n} THEN {n - 1} ELSE {i0} END)"
    i2 = f"(CASE WHEN value < {_sql_edge(i1, n)} THEN {i1} - 1 ELSE {i1} END)"
    i3 = f"(CASE WHEN value >= {_sql_edge(f'({i2} + 1)', n)} AND {i2} <> {n - 1} THEN {i2} + 1 ELSE {i2} END)"
    return f"""
WITH s AS ({src}),
r0 AS (SELECT {rbs}, min(value) AS lo0, max(value) AS hi0 FROM s GROUP BY {rbs}),
r AS (SELECT {rbs}, CASE WHEN lo0 = hi0 THEN lo0 - 0.5::DOUBLE ELSE lo0 END AS lo,
                    CASE WHEN lo0 = hi0 THEN hi0 + 0.5::DOUBLE ELSE hi0 END AS hi FROM r0),
j AS (SELECT s.*, r.lo, r.hi FROM s JOIN r USING ({rbs}) WHERE value >= r.lo AND value <= r.hi),
c AS (SELECT {bs}, {i3} AS bin, CAST(count(*) AS BIGINT) AS cnt FROM j GROUP BY ALL),
tot AS (SELECT {bs}, sum(cnt) AS tot FROM c GROUP BY ALL),
grp AS (SELECT DISTINCT {bs} FROM s),
allb AS (SELECT grp.*, r.lo, r.hi, CAST(b AS INTEGER) AS bin FROM grp JOIN r USING ({rbs}), range(0, {n}) t(b))
SELECT {', '.join('allb.' + b for b in by)}, allb.bin, {R(_sql_edge('allb.bin', n))} AS lo_edge,
       coalesce(c.cnt, 0) AS count,
       {R(f"coalesce(c.cnt, 0) / ({_sql_edge('(allb.bin + 1)', n)} - {_sql_edge('allb.bin', n)}) / tot.tot")} AS density
FROM allb LEFT JOIN c USING ({bs}, bin) LEFT JOIN tot USING ({bs})"""


def _hist_out(h, by):
    return h.select(*by, "bin", rnd("lo_edge").alias("lo_edge"), "count", rnd("density").alias("density"))


@query("hist_joint", _sql_hist(L, 50, ["feature", "y"], ["feature"]))
def hist_joint(spark, sf_dir):
    return _hist_out(G.hist_joint(_long(spark, sf_dir), 50), ["feature", "y"])


@query("hist_own", _sql_hist(L, 60, ["feature", "y"], ["feature", "y"]))
def hist_own(spark, sf_dir):
    return _hist_out(G.hist_own(_long(spark, sf_dir), 60), ["feature", "y"])


SQL_PAIR_LONG = f"SELECT * FROM ({L}) WHERE feature IN (0, 1)"


@query("hist_pair35", _sql_hist(SQL_PAIR_LONG, 35, ["feature", "y"], ["feature"]))
def hist_pair35(spark, sf_dir):
    m = S.embedding_matrix(spark, sf_dir)
    p = B.feature_pair(m, 0, 1)
    both = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(("xi", "xj"))])
    long = p.select("k", "y", F.explode(both).alias("_p")).select("k", "y", "_p.feature", "_p.value")
    return _hist_out(G.hist_joint(long, 35), ["feature", "y"])


KDE_GRID = 10

SQL_KDE = f"""
WITH p AS (SELECT CAST(label % 2 AS INTEGER) AS y, CAST(embedding[1] AS DOUBLE) AS u,
                  CAST(embedding[2] AS DOUBLE) AS v FROM embeddings),
st AS (SELECT y, CAST(count(*) AS DOUBLE) AS n, var_samp(u) AS vx, var_samp(v) AS vy,
              covar_samp(u, v) AS cxy FROM p GROUP BY y),
st2 AS (SELECT y, n, vx * (pow(n, -1.0::DOUBLE / 6.0::DOUBLE) * pow(n, -1.0::DOUBLE / 6.0::DOUBLE)) AS sxx,
               vy * (pow(n, -1.0::DOUBLE / 6.0::DOUBLE) * pow(n, -1.0::DOUBLE / 6.0::DOUBLE)) AS syy,
               cxy * (pow(n, -1.0::DOUBLE / 6.0::DOUBLE) * pow(n, -1.0::DOUBLE / 6.0::DOUBLE)) AS sxy FROM st),
st3 AS (SELECT *, sxx * syy - sxy * sxy AS det FROM st2),
rg AS (SELECT min(u) AS x0, max(u) AS x1, min(v) AS y0, max(v) AS y1 FROM p),
g AS (SELECT CAST(gi // {KDE_GRID} AS INTEGER) AS gx, CAST(gi % {KDE_GRID} AS INTEGER) AS gy FROM range(0, {KDE_GRID * KDE_GRID}) t(gi)),
gp AS (SELECT gx, gy, CAST(gx AS DOUBLE) * ((x1 - x0) / {float(KDE_GRID - 1)}::DOUBLE) + x0 AS px,
              CAST(gy AS DOUBLE) * ((y1 - y0) / {float(KDE_GRID - 1)}::DOUBLE) + y0 AS py FROM g, rg),
k AS (SELECT p.y, gp.gx, gp.gy, gp.px, gp.py, st3.n, st3.det,
             exp(-0.5::DOUBLE * ((st3.syy * (gp.px - p.u) * (gp.px - p.u)
                   - 2.0::DOUBLE * st3.sxy * (gp.px - p.u) * (gp.py - p.v)
                   + st3.sxx * (gp.py - p.v) * (gp.py - p.v)) / st3.det)) AS kv
      FROM p JOIN st3 USING (y), gp)
SELECT y, gx, gy, {R('px')} AS px, {R('py')} AS py,
       {R('sum(kv) / (any_value(n) * (2.0::DOUBLE * 3.141592653589793::DOUBLE) * sqrt(any_value(det)))')} AS density
FROM k GROUP BY y, gx, gy, px, py"""


@query("kde2d", SQL_KDE)
def kde2d(spark, sf_dir):
    p = B.feature_pair(S.embedding_matrix(spark, sf_dir), 0, 1)
    d = G.kde2d(p, "xi", "xj", KDE_GRID)
    return d.select("y", "gx", "gy", rnd("px").alias("px"), rnd("py").alias("py"),
                    rnd("density").alias("density"))
