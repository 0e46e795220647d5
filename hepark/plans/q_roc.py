"""Registered ROC / AUC queries (H1-H11) on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hepark.functions.exprs import rnd, sql_order_key, sql_rnd
from hepark.operators import features as B
from hepark.operators import roc as H
from hepark.operators import sampling as D
from hepark.plans import standins as S
from hepark.plans.registry import query

R = sql_rnd


def _grid_sql() -> str:
    vals = ", ".join(f"({i}, {repr(g)}::DOUBLE)" for i, g in enumerate(H.tpr_grid()))
    return f"(VALUES {vals}) AS g(grid_idx, tpr)"


# ------------------------------------------------------------------ H4 (flagship)

SQL_CHUNKED = f"""
WITH e AS (SELECT vec_id AS k, label % 2 AS y, embedding FROM embeddings),
c AS (SELECT k, ntile(5) OVER (ORDER BY {sql_order_key('k', 0)}) - 1 AS chunk FROM e),
l AS (SELECT e.k, e.y, c.chunk, CAST(generate_subscripts(e.embedding, 1) - 1 AS INTEGER) AS feature,
             CAST(unnest(e.embedding) AS DOUBLE) AS value
      FROM e JOIN c USING (k)),
cnt AS (SELECT feature, chunk, value, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY ALL),
pooled_cnt AS (SELECT feature, value, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY ALL),
a AS (SELECT feature, chunk,
             sum(pos * (coalesce(nb, 0) + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc
      FROM (SELECT *, sum(neg) OVER (PARTITION BY feature, chunk ORDER BY value
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM cnt)
      GROUP BY ALL),
p AS (SELECT feature,
             sum(pos * (coalesce(nb, 0) + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS pooled_auc
      FROM (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY value
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM pooled_cnt)
      GROUP BY ALL)
SELECT a.feature, {R('avg(auc)')} AS mean_auc, {R('stddev_pop(auc)')} AS std_auc,
       {R('any_value(p.pooled_auc)')} AS pooled_auc
FROM a JOIN p USING (feature) GROUP BY a.feature
"""


def _chunked_long(spark, sf_dir):
    m = S.embedding_matrix(spark, sf_dir)
    m = D.chunk(m, 5, seed=0)
    return B.explode_features(m, keep=("k", "y", "chunk"))


@query("feature_auc_chunked", SQL_CHUNKED)
def feature_auc_chunked(spark, sf_dir):
    r = H.feature_auc_chunked(_chunked_long(spark, sf_dir), n=5)
    return r.select("feature", rnd("mean_auc").alias("mean_auc"), rnd("std_auc").alias("std_auc"),
                    rnd("pooled_auc").alias("pooled_auc"))


# ------------------------------------------------------------------ H2 / H3

SQL_AUC_TEMPLATE = """
WITH s AS ({src}),
cnt AS (SELECT {by_sel} score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL),
w AS (SELECT *, sum(neg) OVER ({part} ORDER BY score
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM cnt)
SELECT {by_sel} {auc} AS auc FROM w {group}
"""


def _sql_auc(src: str, by: list[str]) -> str:
    by_sel = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    a = ("CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN "
         "sum(pos * (coalesce(nb, 0) + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) END")
    return SQL_AUC_TEMPLATE.format(src=src, by_sel=by_sel, part=part, group=group, auc=R(a))


@query("auc", _sql_auc(S.SQL_SCORES, ["model"]))
def auc_q(spark, sf_dir):
    a = H.auc(S.score_table(spark, sf_dir), ["model"])
    return a.select("model", rnd("auc").alias("auc"))


@query("auc_global", _sql_auc(
    "SELECT l_extendedprice AS score, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS y "
    "FROM lineitem", []))
def auc_global(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_extendedprice").alias("score"),
                  F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return H.auc(s, []).select(rnd("auc").alias("auc"))


@query("feature_auc", _sql_auc(S.SQL_EMB_LONG.replace("AS value", "AS score"), ["feature"]).replace(
    "SELECT feature, ", "SELECT feature, ", 1))
def feature_auc_q(spark, sf_dir):
    long = B.explode_features(S.embedding_matrix(spark, sf_dir))
    a = H.feature_auc(long)
    return a.select("feature", rnd("auc").alias("auc"))


# ------------------------------------------------------------------ H1 and friends

def _sql_roc(src: str, by: list[str]) -> str:
    """SQL body yielding by..., thr_idx, threshold, tp, fp, tpr, fpr (kept vertices)."""
    bs = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"""
WITH s AS ({src}),
cnt AS (SELECT {bs} score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
        FROM s GROUP BY ALL),
w AS (SELECT *,
        CAST(sum(pos) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
        CAST(sum(neg) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
        CAST(row_number() OVER ({part} ORDER BY score DESC) AS BIGINT) AS thr_idx,
        count(*) OVER ({part}) AS n_thr,
        lead(pos) OVER ({part} ORDER BY score DESC) AS pos_next,
        lead(neg) OVER ({part} ORDER BY score DESC) AS neg_next,
        sum(pos) OVER ({part}) AS P, sum(neg) OVER ({part}) AS N
      FROM cnt),
kept AS (SELECT {bs} thr_idx, score AS threshold, tp, fp, P, N FROM w
         WHERE n_thr <= 2 OR thr_idx = 1 OR thr_idx = n_thr OR pos_next <> pos OR neg_next <> neg
         UNION ALL
         SELECT DISTINCT {bs} CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), P, N
         FROM w)
SELECT {bs} thr_idx, threshold, tp, fp,
       CASE WHEN P > 0 THEN tp / P END AS tpr, CASE WHEN N > 0 THEN fp / N END AS fpr
FROM kept"""


def _roc_out(r, by):
    return r.select(*by, "thr_idx", rnd("threshold").alias("threshold"), "tp", "fp",
                    rnd("tpr").alias("tpr"), rnd("fpr").alias("fpr"))


SQL_ROC = f"""SELECT model, thr_idx, {R('threshold')} AS threshold, tp, fp, {R('tpr')} AS tpr,
       {R('fpr')} AS fpr FROM ({_sql_roc(S.SQL_SCORES, ['model'])})"""


@query("roc_curve", SQL_ROC)
def roc_curve_q(spark, sf_dir):
    return _roc_out(H.roc_curve(S.score_table(spark, sf_dir), ["model"]), ["model"])


SQL_ROC_GLOBAL = f"""SELECT thr_idx, {R('threshold')} AS threshold, tp, fp, {R('tpr')} AS tpr,
       {R('fpr')} AS fpr FROM ({_sql_roc(
    "SELECT l_discount AS score, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS y "
    "FROM lineitem", [])})"""


@query("roc_curve_global", SQL_ROC_GLOBAL)
def roc_curve_global(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_discount").alias("score"),
                  F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return _roc_out(H.roc_curve(s, []), [])


def _sql_grid(src: str, by: list[str]) -> str:
    bs = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"""
WITH r AS ({_sql_roc(src, by)}),
seg AS (SELECT {bs} tpr AS tpr0, fpr AS fpr0,
               lead(tpr) OVER ({part} ORDER BY thr_idx) AS tpr1,
               lead(fpr) OVER ({part} ORDER BY thr_idx) AS fpr1 FROM r)
SELECT {''.join(f'seg.{b}, ' for b in by)} CAST(g.grid_idx AS INTEGER) AS grid_idx, g.tpr,
       CASE WHEN tpr1 IS NULL THEN fpr0
            ELSE (fpr1 - fpr0) / (tpr1 - tpr0) * (g.tpr - tpr0) + fpr0 END AS fpr
FROM seg JOIN {_grid_sql()} ON g.tpr >= seg.tpr0 AND (seg.tpr1 IS NULL OR g.tpr < seg.tpr1)"""


SQL_FOLD_SCORES = S.SQL_SCORES

SQL_GRID = f"""SELECT model, fold, grid_idx, {R('tpr')} AS tpr, {R('fpr')} AS fpr
FROM ({_sql_grid(SQL_FOLD_SCORES, ['model', 'fold'])})"""


def _grid_roc(spark, sf_dir):
    s = S.score_table(spark, sf_dir)
    by = ["model", "fold"]
    return H.roc_on_grid(H.roc_curve(s, by), by)


@query("roc_on_grid", SQL_GRID)
def roc_on_grid_q(spark, sf_dir):
    g = _grid_roc(spark, sf_dir)
    return g.select("model", "fold", "grid_idx", rnd("tpr").alias("tpr"), rnd("fpr").alias("fpr"))


SQL_FPR80 = f"""SELECT model, fold, {R('arg_min(fpr, (abs(tpr - 0.8::DOUBLE), thr_idx))')} AS fpr_at_tpr
FROM ({_sql_roc(SQL_FOLD_SCORES, ['model', 'fold'])}) GROUP BY model, fold"""


@query("fpr_at_80", SQL_FPR80)
def fpr_at_80(spark, sf_dir):
    by = ["model", "fold"]
    r = H.fpr_at_tpr(H.roc_curve(S.score_table(spark, sf_dir), by), by)
    return r.select("model", "fold", rnd("fpr_at_tpr").alias("fpr_at_tpr"))


SQL_FOLD_AUC = f"""SELECT model, {R('avg(auc)')} AS mean_auc, {R('stddev_pop(auc)')} AS std_auc,
       CAST(count(*) AS BIGINT) AS n_folds
FROM ({_sql_auc(SQL_FOLD_SCORES, ['model', 'fold']).replace(R('CASE WHEN'), 'CASE WHEN')}) GROUP BY model"""


def _sql_auc_raw(src: str, by: list[str]) -> str:
    bs = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"""
WITH s AS ({src}),
cnt AS (SELECT {bs} score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL),
w AS (SELECT *, sum(neg) OVER ({part} ORDER BY score
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM cnt)
SELECT {bs} CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
       sum(pos * (coalesce(nb, 0) + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) END AS auc
FROM w GROUP BY ALL"""


SQL_FOLD_AUC = f"""SELECT model, {R('avg(auc)')} AS mean_auc, {R('stddev_pop(auc)')} AS std_auc,
       CAST(count(*) AS BIGINT) AS n_folds
FROM ({_sql_auc_raw(SQL_FOLD_SCORES, ['model', 'fold'])}) GROUP BY model"""


@query("fold_auc", SQL_FOLD_AUC)
def fold_auc_q(spark, sf_dir):
    r = H.fold_auc(S.score_table(spark, sf_dir), ["model"])
    return r.select("model", rnd("mean_auc").alias("mean_auc"), rnd("std_auc").alias("std_auc"),
                    "n_folds")


SQL_FOLD_METRICS_RAW = f"""
SELECT a.model, a.fold, a.auc, f.fpr_at_tpr FROM
 ({_sql_auc_raw(SQL_FOLD_SCORES, ['model', 'fold'])}) a
JOIN (SELECT model, fold, arg_min(fpr, (abs(tpr - 0.8::DOUBLE), thr_idx)) AS fpr_at_tpr
      FROM ({_sql_roc(SQL_FOLD_SCORES, ['model', 'fold'])}) GROUP BY model, fold) f
USING (model, fold)"""

SQL_REJECTION = f"""SELECT model, {R('avg(1.0::DOUBLE / fpr_at_tpr)')} AS mean_rejection,
       {R('stddev_samp(1.0::DOUBLE / fpr_at_tpr)')} AS std_rejection
FROM ({SQL_FOLD_METRICS_RAW}) GROUP BY model"""


@query("rejection", SQL_REJECTION)
def rejection_q(spark, sf_dir):
    m = H.fold_metrics(S.score_table(spark, sf_dir), ["model"])
    r = H.rejection(m, ["model"])
    return r.select("model", rnd("mean_rejection").alias("mean_rejection"),
                    rnd("std_rejection").alias("std_rejection"))


SQL_BAND = f"""SELECT model, grid_idx, {R('tpr')} AS tpr, {R('avg(fpr)')} AS fpr_mean,
       {R('avg(fpr) - stddev_samp(fpr)')} AS fpr_lo, {R('avg(fpr) + stddev_samp(fpr)')} AS fpr_hi
FROM ({_sql_grid(SQL_FOLD_SCORES, ['model', 'fold'])}) GROUP BY model, grid_idx, tpr"""


@query("roc_band", SQL_BAND)
def roc_band_q(spark, sf_dir):
    b = H.roc_band(_grid_roc(spark, sf_dir), ["model"])
    return b.select("model", "grid_idx", rnd("tpr").alias("tpr"), rnd("fpr_mean").alias("fpr_mean"),
                    rnd("fpr_lo").alias("fpr_lo"), rnd("fpr_hi").alias("fpr_hi"))


SQL_TWO_SETS = f"""SELECT 'qty' AS feature_set, * FROM ({S.SQL_SCORES})
UNION ALL
SELECT 'price' AS feature_set, model, fold, k, y, l_extendedprice / 100000.0::DOUBLE AS score
FROM (SELECT l_linestatus AS model, CAST(l_orderkey % 5 AS INTEGER) AS fold,
             l_orderkey * 100000000 + CAST(round(l_extendedprice * 100.0::DOUBLE) AS BIGINT) AS k,
             CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS y, l_extendedprice
      FROM lineitem)"""

SQL_COMPARE = f"""SELECT feature_set, model, {R('avg(auc)')} AS mean_auc, {R('stddev_samp(auc)')} AS std_auc,
       CAST(count(*) AS BIGINT) AS n_folds
FROM ({_sql_auc_raw(SQL_TWO_SETS, ['feature_set', 'model', 'fold'])}) GROUP BY feature_set, model"""


def _two_sets(spark, sf_dir):
    s = S.score_table(spark, sf_dir)
    li = S.table(spark, sf_dir, "lineitem")
    price = li.select(
        F.col("l_linestatus").alias("model"),
        (F.col("l_orderkey") % F.lit(5)).cast("int").alias("fold"),
        (F.col("l_orderkey") * F.lit(100000000)
         + F.round(F.col("l_extendedprice") * F.lit(100.0)).cast("long")).alias("k"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias("y"),
        (F.col("l_extendedprice") / F.lit(100000.0)).alias("score"))
    return (s.withColumn("feature_set", F.lit("qty"))
            .unionByName(price.withColumn("feature_set", F.lit("price"))))


@query("model_compare", SQL_COMPARE)
def model_compare(spark, sf_dir):
    by = ["feature_set", "model"]
    a = H.auc(_two_sets(spark, sf_dir), by + ["fold"])
    r = H.compare_models(a, by)
    return r.select(*by, rnd("mean_auc").alias("mean_auc"), rnd("std_auc").alias("std_auc"), "n_folds")


SQL_ACC = f"""SELECT model, {R('avg(CASE WHEN (score > 0.5::DOUBLE) = (y = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy,
       CAST(count(*) AS BIGINT) AS n FROM ({S.SQL_SCORES}) GROUP BY model"""


@query("accuracy", SQL_ACC)
def accuracy_q(spark, sf_dir):
    r = H.accuracy(S.score_table(spark, sf_dir), ["model"], threshold=0.5)
    return r.select("model", rnd("accuracy").alias("accuracy"), "n")


SQL_AUC_SUM = f"""SELECT {R('sum(auc)')} AS auc_sum, printf('%.3f', sum(auc)) AS auc_sum_text
FROM ({_sql_auc_raw(S.SQL_EMB_LONG.replace('AS value', 'AS score'), ['feature'])})"""


@query("feature_auc_sum", SQL_AUC_SUM)
def feature_auc_sum(spark, sf_dir):
    long = B.explode_features(S.embedding_matrix(spark, sf_dir))
    s = H.auc_sum(H.feature_auc(long))
    return s.select(rnd("auc_sum").alias("auc_sum"), "auc_sum_text")


# ------------------------------------------------------------------ H5: folds and pooled from one table of counts

SQL_FOLDS_POOLED = f"""SELECT model, fold, y, score FROM ({S.SQL_SCORES})
UNION ALL SELECT model, -1 AS fold, y, score FROM ({S.SQL_SCORES})"""


@query("fold_and_pooled_roc", f"""SELECT model, fold, thr_idx, {R('threshold')} AS threshold, tp, fp, {R('tpr')} AS tpr,
       {R('fpr')} AS fpr FROM ({_sql_roc(SQL_FOLDS_POOLED, ['model', 'fold'])})""")
def fold_and_pooled_roc(spark, sf_dir):
    r = H.fold_and_pooled_roc(S.score_table(spark, sf_dir), ["model"])
    return _roc_out(r.withColumn("fold", F.coalesce("fold", F.lit(-1))), ["model", "fold"])


@query("fold_and_pooled_metrics", f"""
WITH a AS ({_sql_auc_raw(SQL_FOLDS_POOLED, ['model', 'fold'])}),
f AS (SELECT model, fold, arg_min(fpr, (abs(tpr - 0.8::DOUBLE), thr_idx)) AS fpr
      FROM ({_sql_roc(SQL_FOLDS_POOLED, ['model', 'fold'])}) GROUP BY model, fold)
SELECT model, {R('avg(auc) FILTER (WHERE fold >= 0)')} AS mean_auc,
       {R('stddev_pop(auc) FILTER (WHERE fold >= 0)')} AS std_auc,
       {R('avg(fpr) FILTER (WHERE fold >= 0)')} AS mean_fpr, {R('max(auc) FILTER (WHERE fold < 0)')} AS pooled_auc,
       {R('max(fpr) FILTER (WHERE fold < 0)')} AS pooled_fpr
FROM a JOIN f USING (model, fold) GROUP BY model""")
def fold_and_pooled_metrics(spark, sf_dir):
    m = H.fold_and_pooled_metrics(S.score_table(spark, sf_dir), ["model"])
    return m.select("model", *[rnd(c).alias(c) for c in m.columns if c != "model"])
