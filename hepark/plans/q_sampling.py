"""Registered sampling, split, fold, chunk and batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hepark.functions.exprs import sql_order_key
from hepark.operators import sampling as D
from hepark.operators.features import head_per_class
from hepark.plans import standins as S
from hepark.plans.registry import query

SEED = 7
ORD = sql_order_key("vec_id", SEED)
EMB = f"SELECT vec_id AS k, CAST(label % 2 AS INTEGER) AS y, {ORD} AS ord FROM embeddings"


@query("shuffle", f"""SELECT k, y, CAST(row_number() OVER (ORDER BY ord) AS BIGINT) AS pos FROM ({EMB})""")
def shuffle_q(spark, sf_dir):
    d = D.shuffle(S.embedding_matrix(spark, sf_dir), "k", SEED, with_pos=True)
    return d.select("k", "y", "pos")


@query("balanced_sample", f"""SELECT k, y, CAST(row_number() OVER (ORDER BY ord) AS BIGINT) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY k) AS rn FROM ({EMB})) WHERE rn <= 100""")
def balanced_sample_q(spark, sf_dir):
    d = D.balanced_sample(S.embedding_matrix(spark, sf_dir), 200, SEED)
    return d.select("k", "y", "pos")


SQL_SPLIT = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY ord) AS rn,
                  count(*) OVER (PARTITION BY y) AS n FROM ({EMB})),
c AS (SELECT y, n, CAST(ceil(0.1::DOUBLE * n) AS BIGINT) AS v FROM (SELECT DISTINCT y, n FROM r)),
t AS (SELECT sum(v) AS vv, sum(n - v) AS rr FROM c),
c2 AS (SELECT y, v, CAST(ceil(CAST(vv AS DOUBLE) / CAST(rr AS DOUBLE) * (n - v)) AS BIGINT) AS tt FROM c, t)
SELECT k, y, CASE WHEN rn <= v THEN 'valid' WHEN rn <= v + tt THEN 'test' ELSE 'train' END AS split
FROM r JOIN c2 USING (y)"""


def _split(spark, sf_dir):
    return D.stratified_split(S.embedding_matrix(spark, sf_dir), 0.1, SEED)


@query("stratified_split", SQL_SPLIT)
def stratified_split_q(spark, sf_dir):
    return _split(spark, sf_dir).select("k", "y", "split")


@query("split_summary", f"""SELECT split, y, CAST(count(*) AS BIGINT) AS n_rows FROM ({SQL_SPLIT})
GROUP BY split, y""")
def split_summary(spark, sf_dir):
    return D.summarise(_split(spark, sf_dir), ["split", "y"])


#: (k, y, fold, slot) of five folds as large as the smaller class allows.
SQL_FOLDS = f"""
WITH e AS ({EMB}),
c AS (SELECT greatest(1, min(n) // 5) AS half FROM (SELECT count(*) AS n FROM e GROUP BY y))
SELECT k, y, CAST((rn - 1) // half AS INTEGER) AS fold,
       CAST(CASE WHEN y = 1 THEN 0 ELSE half END + (rn - 1) % half AS INTEGER) AS slot
FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY ord) AS rn FROM e), c
WHERE (rn - 1) // half < 5"""


@query("kfold", SQL_FOLDS)
def kfold_q(spark, sf_dir):
    d = D.kfold(S.embedding_matrix(spark, sf_dir), k=5, seed=SEED)
    return d.select("k", "y", "fold", "slot")


@query("chunk5", f"""SELECT k, y, CAST(ntile(5) OVER (ORDER BY ord) - 1 AS INTEGER) AS chunk FROM ({EMB})""")
def chunk5(spark, sf_dir):
    d = D.chunk(S.embedding_matrix(spark, sf_dir), 5, SEED)
    return d.select("k", "y", "chunk")


@query("batch_fixed", """SELECT vec_id AS k,
       CAST((row_number() OVER (ORDER BY vec_id) - 1) // 64 AS INTEGER) AS batch_id FROM embeddings""")
def batch_fixed(spark, sf_dir):
    d = D.batchify(S.embedding_matrix(spark, sf_dir), 64, "fixed")
    return d.select("k", "batch_id")


@query("batch_equal", f"""SELECT k,
       CAST(ntile((SELECT CAST(ceil(count(*) / 64.0) AS BIGINT) FROM embeddings)) OVER (ORDER BY ord) - 1
            AS INTEGER) AS batch_id FROM ({EMB})""")
def batch_equal(spark, sf_dir):
    d = D.batchify(S.embedding_matrix(spark, sf_dir), 64, "equal", seed=SEED)
    return d.select("k", "batch_id")


@query("shuffle_lineitem", """SELECT CAST(row_number() OVER (ORDER BY md5(concat(CAST(l_orderkey AS VARCHAR), '|',
       CAST(CAST(round(l_extendedprice * 100.0::DOUBLE) AS BIGINT) AS VARCHAR), '|', '7'))) AS BIGINT) AS pos,
       l_orderkey, l_extendedprice FROM lineitem""")
def shuffle_lineitem(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_extendedprice",
        F.round(F.col("l_extendedprice") * F.lit(100.0)).cast("long").alias("cents"))
    d = D.shuffle(li, ["l_orderkey", "cents"], SEED, with_pos=True)
    return d.select("pos", "l_orderkey", "l_extendedprice")


def _sql_shares(counts: str, draws: str, name: str) -> str:
    """Largest-remainder allocation over a (y, c) table in whole numbers, ties by class order."""
    return f"""{name} AS (
  SELECT y, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= need THEN 1 ELSE 0 END AS a
  FROM (SELECT *, CAST({draws} - sum(whole) OVER () AS BIGINT) AS need
        FROM (SELECT y, CAST(c * {draws} // total AS BIGINT) AS whole, CAST(c * {draws} % total AS BIGINT) AS rest
              FROM (SELECT y, CAST(c AS HUGEINT) AS c, sum(c) OVER () AS total FROM {counts}))))"""


SQL_SPLIT_SK = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY ord) AS rn FROM ({EMB})),
cc AS (SELECT y, count(*) AS c FROM r GROUP BY y),
s1 AS (SELECT CAST(ceil(0.1::DOUBLE * sum(c)) AS BIGINT) AS nv, sum(c) - CAST(ceil(0.1::DOUBLE * sum(c)) AS BIGINT) AS ntr1 FROM cc),
c0 AS (SELECT cc.y, cc.c FROM cc),
{_sql_shares('c0', '(SELECT ntr1 FROM s1)', 'tr1')},
c1 AS (SELECT cc.y, cc.c - tr1.a AS c FROM cc JOIN tr1 USING (y)),
{_sql_shares('c1', '(SELECT nv FROM s1)', 'va')},
s2 AS (SELECT CAST(ceil(CAST(nv AS DOUBLE) / CAST(ntr1 AS DOUBLE) * ntr1) AS BIGINT) AS nte, ntr1 FROM s1),
c2 AS (SELECT y, a AS c FROM tr1),
{_sql_shares('c2', '(SELECT ntr1 - nte FROM s2)', 'tr2')},
c3 AS (SELECT tr1.y, tr1.a - tr2.a AS c FROM tr1 JOIN tr2 USING (y)),
{_sql_shares('c3', '(SELECT nte FROM s2)', 'te')}
SELECT r.k, r.y, CASE WHEN r.rn <= va.a THEN 'valid' WHEN r.rn <= va.a + te.a THEN 'test' ELSE 'train' END AS split
FROM r JOIN va USING (y) JOIN te USING (y)"""


@query("stratified_split_sklearn", SQL_SPLIT_SK)
def stratified_split_sklearn(spark, sf_dir):
    d = D.stratified_split(S.embedding_matrix(spark, sf_dir), 0.1, SEED, rule="sklearn")
    return d.select("k", "y", "split")


# ------------------------------------------------------------------ any key, any class

def _orders_any(spark, sf_dir):
    """Orders with a text key and a class that is null for a half of the rows."""
    return S.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("k"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("y"))


SQL_ORDERS_ANY = f"""SELECT *, {sql_order_key('k', SEED)} AS ord FROM (
  SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS k,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS y FROM orders)"""


def _sql_split_any(rule: str) -> str:
    src = SQL_SPLIT_SK if rule == "sklearn" else SQL_SPLIT
    # the null class is a class: it goes by a name that sorts first
    src = src.replace(EMB, f"SELECT k, coalesce(y, ' ') AS y, ord FROM ({SQL_ORDERS_ANY})")
    return f"SELECT k, nullif(y, ' ') AS y, split FROM ({src})"


@query("split_text_keys_null_class", _sql_split_any("ceil"))
def split_text_keys_null_class(spark, sf_dir):
    return D.stratified_split(_orders_any(spark, sf_dir), 0.1, SEED).select("k", "y", "split")


@query("split_text_keys_null_class_sklearn", _sql_split_any("sklearn"))
def split_text_keys_null_class_sklearn(spark, sf_dir):
    return D.stratified_split(_orders_any(spark, sf_dir), 0.1, SEED, rule="sklearn").select("k", "y", "split")


@query("balanced_sample_text_keys", f"""SELECT k, y, CAST(row_number() OVER (ORDER BY ord) AS BIGINT) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY k) AS rn FROM ({SQL_ORDERS_ANY})) WHERE rn <= 3000""")
def balanced_sample_text_keys(spark, sf_dir):
    return D.balanced_sample(_orders_any(spark, sf_dir), 6000, SEED).select("k", "y", "pos")


@query("head_text_keys", f"""SELECT k, y, CAST(rn AS BIGINT) AS rn FROM (
  SELECT k, y, row_number() OVER (PARTITION BY y ORDER BY k) AS rn FROM ({SQL_ORDERS_ANY})) WHERE rn <= 1500""")
def head_text_keys(spark, sf_dir):
    return head_per_class(_orders_any(spark, sf_dir), 1500).select("k", "y", "rn")


@query("batches_text_keys", f"""SELECT k, CAST((row_number() OVER (ORDER BY k) - 1) // 128 AS INTEGER) AS batch_id
FROM ({SQL_ORDERS_ANY})""")
def batches_text_keys(spark, sf_dir):
    return D.batchify(_orders_any(spark, sf_dir), 128).select("k", "batch_id")
