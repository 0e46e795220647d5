"""Map the shared test tables onto the inputs the operators expect.

Each stand-in exists twice: as a DataFrame builder and as the DuckDB SQL the
oracle uses.  Both read whole tables.

* jets: ``lineitem`` lines that are not returned (``l_returnflag <> 'R'``),
  one order = one event; leptons: the returned lines; MET and the class label
  come from ``orders`` (signal = ``o_orderstatus = 'F'``).
* feature matrix: ``embeddings`` (``k = vec_id``, ``y = label % 2``).
* score table: ``lineitem`` rows (``y = l_returnflag = 'R'``), model = line
  status, fold from the order key.
* x/y pairing: ``documents`` joined to ``labels``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PI = math.pi


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ objects

def _obj_cols() -> list:
    pt = F.col("l_extendedprice") / F.lit(1000.0)
    eta = F.col("l_tax") * F.lit(50.0) - F.lit(2.0)
    phi = F.lit(2.0 * PI) * F.col("l_quantity") / F.lit(50.0) - F.lit(PI)
    return [F.col("l_orderkey").alias("event_id"), pt.alias("pt"), eta.alias("eta"),
            phi.alias("phi"), (pt + F.col("l_quantity")).alias("en"),
            (pt * F.cos(phi)).alias("px"), (pt * F.sin(phi)).alias("py"), (pt * eta).alias("pz"),
            (F.round(F.col("l_discount") * F.lit(100.0)).cast("int") % F.lit(8)).alias("btag")]


def jets_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_returnflag") != "R").select(*_obj_cols())


def leptons_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_returnflag") == "R").select(*_obj_cols())


def objects_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jets and leptons together, ``is_lep`` = 1 for returned lines."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*_obj_cols(), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_lep"))


def met(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("event_id"),
                    (F.col("o_totalprice") / F.lit(1000.0)).alias("met_pt"),
                    (F.lit(2.0 * PI) * (F.col("o_custkey") % F.lit(360)) / F.lit(360.0)
                     - F.lit(PI)).alias("met_phi"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("y"))


SQL_OBJ_COLS = """l_orderkey AS event_id,
      l_extendedprice / 1000.0::DOUBLE AS pt,
      l_tax * 50.0::DOUBLE - 2.0::DOUBLE AS eta,
      (2.0::DOUBLE * pi()) * l_quantity / 50.0::DOUBLE - pi() AS phi,
      l_extendedprice / 1000.0::DOUBLE + l_quantity AS en,
      (l_extendedprice / 1000.0::DOUBLE) * cos((2.0::DOUBLE * pi()) * l_quantity / 50.0::DOUBLE - pi()) AS px,
      (l_extendedprice / 1000.0::DOUBLE) * sin((2.0::DOUBLE * pi()) * l_quantity / 50.0::DOUBLE - pi()) AS py,
      (l_extendedprice / 1000.0::DOUBLE) * (l_tax * 50.0::DOUBLE - 2.0::DOUBLE) AS pz,
      CAST(round(l_discount * 100.0::DOUBLE) AS INTEGER) % 8 AS btag"""

SQL_JETS = f"SELECT {SQL_OBJ_COLS} FROM lineitem WHERE l_returnflag <> 'R'"
SQL_LEPS = f"SELECT {SQL_OBJ_COLS} FROM lineitem WHERE l_returnflag = 'R'"
SQL_MET = """SELECT o_orderkey AS event_id, o_totalprice / 1000.0::DOUBLE AS met_pt,
       (2.0::DOUBLE * pi()) * (o_custkey % 360) / 360.0::DOUBLE - pi() AS met_phi,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS y
FROM orders"""


# ------------------------------------------------------------------ feature matrix

def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("x"),
                    (F.col("label") % 2).cast("int").alias("y"))


SQL_EMB = """SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS x, CAST(label % 2 AS INTEGER) AS y
FROM embeddings"""

SQL_EMB_LONG = """SELECT vec_id AS k, CAST(label % 2 AS INTEGER) AS y,
       CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature,
       CAST(unnest(embedding) AS DOUBLE) AS value
FROM embeddings"""


# ------------------------------------------------------------------ score table

def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_linestatus").alias("model"),
        (F.col("l_orderkey") % F.lit(5)).cast("int").alias("fold"),
        (F.col("l_orderkey") * F.lit(100000000)
         + F.round(F.col("l_extendedprice") * F.lit(100.0)).cast("long")).alias("k"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias("y"),
        (F.col("l_quantity") / F.lit(50.0) + F.col("l_discount")).alias("score"))


SQL_SCORES = """SELECT l_linestatus AS model, CAST(l_orderkey % 5 AS INTEGER) AS fold,
       l_orderkey * 100000000 + CAST(round(l_extendedprice * 100.0::DOUBLE) AS BIGINT) AS k,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS y,
       l_quantity / 50.0::DOUBLE + l_discount AS score
FROM lineitem"""


# ------------------------------------------------------------------ x/y pairing

def documents_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")


def labels_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
