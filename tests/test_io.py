"""Sources, sinks and streaming semantics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hepark.operators import features as B
from hepark.operators import scoring as Fs
from hepark.plans.q_features import raw_events
from hepark.sources import io as A
from hepark.streaming.ingest import ingest_incremental

SF = "/root/testdata/sf0.001"


def test_wide_selection_pushed_to_parquet(spark):
    path = A.scratch_path(spark, "raw")
    raw_events(spark, SF).write.parquet(path)
    flat = B.flatten_events(A.read_events(spark, path), "btag")
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(nleps), IsNotNull(nbtags), IsNotNull(njets), EqualTo(nleps,1)" in plan
    assert len(flat.first()["x"]) == 67


def test_write_ignore_and_missing_split(spark):
    df = spark.createDataFrame([(1, 0, [0.5], "minmax", "train")], "k long, y int, x array<double>, norm string, split string")
    path = A.scratch_path(spark, "splits")
    A.write_splits(df, path)
    other = df.withColumn("k", F.lit(2).cast("long"))
    A.write_splits(other, path, mode="ignore")
    assert [r["k"] for r in A.read_split(spark, path, "minmax", "train").collect()] == [1]
    with pytest.raises(FileNotFoundError):
        A.read_split(spark, path, "minmax", "valid")


def test_model_round_trip_scores_identically(spark):
    net = Fs.autoencoder([6, 4, 2], head=[3, 1])
    path = A.scratch_path(spark, "model")
    A.save_model(spark, net, path)
    back = A.load_model(spark, path)
    df = spark.createDataFrame([(i, [float(i + j) / 7 for j in range(6)]) for i in range(5)], "k long, x array<double>")
    a = Fs.score_network(df, net).orderBy("k").toPandas()
    b = Fs.score_network(df, back).orderBy("k").toPandas()
    assert np.allclose(a["prob"], b["prob"]) and np.allclose(np.vstack(a["recon"]), np.vstack(b["recon"]))
    assert A.load_hyperparameters(spark, path)["config"]["sizes"] == [6, 4, 2]


def test_metrics_written_as_float32(spark):
    df = spark.createDataFrame([("m", 0, 0.123456789)], "model string, fold int, auc double")
    path = A.scratch_path(spark, "metrics")
    A.write_metrics(df, path)
    back = A.read_metrics(spark, path)
    assert dict(back.dtypes)["auc"] == "float"


def test_streaming_ingest_equals_batch(spark):
    schema = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

    def tf(d):
        return d.filter(F.col("value") > 10).select("event_id", (F.col("value") * 2).alias("v2"))

    sink, ckpt = A.scratch_path(spark, "out"), A.scratch_path(spark, "ckpt")
    ingest_incremental(spark, SF, schema, sink, ckpt, tf, glob="events.parquet")
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    exp = sorted(tuple(r) for r in tf(spark.read.parquet(f"{SF}/events.parquet")).collect())
    assert got == exp
    # a rerun with the same checkpoint resumes and appends nothing
    ingest_incremental(spark, SF, schema, sink, ckpt, tf, glob="events.parquet")
    assert spark.read.parquet(sink).count() == len(exp)


def test_read_events_csv_with_schema(spark):
    src = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = A.scratch_path(spark, "orders-csv")
    src.write.option("header", "true").csv(path)
    back = A.read_events(spark, path, "o_orderkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING", fmt="csv")
    assert dict(back.dtypes) == {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderstatus": "string"}
    assert back.count() == src.count()
    assert back.filter("o_orderstatus = 'F'").count() == src.filter("o_orderstatus = 'F'").count()


def test_latent_partitions_by_class(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i)]) for i in range(10)], "k long, y int, latent array<double>")
    path = A.scratch_path(spark, "latent")
    A.write_latent(df, path)
    sig = spark.read.parquet(path).filter("y = 1")
    assert "PartitionFilters: [isnotnull(y" in sig._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["k"] for r in sig.collect()) == [1, 3, 5, 7, 9]
