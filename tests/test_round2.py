"""Sizes, null groups, several norms, unbounded powers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hepark.operators import features as B
from hepark.operators import ranking as R
from hepark.operators import sampling as D
from hepark.operators import scaling as E
from hepark.sources import io as A


def test_bucket_count_follows_input_size(spark):
    small, big = R._default_buckets(spark.range(100)), R._default_buckets(spark.range(10**13))
    assert small == R.DEFAULT_BUCKETS
    assert big >= 80 * 10**12 // R.BYTES_PER_BUCKET
    assert R._default_buckets(spark.range(2 * 10**13)) >= 2 * big - R.LOOKUP_BLOCK


def test_null_groups_and_string_keys_survive(spark):
    df = spark.createDataFrame([("a", 0), ("b", None), ("c", None), ("d", 1)], "k string, y int")
    assert B.head_per_class(df, 5).count() == 4
    assert D.balanced_sample(df, 10).count() == 4
    assert R.positions(df.withColumn("h", F.md5("k")), ["y"], "h", hex_order=True).count() == 4


def test_store_keeps_other_norms(spark, tmp_path):
    path = str(tmp_path / "store")

    def rows(norm, v):
        return spark.createDataFrame([(1, v, norm, "train"), (2, v, norm, "valid")],
                                     "k int, v double, norm string, split string")

    A.write_splits(rows("minmax", 1.0), path)
    A.write_splits(rows("std", 2.0), path)
    A.write_splits(rows("minmax", 9.0), path, mode="ignore")
    assert not A.write_norm_once(spark, path, "std", lambda: pytest.fail("fitted again"))
    got = {(r.norm, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {("minmax", 1.0), ("std", 2.0)}


def test_power_lambda_beyond_the_start(spark):
    rng = np.random.default_rng(0)
    v = 10 + rng.exponential(3, 4000)
    df = spark.createDataFrame([([float(x)],) for x in v], "x array<double>")
    lam = E.fit_power(df, width=1).first()["lam"][0]
    assert lam < -2.5
