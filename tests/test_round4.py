"""Fits whose jobs do not follow the number of steps, files that follow the input."""

import numpy as np
import pytest

from hepark.operators import fitting as J


def _rows(spark, n=240):
    rng = np.random.default_rng(11)
    return spark.createDataFrame([(i, i % 2, [float(v) for v in rng.normal(size=4) + i % 2]) for i in range(n)],
                                 "k long, y int, x array<double>")


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("name", ["plain", "variational"])
def test_steps_of_a_segment_equal_shared_steps(spark, name):
    df = _rows(spark)
    net = J.choose_network(name, [4, 4, 3])
    one, h1 = J.fit_network(df, df, net, epochs=2, batch_size=50, seed=4, rows_per_task=110)
    shared, h2 = J.fit_network(df, df, net, epochs=2, batch_size=50, seed=4, rows_per_task=20)
    assert J.segment_steps(50, 110) == 2 and J.step_tasks(spark, 50, 20) > 1
    assert np.allclose(J._vec(one), J._vec(shared), rtol=0, atol=1e-9)
    for a, b in zip(h1.orderBy("epoch").collect(), h2.orderBy("epoch").collect()):
        assert abs(a["train_loss"] - b["train_loss"]) < 1e-9 and abs(a["valid_loss"] - b["valid_loss"]) < 1e-9


def test_jobs_of_a_fit_do_not_follow_its_steps(spark):
    df = _rows(spark).persist()
    df.count()
    net = J.choose_network("plain", [4, 3])
    few, many = (_jobs(spark, f"fit{b}", lambda b=b: J.fit_network(df, df, net, epochs=1, batch_size=b, seed=4))
                 for b in (120, 5))
    df.unpersist()
    assert few == many                              # 2 steps, 48 steps


def test_files_of_the_wide_table_follow_the_input(spark, tmp_path, monkeypatch):
    from hepark.plans import q_features, q_io
    spark.sql("""SELECT id AS l_orderkey, 1000.0D * (id % 7 + 1) AS l_extendedprice, 0.02D AS l_tax, 5.0D AS l_quantity,
                 0.03D AS l_discount, IF(n = 0, 'R', 'N') AS l_returnflag
                 FROM range(300) LATERAL VIEW explode(sequence(0, 5)) AS n""").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, 7000.0D AS o_totalprice, id AS o_custkey, 'F' AS o_orderstatus FROM range(300)") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    seen = []

    def ingest(spark, src, *args, files_per_trigger, run=q_io.ingest_incremental):
        seen.append((spark.read.parquet(src).inputFiles(), files_per_trigger))
        run(spark, src, *args, files_per_trigger=files_per_trigger)

    monkeypatch.setattr(q_io, "ingest_incremental", ingest)
    want = sorted(map(tuple, q_features.flat_from_wide(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(q_io, "FILE_BYTES", 1024, raising=False)
    assert sorted(map(tuple, q_io.ingest_flat_features(spark, str(tmp_path)).collect())) == want and want
    files, per_trigger = seen[0]
    assert len(files) > q_io.CHUNKS and per_trigger * q_io.CHUNKS >= len(files)
