"""Ordered scans by range partitioning, bracketed quantiles, one-pass aggregates, norm store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hepark.operators import features as B
from hepark.operators import fitting as J
from hepark.operators import hist as G
from hepark.operators import losses as I
from hepark.operators import ranking as R
from hepark.operators import roc as H
from hepark.operators import sampling as D
from hepark.operators import scaling as E
from hepark.sources import io as A


def test_row_numbers_any_key(spark):
    rows = [(f"k{(i * 7919) % 4001:05d}", None if i % 3 == 0 else i % 2) for i in range(4001)]
    df = spark.createDataFrame(rows, "k string, y int").repartition(3)
    got = R.row_numbers(df, ["y"], ["k"], "pos", buckets=13, totals=True).collect()
    for y in (None, 0, 1):
        keys = sorted(k for k, c in rows if c == y)
        own = sorted((r.pos, r.k) for r in got if r.y == y)
        assert own == list(enumerate(keys, 1))
        assert {r.n_group for r in got if r.y == y} == {len(keys)}


def test_row_numbers_short_ranges(spark):
    """Ranging by beginnings keeps the full order."""
    rows = [("same beginning " * 3 + str(i % 97), i) for i in range(500)]
    df = spark.createDataFrame(rows, "t string, i int")
    got = R.row_numbers(df, [], ["t", "i"], buckets=7, ranges=[F.substring("t", 1, 5)]).orderBy("pos").collect()
    assert [(r.t, r.i) for r in got] == sorted(rows)


def test_no_boundary_arrays_in_plans(spark):
    df = spark.range(1000).select((F.col("id") % 60).alias("feature"), F.col("id").cast("double").alias("score"),
                                  (F.col("id") % 2).alias("y"))
    for out in (H.roc_curve(df, ["feature"]), H.auc(df, ["feature"])):
        assert "array" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rule", ["ceil", "sklearn"])
def test_split_keeps_null_class(spark, rule):
    df = spark.createDataFrame([(f"k{i}", None if i % 4 == 0 else "ab"[i % 2]) for i in range(2400)], "k string, y string")
    got = {(r.y, r.split): r["count"] for r in
           D.stratified_split(df, 0.25, rule=rule).groupBy("y", "split").count().collect()}
    assert sum(got.values()) == 2400 and {y for y, _ in got} == {None, "a", "b"}
    assert got[None, "valid"] == 150 and got["b", "valid"] == 300


@pytest.mark.parametrize("accuracy,limit", [(50, None), (10000, None), (100, 0)])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy, limit):
    if limit is not None:                               # the way beyond the broadcast
        monkeypatch.setattr(R, "BROADCAST_BOUNDS_BYTES", limit)
    rng = np.random.default_rng(5)
    sets = {0: rng.normal(size=3000), 1: rng.integers(0, 3, 2000).astype(float), 2: np.full(50, 2.5), None: np.arange(7.0)}
    rows = [(g, float(v)) for g, x in sets.items() for v in x] + [(0, None)]
    probs = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.999, 1.0]
    got = R.exact_quantiles(spark.createDataFrame(rows, "g int, v double").repartition(5), ["g"], "v", probs,
                            accuracy=accuracy).collect()
    for g, x in sets.items():
        own = [r.q for r in sorted((r for r in got if r.g == g), key=lambda r: r.p_idx)]
        assert np.allclose(own, np.quantile(x, probs), rtol=1e-14, atol=0)


def test_quantiles_read_brackets_only(spark):
    """Of many values only a small share leaves the counting pass."""
    import pyarrow as pa
    x = np.random.default_rng(1).normal(size=200_000)
    marks = np.quantile(x, [0.25 - 2e-4, 0.5 - 2e-4, 0.25 + 2e-4, 0.5 + 2e-4])

    class Held:
        value = {0: (marks, 2)}
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), pa.array(x)], names=["g", "v"])
    rows = [r for b in R._bracketed(Held)([batch]) for r in b.to_pylist()]
    assert sum(r["_cnt"] for r in rows) == len(x) and len(rows) < 400


def test_chunked_auc_equals_single(spark):
    rng = np.random.default_rng(2)
    rows = [(int(f), int(c), int(y), float(v)) for f, c, y, v in
            zip(rng.integers(0, 3, 900), rng.integers(0, 4, 900), rng.integers(0, 2, 900), rng.integers(0, 40, 900))]
    rows += [(0, 4, 1, 1.0), (0, 4, 1, 2.0)]            # a chunk of one class has no area
    df = spark.createDataFrame(rows, "feature int, chunk int, y int, value double")
    got = {r.feature: r for r in H.feature_auc_chunked(df).collect()}
    per = H.auc(df, ["feature", "chunk"], "value").toPandas()
    pooled = {r.feature: r.auc for r in H.auc(df, ["feature"], "value").collect()}
    for f in range(3):
        own = per[per.feature == f]["auc"].dropna()
        assert np.isclose(got[f].mean_auc, own.mean()) and np.isclose(got[f].std_auc, own.std(ddof=0))
        assert np.isclose(got[f].pooled_auc, pooled[f])


def test_pooled_and_folds_from_one_count(spark):
    rng = np.random.default_rng(3)
    rows = [("m", int(f), int(y), float(s)) for f, y, s in
            zip(rng.integers(0, 3, 600), rng.integers(0, 2, 600), rng.integers(0, 50, 600))] + [("m", None, 1, 3.0)]
    df = spark.createDataFrame(rows, "model string, fold int, y int, score double")
    got = H.fold_and_pooled_roc(df).toPandas()
    alone = H.roc_curve(df, ["model"]).orderBy("thr_idx").toPandas()
    pooled = got[got.pooled == 1].sort_values("thr_idx")
    assert list(pooled.tpr) == list(alone.tpr) and list(pooled.fpr) == list(alone.fpr)
    one = H.roc_curve(df.where("fold = 1"), ["model"]).orderBy("thr_idx").toPandas()
    assert list(got[(got.pooled == 0) & (got.fold == 1)].sort_values("thr_idx").tp) == list(one.tp)


def test_wasserstein_brute_force(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(60, 3)), rng.normal(1, 2, size=(41, 3)).round(1)
    frame = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    got = {r.dim: r.w1 for r in I.wasserstein_exact(frame(a), frame(b)).collect()}
    want = []
    for d in range(3):
        at = np.sort(np.r_[a[:, d], b[:, d]])
        fa, fb = (np.searchsorted(np.sort(x[:, d]), at[:-1], side="right") / len(x) for x in (a, b))
        want.append((np.diff(at) * np.abs(fa - fb)).sum())
    assert np.allclose([got[d] for d in range(3)], want) and np.isclose(got[None], np.mean(want))
    assert [r.w1 for r in I.wasserstein_exact(frame(a[:, :1]), frame(b).limit(0)).collect()] == [None, None]


def test_power_search_and_constant_feature(spark):
    rng = np.random.default_rng(6)
    x = np.c_[rng.lognormal(size=400), np.full(400, 3.0), -rng.lognormal(size=400)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, x array<double>").repartition(7)

    def loglik(v, lam):
        t = E._yeo_johnson_rows(v, np.array([lam]))[0]
        return -len(v) / 2 * np.log(t.var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()

    best = {r["feature"]: r["lam"] for r in E.search_lambdas(E.long_features(df))}
    assert set(best) == {0, 2}
    for f, lam in best.items():
        assert all(loglik(x[:, f], lam) >= loglik(x[:, f], lam + d) - 1e-9 for d in (-0.01, -1e-4, 1e-4, 0.01))
    out = np.array([r.x for r in E.normalise(df, "power").orderBy("k").collect()])
    assert np.allclose(out[:, 1], 0) and np.allclose(out[:, [0, 2]].std(0), 1)


def test_kde_degenerate_class(spark):
    df = spark.createDataFrame([(1, float(i % 7), float(i % 5)) for i in range(70)] + [(0, 1.0, 1.0), (None, 2.0, None)],
                               "y int, xi double, xj double")
    got = G.kde2d(df, "xi", "xj", 4).collect()
    one = [r.density for r in got if r.y == 1]
    assert len(one) == 16 and all(d > 0 for d in one)
    assert all(r.density is None for r in got if r.y == 0)


def test_event_objects_equals_windows(spark):
    rng = np.random.default_rng(8)
    rows = [(int(e), int(k), float(p), int(t), float(i)) for i, (e, k, p, t) in enumerate(
        zip(np.r_[np.zeros(4000), rng.integers(1, 60, 2000)], rng.integers(0, 2, 6000), rng.permutation(6000),
            rng.integers(0, 3, 6000)))] + [(None, 0, 1.0, 1, 0.0), (99, 1, 2.0, None, 0.0)]
    df = spark.createDataFrame(rows, "event_id int, is_lep int, pt double, btag int, eta double").repartition(6)
    out = B.event_objects(df, jet_feats=["pt", "eta"], lep_feats=["pt"], n_jets=4, n_leps=1)
    assert str(out._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    got = {r.event_id: r for r in out.collect()}
    for e in {r[0] for r in rows}:
        jets = sorted((r for r in rows if r[0] == e and r[1] == 0), key=lambda r: -r[2])
        leps = sorted((r for r in rows if r[0] == e and r[1] == 1), key=lambda r: -r[2])
        own = got[e]
        assert (own.njets, own.nbtags, own.nleps) == (len(jets), sum(r[3] >= 1 for r in jets), len(leps))
        assert [(o.pt, o.eta) for o in own.jets] == [(r[2], r[4]) for r in jets[:4]]
        assert [o.pt for o in own.leps] == [r[2] for r in leps[:1]]
    vec = out.where("event_id = 99").select(B.object_vector("jets", ["pt", "eta"], 4).alias("v")).first().v
    assert vec == [0.0] * 8


# ------------------------------------------------------------------ norm store

def _matrix(spark):
    return spark.createDataFrame([(i, i % 2, [float(i), float(i * i % 17)]) for i in range(60)],
                                 "k long, y int, x array<double>")


def test_norm_pipeline_commits_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    m = _matrix(spark)
    assert E.norm_pipeline(m, path, ["minmax", "std"], 0.2) == ["minmax", "std"]
    assert E.norm_pipeline(m, path, ["minmax", "std", "maxabs"], 0.2) == ["maxabs"]
    assert A.norm_manifest(spark, path, "std")["splits"] == {"train": 36, "valid": 12, "test": 12}
    assert spark.read.parquet(path).groupBy("norm").count().where("count = 60").count() == 3
    assert spark.read.parquet(f"{path}/_reports/auc").groupBy("norm").count().where("count = 2").count() == 3
    (tmp_path / "store" / "norm=std" / A.MANIFEST).unlink()          # a writer that died
    assert not A.has_norm(spark, path, "std")
    assert E.norm_pipeline(m, path, ["minmax", "std"], 0.2) == ["std"]
    assert A.read_split(spark, path, "std", "valid").count() == 12
    with pytest.raises(TypeError):
        E.norm_pipeline(m, path, ["minmax", "nonsense"], 0.2)


def test_failed_report_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = _matrix(spark).withColumn("split", F.lit("train"))

    def fail(_):
        raise RuntimeError("report")

    A.commit_norm(rows, path, "kept")
    with pytest.raises(RuntimeError):
        A.commit_norm(rows, path, "a/b=c", before=fail)
    assert not A.has_norm(spark, path, "a/b=c") and spark.read.parquet(path).count() == 60
    A.commit_norm(rows, path, "a/b=c")
    assert {r.norm for r in spark.read.parquet(path).select("norm").distinct().collect()} == {"kept", "a/b=c"}


def test_latent_classes_one_after_another(spark, tmp_path):
    path = str(tmp_path / "latent")
    m = _matrix(spark).select("k", "y", F.col("x").alias("latent"))
    for y in (1, 0, 0):                                 # a class written twice is replaced
        A.write_latent(m.where(F.col("y") == y), path)
    assert {(r.y, r["count"]) for r in spark.read.parquet(path).groupBy("y").count().collect()} == {(0, 30), (1, 30)}


# ------------------------------------------------------------------ fits

def test_variational_gradients_match_finite_differences():
    rng = np.random.default_rng(5)
    X, y = rng.normal(size=(7, 5)) * 0.5, np.zeros(7)
    noise = (rng.normal(size=(7, 2)), rng.normal(size=(7, 2)))
    net = J.choose_network("variational", [5, 4, 2])
    loss, grads = J.loss_and_grads(net, X, y, 0.3, noise)
    assert abs(loss - J.batch_loss(net, X, y, 0.3, noise)) < 1e-9
    g, theta = J._vec(net, grads), J._vec(net)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        up, down = (J.batch_loss(J._unvec(net, theta + d), X, y, 0.3, noise) for d in (step, -step))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5 * max(1.0, abs(g[i]))


def test_a_step_is_shared_by_tasks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [float(v) for v in rng.normal(size=4)]) for i in range(230)]
    df = spark.createDataFrame(rows, "k long, y int, x array<double>")
    tasks = J.step_tasks(spark, 100, 20)
    assert tasks == min(5, spark.sparkContext.defaultParallelism)
    path = J._epoch_batches(df, "k", 3, 0, 100, 20)
    net = J.choose_network("plain", [4, 3])
    for b, n in enumerate((100, 100, 30)):
        batch = spark.read.schema(df.schema).parquet(f"{path}/_b={b}")
        assert batch.rdd.getNumPartitions() == tasks
        loss, g, count = J._grad_job(batch, net, "x", "y", 0.5)
        held = {r["k"] for r in batch.collect()}
        X = np.array([r[2] for r in rows if r[0] in held])
        y = np.array([r[1] for r in rows if r[0] in held], float)
        want, grads = J.loss_and_grads(net, X, y)
        assert count == n == len(held)
        assert abs(loss - want) < 1e-9 and np.allclose(g, J._vec(net, grads))


@pytest.mark.parametrize("name,parts", [("vanilla", {"recon"}), ("plain", {"class"}), ("classifier", {"recon", "class"}),
                                        ("variational", {"recon", "latent"})])
def test_every_registered_network_is_fitted(spark, name, parts):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, [float(v) for v in rng.normal(size=6) * 0.3 + (i % 2) * 0.5]) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, y int, x array<double>")
    net = J.choose_network(name, [6, 5, 3], **({"head": (3, 1)} if name == "classifier" else {}))
    before = J.eval_losses(df, net, seeds=(0, 1))
    best, hist = J.fit_network(df, df, net, epochs=3, batch_size=64, lr=0.02, seed=0)
    assert J.eval_losses(df, best, seeds=(0, 1))["total"] < before["total"]
    h = [r.asDict() for r in hist.orderBy("epoch").collect()]
    assert [r["epoch"] for r in h] == [0, 1, 2]
    weights = J.loss_weights(net, 0.5)
    for r in h:
        assert {c for c in J.COMPONENTS if r[f"valid_{c}"] is not None} == parts == set(weights)
        assert abs(sum(w * r[f"valid_{c}"] for c, w in weights.items()) - r["valid_loss"]) < 1e-9
    assert J.eval_losses(df.limit(0), net)["total"] == 0.0
