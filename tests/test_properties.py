"""Hand-made edge tables checked against brute-force numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hepark.operators import hist as G
from hepark.operators import roc as H
from hepark.operators import sampling as D
from hepark.operators import scaling as E
from hepark.operators.ranking import exact_quantiles, positions


def np_roc(y, s, drop=True):
    """Reference ROC (distinct thresholds descending, collinear drop, origin)."""
    order = np.argsort(-s, kind="mergesort")
    s, y = s[order], y[order]
    idx = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[idx]
    fps = (1 + idx) - tps
    if drop and len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps = fps[keep], tps[keep]
    tps, fps = np.r_[0, tps], np.r_[0, fps]
    return fps / fps[-1], tps / tps[-1]


def np_auc(y, s):
    fpr, tpr = np_roc(y, s, drop=False)
    integ = getattr(np, "trapezoid", None) or np.trapz
    return float(integ(tpr, fpr))


def frame(spark, y, s, extra=None):
    rows = [(int(a), float(b)) for a, b in zip(y, s)]
    return spark.createDataFrame(rows, "y int, score double")


@pytest.mark.parametrize("seed", [0, 1])
def test_auc_matches_trapezoid_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.normal(size=300) + y * 0.5, 1)  # heavy ties
    a = H.auc(frame(spark, y, s), []).first()["auc"]
    assert a == pytest.approx(np_auc(y, s), abs=1e-12)
    neg = H.auc(frame(spark, y, -s), []).first()["auc"]
    assert neg == pytest.approx(1 - a, abs=1e-12)
    mono = H.auc(frame(spark, y, np.exp(s)), []).first()["auc"]
    assert mono == pytest.approx(a, abs=1e-12)


def test_auc_single_class_is_null(spark):
    assert H.auc(frame(spark, [1, 1, 1], [0.1, 0.2, 0.3]), []).first()["auc"] is None


def test_all_scores_equal(spark):
    a = H.auc(frame(spark, [0, 1, 0, 1], [0.5] * 4), []).first()["auc"]
    assert a == 0.5


def test_roc_curve_and_grid_match_numpy(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(size=400) + y, 1)
    roc = H.roc_curve(frame(spark, y, s), []).orderBy("thr_idx").toPandas()
    fpr, tpr = np_roc(y, s)
    assert np.allclose(roc["fpr"].to_numpy(), fpr) and np.allclose(roc["tpr"].to_numpy(), tpr)
    grid = H.roc_on_grid(H.roc_curve(frame(spark, y, s), []), []).orderBy("grid_idx").toPandas()
    ref = np.interp(np.linspace(0.025, 0.99, 100), tpr, fpr)
    assert len(grid) == 100 and np.allclose(grid["fpr"].to_numpy(), ref, atol=1e-12)
    w = H.fpr_at_tpr(H.roc_curve(frame(spark, y, s), []), []).first()["fpr_at_tpr"]
    assert w == pytest.approx(fpr[np.abs(tpr - 0.8).argmin()])


def test_positions_exact_under_skew(spark):
    # one group holds a third of the rows
    rows = [(0 if i % 3 == 0 else i % 7, f"{(i * 2654435761) % 1000003:07d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, key string")
    got = positions(df, ["g"], "key", out="pos", buckets=16).toPandas()
    for g, part in got.groupby("g"):
        exp = part["key"].rank(method="first").astype(int).to_numpy()
        assert (part["pos"].to_numpy() == exp).all()


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=501), 2)
    df = spark.createDataFrame([(0, float(x)) for x in v], "g int, value double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    q = exact_quantiles(df, ["g"], "value", probs).orderBy("p_idx").toPandas()["q"].to_numpy()
    assert np.allclose(q, np.percentile(v, [p * 100 for p in probs]), atol=1e-12)


def test_histogram_edges_and_constant(spark):
    vals = [0.0, 0.25, 0.5, 0.75, 1.0, 1.0, 0.1, 0.9999999]
    df = spark.createDataFrame([(0, 1, v) for v in vals] + [(1, 1, 3.0)] * 3, "feature int, y int, value double")
    h = G.hist_own(df, bins=4).orderBy("feature", "bin").toPandas()
    c, edges = np.histogram(vals, bins=4, density=False)
    d, _ = np.histogram(vals, bins=4, density=True)
    f0 = h[h.feature == 0]
    assert list(f0["count"]) == list(c) and np.allclose(f0["density"], d)
    f1 = h[h.feature == 1]
    c1, _ = np.histogram([3.0] * 3, bins=4)
    assert list(f1["count"]) == list(c1)


def test_kfold_disjoint_and_balanced(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(103)], "k long, y int")
    f = D.kfold(df, k=4, events=20, seed=1).toPandas()
    assert len(f) == 80 and f["k"].is_unique
    for _, part in f.groupby("fold"):
        assert (part["y"] == 1).sum() == 10 and (part["y"] == 0).sum() == 10
        assert sorted(part["slot"]) == list(range(20))


def test_chunk_sizes_follow_array_split(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(23)], "k long, y int")
    c = D.chunk(df, 5, seed=4).groupBy("chunk").count().orderBy("chunk").toPandas()
    assert list(c["count"]) == [len(a) for a in np.array_split(np.arange(23), 5)]


def test_balanced_sample_short_class(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(20)], "k long, y int")
    s = D.balanced_sample(df, 10, seed=0).toPandas()
    assert (s.y == 1).sum() == 3 and (s.y == 0).sum() == 5 and sorted(s.pos) == list(range(1, 9))


def test_scaler_edge_cases(spark):
    df = spark.createDataFrame([(i, [5.0, 0.0, float(i)]) for i in range(4)], "k long, x array<double>")
    mm = E.normalise(df, "minmax").orderBy("k").toPandas()
    assert all(r[0] == 0.0 and r[1] == 0.0 for r in mm["x"])
    st = E.normalise(df, "std").orderBy("k").toPandas()
    assert all(r[0] == 0.0 for r in st["x"])
    ma = E.normalise(df, "maxabs").orderBy("k").toPandas()
    assert all(r[1] == 0.0 for r in ma["x"])
    one = spark.createDataFrame([(0, [2.0, 3.0])], "k long, x array<double>")
    assert E.normalise(one, "robust").first()["x"] == [0.0, 0.0]
    with pytest.raises(TypeError):
        E.fit_scaler(df, "nope")


def test_scaling_keeps_feature_auc(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(i % 2), [float(v) for v in rng.normal(size=3) + (i % 2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, y int, x array<double>")
    from hepark.operators.features import explode_features
    base = H.feature_auc(explode_features(df)).orderBy("feature").toPandas()["auc"].to_numpy()
    for name in ("minmax", "maxabs", "std", "robust", "power", "quantile"):
        s = E.normalise(df, name, n_quantiles=50) if name == "quantile" else E.normalise(df, name)
        got = H.feature_auc(explode_features(s)).orderBy("feature").toPandas()["auc"].to_numpy()
        tol = 0.02 if name == "quantile" else 1e-9  # quantile map is piecewise flat at the ends
        assert np.allclose(got, base, atol=tol), name


def test_gram_symmetric_unit_diagonal(spark):
    from hepark.operators.scoring import gram
    rows = [(i, [float(i), float(i * i % 5)]) for i in range(6)]
    a = spark.createDataFrame(rows, "k long, x array<double>")
    refs = a.withColumnRenamed("k", "ref")
    g = gram(a, refs, "rbf", gamma=0.3, block=4).toPandas()
    m = g.pivot(index="k", columns="ref", values="kval").to_numpy()
    assert np.allclose(m, m.T) and np.allclose(np.diag(m), 1.0)


def test_fit_network_loss_goes_down(spark):
    from hepark.operators import fitting as J
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 2), [float(v) for v in rng.normal(size=8) * 0.3 + (i % 2) * 0.5]) for i in range(256)]
    df = spark.createDataFrame(rows, "k long, y int, x array<double>")
    net = J.choose_network("vanilla", [8, 4])
    before = J.eval_loss(df, net)
    best, hist = J.fit_network(df, df, net, epochs=4, batch_size=64, lr=0.02, seed=1)
    assert J.eval_loss(df, best) < before
    assert hist.count() == 4
    with pytest.raises(TypeError):
        J.choose_network("nope", [8, 4])


def test_bounds_lookup_matches_linear_count(spark):
    from hepark.operators.ranking import bounds_lookup
    rng = np.random.default_rng(11)
    b = np.sort(np.round(rng.normal(size=299), 1))  # many repeated boundaries
    vals = np.r_[np.round(rng.normal(size=500), 1), b[:20], [-10.0, 10.0]]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double") \
              .withColumn("bnd", F.array(*[F.lit(float(x)) for x in b]))
    got = df.select("v", bounds_lookup(F.col("bnd"), F.col("v"), len(b)).alias("c")).toPandas()
    exp = [int((b < v).sum()) for v in got["v"]]
    assert list(got["c"]) == exp


def test_positions_many_buckets(spark):
    df = spark.createDataFrame([(i % 2, float((i * 7919) % 10007)) for i in range(5000)], "g int, s double")
    got = positions(df, ["g"], "s", out="pos", buckets=512).toPandas()
    for g, part in got.groupby("g"):
        assert (part["pos"].to_numpy() == part["s"].rank(method="first").astype(int).to_numpy()).all()


def test_hist_pair_recon_outside_input_range(spark):
    rows = [(0, 1, float(v), 100.0 + v) for v in range(5)]
    pairs = spark.createDataFrame(rows, "feature int, y int, input double, recon double")
    h = G.hist_pair(pairs, bins=4).toPandas()
    rec = h[h.kind == "recon"]
    assert len(rec) == 4 and rec["count"].sum() == 0 and rec["density"].isna().all()
    inp = h[h.kind == "input"].sort_values("bin")
    c, _ = np.histogram(np.arange(5.0), bins=4)
    assert list(inp["count"]) == list(c)


def test_approximate_quantile_scalers_close_to_exact(spark):
    rng = np.random.default_rng(21)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, x array<double>")
    for name, kw in (("robust", {}), ("quantile", {"n_quantiles": 21})):
        ex = np.vstack(E.apply_scaler(df, E.fit_scaler(df, name, **kw)).orderBy("k").toPandas()["x"])
        ap = np.vstack(E.apply_scaler(df, E.fit_scaler(df, name, exact=False, **kw)).orderBy("k").toPandas()["x"])
        assert np.abs(ex - ap).max() < 0.05, name


def test_api_conveniences(spark):
    from hepark.operators import fitting as J
    from hepark.operators.scoring import gram
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(6)], "k long, a double, b double")
    n = E.normalise_columns(df, "minmax", ["a", "b"]).orderBy("k").toPandas()
    assert n["a"].min() == 0.0 and n["a"].max() == 1.0 and n["b"].max() == 1.0
    m = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "k long, x array<double>")
    refs = m.withColumnRenamed("k", "ref")
    for block in (1024, 3):
        g = gram(m, refs, kernel="linear", block=block).toPandas()
        assert len(g) == 16 and (g["kval"] == g["k"] * g["ref"] + 1).all()
    with pytest.raises(ValueError):
        gram(m, refs, max_refs=3)
    long = spark.createDataFrame([(0, 1, 1.0), (0, 0, 2.0)], "feature int, y int, value double")
    with pytest.raises(TypeError):
        G.hist(long, 4, range="nope")
    assert G.hist(long, 4, range="own").count() == 8
    rows = [(i, i % 2, [float(i % 2) + 0.1 * i, 1.0]) for i in range(40)]
    r = H.feature_auc_chunks(spark.createDataFrame(rows, "k long, y int, x array<double>"), 5, 1).toPandas()
    assert len(r) == 2
    t = J.random_search(spark, 3, 1, lambda p: p["lr"])
    assert t.count() == 3 and t.filter("best").count() == 1


def test_scoring_matches_layer_by_layer(spark):
    from hepark.operators import scoring as Fs
    rng = np.random.default_rng(4)
    X = rng.normal(size=(50, 12))
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(50)], "k long, x array<double>")

    act = {"relu": lambda z: max(z, 0.0), "elu": lambda z: z if z > 0 else np.exp(z) - 1, "tanh": np.tanh,
           "sigmoid": lambda z: 1 / (1 + np.exp(-z)), "linear": lambda z: z,
           "leaky_relu": lambda z: z if z > 0 else 0.2 * z}

    def by_hand(layers, x):
        for layer in layers:
            x = [act[layer["act"]](sum(x[r] * layer["w"][r, c] for r in range(len(x))) + layer["b"][c])
                 for c in range(layer["w"].shape[1])]
        return x

    for net in (Fs.autoencoder([12, 6, 3], head=[4, 1]), Fs.plain_classifier([12, 5, 2]),
                Fs.autoencoder([12, 6, 3], head=[4, 1], latent_act="linear"),
                Fs.autoencoder([12, 4], last_act="elu", head=[2, 1], head_hidden="leaky_relu")):
        got = Fs.score_network(df, net).orderBy("k").toPandas()
        parts = net["parts"]
        latent = [by_hand(parts["encoder"], list(x)) for x in X]
        assert np.allclose(np.vstack(got["latent"]), latent, atol=1e-12)
        assert np.allclose(got["prob"], [by_hand(parts["head"], z)[0] for z in latent], atol=1e-12)
        if "decoder" in parts:
            assert np.allclose(np.vstack(got["recon"]), [by_hand(parts["decoder"], z) for z in latent], atol=1e-12)


def test_power_lambda_matches_golden_section(spark):
    rng = np.random.default_rng(8)
    v = rng.lognormal(size=600) - 0.7

    def yj(x, lam):
        out = np.empty_like(x)
        p = x >= 0
        out[p] = np.log1p(x[p]) if abs(lam) < 1e-16 else ((x[p] + 1) ** lam - 1) / lam
        out[~p] = -np.log1p(-x[~p]) if abs(lam - 2) < 1e-16 else -((-x[~p] + 1) ** (2 - lam) - 1) / (2 - lam)
        return out

    def ll(lam):
        return -len(v) / 2 * np.log(yj(v, lam).var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()

    a, b = -2.0, 2.0
    g = (np.sqrt(5) - 1) / 2
    for _ in range(200):
        c, d = b - g * (b - a), a + g * (b - a)
        if ll(c) > ll(d):
            b = d
        else:
            a = c
    ref = (a + b) / 2
    df = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(v)], "k long, x array<double>")
    lam = E.fit_scaler(df, "power").first()["lam"][0]
    assert abs(lam - ref) < 1e-5


def test_fit_batches_exact_sizes(spark):
    from hepark.operators.fitting import _epoch_batches
    df = spark.createDataFrame([(i, 0, [0.0]) for i in range(103)], "k long, y int, x array<double>")
    path = _epoch_batches(df, "k", 3, 0, 25)
    sizes = spark.read.parquet(path).groupBy("_b").count().orderBy("_b").toPandas()["count"].tolist()
    assert sizes == [25, 25, 25, 25, 3]


def test_xxhash_positions_exact(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(3000)], "k long, g int")
    got = D.shuffle(df, "k", 5, with_pos=True, by=["g"], hash="xxhash64").toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["pos"]) == list(range(1, len(part) + 1))
        o = part.sort_values("pos")
        hs = [r["h"] for r in o["ord"]]
        assert hs == sorted(hs)


def test_sampling_with_xxhash(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(301)], "k long, y int")
    f = D.kfold(df, k=3, events=40, seed=2, hash="xxhash64").toPandas()
    assert len(f) == 120 and f["k"].is_unique
    sp = D.stratified_split(df, 0.1, seed=2, hash="xxhash64").groupBy("split").count().toPandas()
    import math
    assert dict(zip(sp["split"], sp["count"]))["valid"] == math.ceil(0.1 * 151) + math.ceil(0.1 * 150)
    c = D.chunk(df, 5, seed=2, hash="xxhash64").groupBy("chunk").count().orderBy("chunk").toPandas()
    assert list(c["count"]) == [len(a) for a in np.array_split(np.arange(301), 5)]


@pytest.mark.parametrize("name", ["vanilla", "classifier", "plain"])
def test_gradients_match_finite_differences(name):
    from hepark.operators import fitting as J
    rng = np.random.default_rng(1)
    X = rng.normal(size=(7, 5)) * 0.5
    y = (rng.random(7) > 0.5).astype(float)
    kw = {"head": (3, 1)} if name == "classifier" else {}
    net = J.choose_network(name, [5, 4, 2], **kw)
    _, gr = J.loss_and_grads(net, X, y, 0.3)
    g = J._vec(net, gr)
    theta = J._vec(net)
    idx = rng.choice(len(theta), 12, replace=False)
    for i in idx:
        e = np.zeros_like(theta)
        e[i] = 1e-6
        lp, _ = J.loss_and_grads(J._unvec(net, theta + e), X, y, 0.3)
        lm, _ = J.loss_and_grads(J._unvec(net, theta - e), X, y, 0.3)
        assert abs((lp - lm) / 2e-6 - g[i]) < 1e-5 * max(1.0, abs(g[i]))


def test_sklearn_split_allocation():
    from hepark.operators.sampling import largest_remainder, sklearn_split_sizes
    # shares 1.5, 1.5, 2.0: one extra draw goes to the first tied remainder
    assert largest_remainder([3, 3, 4], 5) == [2, 1, 2]
    assert largest_remainder([256, 244], 450) == [230, 220]
    va, te = sklearn_split_sizes([256, 244], 0.1)
    assert sum(va) == 50 and va == [26, 24]
    assert sum(te) in (50, 51) and all(t >= 0 for t in te)


def test_rounding_large_values_under_ansi(spark):
    from hepark.functions.exprs import rnd
    spark.conf.set("spark.sql.ansi.enabled", "true")
    df = spark.createDataFrame([(1.23456789,), (-2.5e-7,), (3.0e15,), (None,)], "v double")
    got = [r[0] for r in df.select(rnd("v")).collect()]
    assert got[0] == 1.234568 and got[1] == 0.0  # -0.0 == 0.0
    assert got[2] == 3.0e15 and got[3] is None


def test_kde_prebin_close_to_exact(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i % 2), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    ex = G.kde2d(df, "a", "b", grid=8).orderBy("y", "gx", "gy").toPandas()
    ap = G.kde2d(df, "a", "b", grid=8, prebin=256).orderBy("y", "gx", "gy").toPandas()
    assert np.allclose(ex["density"], ap["density"], rtol=0.02, atol=1e-4)


def test_grid_search_parallel_same_as_serial(spark):
    from hepark.operators import fitting as J
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "k long, v double")

    def trial(p):
        return df.filter(df.v < p["cut"]).count() * p["w"]

    trials = [{"cut": c, "w": w} for c in (10.0, 50.0) for w in (1.0, 2.0)]
    assert J.grid_search(trials, trial) == J.grid_search(trials, trial, parallelism=3)


def test_grid_at_repeated_tpr_takes_last_vertex(spark):
    # pos 0.9, 0.5 / neg 0.7, 0.3: TPR 0.5 repeats (FPR 0 then 0.5)
    y = np.array([1, 0, 1, 0])
    s = np.array([0.9, 0.7, 0.5, 0.3])
    grid = [0.25, 0.5, 0.75]
    roc = H.roc_curve(frame(spark, y, s), [])
    got = H.roc_on_grid(roc, [], grid).orderBy("grid_idx").toPandas()["fpr"].to_numpy()
    fpr, tpr = np_roc(y, s)
    assert np.allclose(got, np.interp(grid, tpr, fpr)) and got[1] == 0.5


def test_working_point_tie_takes_first_vertex(spark):
    # TPRs 0.25 and 0.75 are exactly 0.25 away from 0.5: the first vertex wins
    y = np.array([1, 0, 1, 1, 0, 1, 0])
    s = np.array([0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3])
    roc = H.roc_curve(frame(spark, y, s), [], drop_intermediate=False)
    got = H.fpr_at_tpr(roc, [], target=0.5).first()["fpr_at_tpr"]
    fpr, tpr = np_roc(y, s, drop=False)
    assert got == fpr[np.abs(tpr - 0.5).argmin()]


def test_forward_loss_matches_gradient_path(spark):
    from hepark.operators import fitting as J
    rng = np.random.default_rng(3)
    X = rng.normal(size=(20, 5))
    y = (rng.random(20) > 0.5).astype(float)
    for name, kw in (("vanilla", {}), ("classifier", {"head": (3, 1)}), ("plain", {})):
        net = J.choose_network(name, [5, 3], **kw)
        lo, _ = J.loss_and_grads(net, X, y, 0.4)
        assert abs(J.batch_loss(net, X, y, 0.4) - lo) < 1e-9
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in X[i]]) for i in range(20)],
                               "k long, y int, x array<double>")
    net = J.choose_network("vanilla", [5, 3])
    assert abs(J.eval_loss(df, net) - J.loss_and_grads(net, X, y)[0] / 20) < 1e-9
