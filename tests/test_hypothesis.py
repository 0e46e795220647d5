"""Randomised checks of the distributed ordered scan and AUC against pandas / brute force."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hepark.operators import roc as H
from hepark.operators.ranking import ordered_scan

SETTINGS = dict(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_st = st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5), st.one_of(st.none(), st.integers(0, 9))),
                   min_size=1, max_size=120)


@settings(**SETTINGS)
@given(rows=rows_st, buckets=st.sampled_from([2, 4, 64]))
def test_ordered_scan_matches_pandas(spark, rows, buckets):
    # unique order value per group: (value, index) packed into a double
    data = [(g, float(v) + i / 1000.0, v, c) for i, (g, v, c) in enumerate(rows)]
    pdf = pd.DataFrame(data, columns=["g", "o", "v", "c"])
    df = spark.createDataFrame(pdf.astype({"c": "float"}), "g long, o double, v long, c double")
    out = ordered_scan(df, ["g"], "o", sums=["v"], prevs=["v"], carries=["c"], totals=True,
                       buckets=buckets).toPandas()
    for g, part in pdf.groupby("g"):
        p = part.sort_values("o")
        o = out[out.g == g].sort_values("o")
        assert list(o["v_below"]) == list(p["v"].cumsum() - p["v"])
        exp_prev = p["v"].shift(1)
        assert [None if pd.isna(a) else int(a) for a in o["prev_v"]] == \
               [None if pd.isna(a) else int(a) for a in exp_prev]
        exp_carry = p["c"].ffill()
        got_carry = o["carry_c"].to_numpy(dtype=float)
        assert np.array_equal(np.nan_to_num(got_carry, nan=-1), np.nan_to_num(exp_carry.to_numpy(dtype=float), nan=-1))
        assert set(o["v_total"]) == {int(p["v"].sum())} and set(o["n_group"]) == {len(p)}


@settings(**SETTINGS)
@given(pairs=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=80))
def test_auc_equals_mann_whitney(spark, pairs):
    y = np.array([a for a, _ in pairs])
    s = np.array([float(b) for _, b in pairs])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    got = H.auc(df, [], buckets=4).first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        assert got is None
        return
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert abs(got - u / (len(pos) * len(neg))) < 1e-12
