"""Selection and flattening on the hand-made event fixture: events with 3, 4
and 9 objects; b-tags 0, 1 and 7."""

import numpy as np
import pytest

from hepark.operators import features as B


@pytest.fixture(scope="module")
def objects(spark):
    rows = []
    for ev, n in ((1, 3), (2, 4), (3, 9)):
        for j in range(n):
            pt = float(100 - 7 * j + ev)          # distinct, descending with j
            btag = (0, 1, 7)[j % 3]
            rows.append((ev, pt, 0.1 * j, 0.2 * j, pt + 1, pt * 0.5, pt * 0.25, pt * 2, btag))
    return spark.createDataFrame(rows, "event_id long, pt double, eta double, phi double, en double, "
                                       "px double, py double, pz double, btag int")


def test_counts_and_selection(spark, objects):
    c = B.count_objects(objects, "event_id", "btag", "njets", "nbtags").orderBy("event_id").toPandas()
    assert list(c["njets"]) == [3, 4, 9]
    assert list(c["nbtags"]) == [2, 2, 6]        # tags 1 and 7 count, 0 does not
    ev = c.assign(nleps=1)
    sel = B.select_events(spark.createDataFrame(ev)).toPandas()
    assert sorted(sel["event_id"]) == [2, 3]     # njets >= 4 and nbtags >= 2


def test_flatten_pads_and_keeps_leading(spark, objects):
    w = B.flatten_topk(objects, "event_id", "pt", 7, B.JET_FEATS_BTAG, "jets").orderBy("event_id").toPandas()
    e1 = w[w.event_id == 1].iloc[0]
    assert e1["jets_pt_2"] > 0 and e1["jets_pt_3"] == 0.0 and e1["jets_btag_6"] == 0.0   # 3 objects, rest padded
    e3 = w[w.event_id == 3].iloc[0]
    pts = [e3[f"jets_pt_{i}"] for i in range(7)]
    assert pts == sorted(pts, reverse=True) and pts[0] == 103.0 and pts[6] == 103.0 - 42.0
    assert len([c for c in w.columns if c.startswith("jets_")]) == 7 * 8


def test_binarise_boundaries(spark):
    df = spark.createDataFrame([(0,), (1,), (7,)], "t int")
    got = [r[0] for r in B.binarise(df, ["t"]).collect()]
    assert got == [0.0, 1.0, 1.0]


def test_layouts_and_names(spark):
    assert len(B.feature_set("nobtag")) == 60 and len(B.feature_set("btag")) == 67
    with pytest.raises(TypeError):
        B.feature_set("other")
    assert B.feature_label(0) == "Jet 1 pt" and B.feature_label(49) == "MET phi"
    assert B.feature_label(59) == "Lepton pz" and B.feature_label(60) is None
    assert B.feature_label(7, "btag") == "Jet 1 btag"


def test_one_hot_widths(spark):
    df = spark.createDataFrame([(0,), (2,)], "y int")
    assert [r[0] for r in B.one_hot(df, "y").select("onehot").collect()] == [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    assert [len(r[0]) for r in B.one_hot(df, "y", n=4).select("onehot").collect()] == [4, 4]


def test_flatten_events_from_wide(spark, objects):
    jets = B.flatten_topk(objects, "event_id", "pt", 10, B.JET_FEATS_BTAG, "jets")
    c = B.count_objects(objects, "event_id", "btag", "njets", "nbtags")
    leps = B.flatten_topk(objects.filter("btag = 7"), "event_id", "pt", 1, B.LEP_FEATS, "leps")
    from pyspark.sql import functions as F
    raw = (jets.join(c, "event_id").join(leps, "event_id")
           .withColumn("nleps", F.lit(1)).withColumn("met_pt", F.lit(2.0)).withColumn("met_phi", F.lit(0.5))
           .withColumn("y", F.lit(1)))
    flat = B.flatten_events(raw, "btag").orderBy("k").toPandas()
    assert list(flat["k"]) == [2, 3]
    x = np.asarray(flat["x"].iloc[0])
    assert len(x) == 67 and set(x[7:56:8]) <= {0.0, 1.0}          # binarised tags
    assert x[56] == 0.5 and x[57] == 2.0 and abs(x[58] - 2.0 * np.cos(0.5)) < 1e-15
