"""Registered feature-construction and join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hepark.functions.exprs import rnd, sql_rnd
from hepark.operators import features as B
from hepark.operators import joins as C
from hepark.plans import standins as S
from hepark.plans.registry import query

R = sql_rnd


# ------------------------------------------------------------------ event table

def event_counts(spark, sf_dir) -> DataFrame:
    """Every order is an event; object counts of both object kinds come from
    one conditional aggregate over all lines (one scan, partial aggregation)."""
    c = B.count_objects(S.objects_long(spark, sf_dir), kind="is_lep")
    ev = S.met(spark, sf_dir).join(c, "event_id", "left")
    return ev.fillna(0, subset=["njets", "nbtags", "nleps"])


SQL_EVENT_COUNTS = f"""
WITH j AS ({S.SQL_JETS}), l AS ({S.SQL_LEPS}), m AS ({S.SQL_MET}),
jc AS (SELECT event_id, CAST(count(*) AS INTEGER) AS njets,
              CAST(sum(CASE WHEN btag >= 1 THEN 1 ELSE 0 END) AS INTEGER) AS nbtags FROM j GROUP BY 1),
lc AS (SELECT event_id, CAST(count(*) AS INTEGER) AS nleps FROM l GROUP BY 1)
SELECT m.*, coalesce(njets, 0) AS njets, coalesce(nbtags, 0) AS nbtags, coalesce(nleps, 0) AS nleps
FROM m LEFT JOIN jc USING (event_id) LEFT JOIN lc USING (event_id)"""


@query("event_selection", f"""SELECT event_id, njets, nbtags, nleps FROM ({SQL_EVENT_COUNTS})
WHERE nleps = 1 AND nbtags >= 2 AND njets >= 4""")
def event_selection(spark, sf_dir):
    ev = B.select_events(event_counts(spark, sf_dir))
    return ev.select("event_id", "njets", "nbtags", "nleps")


def _sql_flatten(src: str, feats, n: int, prefix: str, rounded: bool = True) -> str:
    cols = []
    for i in range(n):
        for f in feats:
            e = f"coalesce(max(CASE WHEN slot = {i + 1} THEN CAST({f} AS DOUBLE) END), 0.0::DOUBLE)"
            cols.append(f"{R(e) if rounded else e} AS {prefix}_{f}_{i}")
    return f"""SELECT event_id, {', '.join(cols)} FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pt DESC) AS slot FROM ({src})
) WHERE slot <= {n} GROUP BY event_id"""


def _round_all(df: DataFrame, keep=("event_id",)) -> DataFrame:
    return df.select(*keep, *[rnd(c).alias(c) for c in df.columns if c not in keep])


@query("flatten_top7", _sql_flatten(S.SQL_JETS, B.JET_FEATS, B.N_JETS, "jets"))
def flatten_top7(spark, sf_dir):
    w = B.flatten_topk(S.jets_long(spark, sf_dir), "event_id", "pt", B.N_JETS, B.JET_FEATS, "jets")
    return _round_all(w)


@query("leading_lepton", _sql_flatten(S.SQL_LEPS, B.LEP_FEATS, B.N_LEPS, "leps"))
def leading_lepton(spark, sf_dir):
    w = B.flatten_topk(S.leptons_long(spark, sf_dir), "event_id", "pt", B.N_LEPS, B.LEP_FEATS, "leps")
    return _round_all(w)


def _sql_btag_bin() -> str:
    raw = _sql_flatten(S.SQL_JETS, ["btag"], B.JET_SLOTS_RAW, "jets", rounded=False)
    cols = ", ".join(f"CASE WHEN jets_btag_{i} >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS jets_btag_{i}"
                     for i in range(B.JET_SLOTS_RAW))
    return f"SELECT event_id, {cols} FROM ({raw})"


@query("binarise_btag", _sql_btag_bin())
def binarise_btag(spark, sf_dir):
    raw = B.flatten_topk(S.jets_long(spark, sf_dir), "event_id", "pt", B.JET_SLOTS_RAW, ["btag"], "jets")
    return B.binarise(raw, [f"jets_btag_{i}" for i in range(B.JET_SLOTS_RAW)])


@query("polar_to_xy", f"""SELECT event_id, {R('met_phi')} AS met_phi, {R('met_pt')} AS met_pt,
       {R('met_pt * cos(met_phi)')} AS met_px, {R('met_pt * sin(met_phi)')} AS met_py
FROM ({S.SQL_MET})""")
def polar_to_xy(spark, sf_dir):
    m = B.polar_to_xy(S.met(spark, sf_dir))
    return m.select("event_id", *[rnd(c).alias(c) for c in ("met_phi", "met_pt", "met_px", "met_py")])


# ------------------------------------------------------------------ B7/B8/B9 flat vectors

def flat_events(spark, sf_dir, layout: str = "nobtag") -> DataFrame:
    """Selected events with the flat jets | MET | lepton vector ``x`` and ``y``."""
    jf = B.JET_FEATS_BTAG if layout == "btag" else B.JET_FEATS
    objs = B.event_objects(S.objects_long(spark, sf_dir), jet_feats=jf)
    ev = B.polar_to_xy(B.select_events(objs).join(S.met(spark, sf_dir), "event_id"))
    x = F.concat(B.object_vector("jets", jf, B.N_JETS, tag="btag"),
                 F.array(*[F.col(f"met_{f}").cast("double") for f in B.MET_FEATS]),
                 B.object_vector("leps", B.LEP_FEATS, B.N_LEPS))
    return ev.select(F.col("event_id").alias("k"), "y", x.alias("x"))


def _sql_flat(layout: str) -> str:
    jf = B.JET_FEATS_BTAG if layout == "btag" else B.JET_FEATS
    jets = _sql_flatten(S.SQL_JETS, jf, B.N_JETS, "jets", rounded=False)
    if layout == "btag":
        # binarise the tag columns (pad 0 stays 0)
        bcols = [f"jets_{f}_{i}" for i in range(B.N_JETS) for f in jf]
        sel = ", ".join(
            f"CASE WHEN {c} >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}" if c.startswith("jets_btag")
            else c for c in bcols)
        jets = f"SELECT event_id, {sel} FROM ({jets})"
    leps = _sql_flatten(S.SQL_LEPS, B.LEP_FEATS, B.N_LEPS, "leps", rounded=False)
    cols = B.feature_set(layout)
    arr = ", ".join(f"CAST({c} AS DOUBLE)" for c in cols)
    return f"""
SELECT ev.event_id AS k, ev.y, [{arr}] AS x FROM
 (SELECT *, met_pt * cos(met_phi) AS met_px, met_pt * sin(met_phi) AS met_py
  FROM ({SQL_EVENT_COUNTS}) WHERE nleps = 1 AND nbtags >= 2 AND njets >= 4) ev
 JOIN ({jets}) jt USING (event_id) JOIN ({leps}) lp USING (event_id)"""


def _sql_flat_long(layout: str) -> str:
    return f"""SELECT k, y, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS feature,
       {R('unnest(x)')} AS value FROM ({_sql_flat(layout)})"""


def _long_out(flat: DataFrame) -> DataFrame:
    long = B.explode_features(flat, keep=("k", "y"))
    return long.select("k", "y", "feature", rnd("value").alias("value"))


@query("feature_vector", _sql_flat_long("nobtag"))
def feature_vector(spark, sf_dir):
    return _long_out(flat_events(spark, sf_dir, "nobtag"))


@query("feature_vector_btag", _sql_flat_long("btag"))
def feature_vector_btag(spark, sf_dir):
    return _long_out(flat_events(spark, sf_dir, "btag"))


def _sql_names(layout: str) -> str:
    vals = ", ".join(f"({i}, '{B.feature_label(i, layout)}')" for i in range(len(B.feature_set(layout))))
    return f"(VALUES {vals}) AS nm(feature, name)"


@query("feature_names", f"""SELECT CAST(nm.feature AS INTEGER) AS feature, nm.name,
       CAST(count(*) AS BIGINT) AS n, {R('avg(v.value)')} AS mean
FROM (SELECT k, generate_subscripts(x, 1) - 1 AS feature, unnest(x) AS value FROM ({_sql_flat('btag')})) v
JOIN {_sql_names('btag')} ON v.feature = nm.feature GROUP BY nm.feature, nm.name""")
def feature_names_q(spark, sf_dir):
    long = B.explode_features(flat_events(spark, sf_dir, "btag"), keep=("k",))
    stats = long.groupBy("feature").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                        F.avg("value").alias("mean"))
    named = B.attach_feature_names(stats, B.feature_names(spark, "btag"))
    return named.select("feature", "name", "n", rnd("mean").alias("mean"))


# ------------------------------------------------------------------ embeddings-based

@query("feature_long", f"""SELECT k, y, feature, {R('value')} AS value FROM ({S.SQL_EMB_LONG})""")
def feature_long(spark, sf_dir):
    long = B.explode_features(S.embedding_matrix(spark, sf_dir))
    return long.select("k", "y", "feature", rnd("value").alias("value"))


@query("feature_pair", f"""SELECT vec_id AS k, CAST(label % 2 AS INTEGER) AS y,
       {R('CAST(embedding[1] AS DOUBLE)')} AS xi, {R('CAST(embedding[2] AS DOUBLE)')} AS xj
FROM embeddings""")
def feature_pair(spark, sf_dir):
    p = B.feature_pair(S.embedding_matrix(spark, sf_dir), 0, 1)
    return p.select("k", "y", rnd("xi").alias("xi"), rnd("xj").alias("xj"))


@query("one_hot", """SELECT vec_id AS k, CAST(i AS INTEGER) AS class_idx,
       CASE WHEN i = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS onehot
FROM embeddings, range(0, (SELECT max(label) + 1 FROM embeddings)) t(i)""")
def one_hot(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "label")
    oh = B.one_hot(e, "label")
    return oh.select("k", F.posexplode("onehot").alias("class_idx", "onehot")) \
             .withColumn("class_idx", F.col("class_idx").cast("int"))


@query("head_per_class", """SELECT k, y, rn FROM (
  SELECT vec_id AS k, CAST(label % 2 AS INTEGER) AS y,
         row_number() OVER (PARTITION BY label % 2 ORDER BY vec_id) AS rn FROM embeddings)
WHERE rn <= 100""")
def head_per_class(spark, sf_dir):
    h = B.head_per_class(S.embedding_matrix(spark, sf_dir), 100)
    return h.select("k", "y", "rn")


# ------------------------------------------------------------------ C1, C2

@query("label_join", """SELECT d.doc_id, d.n_chars, l.quality AS y
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def label_join(spark, sf_dir):
    j = C.attach_labels(S.documents_x(spark, sf_dir), S.labels_y(spark, sf_dir), "doc_id")
    return j.select("doc_id", "n_chars", "y")


@query("class_union", """SELECT o_orderkey AS event_id, o_totalprice, 1 AS y FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey AS event_id, o_totalprice, 0 AS y FROM orders WHERE o_orderstatus <> 'F'""")
def class_union(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    sig = B.with_label(o.filter(F.col("o_orderstatus") == "F"), 1)
    bkg = B.with_label(o.filter(F.col("o_orderstatus") != "F"), 0)
    u = C.stack_classes(sig, bkg)
    return u.select(F.col("o_orderkey").alias("event_id"), "o_totalprice", "y")


@query("class_split_counts", """SELECT CAST(y AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n_rows
FROM (SELECT label % 2 AS y FROM embeddings) GROUP BY y""")
def class_split_counts(spark, sf_dir):
    sig, bkg = B.split_classes(S.embedding_matrix(spark, sf_dir))
    cnt = lambda d: d.agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    return (cnt(sig).withColumn("y", F.lit(1)).unionByName(cnt(bkg).withColumn("y", F.lit(0)))
            .select(F.col("y").cast("int"), "n_rows"))


# ------------------------------------------------------------------ wide raw events (A1 + B*)

def raw_events(spark, sf_dir) -> DataFrame:
    """The wide raw layout the reference reads: counts, MET, 10 jet slots of
    pt, eta, phi, en, px, py, pz and raw b-tag (0..7), one lepton slot."""
    objs = B.event_objects(S.objects_long(spark, sf_dir), jet_feats=B.JET_FEATS_BTAG, n_jets=B.JET_SLOTS_RAW)
    slots = [(holder, f, i) for holder, feats, n in (("jets", B.JET_FEATS_BTAG, B.JET_SLOTS_RAW),
                                                     ("leps", B.LEP_FEATS, B.N_LEPS)) for i in range(n) for f in feats]
    raw = S.met(spark, sf_dir).join(objs, "event_id", "left")
    return raw.select("event_id", "met_pt", "met_phi", "y",
                      *[F.coalesce(c, F.lit(0)).alias(c) for c in ("njets", "nbtags", "nleps")],
                      *[F.coalesce(F.get(F.col(h), F.lit(i))[f], F.lit(0.0)).alias(f"{h}_{f}_{i}")
                        for h, f, i in slots])


@query("flat_from_wide", _sql_flat_long("btag"))
def flat_from_wide(spark, sf_dir):
    return _long_out(B.flatten_events(raw_events(spark, sf_dir), "btag"))


@query("flat_from_wide_nobtag", _sql_flat_long("nobtag"))
def flat_from_wide_nobtag(spark, sf_dir):
    return _long_out(B.flatten_events(raw_events(spark, sf_dir), "nobtag"))
