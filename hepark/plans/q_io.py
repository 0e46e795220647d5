"""Registered source / sink / streaming round trips.

Each writes under the cluster's shared checkpoint folder (a fresh sub-folder
per call), reads the result back and returns it, so the check compares what
actually went through the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from hepark.functions.exprs import rnd, sql_order_key, sql_rnd
from hepark.operators import features as B
from hepark.operators import roc as H
from hepark.operators import sampling as D
from hepark.operators import scaling as E
from hepark.operators import scoring as Fs
from hepark.operators.ranking import input_bytes
from hepark.plans import standins as S
from hepark.plans.q_roc import SQL_FOLD_METRICS_RAW, _sql_auc_raw
from hepark.plans.q_sampling import SEED, SQL_SPLIT_SK
from hepark.plans.q_scoring import NET_CTES, net
from hepark.plans.registry import query
from hepark.session import cut_lineage
from hepark.sources import io as A
from hepark.streaming.ingest import ingest_incremental

R = sql_rnd

ORDERS_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                 "o_orderdate TIMESTAMP, o_orderpriority STRING")


@query("read_events", "SELECT o_orderkey AS event_id, o_totalprice, 1 AS y FROM orders WHERE o_orderstatus = 'F'")
def read_events(spark, sf_dir):
    sig = A.read_events(spark, f"{sf_dir}/orders.parquet", ORDERS_SCHEMA).filter(F.col("o_orderstatus") == "F")
    return B.with_label(sig, 1).select(F.col("o_orderkey").alias("event_id"), "o_totalprice", "y")


SQL_SPLIT_VALID = f"""
WITH e AS (SELECT vec_id AS k, CAST(label % 2 AS INTEGER) AS y, {sql_order_key('vec_id', 5)} AS ord FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY ord) AS rn, count(*) OVER (PARTITION BY y) AS n FROM e),
c AS (SELECT y, n, CAST(ceil(0.25::DOUBLE * n) AS BIGINT) AS v FROM (SELECT DISTINCT y, n FROM r)),
l AS ({S.SQL_EMB_LONG}),
st AS (SELECT feature, 1.0::DOUBLE / CASE WHEN max(value) - min(value) = 0 THEN 1.0::DOUBLE
                                       ELSE max(value) - min(value) END AS a, min(value) AS lo FROM l GROUP BY feature)
SELECT 'minmax' AS norm, k, r.y, feature, {R('l.value * st.a + (0.0::DOUBLE - st.lo * st.a)')} AS value
FROM r JOIN c USING (y) JOIN l USING (k) JOIN st USING (feature) WHERE rn <= v"""


@query("write_read_roundtrip", SQL_SPLIT_VALID)
def write_read_roundtrip(spark, sf_dir):
    m = S.embedding_matrix(spark, sf_dir)
    sp = D.stratified_split(E.normalise(m, "minmax"), 0.25, seed=5).withColumn("norm", F.lit("minmax"))
    path = A.scratch_path(spark, "splits")
    A.write_splits(sp.select("k", "y", "x", "norm", "split"), path)
    A.write_splits(sp.select("k", "y", "x", "norm", "split"), path, mode="ignore")  # A5: no-op
    back = A.read_split(spark, path, "minmax", "valid")
    return B.explode_features(back, keep=("norm", "k", "y")).withColumn("value", rnd("value"))


SQL_NORM_PIPELINE = f"""
WITH sp AS (SELECT k, split FROM ({SQL_SPLIT_SK})), l AS ({S.SQL_EMB_LONG}),
st AS (SELECT feature, 1.0::DOUBLE / CASE WHEN max(value) - min(value) = 0 THEN 1.0::DOUBLE
                                       ELSE max(value) - min(value) END AS a, min(value) AS lo, avg(value) AS mu,
              CASE WHEN stddev_pop(value) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(value) END AS sd
       FROM l GROUP BY feature),
v AS (SELECT 'minmax' AS norm, k, l.y, feature, l.value * st.a + (0.0::DOUBLE - st.lo * st.a) AS value
      FROM l JOIN st USING (feature)
      UNION ALL SELECT 'std', k, l.y, feature, (l.value - st.mu) / st.sd FROM l JOIN st USING (feature)),
n AS (SELECT norm, feature, CAST(count(*) AS BIGINT) AS hist_rows FROM v GROUP BY norm, feature)
SELECT norm, split, k, y, feature, {R('value')} AS value, {R('auc')} AS auc, hist_rows, n_split, built
FROM v JOIN sp USING (k) JOIN n USING (norm, feature)
JOIN ({_sql_auc_raw('SELECT norm, feature, y, value AS score FROM v', ['norm', 'feature'])}) USING (norm, feature)
JOIN (SELECT split, CAST(count(*) AS BIGINT) AS n_split FROM sp GROUP BY split) USING (split)
JOIN (VALUES ('minmax', 'minmax,std'), ('std', 'minmax,std|std')) AS b(norm, built) USING (norm)"""


@query("norm_pipeline", SQL_NORM_PIPELINE)
def norm_pipeline(spark, sf_dir):
    """Two norms, then a rerun that finds one committed and the other half written;
    every feature value of the store with the reports' areas and histogram counts, the
    manifest's rows per split, and which runs built which norm."""
    m = S.embedding_matrix(spark, sf_dir)
    path = A.scratch_path(spark, "norms")
    runs = [E.norm_pipeline(m, path, ["minmax", "std"], 0.1, seed=SEED)]
    fs, manifest = A._fs(spark, f"{A.norm_folder(spark, path, 'std')}/{A.MANIFEST}")
    fs.delete(manifest, False)                          # as a writer that died leaves it
    runs.append(E.norm_pipeline(m, path, ["minmax", "std"], 0.1, seed=SEED))
    built = {n: "|".join(",".join(r) for r in runs if n in r) for n in ("minmax", "std")}
    known = spark.createDataFrame(
        [(n, split, rows, built[n]) for n in ("minmax", "std")
         for split, rows in A.norm_manifest(spark, path, n)["splits"].items()],
        "norm string, split string, n_split long, built string")     # a row for each norm and split
    auc = spark.read.parquet(f"{path}/_reports/auc")
    hist = spark.read.parquet(f"{path}/_reports/hist").groupBy("norm", "feature").agg(F.sum("count").alias("hist_rows"))
    store = B.explode_features(spark.read.parquet(path), keep=("norm", "split", "k", "y"))
    out = store.join(F.broadcast(known), ["norm", "split"]).join(auc, ["norm", "feature"]).join(hist, ["norm", "feature"])
    return out.select("norm", "split", "k", "y", "feature", rnd("value").alias("value"), rnd("auc").alias("auc"),
                      "hist_rows", "n_split", "built")


@query("metrics_roundtrip", f"""SELECT model, fold, {R('CAST(CAST(auc AS FLOAT) AS DOUBLE)')} AS auc,
       {R('CAST(CAST(fpr_at_tpr AS FLOAT) AS DOUBLE)')} AS fpr_at_tpr FROM ({SQL_FOLD_METRICS_RAW})""")
def metrics_roundtrip(spark, sf_dir):
    m = H.fold_metrics(S.score_table(spark, sf_dir), ["model"])
    path = A.scratch_path(spark, "metrics")
    A.write_metrics(m, path)
    back = A.read_metrics(spark, path)
    return back.select("model", "fold", rnd(F.col("auc").cast("double")).alias("auc"),
                       rnd(F.col("fpr_at_tpr").cast("double")).alias("fpr_at_tpr"))


@query("auc_sum_text", f"""SELECT printf('%.3f', sum(auc)) AS value FROM ({SQL_FOLD_METRICS_RAW})""")
def auc_sum_text(spark, sf_dir):
    m = H.fold_metrics(S.score_table(spark, sf_dir), ["model"])
    path = A.scratch_path(spark, "aucsum")
    A.write_auc_sum(m, path)
    return spark.read.text(path)


@query("latent_roundtrip", f"""WITH {NET_CTES}
SELECT k, y, CAST(i AS INTEGER) AS feature, {R('v')} AS latent FROM latent JOIN ys USING (k)""")
def latent_roundtrip(spark, sf_dir):
    """The classes are written one after another, as the reference does; every
    component is read back."""
    s = cut_lineage(Fs.score_network(S.embedding_matrix(spark, sf_dir), net()).select("k", "y", "latent"))
    path = A.scratch_path(spark, "latent")
    for part in B.split_classes(s):
        A.write_latent(part, path)
    back = B.explode_features(spark.read.parquet(path), "latent", keep=("k", "y"), value="latent")
    return back.select("k", F.col("y").cast("int"), "feature", rnd("latent").alias("latent"))


@query("model_roundtrip", f"""WITH {NET_CTES} SELECT k, {R('v')} AS prob FROM prob""")
def model_roundtrip(spark, sf_dir):
    path = A.scratch_path(spark, "model")
    A.save_model(spark, net(), path)
    loaded = A.load_model(spark, path)
    s = Fs.score_network(S.embedding_matrix(spark, sf_dir), loaded)
    return s.select("k", rnd("prob").alias("prob"))


EVENTS_SCHEMA = ("event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, "
                 "props STRING")


def _ingest_transform(df):
    # per chunk: binarise -> select -> project
    d = df.withColumn("flag", F.when(F.col("value") >= 50, F.lit(1.0)).otherwise(F.lit(0.0)))
    return d.filter(F.col("value") > 10).select("event_id", "user_id", "event_type", "flag",
                                                 rnd("value").alias("value"))


@query("ingest_incremental", f"""SELECT event_id, user_id, event_type,
       CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag, {R('value')} AS value
FROM events WHERE value > 10""")
def ingest_incremental_q(spark, sf_dir):
    sink = A.scratch_path(spark, "ingest-out")
    ckpt = A.scratch_path(spark, "ingest-ckpt")
    ingest_incremental(spark, sf_dir, EVENTS_SCHEMA, sink, ckpt, _ingest_transform,
                       glob="events.parquet")
    return spark.read.parquet(sink)


def _ingest_flat_sql() -> str:
    from hepark.plans.q_features import _sql_flat_long
    return _sql_flat_long("btag")


#: Chunks (triggers) that the wide table is streamed in, and the input bytes worth a file.
CHUNKS = 4
FILE_BYTES = 32 << 20


def _files_per_chunk(df) -> int:
    """Files of a chunk: they follow the bytes of the plan's inputs, so a file, which one
    task writes, stays bounded."""
    return max(1, -(-(input_bytes(df) or 0) // (CHUNKS * FILE_BYTES)))


@query("ingest_flat_features", _ingest_flat_sql())
def ingest_flat_features(spark, sf_dir):
    """A2 on the reference's own input form: the wide raw event table, stored
    as several files, is streamed in chunks of files through binarise ->
    select -> project -> assemble; the sink must equal the batch result."""
    from hepark.plans.q_features import _long_out, raw_events
    src = A.scratch_path(spark, "raw-events")
    raw = raw_events(spark, sf_dir)
    files = _files_per_chunk(raw)
    raw.repartition(CHUNKS * files, "event_id").write.parquet(src)
    schema = spark.read.parquet(src).schema
    sink = A.scratch_path(spark, "flat-out")
    ckpt = A.scratch_path(spark, "flat-ckpt")
    ingest_incremental(spark, src, schema, sink, ckpt,
                       lambda d: B.flatten_events(d, "btag"), files_per_trigger=files)
    return _long_out(spark.read.parquet(sink))
