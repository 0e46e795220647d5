"""Registered fitting / selection / history queries.

``early_stop`` runs on a stand-in loss history derived from ``events`` (one
run per event type, one epoch per day, loss = mean value).  The fits are
iterative and get the rows-only check."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hepark.functions.exprs import rnd, sql_rnd
from hepark.operators import fitting as J
from hepark.operators import roc as H
from hepark.operators import sampling as D
from hepark.plans import standins as S
from hepark.plans.registry import query

R = sql_rnd
PATIENCE = 3


def events_history(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    h = e.groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("d")).agg(
        F.avg("value").alias("valid_loss"))
    # one row per (run, day): a run's history is small, so a per-run window is fine
    w = Window.partitionBy("run").orderBy("d")
    return h.select("run", (F.row_number().over(w) - 1).cast("int").alias("epoch"), "valid_loss")


@query("early_stop", f"""
WITH h AS (SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY d) - 1 AS INTEGER) AS epoch, valid_loss
           FROM (SELECT event_type AS run, CAST(ts AS DATE) AS d, avg(value) AS valid_loss FROM events GROUP BY 1, 2)),
w AS (SELECT *, min(valid_loss) OVER (PARTITION BY run ORDER BY epoch
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM h),
i AS (SELECT *, CASE WHEN pm IS NULL OR valid_loss < pm THEN epoch END AS ie FROM w),
l AS (SELECT *, max(ie) OVER (PARTITION BY run ORDER BY epoch
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM i),
s AS (SELECT run, min(epoch) AS stop_epoch FROM l WHERE epoch - last_imp >= {PATIENCE} GROUP BY run),
k AS (SELECT l.*, s.stop_epoch FROM l LEFT JOIN s USING (run)
      WHERE s.stop_epoch IS NULL OR l.epoch < s.stop_epoch)
SELECT run, arg_min(epoch, (valid_loss, epoch)) AS best_epoch, {R('min(valid_loss)')} AS best_loss,
       any_value(stop_epoch) AS stop_epoch, CAST(count(*) AS BIGINT) AS epochs_recorded
FROM k GROUP BY run""")
def early_stop(spark, sf_dir):
    r = J.early_stop(events_history(spark, sf_dir), PATIENCE)
    return r.select("run", "best_epoch", rnd("best_loss").alias("best_loss"), "stop_epoch", "epochs_recorded")


def _train_valid(spark, sf_dir):
    sp = D.stratified_split(S.embedding_matrix(spark, sf_dir), 0.2, seed=1)
    return sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "valid")


@query("fit_network")
def fit_network(spark, sf_dir):
    tr, va = _train_valid(spark, sf_dir)
    net = J.choose_network("vanilla", [64, 16, 8])
    _, hist = J.fit_network(tr, va, net, epochs=3, batch_size=256, lr=0.01, seed=2, run="vanilla")
    return hist.select("run", "epoch", rnd("train_loss").alias("train_loss"),
                       rnd("valid_loss").alias("valid_loss"))


@query("fit_variational")
def fit_variational(spark, sf_dir):
    tr, va = _train_valid(spark, sf_dir)
    _, hist = J.fit_network(tr, va, J.choose_network("variational", [64, 16, 8]), epochs=2, batch_size=512, seed=2,
                            w_cls=0.3, run="variational")
    return hist.select("run", "epoch", *[rnd(c).alias(c) for c in ("train_loss", "valid_loss", "valid_recon",
                                                                  "valid_latent")])


def _trial_auc(spark, sf_dir, p: dict) -> float:
    tr, va = _train_valid(spark, sf_dir)
    net = J.choose_network("plain", [64, 16, 8])
    best, _ = J.fit_network(tr, va, net, epochs=2, batch_size=int(p["batch_size"]), lr=float(p["lr"]),
                            seed=3, patience=J.PATIENCE_OTHER)
    from hepark.operators.scoring import score_network
    s = score_network(va, best).select("y", F.col("prob").alias("score"))
    return H.auc(s, []).first()["auc"]


@query("grid_best")
def grid_best(spark, sf_dir):
    trials = [{"lr": lr, "batch_size": b} for lr in (0.01, 0.001) for b in (128, 256)]
    res = J.grid_search(trials, lambda p: _trial_auc(spark, sf_dir, p), parallelism=len(trials))
    df = spark.createDataFrame(res, "trial int, params string, metric double")
    return J.best_trial(df, "metric", higher=True).select("trial", "params", rnd("metric").alias("auc"))


@query("random_search")
def random_search(spark, sf_dir):
    t = J.random_trials(spark, 3, seed=9).collect()  # the trial table: #trials rows
    res = J.grid_search([{"lr": r["lr"], "batch_size": r["batch_size"]} for r in t],
                        lambda p: _trial_auc(spark, sf_dir, p), parallelism=len(t))
    df = spark.createDataFrame(res, "trial int, params string, metric double")
    return J.best_trial(df, "metric", higher=True).select("trial", "params", rnd("metric").alias("auc"))


@query("fit_margin")
def fit_margin(spark, sf_dir):
    tr, va = _train_valid(spark, sf_dir)
    model = J.fit_margin(tr, C=1.0, max_iter=50)
    s = J.margin_scores(model, va)
    return H.auc(s, []).select(rnd("auc").alias("auc"))
