"""Registered scoring, kernel and loss queries.

The networks use formula-generated weights (see
:func:`hepark.operators.scoring.formula_weight`) so DuckDB can rebuild the
same model from ``range()`` tables and run the forward pass as joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hepark.functions.exprs import rnd, sql_rnd
from hepark.operators import fitting as J
from hepark.operators import hist as G
from hepark.operators import joins as C
from hepark.operators import losses as I
from hepark.operators import sampling as D
from hepark.operators import scoring as Fs
from hepark.operators.roc import auc
from hepark.plans import standins as S
from hepark.plans.q_hist import _hist_out, _sql_hist
from hepark.plans.q_sampling import SQL_FOLDS, SQL_SPLIT
from hepark.plans.registry import query
from hepark.session import cut_lineage

R = sql_rnd

# fixed values of the registered model: 64 -> 16 -> 8 autoencoder, head 8 -> 4 -> 1
SIZES = [64, 16, 8]
HEAD = [4, 1]


def net():
    return Fs.autoencoder(SIZES, HEAD)


def scored(spark, sf_dir):
    return Fs.score_network(S.embedding_matrix(spark, sf_dir), net())


# ------------------------------------------------------------------ SQL forward pass

SQL_ACT = {
    "relu": "greatest({z}, 0.0::DOUBLE)",
    "elu": "CASE WHEN {z} > 0 THEN {z} ELSE exp({z}) - 1.0::DOUBLE END",
    "leaky_relu": "CASE WHEN {z} >= 0 THEN {z} ELSE 0.2::DOUBLE * {z} END",
    "tanh": "tanh({z})",
    "sigmoid": "1.0::DOUBLE / (1.0::DOUBLE + exp(-({z})))",
    "linear": "{z}",
}


def _sql_layer(src: str, part: str, li: int, a: int, b: int, act: str) -> str:
    pid = Fs.PART_IDS[part]
    w = (f"SELECT r, c, 0.3::DOUBLE * sin(1.0::DOUBLE + {131.0 * pid}::DOUBLE + {37.0 * li}::DOUBLE"
         f" + 7.0::DOUBLE * r + 3.0::DOUBLE * c) AS w FROM range(0, {a}) t1(r), range(0, {b}) t2(c)")
    bb = (f"SELECT c, 0.1::DOUBLE * cos(1.0::DOUBLE + {131.0 * pid}::DOUBLE + {37.0 * li}::DOUBLE"
          f" + 3.0::DOUBLE * c) AS b FROM range(0, {b}) t2(c)")
    z = "(sum(h.v * w.w) + any_value(bb.b))"
    return (f"SELECT h.k, CAST(w.c AS INTEGER) AS i, {SQL_ACT[act].format(z=z)} AS v "
            f"FROM ({src}) h JOIN ({w}) w ON h.i = w.r JOIN ({bb}) bb ON bb.c = w.c GROUP BY h.k, w.c")


def _sql_part(src: str, part: str, sizes, acts) -> str:
    cur = src
    for li, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])):
        cur = _sql_layer(cur, part, li, a, b, acts[li])
    return cur


X_LONG = ("SELECT vec_id AS k, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, "
          "CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
N = len(SIZES) - 1
LATENT = _sql_part(X_LONG, "encoder", SIZES, ["relu"] * (N - 1) + ["tanh"])
RECON = _sql_part(f"SELECT * FROM latent", "decoder", list(reversed(SIZES)), ["elu"] * (N - 1) + ["tanh"])
HS = [SIZES[-1]] + HEAD
PROB = _sql_part("SELECT * FROM latent", "head", HS, ["relu"] * (len(HS) - 2) + ["sigmoid"])
NET_CTES = f"""latent AS ({LATENT}),
recon AS ({RECON}),
prob AS ({PROB}),
ys AS (SELECT vec_id AS k, CAST(label % 2 AS INTEGER) AS y FROM embeddings)"""


# ------------------------------------------------------------------ F1

SQL_OUTPUTS = f"""SELECT k, 'latent' AS kind, i AS j, {R('v')} AS value FROM latent
UNION ALL SELECT k, 'recon', i, {R('v')} FROM recon
UNION ALL SELECT k, 'prob', i, {R('v')} FROM prob"""


def _outputs(s):
    """One pass over the scored rows: all three outputs exploded together."""
    def tag(kind, arr):
        return F.transform(arr, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("j"), v.alias("value")))
    allv = F.concat(tag("latent", F.col("latent")), tag("recon", F.col("recon")),
                    F.array(F.struct(F.lit("prob").alias("kind"), F.lit(0).alias("j"), F.col("prob").alias("value"))))
    e = s.select("k", F.explode(allv).alias("_e"))
    return e.select("k", "_e.kind", F.col("_e.j").cast("int").alias("j"), rnd("_e.value").alias("value"))


@query("network_scores", f"WITH {NET_CTES} {SQL_OUTPUTS}")
def network_scores(spark, sf_dir):
    return _outputs(scored(spark, sf_dir))


# linear latent, tanh reconstruction, leaky head
SINK_LATENT = _sql_part(X_LONG, "encoder", SIZES, ["relu"] * (N - 1) + ["linear"])
SINK_PROB = _sql_part("SELECT * FROM latent", "head", HS, ["leaky_relu"] * (len(HS) - 2) + ["sigmoid"])


@query("network_scores_sinkclass",
       f"WITH latent AS ({SINK_LATENT}), recon AS ({RECON}), prob AS ({SINK_PROB}) {SQL_OUTPUTS}")
def network_scores_sinkclass(spark, sf_dir):
    sink = J.choose_network("sinkclass", SIZES, head=HEAD)
    return _outputs(Fs.score_network(S.embedding_matrix(spark, sf_dir), sink))


# ------------------------------------------------------------------ I1-I4, I7

SQL_ROW_ERR = f"""SELECT x.k, sum((x.v - r.v) * (x.v - r.v)) / 64.0::DOUBLE AS err
FROM ({X_LONG}) x JOIN recon r ON x.k = r.k AND x.i = r.i GROUP BY x.k"""


@query("recon_mse", f"""WITH {NET_CTES}, e AS ({SQL_ROW_ERR})
SELECT y, {R('avg(err)')} AS mse FROM e JOIN ys USING (k) GROUP BY y""")
def recon_mse(spark, sf_dir):
    m = I.mse(scored(spark, sf_dir), "x", "recon", ["y"])
    return m.select("y", rnd("mse").alias("mse"))


SQL_BCE_ROW = ("-(CAST(y AS DOUBLE) * greatest(ln(p.v), -100.0::DOUBLE) + "
               "(1.0::DOUBLE - y) * greatest(ln(1.0::DOUBLE - p.v), -100.0::DOUBLE))")


@query("bce", f"""WITH {NET_CTES}
SELECT {R(f'avg({SQL_BCE_ROW})')} AS bce FROM prob p JOIN ys USING (k)""")
def bce_q(spark, sf_dir):
    return I.bce(scored(spark, sf_dir), "y", "prob").select(rnd("bce").alias("bce"))


EPS = "1.1920928955078125e-07::DOUBLE"


@query("bce_shifted", f"""WITH {NET_CTES},
s AS (SELECT k, least(greatest((v + 1.0::DOUBLE) / 2.0::DOUBLE, {EPS}), 1.0::DOUBLE - {EPS}) AS p
      FROM latent WHERE i = 0)
SELECT {R(f'-avg(y * ln(p + {EPS}) + (1.0::DOUBLE - y) * ln(1.0::DOUBLE - p + {EPS}))')} AS bce_shifted
FROM s JOIN ys USING (k)""")
def bce_shifted_q(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("score", F.element_at("latent", 1))
    return I.bce_shifted(s, "y", "score").select(rnd("bce_shifted").alias("bce_shifted"))


@query("combined_loss", f"""WITH {NET_CTES}, e AS ({SQL_ROW_ERR}),
b AS (SELECT avg({SQL_BCE_ROW}) AS bce FROM prob p JOIN ys USING (k))
SELECT {R('0.5::DOUBLE * avg(e.err) + 0.5::DOUBLE * any_value(b.bce)')} AS loss FROM e, b""")
def combined_loss(spark, sf_dir):
    s = scored(spark, sf_dir)
    m = s.agg(F.avg(I.row_sq_err("x", "recon")).alias("mse"), F.avg(I.bce_row("y", "prob")).alias("bce"))
    return m.select(rnd(I.combine_losses("classifier", F.col("mse"), F.col("bce"), w=0.5)).alias("loss"))


@query("loss_by_batch", f"""WITH {NET_CTES}, e AS ({SQL_ROW_ERR}),
bt AS (SELECT k, (row_number() OVER (ORDER BY k) - 1) // 64 AS batch_id FROM e)
SELECT {R('avg(m)')} AS loss, CAST(count(*) AS BIGINT) AS n_batches FROM
 (SELECT batch_id, avg(err) AS m FROM e JOIN bt USING (k) GROUP BY batch_id)""")
def loss_by_batch(spark, sf_dir):
    s = D.batchify(scored(spark, sf_dir), 64, "fixed")
    r = I.loss_by(s, I.row_sq_err("x", "recon"), "batch_id")
    return r.select(rnd("loss").alias("loss"), "n_batches")


# ------------------------------------------------------------------ C4, G3

SQL_PAIRS = f"""SELECT x.k, ys.y, x.i AS feature, x.v AS input, r.v AS recon
FROM ({X_LONG}) x JOIN recon r ON x.k = r.k AND x.i = r.i JOIN ys ON ys.k = x.k"""


def _pairs(spark, sf_dir):
    s = scored(spark, sf_dir)
    return C.pair_reco(s.select("k", "y", "x"), s.select("k", "recon"))


def _pairs_materialized(spark, sf_dir):
    # the histogram reads the pairs twice (range, counts): score the network once
    return cut_lineage(_pairs(spark, sf_dir))


@query("pair_reco", f"""WITH {NET_CTES}
SELECT k, y, feature, {R('input')} AS input, {R('recon')} AS recon FROM ({SQL_PAIRS})""")
def pair_reco(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("k", "y", "feature", rnd("input").alias("input"), rnd("recon").alias("recon"))


def _sql_hist_reco() -> str:
    # the histogram template reads (by..., value) rows; both kinds use the input range
    body = _sql_hist("SELECT * FROM hs", 60, ["feature", "y", "kind"], ["feature", "y"])
    body = body.replace("r0 AS (SELECT feature, y, min(value) AS lo0, max(value) AS hi0 FROM s GROUP BY feature, y)",
                        "r0 AS (SELECT feature, y, min(value) AS lo0, max(value) AS hi0 FROM s "
                        "WHERE kind = 'input' GROUP BY feature, y)")
    return f"""WITH {NET_CTES}, pr AS ({SQL_PAIRS}),
hs AS (SELECT feature, y, 'input' AS kind, input AS value FROM pr
       UNION ALL SELECT feature, y, 'recon' AS kind, recon AS value FROM pr)
SELECT * FROM ({body.replace('WITH s AS', 'WITH s AS', 1)})"""


@query("hist_reco", _sql_hist_reco())
def hist_reco(spark, sf_dir):
    h = G.hist_pair(_pairs_materialized(spark, sf_dir), 60)
    return _hist_out(h, ["feature", "y", "kind"])


# ------------------------------------------------------------------ F5, F6

@query("fold_scores", f"""WITH {NET_CTES}, f AS ({SQL_FOLDS})
SELECT 'ae' AS model, f.fold, f.k, f.y, {R('p.v')} AS score FROM f JOIN prob p USING (k)""")
def fold_scores(spark, sf_dir):
    folds = D.kfold(S.embedding_matrix(spark, sf_dir), k=5, seed=7)
    n = net()
    n["name"] = "ae"
    s = Fs.score_folds(folds, n)
    return s.select("model", "fold", "k", "y", rnd("score").alias("score"))


@query("encode_split", f"""WITH {NET_CTES}, sp AS ({SQL_SPLIT})
SELECT k, i AS j, {R('v')} AS value FROM latent JOIN sp USING (k) WHERE split = 'train'""")
def encode_split_q(spark, sf_dir):
    m = D.stratified_split(S.embedding_matrix(spark, sf_dir), 0.1, seed=7)
    e = Fs.encode_split(m, net(), "train")
    return e.select("k", F.posexplode("x").alias("j", "value")).select(
        "k", F.col("j").cast("int"), rnd("value").alias("value"))


# ------------------------------------------------------------------ C3, F3, F4, F7

SQL_CENTROIDS = """SELECT label AS ref, list(m ORDER BY i) AS c FROM (
  SELECT label, i, avg(v) AS m FROM (
    SELECT label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v
    FROM embeddings) GROUP BY label, i) GROUP BY label"""
SQL_X = "SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"


def _cent(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("x"))
    return Fs.centroids(e, "label").withColumnRenamed("label", "ref")


def _gram_q(kernel: str, sql_k: str):
    @query(f"gram_{kernel}", f"""WITH c AS ({SQL_CENTROIDS}), x AS ({SQL_X})
SELECT x.k, CAST(c.ref AS BIGINT) AS ref, {R(sql_k)} AS kval FROM x, c""")
    def fn(spark, sf_dir):
        g = Fs.gram(S.embedding_matrix(spark, sf_dir), _cent(spark, sf_dir), kernel, gamma=0.5)
        return g.select("k", F.col("ref").cast("long"), rnd("kval").alias("kval"))
    return fn


_gram_q("linear", "list_dot_product(x.x, c.c)")
_gram_q("rbf", "exp(-0.5::DOUBLE * list_sum(list_transform(list_zip(x.x, c.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))")
_gram_q("poly", "pow(0.5::DOUBLE * list_dot_product(x.x, c.c), 3)")
_gram_q("overlap", """pow(list_dot_product(x.x, list_transform(c.c, lambda v: v / sqrt(list_sum(list_transform(c.c, lambda u: u * u)))))
    / sqrt(list_sum(list_transform(x.x, lambda u: u * u))), 2)""")


def _sv(spark, sf_dir):
    c = _cent(spark, sf_dir)
    return c.select("ref", "x", (F.col("ref") % 2).cast("int").alias("y"),
                    F.when(F.col("ref") % 2 == 1, F.lit(0.1)).otherwise(F.lit(-0.1)).alias("alpha"))


@query("kernel_scores", f"""WITH c AS ({SQL_CENTROIDS}), x AS ({SQL_X})
SELECT x.k, {R('''sum(CASE WHEN c.ref % 2 = 1 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END *
    exp(-0.5::DOUBLE * list_sum(list_transform(list_zip(x.x, c.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))) + 0.0::DOUBLE''')} AS score
FROM x, c GROUP BY x.k""")
def kernel_scores(spark, sf_dir):
    s = Fs.kernel_scores(S.embedding_matrix(spark, sf_dir), _sv(spark, sf_dir), "rbf", b=0.0, gamma=0.5)
    return s.select("k", rnd("score").alias("score"))


@query("kernel_auc", f"""WITH c AS ({SQL_CENTROIDS}), x AS ({SQL_X}),
s AS (SELECT x.k, sum(CASE WHEN c.ref % 2 = 1 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END *
    exp(-0.5::DOUBLE * list_sum(list_transform(list_zip(x.x, c.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))) + 0.0::DOUBLE AS score
      FROM x, c GROUP BY x.k),
sy AS (SELECT round(score, 12) AS score, CAST(label % 2 AS INTEGER) AS y FROM s JOIN embeddings ON vec_id = k),
cnt AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM sy GROUP BY score),
w AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM cnt)
SELECT {R('sum(pos * (coalesce(nb, 0) + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))')} AS auc FROM w""")
def kernel_auc(spark, sf_dir):
    m = S.embedding_matrix(spark, sf_dir)
    s = Fs.kernel_scores(m, _sv(spark, sf_dir), "rbf", b=0.0, gamma=0.5)
    s = s.join(m.select("k", "y"), "k").withColumn("score", F.round("score", 12))
    return auc(s, []).select(rnd("auc").alias("auc"))


@query("support_counts", """SELECT CAST(label % 2 AS INTEGER) AS y, CAST(count(DISTINCT label) AS BIGINT) AS n_support
FROM embeddings GROUP BY label % 2""")
def support_counts(spark, sf_dir):
    return Fs.support_counts(_sv(spark, sf_dir), "y")


# ------------------------------------------------------------------ F2, I5, I6

def _sql_noise(seed: int, dim: int) -> str:
    """Box-Muller normals from md5(k|seed|i), as scoring.normal_noise."""
    h = f"md5(concat(CAST(k AS VARCHAR), '|', '{seed}', '|', CAST(i AS VARCHAR)))"
    u1 = f"((('0x' || substr({h}, 1, 13))::UBIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    u2 = f"((('0x' || substr({h}, 14, 13))::UBIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    return (f"SELECT k, CAST(i AS INTEGER) AS i, sqrt(-2.0::DOUBLE * ln({u1})) * cos({2.0 * 3.141592653589793!r}::DOUBLE * {u2}) AS e "
            f"FROM (SELECT vec_id AS k FROM embeddings), range(0, {dim}) t(i)")


VAR_SIZES = [64, 32, 8]
VAR_PRE = _sql_part(X_LONG, "encoder", VAR_SIZES[:-1], ["elu"] * (len(VAR_SIZES) - 2))
VAR_MU = _sql_layer("SELECT * FROM pre", "mu", 0, VAR_SIZES[-2], VAR_SIZES[-1], "linear")
VAR_LV = _sql_layer("SELECT * FROM pre", "logvar", 0, VAR_SIZES[-2], VAR_SIZES[-1], "linear")


@query("variational_scores", f"""WITH pre AS ({VAR_PRE}), mu AS ({VAR_MU}), lv AS ({VAR_LV}),
eps AS ({_sql_noise(11, VAR_SIZES[-1])}),
ys AS (SELECT vec_id AS k, CAST(label % 2 AS INTEGER) AS y FROM embeddings)
SELECT mu.k, ys.y, mu.i AS j, {R('mu.v + eps.e * lv.v')} AS value
FROM mu JOIN lv ON mu.k = lv.k AND mu.i = lv.i JOIN eps ON eps.k = mu.k AND eps.i = mu.i JOIN ys ON ys.k = mu.k""")
def variational_scores(spark, sf_dir):
    m = S.embedding_matrix(spark, sf_dir)
    v = Fs.score_variational(m, Fs.variational(VAR_SIZES), seed=11, scale="logvar")
    return v.select("k", "y", F.posexplode("latent").alias("j", "value")).select(
        "k", "y", F.col("j").cast("int"), rnd("value").alias("value"))


@query("latent_kl", f"""WITH {NET_CTES}, eps AS ({_sql_noise(5, SIZES[-1])}),
z AS (SELECT latent.k, latent.i, latent.v AS z, eps.e FROM latent JOIN eps ON latent.k = eps.k AND latent.i = eps.i),
n AS (SELECT k, ln(sum(exp(z))) AS lz, ln(sum(exp(e))) AS le FROM z GROUP BY k)
SELECT {R('sum(exp(e - le) * ((e - le) - (z - lz))) / count(DISTINCT z.k)')} AS latent_kl
FROM z JOIN n USING (k)""")
def latent_kl(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("samples", Fs.normal_noise("k", 5, SIZES[-1]))
    return I.latent_kl(s).select(rnd("latent_kl").alias("latent_kl"))


W_PROBS = [float(v) for v in np.linspace(0.05, 0.95, 19)]


@query("wasserstein", f"""WITH {NET_CTES},
l AS (SELECT latent.k, ys.y, latent.i AS dim, latent.v FROM latent JOIN ys USING (k)),
q AS (SELECT y, dim, unnest(quantile_cont(v, [{', '.join(repr(p) + '::DOUBLE' for p in W_PROBS)}])) AS q,
             unnest(range(0, {len(W_PROBS)})) AS p_idx FROM l GROUP BY y, dim)
SELECT CAST(a.dim AS INTEGER) AS dim, {R('avg(abs(a.q - b.q))')} AS w1
FROM q a JOIN q b ON a.dim = b.dim AND a.p_idx = b.p_idx AND a.y = 1 AND b.y = 0 GROUP BY a.dim""")
def wasserstein(spark, sf_dir):
    s = cut_lineage(scored(spark, sf_dir))  # both classes read the scores: score once
    w = I.wasserstein(s.filter(F.col("y") == 1), s.filter(F.col("y") == 0), W_PROBS, x="latent")
    return w.select(F.col("dim").cast("int"), rnd("w1").alias("w1"))


@query("loss_by_split", f"""WITH {NET_CTES}, e AS ({SQL_ROW_ERR}), sp AS ({SQL_SPLIT})
SELECT split, {R('avg(err)')} AS loss, CAST(count(*) AS BIGINT) AS n_rows FROM e JOIN sp USING (k) GROUP BY split""")
def loss_by_split(spark, sf_dir):
    s = D.stratified_split(scored(spark, sf_dir), 0.1, seed=7)
    r = s.groupBy("split").agg(F.avg(I.row_sq_err("x", "recon")).alias("loss"),
                               F.count(F.lit(1)).cast("long").alias("n_rows"))
    return r.select("split", rnd("loss").alias("loss"), "n_rows")


N_PROJ = 6


def _sql_dirs() -> str:
    """The same seeded unit directions as losses.seeded_directions."""
    h = "md5(concat(CAST(proj + 1000003 * 13 AS VARCHAR), '|', '13', '|', CAST(i AS VARCHAR)))"
    u1 = f"((('0x' || substr({h}, 1, 13))::UBIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    u2 = f"((('0x' || substr({h}, 14, 13))::UBIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    g = f"sqrt(-2.0::DOUBLE * ln({u1})) * cos({2.0 * 3.141592653589793!r}::DOUBLE * {u2})"
    return f"""SELECT proj, i, g / sqrt(sum(g * g) OVER (PARTITION BY proj)) AS d FROM (
      SELECT proj, i, {g} AS g FROM range(0, {N_PROJ}) t1(proj), range(0, 64) t2(i))"""


@query("wasserstein_sliced", f"""
WITH dirs AS ({_sql_dirs()}),
x AS (SELECT vec_id AS k, CAST(label % 2 AS INTEGER) AS y, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i,
             CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
p AS (SELECT x.k, x.y, dirs.proj, sum(x.v * dirs.d) AS v FROM x JOIN dirs ON x.i = dirs.i GROUP BY x.k, x.y, dirs.proj),
q AS (SELECT y, proj, unnest(quantile_cont(v, [{', '.join(repr(p) + '::DOUBLE' for p in W_PROBS)}])) AS q,
             unnest(range(0, {len(W_PROBS)})) AS p_idx FROM p GROUP BY y, proj)
SELECT CAST(a.proj AS INTEGER) AS dim, {R('avg(abs(a.q - b.q))')} AS w1
FROM q a JOIN q b ON a.proj = b.proj AND a.p_idx = b.p_idx AND a.y = 1 AND b.y = 0 GROUP BY a.proj""")
def wasserstein_sliced(spark, sf_dir):
    m = S.embedding_matrix(spark, sf_dir)
    dirs = I.seeded_directions(spark, N_PROJ, 64, seed=13)
    w = I.wasserstein(m.filter(F.col("y") == 1), m.filter(F.col("y") == 0), W_PROBS, projections=dirs)
    return w.select(F.col("dim").cast("int"), rnd("w1").alias("w1"))


# I4, variational form: (1 - w) * reconstruction MSE + w * latent KL
VAR_N = len(VAR_SIZES) - 1
VAR_DEC = _sql_part("SELECT k, i, v FROM zs", "decoder", list(reversed(VAR_SIZES)),
                    ["elu"] * (VAR_N - 1) + ["tanh"])


@query("combined_loss_variational", f"""WITH pre AS ({VAR_PRE}), mu AS ({VAR_MU}), lv AS ({VAR_LV}),
eps AS ({_sql_noise(11, VAR_SIZES[-1])}),
zs AS (SELECT mu.k, mu.i, mu.v + eps.e * lv.v AS v
       FROM mu JOIN lv ON mu.k = lv.k AND mu.i = lv.i JOIN eps ON eps.k = mu.k AND eps.i = mu.i),
rec AS ({VAR_DEC}),
err AS (SELECT x.k, sum((x.v - r.v) * (x.v - r.v)) / 64.0::DOUBLE AS err
        FROM ({X_LONG}) x JOIN rec r ON x.k = r.k AND x.i = r.i GROUP BY x.k),
smp AS ({_sql_noise(5, VAR_SIZES[-1])}),
z AS (SELECT zs.k, zs.i, zs.v AS z, smp.e FROM zs JOIN smp ON zs.k = smp.k AND zs.i = smp.i),
n AS (SELECT k, ln(sum(exp(z))) AS lz, ln(sum(exp(e))) AS le FROM z GROUP BY k),
kl AS (SELECT sum(exp(e - le) * ((e - le) - (z - lz))) / count(DISTINCT z.k) AS kl FROM z JOIN n USING (k))
SELECT {R('0.7::DOUBLE * (SELECT avg(err) FROM err) + 0.3::DOUBLE * (SELECT kl FROM kl)')} AS loss""")
def combined_loss_variational(spark, sf_dir):
    m = S.embedding_matrix(spark, sf_dir)
    v = Fs.score_variational(m, Fs.variational(VAR_SIZES), seed=11, scale="logvar")
    v = v.withColumn("samples", Fs.normal_noise("k", 5, VAR_SIZES[-1]))
    # both losses from one aggregate
    r = v.agg(F.avg(I.row_sq_err("x", "recon")).alias("mse"),
              (F.sum(I.latent_kl_row("latent", "samples")) / F.count(F.lit(1)).cast("double")).alias("latent_kl"))
    return r.select(rnd(I.combine_losses("variational", F.col("mse"), latent=F.col("latent_kl"), w=0.3))
                    .alias("loss"))


def _sql_w1_ctes(long: str) -> str:
    """Area between the two classes' cumulative distributions of (dim, y, v)."""
    return f"""
c AS (SELECT dim, v, sum((y = 1)::BIGINT) AS a, sum((y = 0)::BIGINT) AS b FROM {long} GROUP BY dim, v),
w AS (SELECT dim, v - lag(v) OVER o AS gap, (sum(a) OVER o - a) / sum(a) OVER (PARTITION BY dim) AS fa,
             (sum(b) OVER o - b) / sum(b) OVER (PARTITION BY dim) AS fb
      FROM c WINDOW o AS (PARTITION BY dim ORDER BY v)),
d AS (SELECT CAST(dim AS INTEGER) AS dim, sum(coalesce(gap, 0.0::DOUBLE) * abs(fa - fb)) AS w1 FROM w GROUP BY dim)"""


def _sql_w1(long: str) -> str:
    return f"""{_sql_w1_ctes(long)}
SELECT dim, {R('w1')} AS w1 FROM d UNION ALL SELECT -1, {R('avg(w1)')} FROM d"""


def _w1_out(w):
    return w.select(F.coalesce("dim", F.lit(-1)).alias("dim"), rnd("w1").alias("w1"))


@query("wasserstein_exact", f"""WITH {NET_CTES},
l AS (SELECT latent.i AS dim, ys.y, latent.v FROM latent JOIN ys USING (k)), {_sql_w1('l')}""")
def wasserstein_exact(spark, sf_dir):
    s = cut_lineage(scored(spark, sf_dir))              # both classes read the scores: score once
    return _w1_out(I.wasserstein_exact(s.filter(F.col("y") == 1), s.filter(F.col("y") == 0), x="latent"))


@query("wasserstein_exact_features", f"""
WITH l AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(label % 2 AS INTEGER) AS y,
                  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), {_sql_w1('l')}""")
def wasserstein_exact_features(spark, sf_dir):
    m = S.embedding_matrix(spark, sf_dir)
    return _w1_out(I.wasserstein_exact(m.filter(F.col("y") == 1), m.filter(F.col("y") == 0)))


# ------------------------------------------------------------------ I4 with a transport loss (exact distance)

def _sql_transport(loss: str) -> str:
    """A loss of the reconstruction error ``m``, the latent vectors' mean distance to seeded normals ``t`` and
    the head's cross entropy ``c``."""
    return f"""WITH {NET_CTES}, e AS ({SQL_ROW_ERR}), eps AS ({_sql_noise(5, SIZES[-1])}),
l AS (SELECT i AS dim, 1 AS y, v FROM latent UNION ALL SELECT i, 0, e FROM eps), {_sql_w1_ctes('l')},
p AS (SELECT (SELECT avg(err) FROM e) AS m, (SELECT avg(w1) FROM d) AS t,
             (SELECT avg({SQL_BCE_ROW}) FROM prob p JOIN ys USING (k)) AS c)
SELECT {R(loss)} AS loss FROM p"""


def _transport_loss(spark, sf_dir, kind, **weights):
    s = cut_lineage(scored(spark, sf_dir).withColumn("samples", Fs.normal_noise("k", 5, SIZES[-1])))
    w1 = I.wasserstein_exact(s.select("latent"), s.select(F.col("samples").alias("latent")), x="latent")
    m = s.agg(F.avg(I.row_sq_err("x", "recon")).alias("m"), F.avg(I.bce_row("y", "prob")).alias("c"))
    t = w1.where("dim is null").select(F.col("w1").alias("t")).first()["t"]     # one number
    return m.select(rnd(I.combine_losses(kind, F.col("m"), F.col("c"), F.lit(t), **weights)).alias("loss"))


@query("combined_loss_sinkhorn", _sql_transport("0.75::DOUBLE * m + 0.25::DOUBLE * t"))
def combined_loss_sinkhorn(spark, sf_dir):
    return _transport_loss(spark, sf_dir, "sinkhorn", w=0.25)


@query("combined_loss_sinkclass", _sql_transport("m + 0.4::DOUBLE * t + 0.6::DOUBLE * c"))
def combined_loss_sinkclass(spark, sf_dir):
    return _transport_loss(spark, sf_dir, "sinkclass", a=0.4, b=0.6)


# ------------------------------------------------------------------ F2 parts, J6, J7

@query("variational_parts", f"""WITH pre AS ({VAR_PRE}), mu AS ({VAR_MU}), lv AS ({VAR_LV}),
eps AS ({_sql_noise(11, VAR_SIZES[-1])})
SELECT mu.k, mu.i AS j, {R('mu.v')} AS mu, {R('lv.v')} AS logvar, {R('mu.v + eps.e * exp(0.5::DOUBLE * lv.v)')} AS latent
FROM mu JOIN lv ON mu.k = lv.k AND mu.i = lv.i JOIN eps ON eps.k = mu.k AND eps.i = mu.i""")
def variational_parts(spark, sf_dir):
    v = Fs.score_variational(S.embedding_matrix(spark, sf_dir), Fs.variational(VAR_SIZES), seed=11, scale="std")
    z = v.select("k", F.posexplode(F.arrays_zip("mu", "logvar", "latent")).alias("j", "z"))
    return z.select("k", F.col("j").cast("int"), *[rnd(F.col(f"z.{c}")).alias(c) for c in ("mu", "logvar", "latent")])


@query("valid_losses", f"""WITH {NET_CTES}, e AS ({SQL_ROW_ERR}),
pre AS ({VAR_PRE}), mu AS ({VAR_MU}), lv AS ({VAR_LV}), eps AS ({_sql_noise(11, VAR_SIZES[-1])}),
zs AS (SELECT mu.k, mu.i, mu.v + eps.e * lv.v AS v
       FROM mu JOIN lv ON mu.k = lv.k AND mu.i = lv.i JOIN eps ON eps.k = mu.k AND eps.i = mu.i),
rec AS ({VAR_DEC}),
err AS (SELECT x.k, sum((x.v - r.v) * (x.v - r.v)) / 64.0::DOUBLE AS err
        FROM ({X_LONG}) x JOIN rec r ON x.k = r.k AND x.i = r.i GROUP BY x.k),
smp AS ({_sql_noise(5, VAR_SIZES[-1])}),
z AS (SELECT zs.k, zs.i, zs.v AS z, smp.e FROM zs JOIN smp ON zs.k = smp.k AND zs.i = smp.i),
n AS (SELECT k, ln(sum(exp(z))) AS lz, ln(sum(exp(e))) AS le FROM z GROUP BY k),
p AS (SELECT (SELECT avg(err) FROM e) AS m, (SELECT avg({SQL_BCE_ROW}) FROM prob p JOIN ys USING (k)) AS c,
             (SELECT avg(err) FROM err) AS vm,
             (SELECT sum(exp(e - le) * ((e - le) - (z - lz))) / count(DISTINCT z.k) FROM z JOIN n USING (k)) AS vl)
SELECT 'vanilla' AS network, {R('m')} AS valid_loss, {R('m')} AS recon, CAST(NULL AS DOUBLE) AS class,
       CAST(NULL AS DOUBLE) AS latent FROM p
UNION ALL SELECT 'classifier', {R('0.7::DOUBLE * m + 0.3::DOUBLE * c')}, {R('m')}, {R('c')}, NULL FROM p
UNION ALL SELECT 'variational', {R('0.7::DOUBLE * vm + 0.3::DOUBLE * vl')}, {R('vm')}, NULL, {R('vl')} FROM p""")
def valid_losses(spark, sf_dir):
    """The validation pass of a fit: component losses of registered networks (one row each)."""
    m = S.embedding_matrix(spark, sf_dir)
    rows = []
    for name, sizes, kw in (("vanilla", SIZES, {}), ("classifier", SIZES, {"head": HEAD}), ("variational", VAR_SIZES, {})):
        r = J.eval_losses(m, J.choose_network(name, sizes, **kw), w_cls=0.3, seeds=(11, 5))
        rows.append((name, r["total"], *[r[c] for c in J.COMPONENTS]))
    names = ["valid_loss", "recon", "class", "latent"]
    df = spark.createDataFrame(rows, "network string, " + ", ".join(f"{c} double" for c in names))
    return df.select("network", *[rnd(c).alias(c) for c in names])
