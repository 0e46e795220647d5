"""Fitting, model selection and run history.

Steps of J1 depend on each other, so their number grows with the rows and a step has to be
cheap.  Each epoch gets a seeded md5 batch assignment, written once as a table partitioned
by *segment*, and a job's task gets about ``ROWS_PER_TASK`` rows.  A batch of more rows is a
segment of its own: executors compute gradient sums with the broadcast weights
(``mapInArrow``, one packed vector per partition), a tree-shaped ``treeAggregate`` combines
them, and the driver applies the small Adam update.  Of smaller batches a segment holds
several, whose steps one task makes one after another; the next segment's task goes
on from its weights and moments.  The driver only ever holds vectors of the size of the
weights, and runs are reproducible.
"""

from __future__ import annotations

import copy
import itertools
import math
from collections.abc import Callable
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hepark.functions.exprs import order_key
from hepark.operators import scoring as Fs

# fixed values: patience of the early stopping rule (autoencoders / others)
PATIENCE_AE = 15
PATIENCE_OTHER = 20


# ------------------------------------------------------------------ J7

def networks() -> dict[str, Callable[..., dict]]:
    return {"vanilla": lambda sizes, **kw: Fs.autoencoder(sizes, **kw),
            "classifier": lambda sizes, head=(32, 16, 1), **kw: Fs.autoencoder(sizes, head=list(head), **kw),
            "variational": lambda sizes, **kw: Fs.variational(sizes, **kw),
            "sinkhorn": lambda sizes, latent_act="linear", **kw: Fs.autoencoder(sizes, latent_act=latent_act, **kw),
            "sinkclass": lambda sizes, head=(128, 64, 32, 16, 8, 1), latent_act="linear", **kw: Fs.autoencoder(
                sizes, head=list(head), head_hidden="leaky_relu", latent_act=latent_act, **kw),
            "plain": lambda sizes, **kw: Fs.plain_classifier(sizes)}


def choose_network(name: str, sizes: Sequence[int], **kw) -> dict:
    reg = networks()
    if name not in reg:
        raise TypeError(f"network {name!r} does not exist")
    net = reg[name](list(sizes), **kw)
    net["name"] = name
    return net


# ------------------------------------------------------------------ numpy backprop helpers

_DACT = {
    "relu": lambda z, a: (z > 0).astype(np.float64),
    "leaky_relu": lambda z, a: np.where(z >= 0, 1.0, 0.2),
    "elu": lambda z, a: np.where(z > 0, 1.0, a + 1.0),
    "sigmoid": lambda z, a: a * (1.0 - a),
    "tanh": lambda z, a: 1.0 - a * a,
    "linear": lambda z, a: np.ones_like(z),
}


def _fwd(layers, X):
    cache, h = [], X
    for L in layers:
        z = h @ L["w"] + L["b"]
        a = Fs.NP_ACT[L["act"]](z)
        cache.append((h, z, a))
        h = a
    return h, cache


def _bwd(layers, cache, g):
    grads = [None] * len(layers)
    for i in range(len(layers) - 1, -1, -1):
        h, z, a = cache[i]
        gz = g * _DACT[layers[i]["act"]](z, a)
        grads[i] = (h.T @ gz, gz.sum(axis=0))
        g = gz @ layers[i]["w"].T
    return grads, g


#: Component losses of a network, in the order of history columns.
COMPONENTS = ("recon", "class", "latent")


def loss_weights(net: dict, w: float) -> dict[str, float]:
    """Weight of each component the network has: 1 alone, else 1 - w for the
    reconstruction and w for the other (class or latent) loss."""
    p = net["parts"]
    other = "class" if "head" in p else "latent" if "mu" in p else None
    if "decoder" not in p:
        return {"class": 1.0}
    return {"recon": 1.0 - w, other: w} if other else {"recon": 1.0}


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _encode(p: dict, X: np.ndarray, noise):
    """(latent, what its backward pass needs)."""
    h, c_enc = _fwd(p["encoder"], X)
    if "mu" not in p:
        return h, (c_enc,)
    mu, c_mu = _fwd(p["mu"], h)
    lv, c_lv = _fwd(p["logvar"], h)
    return mu + noise[0] * lv, (c_enc, c_mu, c_lv)


def _class_loss(q: np.ndarray, y: np.ndarray) -> float:
    lq = np.maximum(np.log(np.clip(q, 1e-300, None)), -100.0)
    l1q = np.maximum(np.log(np.clip(1.0 - q, 1e-300, None)), -100.0)
    return float(-(y * lq + (1 - y) * l1q).sum())


def _latent_loss(z: np.ndarray, samples: np.ndarray) -> float:
    p = _softmax(samples)
    return float((p * (np.log(p) - np.log(np.clip(_softmax(z), 1e-300, None)))).sum())


def loss_parts(net: dict, X: np.ndarray, y: np.ndarray, noise=None) -> dict[str, float]:
    """Summed, unweighted component losses of one block of rows, forward pass only:
    ``recon`` (mean squared error of a row), ``class`` (BCE of the head), ``latent``
    (KL of softmax(samples) against softmax(latent)).  ``noise`` is (eps, samples), both
    rows x latent size, for networks that sample their latent vector."""
    p = net["parts"]
    z, _ = _encode(p, X, noise)
    out = {}
    if "decoder" in p:
        d = Fs.forward_np(p["decoder"], z) - X
        out["recon"] = float((d * d).mean(axis=1).sum())
    if "head" in p:
        out["class"] = _class_loss(Fs.forward_np(p["head"], z)[:, 0], y)
    if "mu" in p:
        out["latent"] = _latent_loss(z, noise[1])
    return out


def batch_loss(net: dict, X: np.ndarray, y: np.ndarray, w_cls: float = 0.5, noise=None) -> float:
    """Summed weighted loss of one block of rows."""
    weights = loss_weights(net, w_cls)
    return sum(weights[c] * v for c, v in loss_parts(net, X, y, noise).items())


def loss_and_grads(net: dict, X: np.ndarray, y: np.ndarray, w_cls: float = 0.5, noise=None):
    """Summed (not averaged) weighted loss and gradients of one block of rows; the
    components and their weights are those of :func:`loss_parts` and :func:`loss_weights`."""
    p, weights = net["parts"], loss_weights(net, w_cls)
    z, caches = _encode(p, X, noise)
    loss, grads, g = 0.0, {}, np.zeros_like(z)
    if "decoder" in p:
        r, c = _fwd(p["decoder"], z)
        d = r - X
        loss += weights["recon"] * float((d * d).mean(axis=1).sum())
        grads["decoder"], back = _bwd(p["decoder"], c, weights["recon"] * 2.0 * d / X.shape[1])
        g += back
    if "head" in p:
        q, c = _fwd(p["head"], z)
        q = q[:, 0]
        loss += weights["class"] * _class_loss(q, y)
        qc = np.clip(q, 1e-12, 1 - 1e-12)
        grads["head"], back = _bwd(p["head"], c, (weights["class"] * ((1 - y) / (1 - qc) - y / qc))[:, None])
        g += back
    if "mu" in p:
        loss += weights["latent"] * _latent_loss(z, noise[1])
        g += weights["latent"] * (_softmax(z) - _softmax(noise[1]))
        grads["mu"], g_mu = _bwd(p["mu"], caches[1], g)
        grads["logvar"], g_lv = _bwd(p["logvar"], caches[2], g * noise[0])
        g = g_mu + g_lv
    grads["encoder"], _ = _bwd(p["encoder"], caches[0], g)
    return loss, grads


def flatten_params(net: dict) -> list[tuple[str, int, str]]:
    slots = []
    for part in ("encoder", "mu", "logvar", "decoder", "head"):
        for li, _ in enumerate(net["parts"].get(part, [])):
            slots += [(part, li, "w"), (part, li, "b")]
    return slots


def _vec(net: dict, grads: dict | None = None) -> np.ndarray:
    out = []
    for part, li, kind in flatten_params(net):
        if grads is None:
            out.append(net["parts"][part][li][kind].ravel())
        else:
            gw, gb = grads[part][li]
            out.append((gw if kind == "w" else gb).ravel())
    return np.concatenate(out)


def _unvec(net: dict, v: np.ndarray) -> dict:
    new = {"parts": {k: [dict(L) for L in ls] for k, ls in net["parts"].items()},
           "config": net.get("config", {}), "name": net.get("name", "net")}
    i = 0
    for part, li, kind in flatten_params(net):
        shape = net["parts"][part][li][kind].shape
        n = int(np.prod(shape))
        new["parts"][part][li][kind] = v[i:i + n].reshape(shape)
        i += n
    return new


# ------------------------------------------------------------------ J1

def _block_columns(df: DataFrame, net: dict, x: str, label: str, key: str, seeds: tuple[int, int]) -> list:
    """The columns a block of rows needs: vector, label and, for a network that samples
    its latent vector, the seeded normals of eps and of the prior."""
    cols = [F.col(x).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")]
    if "mu" in net["parts"]:
        d = net["parts"]["mu"][-1]["w"].shape[1]
        cols += [Fs.normal_noise(key, s, d).alias(n) for n, s in zip(("eps", "samples"), seeds)]
    return cols


def _blocks(net: dict, batches):
    """(X, y, noise) of each Arrow batch that has rows."""
    width = len(net["parts"]["encoder"][0]["w"])
    for b in batches:
        if b.num_rows:
            noise = tuple(Fs._matrix(b.column(i)) for i in (2, 3)) if b.num_columns > 2 else None
            yield Fs._matrix(b.column(0), width), b.column(1).to_numpy(zero_copy_only=False), noise


def _grad_job(df: DataFrame, net: dict, x: str, label: str, w_cls: float, key: str = "k",
              seeds: tuple[int, int] = (0, 1)) -> tuple[float, np.ndarray, int]:
    """One distributed gradient evaluation over the rows of ``df``.

    Each partition computes its gradient sum over Arrow batches and emits a
    single row (loss, count, gradient packed as float64 bytes); those rows -
    one per partition, whatever the data size - are combined with a
    tree-shaped ``treeAggregate`` as numpy vectors, so no per-parameter rows are
    shuffled and the driver receives one vector."""
    bc = df.sparkSession.sparkContext.broadcast(net)
    npar = len(_vec(net))

    def part_grads(batches):
        tot, cnt, loss = np.zeros(npar), 0, 0.0
        n = bc.value
        for X, y, noise in _blocks(n, batches):
            lo, gr = loss_and_grads(n, X, y, w_cls, noise)
            tot += _vec(n, gr)
            loss += lo
            cnt += len(y)
        if cnt:
            yield pa.RecordBatch.from_pydict({"loss": [loss], "n": [cnt], "g": [tot.tobytes()]})

    parts = df.select(*_block_columns(df, net, x, label, key, seeds)).mapInArrow(
        part_grads, "loss double, n long, g binary")

    def unpack(r):
        return (float(r["loss"]), int(r["n"]), np.frombuffer(r["g"], dtype=np.float64).copy())

    def add(a, b):
        return (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    # one job, also where there are no rows
    loss, n, g = parts.rdd.map(unpack).treeAggregate((0.0, 0, np.zeros(npar)), add, add, depth=2)
    bc.destroy()
    return loss, g, n


def eval_losses(df: DataFrame, net: dict, x: str = "x", label: str = "y", w_cls: float = 0.5, key: str = "k",
                seeds: tuple[int, int] = (0, 1)) -> dict[str, float | None]:
    """Mean losses over ``df``, unweighted per component (None where the network has
    no such part), and ``total``, weighted.  Forward pass only, one row of sums per
    partition, summed by an aggregate.  An empty ``df`` gives 0 for every loss."""
    bc = df.sparkSession.sparkContext.broadcast(net)
    weights = loss_weights(net, w_cls)

    def part_loss(batches):
        sums, cnt = dict.fromkeys(weights, 0.0), 0
        for X, y, noise in _blocks(bc.value, batches):
            for c, v in loss_parts(bc.value, X, y, noise).items():
                sums[c] += v
            cnt += len(y)
        if cnt:
            yield pa.RecordBatch.from_pydict({"n": [cnt], **{c: [v] for c, v in sums.items()}})

    sums = df.select(*_block_columns(df, net, x, label, key, seeds)).mapInArrow(
        part_loss, "n long, " + ", ".join(f"{c} double" for c in weights))
    r = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *weights)]).first()
    bc.destroy()
    mean = {c: float(r[c]) / max(int(r["n"]), 1) for c in weights}
    return {"total": sum(weights[c] * mean[c] for c in weights)} | {c: mean.get(c) for c in COMPONENTS}


def eval_loss(df: DataFrame, net: dict, x: str = "x", label: str = "y", w_cls: float = 0.5, key: str = "k",
              seeds: tuple[int, int] = (0, 1)) -> float:
    """Mean weighted loss over ``df``."""
    return eval_losses(df, net, x, label, w_cls, key, seeds)["total"]


#: Rows that are worth a task: about as long a gradient as it takes to start a job.
ROWS_PER_TASK = 8192


def step_tasks(spark: SparkSession, batch_size: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Tasks that share one optimiser step."""
    return max(1, min(spark.sparkContext.defaultParallelism, math.ceil(batch_size / rows_per_task)))


def segment_steps(batch_size: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Consecutive batches of a segment: as many as make up a task's rows, whatever the
    table's size."""
    return max(1, rows_per_task // batch_size)


def _epoch_batches(tr: DataFrame, key: str, seed: int, epoch: int, batch_size: int,
                   rows_per_task: int = ROWS_PER_TASK, steps: int = 1) -> str:
    """Write one epoch's batches as a table partitioned by segment (``_b``: ``steps``
    consecutive batches, by default one) in the shared checkpoint folder; a job then reads
    only its own partition, in which ``_step`` is the batch.

    Rows are put in a seeded md5 order, positioned with the distributed
    ordered scan, and cut into batches of exactly ``batch_size`` rows (the last
    one short), as a shuffled data loader does.  A batch is dealt to
    :func:`step_tasks` files; as they are not more than Spark's cores, a reader
    gives each a task of its own."""
    from hepark.operators.ranking import positions
    from hepark.sources.io import scratch_path
    path = scratch_path(tr.sparkSession, f"epoch{epoch}")
    eb = positions(tr.withColumn("_o", order_key(key, seed * 100003 + epoch)), [], "_o", out="_pos",
                   hex_order=True)
    tasks = step_tasks(tr.sparkSession, batch_size, rows_per_task)
    eb = eb.withColumn("_step", F.floor((F.col("_pos") - 1) / F.lit(int(batch_size))).cast("int")) \
        .withColumn("_b", F.floor(F.col("_step") / F.lit(int(steps))).cast("int")) \
        .withColumn("_t", F.pmod(F.col("_pos"), F.lit(tasks)).cast("int")).drop("_o", "_pos")
    eb.repartition("_b", "_t").write.partitionBy("_b", "_t").parquet(path)
    return path


class Adam:
    """Weights as one vector with Adam's moments; ``step`` takes a mean gradient."""

    def __init__(self, theta: np.ndarray, lr: float):
        self.theta, self.lr, self.t = theta, lr, 0
        self.m, self.v = np.zeros_like(theta), np.zeros_like(theta)

    def step(self, g: np.ndarray, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> None:
        self.t += 1
        self.m = b1 * self.m + (1 - b1) * g
        self.v = b2 * self.v + (1 - b2) * g * g
        self.theta = self.theta - self.lr * (self.m / (1 - b1 ** self.t)) / (
            np.sqrt(self.v / (1 - b2 ** self.t)) + eps)


def _by_step(net: dict, batches):
    """(step, X, y, noise) of each run of equal steps in Arrow batches whose last column is
    the step."""
    for b in batches:
        step = b.column(b.num_columns - 1).to_numpy()
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True]) if len(step) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            held = b.slice(lo, hi - lo).select(list(range(b.num_columns - 1)))
            for X, y, noise in _blocks(net, [held]):
                yield int(step[lo]), X, y, noise


def _segment_job(df: DataFrame, net: dict, opt: Adam, x: str, label: str, w_cls: float, key: str = "k",
                 seeds: tuple[int, int] = (0, 1)) -> tuple[Adam, list[float]]:
    """The optimiser after the steps of one segment's batches (column ``_step``), and the
    mean loss of each batch: one job of one task, which streams the segment's rows - not more
    than a task is worth - in the order of their steps."""
    bc = df.sparkSession.sparkContext.broadcast((net, opt))
    rows = df.select(*_block_columns(df, net, x, label, key, seeds), "_step").coalesce(1) \
        .sortWithinPartitions("_step")

    def run(batches):
        cur, opt = bc.value
        opt, losses = copy.copy(opt), []
        for _, parts in itertools.groupby(_by_step(cur, batches), key=lambda r: r[0]):
            tot, cnt, loss = np.zeros_like(opt.theta), 0, 0.0
            for _, X, y, noise in parts:
                lo, gr = loss_and_grads(cur, X, y, w_cls, noise)
                tot += _vec(cur, gr)
                loss += lo
                cnt += len(y)
            opt.step(tot / cnt)
            cur = _unvec(cur, opt.theta)
            losses.append(loss / cnt)
        yield pa.RecordBatch.from_pydict({"t": [opt.t], "losses": [np.array(losses, float).tobytes()],
                                          **{n: [getattr(opt, n).tobytes()] for n in ("theta", "m", "v")}})

    r = rows.mapInArrow(run, "t long, losses binary, theta binary, m binary, v binary").collect()
    bc.destroy()
    if not r:                                      # a segment without files
        return opt, []
    new = Adam(np.frombuffer(r[0]["theta"]).copy(), opt.lr)
    new.t, new.m, new.v = int(r[0]["t"]), np.frombuffer(r[0]["m"]).copy(), np.frombuffer(r[0]["v"]).copy()
    return new, np.frombuffer(r[0]["losses"]).tolist()


def fit_network(train: DataFrame, valid: DataFrame, net: dict, epochs: int = 5, batch_size: int = 256,
                lr: float = 0.01, seed: int = 0, key: str = "k", x: str = "x", label: str = "y",
                w_cls: float = 0.5, patience: int = PATIENCE_AE, run: str = "run",
                rows_per_task: int = ROWS_PER_TASK) -> tuple[dict, DataFrame]:
    """Mini-batch Adam with best-validation weights and early stopping.

    Each epoch's batches (seeded order, exact batch size, last one short) are
    written once as a table partitioned by segment, so a job reads one segment, not
    the whole set; the table goes when the epoch is over.  ``rows_per_task`` says whether
    a job is several steps in one task or one step shared by several tasks.
    Networks that sample their latent vector draw new seeded noise every epoch and are
    validated on the same noise each time.
    Returns (best network, history DataFrame of run, epoch, train_loss,
    valid_loss and the unweighted valid_recon, valid_class and valid_latent, null where the
    network has no such part).  The epoch losses recorded follow the reference: the epoch
    that triggers the stop is not recorded."""
    from hepark.sources.io import remove
    spark = train.sparkSession
    noise = seed * 100003 + 2
    tr = train.select(key, x, label)
    va = valid.select(key, x, label).persist(StorageLevel.MEMORY_AND_DISK)
    n = tr.count()
    n_batches = max(1, math.ceil(n / batch_size))
    opt = Adam(_vec(net), lr)
    schema = T.StructType([*tr.schema.fields, T.StructField("_step", T.IntegerType())])
    shared = step_tasks(spark, batch_size, rows_per_task) > 1
    steps = segment_steps(batch_size, rows_per_task)
    best, best_loss, no_imp = net, float("inf"), 0
    hist = []
    cur = net
    for ep in range(epochs):
        path = _epoch_batches(tr, key, seed, ep, batch_size, rows_per_task, steps)
        batch_losses = []
        for first in range(0, n_batches, steps):  # exact sizes: ids 0..n_batches-1
            rows = spark.read.schema(schema).parquet(f"{path}/_b={first // steps}")
            seeds = (noise + 2 * ep, noise + 2 * ep + 1)
            if shared:
                loss, g, cnt = _grad_job(rows, cur, x, label, w_cls, key, seeds)
                losses = [loss / cnt] if cnt else []
                if cnt:
                    opt.step(g / cnt)
            else:
                opt, losses = _segment_job(rows, cur, opt, x, label, w_cls, key, seeds)
            cur = _unvec(cur, opt.theta)
            batch_losses += losses
        remove(spark, path)
        train_loss = float(np.mean(batch_losses)) if batch_losses else float("nan")
        losses = eval_losses(va, cur, x, label, w_cls, key, (noise - 2, noise - 1))
        valid_loss = losses["total"]
        if best_loss > valid_loss:
            best, best_loss, no_imp = cur, valid_loss, 0
        else:
            no_imp += 1
        if no_imp >= patience:
            break
        hist.append((run, ep, train_loss, valid_loss, *[losses[c] for c in COMPONENTS]))
    va.unpersist()
    h = spark.createDataFrame(hist, "run string, epoch int, train_loss double, valid_loss double, "
                              + ", ".join(f"valid_{c} double" for c in COMPONENTS))
    return best, h


# ------------------------------------------------------------------ J2

def fit_margin(train: DataFrame, C: float = 1.0, x: str = "x", label: str = "y", max_iter: int = 100):
    """Linear margin classifier with cost C (LinearSVC, regParam = 1/(C n))."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector
    n = train.count()
    d = train.select(array_to_vector(F.col(x).cast("array<double>")).alias("features"),
                     F.col(label).cast("double").alias("label"))
    return LinearSVC(regParam=1.0 / (C * max(n, 1)), maxIter=max_iter).fit(d)


def margin_scores(model, df: DataFrame, x: str = "x", keep: Sequence[str] = ("k", "y")) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    d = df.select(*keep, array_to_vector(F.col(x).cast("array<double>")).alias("features"))
    out = model.transform(d)
    return out.select(*keep, vector_to_array("rawPrediction")[1].alias("score"))


# ------------------------------------------------------------------ J3, J4

def grid_search(trials: Sequence[dict], run_trial: Callable[[dict], float],
                parallelism: int = 1) -> list[tuple]:
    """Run every trial (each one a chain of Spark jobs) and log
    (trial, params, metric) in trial order.  ``parallelism > 1`` submits
    trials from that many driver threads at once (Spark schedules concurrent
    jobs), which keeps a large cluster busy when one trial cannot."""
    def one(i_p):
        i, p = i_p
        return (i, str(sorted(p.items())), float(run_trial(p)))
    if parallelism <= 1:
        return [one(t) for t in enumerate(trials)]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        return sorted(ex.map(one, enumerate(trials)))


def best_trial(results: DataFrame, metric: str = "metric", higher: bool = True) -> DataFrame:
    """Strict best; the first trial wins ties."""
    o = F.col(metric).desc() if higher else F.col(metric).asc()
    return results.orderBy(o, F.col("trial")).limit(1)


def random_trials(spark: SparkSession, n: int, seed: int, lr_range=(1e-4, 1e-1),
                  w_range=(0.0, 1.0), batches=(64, 128, 256)) -> DataFrame:
    """Seeded search space sample: log-uniform lr, uniform loss weight,
    categorical batch size (md5-derived uniforms)."""
    base = spark.range(n).withColumnRenamed("id", "trial")

    def u(tag):
        h = F.md5(F.concat(F.col("trial").cast("string"), F.lit(f"|{seed}|{tag}")))
        return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16 ** 13))
    lo, hi = math.log(lr_range[0]), math.log(lr_range[1])
    barr = F.array(*[F.lit(int(b)) for b in batches])
    return base.select(
        "trial",
        F.exp(F.lit(lo) + u("lr") * F.lit(hi - lo)).alias("lr"),
        (F.lit(w_range[0]) + u("w") * F.lit(w_range[1] - w_range[0])).alias("w_cls"),
        F.element_at(barr, (F.floor(u("b") * F.lit(len(batches))) + 1).cast("int")).alias("batch_size"))


# ------------------------------------------------------------------ J5, J6

def early_stop(history: DataFrame, patience: int, run: str = "run", epoch: str = "epoch",
               loss: str = "valid_loss") -> DataFrame:
    """Per run: best epoch/loss and the stop epoch under the rule "stop when
    the epochs since the last strict improvement reach ``patience``"
    (null when training would not stop).  Windows are per run over epochs:
    a history has one row per epoch, so a run is small."""
    w = Window.partitionBy(run).orderBy(epoch)
    prev_min = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("_imp", prev_min.isNull() | (F.col(loss) < prev_min))
    h = h.withColumn("_last", F.max(F.when(F.col("_imp"), F.col(epoch))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("_since", F.col(epoch) - F.col("_last"))
    stop = h.filter(F.col("_since") >= patience).groupBy(run).agg(F.min(epoch).alias("stop_epoch"))
    h = h.join(stop, run, "left").filter(F.col("stop_epoch").isNull() | (F.col(epoch) < F.col("stop_epoch")))
    return h.groupBy(run).agg(
        F.min_by(epoch, F.struct(F.col(loss), F.col(epoch))).alias("best_epoch"),
        F.min(loss).alias("best_loss"), F.first("stop_epoch").alias("stop_epoch"),
        F.count(F.lit(1)).cast("long").alias("epochs_recorded"))


def random_search(spark: SparkSession, n: int, seed: int, run_trial: Callable[[dict], float],
                  higher: bool = True, **space) -> DataFrame:
    """Sample ``n`` seeded trials (log-uniform lr, uniform loss weight,
    categorical batch size), run each, return every trial with its metric and
    a ``best`` flag (strict best, first trial on ties)."""
    trials = random_trials(spark, n, seed, **space).collect()  # n rows: the trial table
    params = [{"lr": r["lr"], "w_cls": r["w_cls"], "batch_size": r["batch_size"]} for r in trials]
    res = grid_search(params, run_trial)
    df = spark.createDataFrame(res, "trial int, params string, metric double")
    best = best_trial(df, "metric", higher).select("trial", F.lit(True).alias("best"))
    return df.join(best, "trial", "left").fillna(False, subset=["best"])
