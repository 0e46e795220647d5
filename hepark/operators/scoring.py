"""Batch scoring: dense networks, variational encoders, kernels.

Model weights are small (bounded by the layer sizes) and travel to executors
once as a broadcast; rows are scored per Arrow batch with numpy matrix
products inside an ``arrow_udf`` (no per-row Python).  Kernel scoring
evaluates each row against a reference set (support vectors, centroids) whose
size is checked and which is broadcast once, again per Arrow batch with numpy,
so there is no cross join of two row sets.
"""

from __future__ import annotations

import json
import math
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- networks
# A network is {"parts": {name: [{"w": in x out array, "b": out array, "act": str}, ...]},
#               "config": {...}}.  Parts: encoder, decoder, head, mu, logvar.

NP_ACT = {
    "relu": lambda z: np.maximum(z, 0.0),
    "leaky_relu": lambda z: np.where(z >= 0, z, 0.2 * z),
    "elu": lambda z: np.where(z > 0, z, np.expm1(np.minimum(z, 0.0))),
    "sigmoid": lambda z: 1.0 / (1.0 + np.exp(-z)),
    "tanh": np.tanh,
    "linear": lambda z: z,
}



def formula_weight(part: int, layer: int, r: int, c: int) -> float:
    """Deterministic weights for checks: 0.3*sin(1 + 131p + 37l + 7r + 3c)."""
    return 0.3 * math.sin(1.0 + 131.0 * part + 37.0 * layer + 7.0 * r + 3.0 * c)


def formula_bias(part: int, layer: int, c: int) -> float:
    return 0.1 * math.cos(1.0 + 131.0 * part + 37.0 * layer + 3.0 * c)


PART_IDS = {"encoder": 0, "decoder": 1, "head": 2, "mu": 3, "logvar": 4}


def dense_part(part: str, sizes: Sequence[int], acts: Sequence[str]) -> list[dict]:
    pid = PART_IDS[part]
    layers = []
    for li, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])):
        w = np.array([[formula_weight(pid, li, r, c) for c in range(b)] for r in range(a)])
        bias = np.array([formula_bias(pid, li, c) for c in range(b)])
        layers.append({"w": w, "b": bias, "act": acts[li]})
    return layers


def autoencoder(sizes: Sequence[int], head: Sequence[int] | None = None, last_act: str = "tanh",
                head_hidden: str = "relu", latent_act: str | None = None, encoder_act: str = "relu") -> dict:
    """Autoencoder shapes: encoder ``encoder_act`` hidden + ``latent_act`` latent
    (None: as ``last_act``); decoder reversed sizes, ELU hidden + ``last_act``;
    optional head (``head_hidden`` hidden, sigmoid last) on the latent."""
    n = len(sizes) - 1
    enc_act = [encoder_act] * (n - 1) + [latent_act or last_act]
    dec_act = ["elu"] * (n - 1) + [last_act]
    parts = {"encoder": dense_part("encoder", sizes, enc_act),
             "decoder": dense_part("decoder", list(reversed(sizes)), dec_act)}
    cfg = {"sizes": list(sizes), "last_act": last_act}
    if head:
        hs = [sizes[-1]] + list(head)
        parts["head"] = dense_part("head", hs, [head_hidden] * (len(hs) - 2) + ["sigmoid"])
        cfg["head"] = list(head)
    return {"parts": parts, "config": cfg}


def plain_classifier(sizes: Sequence[int]) -> dict:
    """ReLU after every layer including the latent one, then Linear to 1 + Sigmoid."""
    enc = dense_part("encoder", sizes, ["relu"] * (len(sizes) - 1))
    head = dense_part("head", [sizes[-1], 1], ["sigmoid"])
    return {"parts": {"encoder": enc, "head": head}, "config": {"sizes": list(sizes), "plain": True}}


def variational(sizes: Sequence[int], last_act: str = "tanh") -> dict:
    """ELU encoder for all but the last size, then mean and log-variance heads."""
    pre = list(sizes[:-1])
    enc = dense_part("encoder", pre, ["elu"] * (len(pre) - 1))
    mu = dense_part("mu", [pre[-1], sizes[-1]], ["linear"])
    lv = dense_part("logvar", [pre[-1], sizes[-1]], ["linear"])
    n = len(sizes) - 1
    dec = dense_part("decoder", list(reversed(sizes)), ["elu"] * (n - 1) + [last_act])
    return {"parts": {"encoder": enc, "mu": mu, "logvar": lv, "decoder": dec},
            "config": {"sizes": list(sizes), "variational": True}}


def forward_np(layers: list[dict], X: np.ndarray) -> np.ndarray:
    h = X
    for L in layers:
        h = NP_ACT[L["act"]](h @ L["w"] + L["b"])
    return h


def _lists(m: np.ndarray) -> pa.ListArray:
    """A matrix as a column of vectors, without a Python object per row."""
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1],
                                    np.ascontiguousarray(m, np.float64).reshape(-1))


def score_network(df: DataFrame, net: dict, x: str = "x") -> DataFrame:
    """adds ``latent`` and, when the parts exist, ``recon`` and ``prob``,
    per Arrow batch with numpy matrix products."""
    parts = net["parts"]
    sc = df.sparkSession.sparkContext
    bc = sc.broadcast({k: [{"w": L["w"], "b": L["b"], "act": L["act"]} for L in v] for k, v in parts.items()})
    fields = [T.StructField("latent", T.ArrayType(T.DoubleType()))]
    if "decoder" in parts:
        fields.append(T.StructField("recon", T.ArrayType(T.DoubleType())))
    if "head" in parts:
        fields.append(T.StructField("prob", T.DoubleType()))
    rtype = T.StructType(fields)

    @F.arrow_udf(rtype)
    def fwd(xcol: pa.Array) -> pa.Array:
        p = bc.value
        X = _matrix(xcol, len(p["encoder"][0]["w"]))
        z = forward_np(p["encoder"], X)
        out = [_lists(z)]
        if "decoder" in p:
            out.append(_lists(forward_np(p["decoder"], z)))
        if "head" in p:
            out.append(pa.array(forward_np(p["head"], z)[:, 0]))
        return pa.StructArray.from_arrays(out, [f.name for f in fields])

    s = df.withColumn("_s", fwd(F.col(x).cast("array<double>")))
    return s.select(*df.columns, *[F.col(f"_s.{f.name}").alias(f.name) for f in fields])


# ---------------------------------------------------------------- F2

def _uniform(h: Column, start: int) -> Column:
    return (F.conv(F.substring(h, start, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16 ** 13))


def normal_noise(key: str, seed: int, dim: int) -> Column:
    """Deterministic standard normals per (row key, seed, dimension):
    Box-Muller on two uniforms from md5 digits."""
    def one(i):
        h = F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.lit(str(seed)), F.lit("|"),
                           i.cast("string")))
        return F.sqrt(F.lit(-2.0) * F.log(_uniform(h, 1))) * F.cos(F.lit(2.0 * math.pi) * _uniform(h, 14))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)


def sample_latent(parts: dict, X: np.ndarray, E: np.ndarray, scale: str = "logvar"):
    """(mu, log-variance, ``mu + E * s``) of one block of rows."""
    h = forward_np(parts["encoder"], X)
    mu, lv = forward_np(parts["mu"], h), forward_np(parts["logvar"], h)
    return mu, lv, mu + E * (lv if scale == "logvar" else np.exp(0.5 * lv))


def score_variational(df: DataFrame, net: dict, seed: int = 0, scale: str = "logvar",
                      x: str = "x", key: str = "k") -> DataFrame:
    """mu, log-variance, sampled latent ``mu + eps*s`` (s = log-variance as
    in the reference, or ``exp(0.5*logvar)`` with ``scale='std'``) and the
    reconstruction of the sample."""
    parts = net["parts"]
    d = parts["mu"][-1]["w"].shape[1]
    bc = df.sparkSession.sparkContext.broadcast(parts)
    names = ["mu", "logvar", "latent", "recon"]
    rtype = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])

    @F.arrow_udf(rtype)
    def fwd(xcol: pa.Array, ecol: pa.Array) -> pa.Array:
        p = bc.value
        mu, lv, z = sample_latent(p, _matrix(xcol, len(p["encoder"][0]["w"])), _matrix(ecol, d), scale)
        return pa.StructArray.from_arrays([_lists(m) for m in (mu, lv, z, forward_np(p["decoder"], z))], names)

    s = df.withColumn("_s", fwd(F.col(x).cast("array<double>"), normal_noise(key, seed, d)))
    return s.select(*df.columns, *[F.col(f"_s.{n}").alias(n) for n in names])


# ---------------------------------------------------------------- model tables

def network_table(spark: SparkSession, net: dict) -> DataFrame:
    """Weights as rows ``(part, layer, row, col, w)``; bias rows have row = -1."""
    rows = []
    for part, layers in net["parts"].items():
        for li, L in enumerate(layers):
            W = L["w"]
            rows += [(part, li, r, c, float(W[r, c])) for r in range(W.shape[0]) for c in range(W.shape[1])]
            rows += [(part, li, -1, c, float(v)) for c, v in enumerate(L["b"])]
    return spark.createDataFrame(rows, "part string, layer int, row int, col int, w double")


def network_config(net: dict) -> str:
    acts = {p: [L["act"] for L in ls] for p, ls in net["parts"].items()}
    return json.dumps({"config": net["config"], "activations": acts})


def network_from_table(rows, config_json: str) -> dict:
    """Rebuild a network from collected weight rows (size = #weights)."""
    cfg = json.loads(config_json)
    acts = cfg["activations"]
    parts: dict = {}
    by = {}
    for r in rows:
        by.setdefault((r["part"], r["layer"]), []).append(r)
    for (part, li), rs in sorted(by.items()):
        nin = max(x["row"] for x in rs) + 1
        nout = max(x["col"] for x in rs) + 1
        W = np.zeros((nin, nout))
        b = np.zeros(nout)
        for x in rs:
            if x["row"] < 0:
                b[x["col"]] = x["w"]
            else:
                W[x["row"], x["col"]] = x["w"]
        parts.setdefault(part, []).append({"w": W, "b": b, "act": acts[part][li]})
    return {"parts": parts, "config": cfg["config"]}


# ---------------------------------------------------------------- kernels

KERNELS = ("linear", "rbf", "poly", "overlap")


def kernel_matrix_np(X: np.ndarray, R: np.ndarray, kernel: str, gamma: float, degree: int,
                     coef0: float) -> np.ndarray:
    """K(X, R) for one Arrow batch against one reference block."""
    if kernel == "linear":
        return X @ R.T
    if kernel == "poly":
        return (gamma * (X @ R.T) + coef0) ** degree
    if kernel == "rbf":
        d2 = np.zeros((X.shape[0], R.shape[0]))
        for i in range(X.shape[1]):  # direct squared differences (no expansion cancellation)
            d = X[:, i, None] - R[None, :, i]
            d2 += d * d
        return np.exp(-gamma * d2)
    if kernel == "overlap":
        xn = np.sqrt((X * X).sum(axis=1))
        rn = np.sqrt((R * R).sum(axis=1))
        ru = R / np.where(rn == 0, 1.0, rn)[:, None]
        c = (X @ ru.T) / np.where(xn == 0, 1.0, xn)[:, None]
        return c * c
    raise TypeError(f"unknown kernel {kernel!r}")


#: Rows of a reference set (support vectors, centroids) that may be broadcast.
MAX_REFERENCES = 65536


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column of equally long vectors (``width``, if given) as a matrix, from its
    flat buffer."""
    if vectors.null_count:
        raise ValueError("a vector is null")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), width or -1) if len(vectors) else np.zeros((0, width or 0))


def _references(refs: DataFrame, value: Column, x: str, max_refs: int) -> tuple[pa.Array, np.ndarray]:
    """The bounded side: a value per reference (id or weight) and the vectors.
    A set of more than ``max_refs`` rows is an error, found from that many rows."""
    rows = refs.select(value, F.col(x).cast("array<double>").alias("_r")).limit(max_refs + 1).toArrow()
    if rows.num_rows > max_refs:
        raise ValueError(f"a reference set holds at most {max_refs} rows")
    values, vectors = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
    return values, _matrix(vectors)


def gram(a: DataFrame, refs: DataFrame, kernel: str = "rbf", x: str = "x", key: str = "k",
         ref_key: str = "ref", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0,
         block: int = 1024, max_refs: int = MAX_REFERENCES) -> DataFrame:
    """kernel values ``(key, ref, kval)`` between every row of ``a`` and a
    reference set of at most ``max_refs`` rows (support vectors, centroids).

    The references are broadcast once; an Arrow batch of ``a`` is scored in
    blocks of ``block`` x ``block`` values, so ``a`` is read once, whatever the
    number of references.  Output size is |a| x |refs| by definition."""
    if kernel not in KERNELS:
        raise TypeError(f"unknown kernel {kernel!r}")
    schema = T.StructType([T.StructField(key, a.schema[key].dataType),
                           T.StructField(ref_key, refs.schema[ref_key].dataType),
                           T.StructField("kval", T.DoubleType())])
    bc = a.sparkSession.sparkContext.broadcast(_references(refs, F.col(ref_key), x, max_refs))

    def run(batches):
        ids, R = bc.value
        for batch in batches:
            keys, X = batch.column(0), _matrix(batch.column(1))
            for i in range(0, len(X), block):
                for j in range(0, len(R), block):
                    K = kernel_matrix_np(X[i:i + block], R[j:j + block], kernel, gamma, degree, coef0)
                    n, m = K.shape
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(np.repeat(np.arange(i, i + n), m))),
                         ids.take(pa.array(np.tile(np.arange(j, j + m), n))), pa.array(K.ravel())],
                        schema.fieldNames())

    return a.select(key, F.col(x).cast("array<double>").alias("_x")).mapInArrow(run, schema)


def kernel_scores(df: DataFrame, sv: DataFrame, kernel: str = "rbf", b: float = 0.0,
                  x: str = "x", key: str = "k", alpha: str = "alpha", gamma: float = 1.0,
                  degree: int = 3, coef0: float = 0.0, block: int = 1024,
                  max_refs: int = MAX_REFERENCES) -> DataFrame:
    """decision score sum_i alpha_i K(row, sv_i) + b.

    At most ``max_refs`` support vectors, broadcast once; an Arrow batch adds
    ``K @ alpha`` over blocks of ``block`` of them, so there are no row ids,
    joins or shuffles."""
    if kernel not in KERNELS:
        raise TypeError(f"unknown kernel {kernel!r}")
    bc = df.sparkSession.sparkContext.broadcast(
        _references(sv, F.col(alpha).cast("double").alias("_a"), x, max_refs))

    @F.arrow_udf(T.DoubleType())
    def score(xcol: pa.Array) -> pa.Array:
        weights, R = bc.value
        al, out = weights.to_numpy(zero_copy_only=False), np.full(len(xcol), float(b))
        X = _matrix(xcol)
        for j in range(0, len(R) if len(X) else 0, block):
            out += kernel_matrix_np(X, R[j:j + block], kernel, gamma, degree, coef0) @ al[j:j + block]
        return pa.array(out)

    return df.select(key, score(F.col(x).cast("array<double>")).alias("score"))


def support_counts(sv: DataFrame, label: str = "y") -> DataFrame:
    """support vectors per class."""
    return sv.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("n_support"))


def centroids(df: DataFrame, by: str, x: str = "x") -> DataFrame:
    """Per-group mean vectors (#groups rows): a bounded reference set."""
    e = df.select(by, F.posexplode(F.col(x).cast("array<double>")).alias("_i", "_v"))
    m = e.groupBy(by, "_i").agg(F.avg("_v").alias("_m"))
    return (m.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_s"))
            .select(by, F.transform("_s", lambda s: s["_m"]).alias(x)))


# ---------------------------------------------------------------- F5, F6

def encode_split(df: DataFrame, net: dict | None, split: str | None = None, split_col: str = "split",
                 x: str = "x", latent: bool = True) -> DataFrame:
    """the rows of one split encoded to the latent space (raw pass-through
    when ``latent`` is False)."""
    d = df.filter(F.col(split_col) == split) if split is not None else df
    if not latent or net is None:
        return d
    s = score_network(d, net, x)
    return s.drop(x).withColumnRenamed("latent", x)


def score_folds(df: DataFrame, net: dict, x: str = "x", fold: str = "fold", key: str = "k",
                label: str = "y", model: str = "model") -> DataFrame:
    """the score table (model, fold, k, y, score) of all folds at once."""
    s = score_network(df, net, x)
    return s.select(F.lit(net.get("name", "net")).alias(model), fold, key, label, F.col("prob").alias("score"))
