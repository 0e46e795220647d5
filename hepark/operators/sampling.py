"""Seeded shuffles, balanced samples, stratified splits, k-folds, chunks and
batches (D1-D7).

Randomness is an md5 order key of (row key, seed): reproducible, identical in
any engine, independent of partitioning, and its hex prefix is a balanced
range bucket for the two-phase ranks.  Every operator also takes
``hash='xxhash64'``: the same seeded, partition-independent order from a
64-bit hash plus the key, about 3x faster end to end at scale (not
reproducible outside Spark).  Per-class ranks never use a
``partitionBy(y)`` window (two classes = two tasks).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hepark.functions.exprs import order_key
from hepark.operators.ranking import first_per_group, group_counts, join_groups, ntile_of, positions


def shuffle(df: DataFrame, key: str | Sequence[str] = "k", seed: int = 0, out: str = "ord",
            with_pos: bool = False, by: Sequence[str] = (), pos: str = "pos",
            hash: str = "md5") -> DataFrame:
    """Seeded order key; ``with_pos`` adds the 1-based position in it.
    ``hash='xxhash64'`` trades the cross-engine md5 contract for a ~15x
    cheaper key (see ``exprs.order_key``)."""
    d = df.withColumn(out, order_key(key, seed, hash))
    if with_pos:
        d = positions(d, list(by), out, out=pos, hex_order=hash)
    return d


def balanced_sample(df: DataFrame, n: int, seed: int = 0, key: str = "k",
                    label: str = "y", hash: str = "md5") -> DataFrame:
    """``int(n/2)`` first rows (by key) of each class, then shuffled.

    ``n < 0`` keeps every row (still shuffled)."""
    if n >= 0:
        half = int(int(n) / 2)
        df = first_per_group(df, [label], key, half, "_rn").drop("_rn")
    return shuffle(df, key, seed, with_pos=True, hash=hash)


def largest_remainder(counts: Sequence[int], n_draws: int) -> list[int]:
    """Share ``n_draws`` among classes in proportion to ``counts``: whole parts
    first, then one each to the classes whose remainder is largest (the earlier
    class on ties)."""
    total = sum(counts)
    whole = [c * n_draws // total for c in counts]
    order = sorted(range(len(counts)), key=lambda j: (-(counts[j] * n_draws % total), j))
    extra = set(order[:n_draws - sum(whole)])
    return [w + (j in extra) for j, w in enumerate(whole)]


def sklearn_split_sizes(counts: Sequence[int], p: float) -> tuple[list[int], list[int]]:
    """Per-class (valid, test) sizes of the reference's two successive
    stratified splits: valid = ceil(p N) overall; test = the fraction
    valid/train of the remaining train part."""
    import math
    n = int(sum(counts))
    n_valid = int(math.ceil(p * n))
    n_train1 = n - n_valid
    tr1 = largest_remainder(counts, n_train1)
    va = largest_remainder([c - t for c, t in zip(counts, tr1)], n_valid)
    q = float(n_valid / n_train1)
    n_test = int(math.ceil(q * n_train1))
    tr2 = largest_remainder(tr1, n_train1 - n_test)
    te = largest_remainder([c - t for c, t in zip(tr1, tr2)], n_test)
    return va, te


def stratified_split(df: DataFrame, p: float, seed: int = 0, key: str = "k",
                     label: str = "y", out: str = "split", hash: str = "md5",
                     rule: str = "ceil") -> DataFrame:
    """D3: per class, the first ``v_c`` rows of the seeded order are
    ``valid``, the next ``t_c`` are ``test``, the rest ``train``; class ratios
    are kept.

    ``rule='ceil'``: ``v_c = ceil(p*n_c)``, ``t_c = ceil(q*r_c)`` with
    ``q = #valid / #remaining``.  ``rule='sklearn'``: the sizes of the
    reference's two scikit-learn splits (largest-remainder allocation), from
    the per-class counts (a #classes-row table read on the driver)."""
    d = shuffle(df, key, seed, hash=hash)
    d = positions(d, [label], "ord", out="_rn", hex_order=hash)
    if rule == "sklearn":
        cls = sorted(((r[0], int(r[1])) for r in group_counts(df, [label], "_n").collect()),
                     key=lambda c: (c[0] is not None, c[0]))   # the null class first
        va, te = sklearn_split_sizes([c for _, c in cls], p)
        v = F.lit(0).cast("long")
        t = F.lit(0).cast("long")
        for (lab, _), vi, ti in zip(cls, va, te):
            v = F.when(F.col(label).eqNullSafe(F.lit(lab)), F.lit(vi)).otherwise(v)
            t = F.when(F.col(label).eqNullSafe(F.lit(lab)), F.lit(ti)).otherwise(t)
        split = (F.when(F.col("_rn") <= v, F.lit("valid")).when(F.col("_rn") <= v + t, F.lit("test"))
                 .otherwise(F.lit("train")))
        return d.withColumn(out, split).drop("_rn")
    if rule != "ceil":
        raise TypeError(f"unknown split rule {rule!r}")
    cnt = group_counts(df, [label], "_n")
    cnt = cnt.withColumn("_v", F.ceil(F.lit(float(p)) * F.col("_n")).cast("long"))
    allc = Window.partitionBy()  # over the per-class table: #classes rows
    cnt = cnt.withColumn("_vsum", F.sum("_v").over(allc)) \
             .withColumn("_rsum", F.sum(F.col("_n") - F.col("_v")).over(allc))
    cnt = cnt.withColumn(
        "_t", F.ceil(F.try_divide(F.col("_vsum").cast("double"), F.col("_rsum").cast("double"))
                     * (F.col("_n") - F.col("_v"))).cast("long"))
    # one row per class: the size is bounded by the number of classes
    d = join_groups(d, cnt.select(label, "_v", "_t"), [label], broadcast=True)
    split = (F.when(F.col("_rn") <= F.col("_v"), F.lit("valid"))
             .when(F.col("_rn") <= F.col("_v") + F.col("_t"), F.lit("test"))
             .otherwise(F.lit("train")))
    return d.withColumn(out, split).drop("_rn", "_v", "_t")


def kfold(df: DataFrame, k: int, events: int | None = None, seed: int = 0, key: str = "k",
          label: str = "y", hash: str = "md5") -> DataFrame:
    """Balanced k-fold.  Per class, consecutive blocks of ``events/2``
    rows of the seeded order form the folds; rows beyond ``k`` full blocks are
    discarded.  ``events=None`` makes the blocks as large as the smaller class
    allows.  ``slot`` is the in-fold position before the in-fold shuffle
    (signal first), and ``fold_ord`` orders a fold with the same permutation
    for every fold."""
    if events is None:
        least = group_counts(df, [label]).agg(F.min("_n")).first()[0]   # one number
        events = 2 * max(1, (least or 0) // k)
    half = int(events / 2)
    d = shuffle(df, key, seed, hash=hash)
    d = positions(d, [label], "ord", out="_rn", hex_order=hash)
    d = d.withColumn("fold", F.floor((F.col("_rn") - 1) / F.lit(half)).cast("int")) \
         .filter(F.col("fold") < k)
    slot = (F.when(F.col(label) == 1, F.lit(0)).otherwise(F.lit(half))
            + (F.col("_rn") - 1) % F.lit(half)).cast("int")
    d = d.withColumn("slot", slot)
    return d.withColumn("fold_ord", order_key("slot", seed)).drop("_rn")


def chunk(df: DataFrame, n: int = 5, seed: int = 0, key: str = "k", out: str = "chunk",
          by: Sequence[str] = (), hash: str = "md5") -> DataFrame:
    """Seeded shuffle then ``n`` near-equal chunks (first ``N % n`` one
    row larger, as numpy.array_split / ntile)."""
    by = list(by)
    d = df.withColumn("ord", order_key(key, seed, hash))
    # positions and group sizes come out of the same ordered scan
    d = positions(d, by, "ord", out="pos", hex_order=hash, totals=True)
    return d.withColumn(out, ntile_of(F.col("pos"), F.col("n_group"), n)).drop("n_group")


def batchify(df: DataFrame, b: int | None, rule: str = "fixed", seed: int | None = None,
             key: str = "k", out: str = "batch_id", hash: str = "md5") -> DataFrame:
    """Batch ids.  ``equal``: ``ceil(N/b)`` near-equal batches;
    ``fixed``: batches of ``b`` with a short last one; ``b=None``: one batch.
    With a ``seed`` rows are shuffled first, otherwise taken in key order."""
    if b is None:
        return df.withColumn(out, F.lit(0))
    if seed is not None:
        d = positions(df.withColumn("ord", order_key(key, seed, hash)), [], "ord", out="pos",
                      hex_order=hash, totals=True)
    else:
        d = positions(df, [], key, out="pos", totals=True)
    d = d.withColumnRenamed("n_group", "_N")
    if rule == "fixed":
        return d.withColumn(out, F.floor((F.col("pos") - 1) / F.lit(int(b))).cast("int")).drop("_N")
    if rule == "equal":
        nb = F.ceil(F.col("_N") / F.lit(float(b))).cast("long")
        q = F.floor(F.col("_N") / nb).cast("long")
        r = F.col("_N") - q * nb
        big = r * (q + 1)
        bid = F.when(F.col("pos") <= big, F.floor((F.col("pos") - 1) / (q + 1))).otherwise(
            r + F.floor((F.col("pos") - 1 - big) / q))
        return d.withColumn(out, bid.cast("int")).drop("_N")
    raise TypeError(f"unknown batch rule {rule!r}")


def summarise(df: DataFrame, by: Sequence[str] = ("split", "y")) -> DataFrame:
    """Rows per split and class."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
