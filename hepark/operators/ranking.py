"""Distributed ordered scans: prefix sums, ranks, previous-row values.

A window with no ``partitionBy`` (or with a key that has only a couple of
values, like the class label) funnels the whole table through one task.
ROC curves, seeded positions, chunking, folds and per-class head cuts all
need an ordered scan over such a group, so they share a two-phase scheme:

1. every row gets a *bucket*: a range of the order inside its group.  Hash order
   keys (md5 or xxhash64) are uniform, so their leading bits are the bucket.  Any
   other key - of any type Spark can order, of several columns - is ranged by
   Spark itself: ``repartitionByRange`` on (group, order), written once, the partition
   is the bucket.  The ranges cut the whole table, not each group, so a group
   gets as many buckets as its share of the rows, and no boundaries travel;
2. a local window inside ``(group, bucket)`` computes the in-bucket part;
3. one aggregate per ``(group, bucket)`` gives bucket totals and the bucket's last
   row; a window over that small table turns them into offsets, group totals and
   the carry-in row.  A range that lies inside one group, or a group inside one
   range, needs none: only the groups that a cut goes through remain, at
   most two rows a cut;
4. the small table is joined back on ``(group, bucket)`` (broadcast after ranging, by the
   bound above; with hash buckets AQE decides at run time).

The bucket count follows the size of the plan's inputs, so tasks stay bounded
however large a group is.  A null group key is a group like any other.

No task ever sees more than one bucket of one group.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hepark.functions.exprs import order_bucket
from hepark.session import cut_lineage

DEFAULT_BUCKETS = 64
BYTES_PER_BUCKET = 256 * 1024 * 1024
LOOKUP_BLOCK = 32
INLINE_BOUNDS = 4096
UNKNOWN_BYTES = 2**62          # Spark's default size of a relation without statistics
ROW_BYTES_PER_COLUMN = 16
BROADCAST_BOUNDS_BYTES = 64 * 1024 * 1024


def input_bytes(df: DataFrame) -> int | None:
    """Size of the plan's inputs (no job); None if one is unknown (rows of an RDD).  The
    inputs' sizes are added; Catalyst's own estimate of a join multiplies them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if max(sizes, default=0) >= UNKNOWN_BYTES else sum(sizes)


def _default_buckets(df: DataFrame) -> int:
    """Hash buckets per group from the size of the plan's inputs: one per 256
    MiB, at least 64, a multiple of 32.  An input of unknown size costs a count."""
    size = input_bytes(df)
    if size is None:
        size = df.count() * ROW_BYTES_PER_COLUMN * len(df.columns)
    b = max(DEFAULT_BUCKETS, -(-size // BYTES_PER_BUCKET))
    return -(-b // LOOKUP_BLOCK) * LOOKUP_BLOCK


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], broadcast: bool = False,
                how: str = "inner") -> DataFrame:
    """Join on ``by`` (inner by default) in which a null key is a group like any other."""
    names = {c: f"_by_{i}" for i, c in enumerate(by)}
    right = right.withColumnsRenamed(names)
    on = [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()]
    return left.join(F.broadcast(right) if broadcast else right, on, how).drop(*names.values())


def is_materialized(df: DataFrame) -> bool:
    """True when the plan is a direct read of a checkpoint (no recomputation)."""
    try:
        node = df._jdf.queryExecution().analyzed()
        while node.nodeName() in ("Project", "SubqueryAlias") and node.children().size() == 1:
            node = node.children().apply(0)
        return node.nodeName() == "LogicalRDD"
    except Exception:  # pragma: no cover
        return False


def bounds_lookup(bounds: Column, v: Column, n_bounds: int) -> Column:
    """Number of (sorted) boundaries below ``v`` with about 2*sqrt(n) comparisons:
    count the block heads below ``v``, then the boundaries of that one block."""
    k = LOOKUP_BLOCK
    if n_bounds <= 2 * k:
        return F.size(F.filter(bounds, lambda b: b < v))
    if n_bounds > INLINE_BOUNDS:
        k = int(n_bounds ** 0.5) + 1
        heads = F.transform(F.sequence(F.lit(0), F.lit(n_bounds - 1), F.lit(k)), lambda i: F.get(bounds, i))
    else:
        heads = F.array(*[F.element_at(bounds, i + 1) for i in range(0, n_bounds, k)])
    c = F.size(F.filter(heads, lambda b: b < v))
    start = (c - 1) * F.lit(k)
    fine = F.size(F.filter(F.slice(bounds, start + 1, F.lit(k)), lambda b: b < v))
    return F.when(c == 0, F.lit(0)).otherwise(start + fine)


def _range_count(df: DataFrame) -> int:
    """Ranges of the whole table: the session's shuffle partitions, more where the
    plan's inputs hold over 256 MiB for each."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-(input_bytes(df) or 0) // BYTES_PER_BUCKET))


def range_buckets(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], buckets: int,
                  out: str = "_bkt") -> DataFrame:
    """Attach a monotone bucket id of any orderable key: rows are ranged by (group,
    order) and the partition is the bucket.  Written as a reliable checkpoint, since the
    ranges come from a sample and both phases must see the same ones; a lost executor
    costs a re-read."""
    return cut_lineage(df.repartitionByRange(buckets, *by, *order).withColumn(out, F.spark_partition_id()))


def _cut_groups(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of the (group, bucket) rows those of groups with several buckets."""
    w = Window.partitionBy(*by)
    return totals.withColumn("_cut", F.min("_bkt").over(w) < F.max("_bkt").over(w)).where("_cut").drop("_cut")


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "pos",
                buckets: int | None = None, totals: bool = False,
                ranges: Sequence[str | Column] | None = None) -> DataFrame:
    """Exact 1-based ``row_number()`` inside ``by`` in the order of the columns
    ``order`` (any types, nulls first), however large a group is; ``totals`` adds
    ``n_group``.  Rows that agree in all order columns are numbered arbitrarily.
    ``ranges`` gives shorter keys that never decrease in that order (the
    beginnings of long texts): the sample of the ranging holds them."""
    by, order = list(by), list(order)
    buckets = buckets or _range_count(df)
    b = range_buckets(df, by, ranges or order, buckets)
    here = Window.partitionBy(*by, "_bkt")
    local = b.withColumn(out, F.row_number().over(here.orderBy(*order)).cast("long"))
    if totals:
        local = local.withColumn("_bn", F.count(F.lit(1)).over(here))
    counts = _cut_groups(b.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_n")), by)
    w = Window.partitionBy(*by)
    offs = counts.select(*by, "_bkt", F.sum("_n").over(w).alias("_all"), (F.sum("_n").over(
        w.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_off"))
    # at most two rows for each cut between two ranges
    got = join_groups(local, offs, by + ["_bkt"], broadcast=True, how="left")
    got = got.withColumn(out, F.col(out) + F.coalesce("_off", F.lit(0)))
    if totals:
        got = got.withColumn("n_group", F.coalesce("_all", "_bn")).drop("_bn")
    return got.drop("_off", "_all", "_bkt")


def ordered_scan(df: DataFrame, by: Sequence[str], order_col: str,
                 sums: Sequence[str] = (), prevs: Sequence[str] = (),
                 carries: Sequence[str] = (), totals: bool = False, buckets: int | None = None,
                 bucket: str | Column | None = None, keep_bucket: bool = False) -> DataFrame:
    """One distributed pass over each group in ``order_col`` order.

    Adds, per row:
      * ``<c>_below``  sum of ``c`` over rows of the group strictly before it;
      * ``prev_<c>``   value of ``c`` on the row just before it (null on the first);
      * ``carry_<c>``  last non-null ``c`` at or before the row (forward fill);
      * ``<c>_total``  group total of ``c`` (when ``totals``), and ``n_group``.
    ``order_col`` must be unique inside a group (aggregate ties first).
    ``bucket`` may name an existing monotone bucket column or give an
    expression; by default the rows are ranged (:func:`range_buckets`).
    """
    by = list(by)
    if bucket is None:
        buckets = buckets or _range_count(df)
    if isinstance(bucket, str):
        b = df.withColumnRenamed(bucket, "_bkt") if bucket != "_bkt" else df
    elif bucket is not None:
        b = df.withColumn("_bkt", bucket)
    else:
        b = range_buckets(df, by, [order_col], buckets)
    ranged = bucket is None

    w = Window.partitionBy(*by, "_bkt").orderBy(order_col)
    wl = w.rowsBetween(Window.unboundedPreceding, -1)
    local_cols = {f"_loc_{c}": F.coalesce(F.sum(c).over(wl), F.lit(0)) for c in sums}
    local_cols.update({f"_lprev_{c}": F.lag(c).over(w) for c in prevs})
    local_cols.update({f"_lcar_{c}": F.last(c, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)) for c in carries})
    local_cols["_lrn"] = F.row_number().over(w)
    if totals and ranged:
        local_cols |= {f"_here_{c}": F.sum(c).over(Window.partitionBy(*by, "_bkt")) for c in [*sums]}
        local_cols["_here"] = F.count(F.lit(1)).over(Window.partitionBy(*by, "_bkt"))
    local = b.withColumns(local_cols)

    aggs = [F.sum(c).alias(f"_bt_{c}") for c in sums]
    aggs += [F.max_by(c, order_col).alias(f"_blast_{c}") for c in prevs]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))).alias(f"_bnn_{c}")
             for c in carries]
    aggs.append(F.count(F.lit(1)).cast("long").alias("_bn"))
    tot = b.groupBy(*by, "_bkt").agg(*aggs)
    if ranged:
        tot = _cut_groups(tot, by)
    wo = Window.partitionBy(*by).orderBy("_bkt")
    wob = wo.rowsBetween(Window.unboundedPreceding, -1)
    wg = Window.partitionBy(*by)
    off_cols = {f"_off_{c}": F.coalesce(F.sum(f"_bt_{c}").over(wob), F.lit(0)) for c in sums}
    off_cols.update({f"_pprev_{c}": F.lag(f"_blast_{c}").over(wo) for c in prevs})
    off_cols.update({f"_pcar_{c}": F.last(f"_bnn_{c}", ignorenulls=True).over(wob) for c in carries})
    if totals:
        off_cols.update({f"{c}_total": F.sum(f"_bt_{c}").over(wg) for c in sums})
        off_cols["n_group"] = F.sum("_bn").over(wg)
    offs = tot.withColumns(off_cols).select(*by, "_bkt", *off_cols.keys())

    # after ranging at most two rows for each cut between two ranges
    out = join_groups(local, offs, by + ["_bkt"], broadcast=ranged, how="left" if ranged else "inner")
    fin = {f"{c}_below": F.coalesce(f"_off_{c}", F.lit(0)) + F.col(f"_loc_{c}") for c in sums}
    if totals and ranged:
        fin |= {f"{c}_total": F.coalesce(f"{c}_total", f"_here_{c}") for c in sums}
        fin["n_group"] = F.coalesce("n_group", "_here")
    fin.update({f"prev_{c}": F.when(F.col("_lrn") == 1, F.col(f"_pprev_{c}"))
                .otherwise(F.col(f"_lprev_{c}")) for c in prevs})
    fin.update({f"carry_{c}": F.coalesce(F.col(f"_lcar_{c}"), F.col(f"_pcar_{c}")) for c in carries})
    out = out.withColumns(fin)
    drop = ([f"_loc_{c}" for c in sums] + [f"_off_{c}" for c in sums]
            + [f"_lprev_{c}" for c in prevs] + [f"_pprev_{c}" for c in prevs]
            + [f"_lcar_{c}" for c in carries] + [f"_pcar_{c}" for c in carries] + ["_lrn", "_here"]
            + [f"_here_{c}" for c in sums])
    out = out.drop(*drop)
    if not keep_bucket:
        out = out.drop("_bkt")
    return out


def positions(df: DataFrame, by: Sequence[str], order_col: str, out: str = "pos",
              buckets: int | None = None, hex_order: bool | str = False, totals: bool = False,
              bucket: str | None = None) -> DataFrame:
    """Exact 1-based ``row_number()`` inside ``by`` ordered by a unique
    ``order_col`` of any type without a window over the whole group.

    ``hex_order=True`` (or ``"md5"``) declares ``order_col`` an md5 hex
    digest, whose prefix is a balanced bucket with no quantile pass;
    ``hex_order="xxhash64"`` declares an xxhash64 order key (see
    ``exprs.order_key``).  ``totals`` adds ``n_group``.
    """
    if bucket is None and not hex_order:
        return row_numbers(df, by, [order_col], out, buckets, totals)
    buckets = buckets or _default_buckets(df)
    bcol = bucket if bucket is not None else order_bucket(
        order_col, buckets, "md5" if hex_order is True else hex_order)
    r = ordered_scan(df.withColumn("_one", F.lit(1).cast("long")), by, order_col, sums=["_one"],
                     buckets=buckets, bucket=bcol, totals=totals)
    r = r.withColumn(out, (F.col("_one_below") + 1).cast("long")).drop("_one", "_one_below")
    if totals:
        r = r.drop("_one_total")
    return r


#: Up to this rank Spark keeps only the first rows of each group in every task.
TOP_N = 1000


def first_per_group(df: DataFrame, by: Sequence[str], order_col: str, n: int, out: str) -> DataFrame:
    """The first ``n`` rows of each group with their rank: for small ``n`` a rank
    filter, which Spark plans as a top-n in each task before the shuffle; for
    larger ``n`` the two-phase positions."""
    if n <= TOP_N:
        w = Window.partitionBy(*by).orderBy(order_col)
        return df.withColumn(out, F.row_number().over(w).cast("long")).filter(F.col(out) <= n)
    return positions(df, by, order_col, out=out).filter(F.col(out) <= n)


def group_counts(df: DataFrame, by: Sequence[str], out: str = "_n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias(out))


def ntile_of(pos: Column, n: Column, k: int) -> Column:
    """0-based ``ntile(k)`` bucket of 1-based position ``pos`` among ``n``:
    the first ``n % k`` tiles are one row larger (numpy.array_split rule)."""
    q = F.floor(n / F.lit(k)).cast("long")
    r = (n - q * F.lit(k)).cast("long")
    big = r * (q + 1)
    return F.when(pos <= big, F.floor((pos - 1) / (q + 1))).otherwise(
        r + F.floor((pos - 1 - big) / F.greatest(q, F.lit(1)))).cast("int")


#: Ranks that a quantile's bracket reaches to each side, in errors of the sketch.
BRACKET = 2


def _brackets(bounds: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted edges of a group's brackets (lo of each quantile, then hi of each), and which
    gaps between them lie inside a bracket (gap i ends at edge i)."""
    edges = np.unique(bounds)
    inside = np.zeros(len(edges) + 2, np.int64)
    np.add.at(inside, np.searchsorted(edges, bounds[:m]) + 1, 1)
    np.add.at(inside, np.searchsorted(edges, bounds[m:]) + 1, -1)
    return edges, np.cumsum(inside)[:len(edges) + 1] > 0


def _bracketed(table):
    """(group, value) -> counts of the places (odd: an edge, even: a gap), with the values
    where the place is an edge or lies in a bracket."""
    schema = pa.schema([("_g", pa.int32()), ("_place", pa.int32()), ("_v", pa.float64()), ("_cnt", pa.int64())])

    def rows(g, place, v, cnt):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(place), g), pa.int32()), pa.array(place, pa.int32()), v, pa.array(cnt, pa.int64())],
            schema=schema)

    def run(batches):
        groups = {g: _brackets(b, m) for g, (b, m) in table.value.items()}
        counts = {g: np.zeros(2 * len(e) + 1, np.int64) for g, (e, _) in groups.items()}
        for batch in batches:
            g, v = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            order = np.lexsort((v, g))
            g, v = g[order], v[order]
            cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                edges, inside = groups[int(g[a])]
                x = v[a:b]
                at = np.searchsorted(edges, x)
                place = at + np.searchsorted(edges, x, side="right")
                kept = (place % 2 == 0) & inside[at]
                counts[int(g[a])] += np.bincount(place[~kept], minlength=2 * len(edges) + 1)
                if kept.any():
                    x, place = x[kept], place[kept]
                    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                    yield rows(int(g[a]), place[first], pa.array(x[first]), np.diff(np.r_[first, len(x)]))
        for g, c in counts.items():
            place = np.flatnonzero(c)
            edges = groups[g][0]
            v = edges[np.minimum(place // 2, len(edges) - 1)]
            yield rows(g, place, pa.array(v, mask=place % 2 == 0), c[place])
    return run


def exact_quantiles(long: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    buckets: int | None = None, accuracy: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy's default method) per group.

    Spark's exact ``percentile`` keeps every distinct value of a group in one
    task's memory.  Here the input is read twice and neither copied nor sorted:

    1. a mergeable rank sketch per group (``percentile_approx``) brackets every
       quantile by the sketch's error to both sides;
    2. each task counts its values between the brackets' edges and passes on only the
       distinct values inside a bracket with their counts (a share of about
       ``4 * #probs / accuracy``, at most a fifth by default);
    3. cumulative counts over the brackets' edges give each target rank its bracket, and
       an ordered scan over the values of the brackets hit gives its value.

    The counts are exact, so the sketch decides only how much is passed on.  The
    edges of all groups are broadcast; beyond ``BROADCAST_BOUNDS_BYTES`` the
    quantiles come from two ordered scans (:func:`_scan_quantiles`).  Null values are
    ignored.  Output: by..., ``p_idx`` (int), ``p``, ``q``.
    """
    by, probs = list(by), [float(p) for p in probs]
    m = len(probs)
    accuracy = accuracy or max(10000, 20 * m)
    off = BRACKET / accuracy
    at = [max(0.0, p - off) for p in probs] + [min(1.0, p + off) for p in probs]
    long = long.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    marks = cut_lineage(long.groupBy(*by).agg(F.percentile_approx("_v", at, accuracy).alias("_b"),
                                              F.count(F.lit(1)).alias("_n"))
                        .withColumn("_g", F.monotonically_increasing_id()))
    n_groups = marks.count()
    if n_groups * (2 * m + 8) * 8 > BROADCAST_BOUNDS_BYTES:
        return _scan_quantiles(long, by, "_v", probs, buckets)
    rows = marks.collect()                              # edges of all groups, size checked
    spark = long.sparkSession
    number = {r["_g"]: i for i, r in enumerate(rows)}
    table = spark.sparkContext.broadcast({i: (np.asarray(r["_b"], np.float64), m) for i, r in enumerate(rows)})
    ids = spark.createDataFrame([(int(g), i) for g, i in number.items()], "_g long, _i int")
    names = marks.join(F.broadcast(ids), "_g").select(*by, F.col("_i").alias("_g"), "_n")
    keyed = join_groups(long, names.drop("_n"), by, broadcast=True) if by else long.withColumn("_g", F.lit(0))
    held = keyed.select("_g", "_v").mapInArrow(_bracketed(table), "_g int, _place int, _v double, _cnt long")
    held = cut_lineage(held.groupBy("_g", "_place", "_v").agg(F.sum("_cnt").alias("_cnt")))
    # each target rank's place: a few rows for each quantile of each group
    w = Window.partitionBy("_g").orderBy("_place")
    places = held.groupBy("_g", "_place").agg(F.sum("_cnt").alias("_c"), F.max("_v").isNotNull().alias("_known"))
    places = places.withColumn("_from", F.sum("_c").over(w) - F.col("_c"))
    h = (F.col("_n") - 1).cast("double") * F.col("p")
    targets = (names.select("_g", "_n", F.posexplode(F.array(*[F.lit(p) for p in probs])).alias("p_idx", "p"))
               .select("_g", F.col("p_idx").cast("int").alias("p_idx"), "p", h.alias("_h"),
                       F.explode(F.array(F.floor(h).cast("long"), F.ceil(h).cast("long"))).alias("_r")).distinct())
    both = places.select("_g", F.col("_from").alias("_at"), F.lit(0).alias("_kind"), "_place", "_known", "_from",
                         *[F.lit(None).cast(t).alias(c) for c, t in (("p_idx", "int"), ("p", "double"),
                                                                    ("_h", "double"), ("_r", "long"))]).union(
        targets.select("_g", F.col("_r").alias("_at"), F.lit(1).alias("_kind"),
                       *[F.lit(None).cast(t) for t in ("int", "boolean", "long")], "p_idx", "p", "_h", "_r"))
    wt = Window.partitionBy("_g").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    hits = both.withColumns({c: F.last(c, ignorenulls=True).over(wt) for c in ("_place", "_known", "_from")}) \
        .where("_kind = 1").select("_g", "_place", "_known", (F.col("_r") - F.col("_from")).alias("_k"), "p_idx", "p",
                                   "_h", "_r")
    hits = cut_lineage(hits)
    if hits.where("not _known").limit(1).count():       # a sketch beyond its error bound
        return _scan_quantiles(long, by, "_v", probs, buckets)
    values = held.where("_v is not null").join(F.broadcast(hits.select("_g", "_place").distinct()), ["_g", "_place"])
    values = ordered_scan(values, ["_g", "_place"], "_v", sums=["_cnt"], buckets=buckets)
    k = F.col("_k")
    got = values.join(F.broadcast(hits), ["_g", "_place"]).where(
        (k >= F.col("_cnt_below")) & (k < F.col("_cnt_below") + F.col("_cnt")))
    piv = got.groupBy("_g", "p_idx", "p", "_h").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    t = F.col("_h") - F.floor("_h")
    q = (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * t).alias("q")
    return piv.join(F.broadcast(names.drop("_n")), "_g").select(*by, "p_idx", "p", q)


def _scan_quantiles(long: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    buckets: int | None = None) -> DataFrame:
    """:func:`exact_quantiles` for groups too many for a broadcast, by two ordered scans:
    distinct values with counts -> cumulative counts (rank ranges); then the
    target ranks ``floor/ceil((n-1)p)`` are merged into the ordered values and
    pick up the value covering them by a forward fill.  The second scan reuses
    the first scan's buckets (a target goes to the bucket whose first rank
    precedes it), so it needs no new boundaries and no extra materialisation.
    Output: by..., ``p_idx`` (int), ``p``, ``q``.
    """
    by = list(by)
    c = cut_lineage(long.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).cast("long").alias("_cnt")))
    s = ordered_scan(c, by, "_v", sums=["_cnt"], buckets=buckets, keep_bucket=True)
    data = s.select(*by, "_bkt", (F.col("_cnt_below") * 2).cast("long").alias("_ord"), "_v")
    n = c.groupBy(*by).agg(F.sum("_cnt").alias("_n"))
    # first rank of every bucket, per group (#groups x #buckets rows)
    starts = (data.groupBy(*by, "_bkt").agg(F.min("_ord").alias("_s"))
              .groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_s", "_bkt"))).alias("_starts")))
    parr = F.array(*[F.lit(float(p)) for p in probs])
    h = (F.col("_n") - 1).cast("double") * F.col("p")
    # one row per (group, prob, side): bounded by #groups x #probs
    tg = (n.select(*by, "_n", F.posexplode(parr).alias("p_idx", "p"))
          .withColumn("p_idx", F.col("p_idx").cast("int"))
          .withColumn("_h", h)
          .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
          .withColumn("_r", F.when(F.col("_side") == 0, F.floor("_h")).otherwise(F.ceil("_h")).cast("long"))
          .select(*by, "p_idx", "p", "_h", "_side", (F.col("_r") * 2 + 1).alias("_ord"),
                  F.lit(None).cast("double").alias("_v")))
    if by:
        tg = join_groups(tg, starts, by)
    else:  # one row of #buckets entries: read once, inlined as a literal
        row = starts.first()
        lit = F.array(*[F.struct(F.lit(int(e["_s"])).alias("_s"), F.lit(int(e["_bkt"])).alias("_bkt"))
                        for e in (row["_starts"] if row is not None else [])])
        tg = tg.withColumn("_starts", lit)
    t_ord = F.col("_ord")
    k = F.size(F.filter(F.col("_starts"), lambda st: st["_s"] < t_ord))
    tg = tg.withColumn("_bkt", F.element_at(F.col("_starts"), F.greatest(k, F.lit(1)))["_bkt"]).drop("_starts")
    u = data.select(*by, F.lit(None).cast("int").alias("p_idx"), F.lit(None).cast("double").alias("p"),
                    F.lit(None).cast("double").alias("_h"), F.lit(None).cast("int").alias("_side"),
                    "_ord", "_v", "_bkt").unionByName(tg)
    u = ordered_scan(u, by, "_ord", carries=["_v"], bucket="_bkt").filter(F.col("p_idx").isNotNull())
    piv = u.groupBy(*by, "p_idx", "p", "_h").agg(
        F.max(F.when(F.col("_side") == 0, F.col("carry__v"))).alias("_lo"),
        F.max(F.when(F.col("_side") == 1, F.col("carry__v"))).alias("_hi"))
    t = F.col("_h") - F.floor("_h")
    return piv.select(*by, "p_idx", "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * t).alias("q"))
