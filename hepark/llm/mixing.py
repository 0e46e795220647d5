"""Mixing sources to target weights by systematic sampling.

A source's target is its weighted share of the mix, stopped at ``max_repeats``
times its size, the excess reshared by weight.  A document's expected number of
copies is target / source size; within a source the expectations are
prefix-summed over documents ordered by size, one offset is added, and a
document is emitted once for each integer that its interval crosses.  Ordering
by size keeps the words taken near the target, not only the documents.

The prefix sum is ``rate * rank``; the rank within a source comes from counts
per (source, size class, hash bucket) and a row number inside a bucket of about
``BUCKET_ROWS`` rows, so no task holds a whole source, however hot.  Order and
offsets come from md5 of ids and names: reruns agree.

Edge cases: null or empty text has size 0 and takes nothing; a null source is a
source of its own, last in the weight order; a null doc_id takes part like any
other id; repeated rows count as documents of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hepark.llm.common import WORD, free_name, staged

BUCKET_ROWS = 1000


def _unit(text: Column) -> Column:
    """md5 of a text as a number in [0, 1) with 32 bits."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _size_class(size: Column) -> Column:
    """Monotone in size: number of digits, then the first two digits."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(F.rpad(digits, 2, "0"), 1, 2).cast("int")


def source_targets(sizes: DataFrame, ratio: float, max_repeats: float,
                   weights: tuple[float, ...]) -> DataFrame:
    """(source key, source_size, target) for each source; one row per source.

    The water level ``t`` with ``sum(min(cap, t * weight)) = ratio * total`` is
    found from the sources in order of cap / weight."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src").isNull(), "src")
    pos = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.select("src", "source_size", (F.lit(float(max_repeats)) * F.col("source_size")).alias("cap"),
                     F.element_at(F.array(*[F.lit(float(w)) for w in weights]), pos + 1).alias("w"))
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").isNull(), "src")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumn("t", (F.lit(float(ratio)) * F.sum("source_size").over(every)
                               - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                         / F.sum("w").over(after))
    fits = F.when(F.col("t") <= F.col("cap") / F.col("w"), F.col("t"))
    return per.withColumn("t", F.max(fits).over(every)).select(
        "src", "source_size",
        F.when(F.col("t").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("t") * F.col("w"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", ratio: float = 1.5, max_repeats: float = 2.0,
                weights: tuple[float, ...] = (5, 2, 1), seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every document."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    docs = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                              F.col(source_col).cast("string").alias("src"), size.alias("size")), "mix-sizes")
    targets = source_targets(docs, ratio, max_repeats, weights).select(
        F.col("src").alias("src_t"), "source_size", "target")
    docs = docs.join(targets, F.col("src").eqNullSafe(F.col("src_t"))).drop("src_t")
    docs = docs.select("*", _size_class(F.col("size")).alias("cls"),
                       F.coalesce(_unit(F.col("doc_id").cast("string")), F.lit(0.0)).alias("h"))
    strata = docs.groupBy("src", "cls").agg(F.count("*").alias("rows")).select(
        F.col("src").alias("src_s"), F.col("cls").alias("cls_s"),
        F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"))
    docs = docs.join(strata, F.col("src").eqNullSafe(F.col("src_s")) & (F.col("cls") == F.col("cls_s"))) \
        .withColumn("bucket", F.floor(F.col("h") * F.col("buckets"))).drop("src_s", "cls_s", "buckets")
    docs = staged(docs, "mix-strata")
    ahead = Window.partitionBy("src").orderBy("cls", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = docs.groupBy("src", "cls", "bucket").agg(F.count("*").alias("rows")).select(
        F.col("src").alias("src_o"), F.col("cls").alias("cls_o"), F.col("bucket").alias("bucket_o"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("offset"))
    docs = docs.withColumn("rn", F.row_number().over(
        Window.partitionBy("src", "cls", "bucket").orderBy("h", "doc_id"))) \
        .join(offsets, F.col("src").eqNullSafe(F.col("src_o")) & (F.col("cls") == F.col("cls_o"))
              & (F.col("bucket") == F.col("bucket_o")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("offset") + F.col("rn")).cast("double")
    u = _unit(F.concat(F.lit(seed + ":"), F.coalesce("src", F.lit(""))))
    crossed = F.floor(u + rank * rate) - F.floor(u + (rank - 1) * rate)
    copies = F.least(F.lit(int(-(-max_repeats // 1))), F.greatest(F.lit(0), crossed)).cast("long")
    return docs.select("doc_id", "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row once per copy; a text without words is not
    emitted.  Rows that share an id share the larger number of copies."""
    taken = mix_sources(docs, **options).where("size > 0").groupBy("doc_id").agg(F.max("copies").alias("n"))
    key, n, at = (free_name(docs, c) for c in ("mix_id", "mix_copies", "mix_copy"))
    both = docs.join(taken.select(F.col("doc_id").alias(key), F.col("n").alias(n)).hint("merge"),
                     F.col("doc_id").eqNullSafe(F.col(key)))
    words = F.regexp_count(F.col(options.get("text_col", "text")).cast("string"), F.lit(WORD)) > 0
    return both.where((F.col(n) > 0) & words).withColumn(
        at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS src,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1] AS w FROM p),
t AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM w),
g AS (SELECT src, source_size, least(cap, w * max(CASE WHEN t <= cap / w THEN t END) OVER ()) AS target FROM t),
r AS (SELECT d.doc_id, d.src, d.size, g.source_size, g.target,
             CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.src ORDER BY length(d.size::VARCHAR) * 100 + rpad(d.size::VARCHAR, 2, '0')[1:2]::INT,
                 md5(d.doc_id::VARCHAR)[1:8], d.doc_id)::DOUBLE AS rank,
             ('0x' || md5('mix:' || coalesce(d.src, ''))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN g ON d.src IS NOT DISTINCT FROM g.src)
SELECT doc_id, size, source_size, target,
       ((floor(u + rank * rate) - floor(u + (rank - 1) * rate)) * size)::BIGINT AS taken FROM r
"""
