"""Column-expression helpers (JVM-side Spark expressions)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: float32 machine epsilon (numpy.finfo(float32).eps) and the
# log clamp used by binary cross-entropy
FLOAT32_EPS = 1.1920928955078125e-07
LOG_CLAMP = -100.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


ROUND_LIMIT = 1e12  # |x| at or above this is returned unrounded (no BIGINT overflow)


def rnd(c, digits: int = 6) -> Column:
    """Round half up as floor(x*10^d + 0.5)/10^d.

    Written with IEEE operations only, so the same double comes out of Spark
    and DuckDB for the same input.  Magnitudes from ``ROUND_LIMIT`` up pass
    through unchanged, so the BIGINT ``floor`` cannot overflow under ANSI.
    """
    s = float(10 ** digits)
    x = col(c).cast("double")
    r = (F.floor(x * F.lit(s) + F.lit(0.5)) / F.lit(s)).cast("double")
    return F.when(F.abs(x) < F.lit(ROUND_LIMIT), r).otherwise(x)


def sql_rnd(expr: str, digits: int = 6) -> str:
    """DuckDB twin of :func:`rnd`."""
    s = f"{10 ** digits}.0::DOUBLE"
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < {ROUND_LIMIT!r}::DOUBLE THEN floor({x} * {s} + 0.5) / {s} "
            f"ELSE {x} END)")


def order_key(cols: Sequence[str] | str, seed: int, hash: str = "md5") -> Column:
    """Seeded pseudo-random order key.

    ``md5`` (default): md5 hex of the key columns and the seed - identical in
    Spark and DuckDB, so the shuffle is reproducible and checkable.
    ``xxhash64``: ``struct(xxhash64(key, seed), key...)`` - about 15x cheaper
    to compute; the key makes it unique despite 64-bit hash collisions.
    Never ``rand()`` on tested paths.
    """
    if isinstance(cols, str):
        cols = [cols]
    if hash == "xxhash64":
        return F.struct(F.xxhash64(*[F.col(c) for c in cols], F.lit(int(seed))).alias("h"),
                        *[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])
    if hash != "md5":
        raise TypeError(f"unknown order hash {hash!r}")
    parts = []
    for c in cols:
        parts += [F.col(c).cast("string"), F.lit("|")]
    parts.append(F.lit(str(int(seed))))
    return F.md5(F.concat(*parts))


def sql_order_key(cols: Sequence[str] | str, seed: int) -> str:
    if isinstance(cols, str):
        cols = [cols]
    parts = []
    for c in cols:
        parts += [f"CAST({c} AS VARCHAR)", "'|'"]
    parts.append(f"'{int(seed)}'")
    return "md5(concat(" + ", ".join(parts) + "))"


def hex_bucket(h, buckets: int) -> Column:
    """Monotone bucket of an md5 hex string into ``buckets`` equal ranges.

    The leading 8 hex digits are uniform, so buckets are balanced no matter
    how the keys are distributed.
    """
    lead = F.conv(F.substring(col(h), 1, 8), 16, 10).cast("double")
    return F.floor(lead * F.lit(float(buckets)) / F.lit(4294967296.0)).cast("int")


def order_bucket(ord_col, buckets: int, hash: str = "md5") -> Column:
    """Monotone, balanced bucket of an order key made by :func:`order_key`."""
    if hash == "md5":
        return hex_bucket(ord_col, buckets)
    h = col(ord_col)["h"].cast("double")
    b = F.floor((h + F.lit(9.223372036854775807e18)) / F.lit(1.8446744073709552e19) * F.lit(float(buckets)))
    return F.least(F.greatest(b, F.lit(0)), F.lit(buckets - 1)).cast("int")
