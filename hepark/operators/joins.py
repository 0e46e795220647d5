"""Keyed pairing and stacking.

The reference pairs features and labels by position; here every row carries
a key and pairing is an equi-join on it.  Catalyst picks the strategy: with
AQE a side whose *runtime* size is under the broadcast threshold is
broadcast, otherwise both sides shuffle on the key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_labels(x: DataFrame, y: DataFrame, on: str | Sequence[str] = "k",
                  how: str = "inner") -> DataFrame:
    """Pair feature rows with label rows on their key."""
    return x.join(y, on, how)


def stack_classes(sig: DataFrame, bkg: DataFrame) -> DataFrame:
    """Union all of the two classes (columns matched by name)."""
    return sig.unionByName(bkg)


def pair_reco(x: DataFrame, xr: DataFrame, key: str = "k", x_col: str = "x",
              xr_col: str = "recon", keep: Sequence[str] = ("y",)) -> DataFrame:
    """C4: input and reconstruction of the same row, feature by feature.

    Both arrays are brought onto one row by the key join, then zipped and
    exploded: ``(key, keep..., feature, input, recon)``."""
    j = x.select(key, *keep, x_col).join(xr.select(key, xr_col), key, "inner")
    z = F.arrays_zip(F.col(x_col).cast("array<double>").alias("input"),
                     F.col(xr_col).cast("array<double>").alias("recon"))
    return (j.select(key, *keep, F.posexplode(z).alias("feature", "_z"))
            .select(key, *keep, F.col("feature").cast("int"),
                    F.col("_z.input").alias("input"), F.col("_z.recon").alias("recon")))
