"""Sources and sinks.

Datasets are plain parquet folders.  Feature splits are one table
partitioned by ``norm`` and ``split`` (partition pruning replaces the
reference's one-file-per-split naming); metric vectors are float32 parquet;
models are a weight table plus a JSON config.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hepark.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                fmt: str = "parquet") -> DataFrame:
    """A1: one class's raw event table; partitions replace chunked reading."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true")
    return r.load(path)


#: Written into a norm's folder before the folder is moved into place.
MANIFEST = "_manifest.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that is not needed any more."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def norm_folder(spark: SparkSession, path: str, norm: str) -> str:
    """A norm's folder in the store, with Spark's own escapes for partition names."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(norm)
    return f"{path}/norm={name}"


def has_norm(spark: SparkSession, path: str, norm: str) -> bool:
    """Does the feature store hold this norm, committed as a whole?  (One file system
    lookup, so it can be asked before any fit is run.)  A folder without manifest - left
    by a writer that died - does not count."""
    fs, p = _fs(spark, f"{norm_folder(spark, path, norm)}/{MANIFEST}")
    return fs.exists(p)


def norm_manifest(spark: SparkSession, path: str, norm: str) -> dict:
    """Rows per split of a committed norm."""
    fs, p = _fs(spark, f"{norm_folder(spark, path, norm)}/{MANIFEST}")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_norm(df: DataFrame, path: str, norm: str, before=None) -> None:
    """Write one norm's rows (with a ``split`` column) so that it appears in the store
    as a whole or not at all.

    The rows go to a staging folder that readers skip; ``before`` may look at them;
    the manifest (rows per split) is added; the folder is renamed into place, which is atomic
    on HDFS and POSIX file systems.  A norm of this name, or what a failed
    writer left of it, is replaced as a whole; other norms are not touched."""
    spark = df.sparkSession
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    df.write.partitionBy("split").parquet(staging)
    rows = spark.read.parquet(staging)
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    if before is not None:
        before(rows)
    fs, manifest = _fs(spark, f"{staging}/{MANIFEST}")
    out = fs.create(manifest, True)
    out.write(bytearray(json.dumps({"norm": norm, "splits": counts}).encode()))
    out.close()
    _, source = _fs(spark, staging)
    _, target = _fs(spark, norm_folder(spark, path, norm))
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"could not move {staging} to {target}")


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A3/A5: one parquet table partitioned by norm and split.  ``overwrite``
    replaces the norms that ``df`` holds, each as a whole (:func:`commit_norm`), and leaves
    the others; ``ignore`` writes only the norms that the table does not hold yet."""
    if mode not in ("overwrite", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    for norm in [r["norm"] for r in df.select("norm").distinct().collect()]:   # a handful of names
        if mode == "overwrite" or not has_norm(spark, path, norm):
            commit_norm(df.filter(F.col("norm") == norm).drop("norm"), path, norm)


def write_norm_once(spark: SparkSession, path: str, norm: str, build) -> bool:
    """A5: run ``build()`` (fit, apply, split) and commit its rows only if this norm
    is not in the store; tells whether it ran."""
    if has_norm(spark, path, norm):
        return False
    commit_norm(build().drop("norm"), path, norm)
    return True


def read_split(spark: SparkSession, path: str, norm: str, split: str) -> DataFrame:
    """A4: one split of one norm (partition pruning).  Raises when absent."""
    df = spark.read.parquet(path).filter((F.col("norm") == norm) & (F.col("split") == split))
    if df.limit(1).count() == 0:
        raise FileNotFoundError(f"no rows for norm={norm!r} split={split!r} under {path}")
    return df


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: tuple[str, ...] = ("model",)) -> None:
    """Metric vectors as float32."""
    cols = [F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name) for f in df.schema.fields]
    w = df.select(*cols).write.mode(mode)
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


def write_auc_sum(df: DataFrame, path: str, col: str = "auc", mode: str = "overwrite") -> None:
    """The AUC sum as '%.3f' text."""
    df.agg(F.format_string("%.3f", F.sum(col)).alias("value")).coalesce(1).write.mode(mode).text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Per-fold metric vectors of several models (partition column model)."""
    return spark.read.parquet(path)


def write_latent(df: DataFrame, path: str, mode: str = "overwrite", label: str = "y") -> None:
    """Latent / score arrays per class.  ``overwrite`` replaces the classes that
    ``df`` holds and leaves the others, so classes may be written one after another."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(label).parquet(path)


def save_model(spark: SparkSession, net: dict, path: str, mode: str = "overwrite") -> None:
    """Weights parquet + config JSON."""
    from hepark.operators.scoring import network_config, network_table
    network_table(spark, net).write.mode(mode).parquet(f"{path}/weights")
    spark.createDataFrame([(network_config(net),)], "config string").coalesce(1) \
         .write.mode(mode).text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> dict:
    """Rebuild the network (size = #weights, bounded by the layout)."""
    from hepark.operators.scoring import network_from_table
    cfg = spark.read.text(f"{path}/config").first()[0]
    rows = spark.read.parquet(f"{path}/weights").collect()
    return network_from_table(rows, cfg)


def load_hyperparameters(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/config").first()[0])
