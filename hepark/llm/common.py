"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hepark.operators.ranking import row_numbers
from hepark.session import checkpoint_dir

#: A word: a maximal run of anything but space, tab, newline, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` (with the writer's ``options``) to the cluster's shared checkpoint
    folder and read it back.

    Cuts the lineage with files every executor can read, so that a lost
    executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, so that extra
    columns of the input cannot clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_key() -> list:
    """128 bits of the text, as two columns."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")]


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with a doc_id for every distinct document, and what stands for what.

    Where each doc_id names one text, the rows come back as they are, with None.
    Otherwise - null ids, or rows that share an id but not the text - every distinct
    (doc_id, text) gets a number in the order of doc_id (null last), then of a hash of its text;
    the second table holds (number, doc_id).  Equal rows share a number."""
    keys = docs.select("doc_id", *text_key())
    h = F.struct("h1", "h2")
    if not keys.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")) \
            .where("doc_id is null or lo <> hi").limit(1).count():
        return docs, None
    rows = keys.distinct().withColumn("last", F.col("doc_id").isNull())
    names = staged(row_numbers(rows, [], ["last", "doc_id", "h1", "h2"], "number")
                   .select("number", F.col("doc_id").alias("id"), "h1", "h2"), "numbers")
    d = docs.select("doc_id", "text", *text_key()).alias("d")
    n = names.alias("n").hint("merge")
    on = F.col("d.doc_id").eqNullSafe(F.col("n.id")) & (F.col("d.h1") == F.col("n.h1")) & (F.col("d.h2") == F.col("n.h2"))
    return staged(d.join(n, on).select(F.col("number").alias("doc_id"), "text"), "numbered"), \
        names.select("number", F.col("id").alias("doc_id"))


def renamed(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """Rows with the doc_ids that their numbers stand for."""
    if names is None:
        return rows
    cols = rows.columns
    return rows.withColumnRenamed("doc_id", "number").join(names.hint("merge"), "number").select(*cols)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use (in any case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name
