"""Corpus pipeline over ``documents``: toxicity, line dedup, near dedup,
benchmark decontamination, mixing.

Lists of ids grow with the corpus, so joins on them are merged and never broadcast.
Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's
input.  All but the last return the columns of ``documents``.

doc_id is the key.  A null doc_id passes the filters but for toxicity and line dedup, which
judge its text, and is emitted as the mixing asks; null or empty texts are kept until the mixing,
which does not emit them; equal rows share their fate; an empty table gives no rows; extra
columns pass through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hepark.llm import cgk, linededup, minhash, mixing, toxicity
from hepark.llm.common import free_name
from hepark.session import checkpoint_dir


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier predicts toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, labels)


def dedup_lines(spark, docs, sf_dir):
    """Later repeats of runs of three lines or 50 words or more go; so does a document
    all of whose lines went.  ``n_chars`` follows the text."""
    key, h1, h2, text = (free_name(docs, c) for c in ("line_id", "line_h1", "line_h2", "line_text"))
    cut = linededup.dedup_lines(docs).select(F.col("doc_id").alias(key), F.col("h1").alias(h1), F.col("h2").alias(h2),
                                             F.col("text").alias(text))
    whole = F.coalesce(F.col("text"), F.lit(""))
    both = docs.join(cut.hint("merge"), F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(whole) == F.col(h1))
                     & (F.xxhash64(F.lit("second"), whole) == F.col(h2)), "left")
    cols = {"text": F.coalesce(text, "text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(
            F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    return both.where(F.col(text).isNull() | (F.col(text) != "")).withColumns(cols).select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates (five-word shingles, as stages take them; the query
    op7 takes four) the smallest doc_id stays."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = cgk.contaminations(docs, items).select("doc_id").distinct()
    return docs.join(leaks.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Each document as often as its source's target asks."""
    return mixing.emit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The stages learn, hash and walk: SQL cannot express them.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Every stage in order, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
