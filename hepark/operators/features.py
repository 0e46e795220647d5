"""Feature construction: cuts, object flattening, derived columns."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hepark.operators.ranking import first_per_group, positions

# fixed values: object layout of the flat feature vector
N_JETS = 7
N_LEPS = 1
JET_SLOTS_RAW = 10
JET_FEATS = ["pt", "eta", "phi", "en", "px", "py", "pz"]
JET_FEATS_BTAG = ["pt", "eta", "phi", "en", "px", "py", "pz", "btag"]
MET_FEATS = ["phi", "pt", "px", "py"]
LEP_FEATS = ["pt", "eta", "phi", "en", "px", "py", "pz"]
SELECTION = "nleps = 1 AND nbtags >= 2 AND njets >= 4"
BTAG_THRESHOLD = 1

# fixed values: display names of the feature kinds
JET_LABELS = {"pt": "pt", "eta": "eta", "phi": "phi", "en": "energy", "px": "px", "py": "py",
              "pz": "pz", "btag": "btag"}
MET_LABELS = {"phi": "phi", "pt": "pt", "px": "px", "py": "py"}


# ------------------------------------------------------------------ B1, B2, B3

def binarise(df: DataFrame, cols: Sequence[str], thr: float = BTAG_THRESHOLD) -> DataFrame:
    """``col >= thr -> 1.0 else 0.0`` (Spark ML's Binarizer is strict ``>``)."""
    return df.withColumns({c: F.when(F.col(c) >= F.lit(thr), F.lit(1.0)).otherwise(F.lit(0.0))
                           for c in cols})


def select_events(df: DataFrame, predicate: str = SELECTION) -> DataFrame:
    """Event selection; a plain filter so parquet pushdown applies."""
    return df.filter(F.expr(predicate))


def _is(kind: str | None, value) -> F.Column:
    return F.lit(True) if kind is None else F.col(kind) == F.lit(value)


def count_objects(objs: DataFrame, event: str = "event_id", btag: str | None = "btag",
                  count_name: str = "njets", tag_name: str = "nbtags",
                  thr: float = BTAG_THRESHOLD, kind: str | None = None,
                  other_name: str = "nleps") -> DataFrame:
    """Object counts per event (partial aggregation before the shuffle).  With a ``kind``
    column the table holds both kinds of objects (0: jets, 1: leptons) and one aggregate
    counts jets, tagged jets and leptons."""
    jet = _is(kind, 0)
    aggs = [F.sum(F.when(jet, 1).otherwise(0)).cast("int").alias(count_name)]
    if btag is not None:
        aggs.append(F.sum(F.when(jet & (F.col(btag) >= F.lit(thr)), 1).otherwise(0)).cast("int").alias(tag_name))
    if kind is not None:
        aggs.append(F.sum(F.when(_is(kind, 1), 1).otherwise(0)).cast("int").alias(other_name))
    return objs.groupBy(event).agg(*aggs)


# ------------------------------------------------------------------ B4, B5

def flatten_topk(objs: DataFrame, event: str = "event_id", order: str = "pt", n: int = N_JETS,
                 feats: Sequence[str] = JET_FEATS, prefix: str = "jets", pad: float = 0.0,
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Keep the ``n`` leading objects of each event by ``order`` descending and
    lay them out object-major, feature-minor as ``<prefix>_<feat>_<slot>``.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before the
    shuffle, so even an event holding a huge share of all objects sends at
    most ``n`` rows per input partition.  Missing slots are ``pad``.
    """
    w = Window.partitionBy(event).orderBy(F.col(order).desc(), *[F.col(c) for c in tiebreak])
    ranked = objs.withColumn("_slot", F.row_number().over(w)).filter(F.col("_slot") <= n)
    aggs = [F.max(F.when(F.col("_slot") == i + 1, F.col(f).cast("double"))).alias(f"{prefix}_{f}_{i}")
            for i in range(n) for f in feats]
    wide = ranked.groupBy(event).agg(*aggs)
    cols = [f"{prefix}_{f}_{i}" for i in range(n) for f in feats]
    return wide.fillna(pad, subset=cols)


def _leading_in_batch(n: int, thr: float):
    """Of each event and kind in a batch the ``n`` leading objects; the first of them
    carries the counts of all (columns: event, kind, order, tag, objects' features)."""
    def run(batches):
        for batch in batches:
            event, kind, order, tag = (batch.column(i) for i in range(4))
            rows = pa.RecordBatch.from_arrays([event, kind, order], names=["e", "k", "o"])
            at = pc.sort_indices(rows, sort_keys=[("e", "ascending"), ("k", "ascending"), ("o", "descending")])
            event, kind = event.take(at), kind.take(at)
            new = np.ones(len(at), bool)
            if len(at) > 1:
                same = pc.and_(pc.equal(event[1:], event[:-1]), pc.equal(kind[1:], kind[:-1]))
                null = pc.and_(pc.and_(event[1:].is_null(), event[:-1].is_null()), pc.equal(kind[1:], kind[:-1]))
                new[1:] = ~(np.asarray(same.fill_null(False)) | np.asarray(null.fill_null(False)))
            first = np.flatnonzero(new)
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            tagged = np.nan_to_num(np.asarray(tag.take(at).cast(pa.float64()).fill_null(0.0))) >= thr
            kept = pa.array(np.flatnonzero(rank < n))
            sums = [np.zeros(len(at), np.int64) for _ in range(2)]
            if len(first):
                sums[0][first] = np.diff(np.r_[first, len(at)])
                sums[1][first] = np.add.reduceat(tagged.astype(np.int64), first)
            out = [c.take(at.take(kept)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(s).take(kept) for s in sums)],
                                             names=[*batch.schema.names, "_n", "_tags"])
    return run


def event_objects(objs: DataFrame, event: str = "event_id", kind: str = "is_lep", order: str = "pt",
                  btag: str = "btag", jet_feats: Sequence[str] = JET_FEATS, lep_feats: Sequence[str] = LEP_FEATS,
                  n_jets: int = N_JETS, n_leps: int = N_LEPS, thr: float = BTAG_THRESHOLD) -> DataFrame:
    """B3, B4 and B5 from one shuffle on the event key: per event the counts ``njets``,
    ``nbtags``, ``nleps`` and, as arrays of structs in descending ``order``, the leading
    ``jets`` and ``leps`` (``kind`` 0 and 1).

    Before the shuffle each batch of objects is cut to the leading ones of every event
    and kind, with the counts of all, so an event that holds a huge share of all objects
    sends a few rows a batch; behind it the counts are added up and the leading objects
    merged.  Equal ``order`` values are ordered by the remaining features."""
    feats = list(dict.fromkeys([*jet_feats, *lep_feats]))
    rest = [f for f in feats if f not in (order, btag)]
    src = objs.select(F.col(event), F.col(kind).cast("int").alias(kind), F.col(order).cast("double").alias(order),
                      F.col(btag).cast("double").alias(btag), *[F.col(f).cast("double").alias(f) for f in rest])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    cut = src.mapInArrow(_leading_in_batch(max(n_jets, n_leps), thr), schema + ", _n long, _tags long")
    obj = F.struct(order, *[f for f in [*rest, btag] if f != order])

    def lead(value: int, n: int):
        return F.slice(F.sort_array(F.collect_list(F.when(F.col(kind) == value, obj)), asc=False), 1, n)

    def total(c: str, value: int):
        return F.sum(F.when(F.col(kind) == value, F.col(c)).otherwise(0)).cast("int")

    return cut.groupBy(event).agg(total("_n", 0).alias("njets"), total("_tags", 0).alias("nbtags"),
                                  total("_n", 1).alias("nleps"), lead(0, n_jets).alias("jets"),
                                  lead(1, n_leps).alias("leps"))


def object_vector(objects: str, feats: Sequence[str], n: int, pad: float = 0.0, tag: str | None = None,
                  thr: float = BTAG_THRESHOLD) -> F.Column:
    """The flat block of an array of objects, object-major: ``n`` slots of ``feats``, missing
    ones ``pad``; ``tag`` names a feature to binarise."""
    def value(o, f):
        v = F.coalesce(o[f].cast("double"), F.lit(pad))
        return F.when(v >= F.lit(thr), F.lit(1.0)).otherwise(F.lit(0.0)) if f == tag else v
    return F.array(*[value(F.get(F.col(objects), F.lit(i)), f) for i in range(n) for f in feats])


def wide_columns(prefix: str, feats: Sequence[str], n: int) -> list[str]:
    return [f"{prefix}_{f}_{i}" for i in range(n) for f in feats]


# ------------------------------------------------------------------ B6, B7, B8, B9, B10

def polar_to_xy(df: DataFrame, pt: str = "met_pt", phi: str = "met_phi",
                prefix: str = "met") -> DataFrame:
    return (df.withColumn(f"{prefix}_px", F.col(pt) * F.cos(F.col(phi)))
              .withColumn(f"{prefix}_py", F.col(pt) * F.sin(F.col(phi))))


def feature_set(name: str = "nobtag") -> list[str]:
    """Column order of the flat vector: jets, MET, lepton (60 or 67 wide)."""
    if name not in ("nobtag", "btag"):
        raise TypeError(f"unknown feature set {name!r}")
    jf = JET_FEATS_BTAG if name == "btag" else JET_FEATS
    return (wide_columns("jets", jf, N_JETS) + [f"met_{f}" for f in MET_FEATS]
            + wide_columns("leps", LEP_FEATS, N_LEPS))


def assemble(df: DataFrame, cols: Sequence[str], out: str = "x") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def with_label(df: DataFrame, value: int, label: str = "y") -> DataFrame:
    return df.withColumn(label, F.lit(int(value)).cast("int"))


def split_classes(df: DataFrame, label: str = "y") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)


# ------------------------------------------------------------------ B11

def head_per_class(df: DataFrame, n: int, key: str = "k", label: str = "y",
                   out: str = "rn") -> DataFrame:
    """First ``n`` rows of each class by ``key`` (``n < 0`` keeps all)."""
    if n < 0:
        return positions(df, [label], key, out=out)
    return first_per_group(df, [label], key, n, out)


# ------------------------------------------------------------------ B12

def feature_label(index: int, layout: str = "nobtag") -> str | None:
    """Display name of a vector position, told from its column's name."""
    columns = feature_set(layout)
    if not 0 <= index < len(columns):
        return None
    holder, kind, *slot = columns[index].split("_")
    if holder == "met":
        return f"MET {MET_LABELS[kind]}"
    return f"Jet {int(slot[0]) + 1} {JET_LABELS[kind]}" if holder == "jets" else f"Lepton {JET_LABELS[kind]}"


def feature_names(spark: SparkSession, layout: str = "nobtag", width: int | None = None) -> DataFrame:
    """Dimension table ``(feature INT, name STRING)``; size = #features."""
    width = width if width is not None else len(feature_set(layout))
    rows = [(i, feature_label(i, layout)) for i in range(width)]
    schema = T.StructType([T.StructField("feature", T.IntegerType()),
                           T.StructField("name", T.StringType())])
    return spark.createDataFrame(rows, schema)


def attach_feature_names(long: DataFrame, names: DataFrame, feature: str = "feature") -> DataFrame:
    # the names table has one row per feature: its size is bounded by the layout
    return long.join(F.broadcast(names), feature, "left")


# ------------------------------------------------------------------ B13, B14, B15

def feature_pair(df: DataFrame, i: int, j: int, x: str = "x", label: str = "y",
                 key: str = "k") -> DataFrame:
    xs = F.col(x)
    return df.select(key, label, F.element_at(xs, i + 1).cast("double").alias("xi"),
                     F.element_at(xs, j + 1).cast("double").alias("xj"))


def explode_features(df: DataFrame, x: str = "x", keep: Sequence[str] = ("k", "y"),
                     feature: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*keep, F.posexplode(F.col(x).cast("array<double>")).alias(feature, value)) \
             .withColumn(feature, F.col(feature).cast("int"))


def one_hot(df: DataFrame, col: str = "y", n: int | None = None, out: str = "onehot") -> DataFrame:
    """Width ``max+1`` (one scalar aggregate) or fixed ``n``."""
    if n is None:
        n = int(df.agg(F.max(col)).first()[0]) + 1
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    return df.withColumn(out, F.transform(idx, lambda i: F.when(i == F.col(col), F.lit(1.0))
                                          .otherwise(F.lit(0.0))))


# ------------------------------------------------------------------ wide raw tables

def flatten_events(raw: DataFrame, layout: str = "nobtag", key: str = "event_id",
                       label: str | None = "y", selection: str | None = SELECTION,
                       btag_slots: int = JET_SLOTS_RAW) -> DataFrame:
    """The per-chunk pipeline on a wide raw event table: binarise the b-tag
    slots, apply the selection, derive MET x/y, keep the leading jet slots and
    the lepton, and assemble ``x`` (jets | MET | lepton).

    The selection only reads count columns, so Catalyst pushes it below the
    projections into the parquet scan."""
    tags = [f"jets_btag_{i}" for i in range(btag_slots) if f"jets_btag_{i}" in raw.columns]
    d = binarise(raw, tags)
    if selection:
        d = select_events(d, selection)
    d = polar_to_xy(d, "met_pt", "met_phi", "met")
    d = assemble(d, feature_set(layout))
    keep = [F.col(key).alias("k")] + ([F.col(label)] if label else [])
    return d.select(*keep, "x")
