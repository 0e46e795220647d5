"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns.  Its key at depth d is the xor of one
128-bit hash per (position, role, text), so a turn's key needs the turns before it only
through one exclusive-or, which Spark sums up piece by piece.

1. ``rebuild``: turns are numbered, taken over from the base conversation, numbered again.
2. ``chains``: the keys of the nodes on a conversation's way, in *bands* of depths (16,
   256, then ``BAND`` more each), so that a row stays bounded however long a conversation is.
   Equal conversations are counted first; one chain stands for all of them.
3. Peeling, from the deepest band up.  A band's rows are the conversations that end in
   it and the nodes that survive from the band below, as chains.  They are ranged by the
   keys on their way, so that what begins alike lies together, and each task strips turns from the
   end: a node that no later row can reach is closed - its totals are whole, it is
   written - and merged into the node one turn shorter.  So nodes are discovered and
   aggregated in the same pass.
   What lies on the first or last chain of a task may go on in the neighbouring task;
   these two chains, with the totals gathered so far, are ranged and peeled again
   (two rows a task, so rounds shrink fast) until one task closes them all.  A node
   shared by any number of conversations is merged within tasks first, and no task
   gathers its members.
4. Nodes get their parent's smallest member and the digest of the conversations that
   end in them by joins on their keys.  SHA-256 goes through its text in order, so one
   task streams through a node's ids; they come sorted, up to 2**``ID_BITS`` in a row.

Edge cases: rows without conv_id belong to no conversation; null role or text is
empty; a null turn comes first, equal turns are ordered by role, then text; a
conversation without turns left ends in the root; an empty table has no nodes,
not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hepark.llm.common import staged
from hepark.operators.ranking import row_numbers

#: Depths of the first bands; further bands have BAND depths each.
EDGES, BAND = (16, 256), 1024
ID_BITS = 9
#: Chains that one task may close in the last round.
LAST_CHAINS = 2048
KEY = 16


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes over from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations: conv_id, depth, c0, c1 - a hash of role and
    text - and the size of the text; all conversations: conv_id, length)."""
    c = F.col
    turns = conversations.where("conv_id is not null").select(
        c("conv_id").cast("long").alias("conv_id"), c("turn"),
        F.coalesce(c("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    starts = ["turn", F.substring("role", 1, 32), F.substring("text", 1, 32)]   # of equal turns
    turns = row_numbers(turns, ["conv_id"], ["turn", "role", "text"], "i", ranges=starts).select(
        "conv_id", "i", F.xxhash64("role", "text").alias("c0"), F.xxhash64(F.lit("second"), "text", "role").alias("c1"),
        F.octet_length("text").cast("long").alias("size"))
    turns = staged(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", borrowed(c("conv_id")))
    bases = sizes.where(c("conv_id") % 5 == 0).select(c("conv_id").alias("base"), c("n").alias("base_n"))
    sizes = sizes.withColumn("base", c("conv_id") - c("conv_id") % 5).join(bases, "base", "left").select(
        "conv_id", "base", "n", "h", F.least(c("h"), F.coalesce("base_n", F.lit(0))).alias("got"))
    sizes = staged(sizes, "conversations")
    own = turns.join(sizes.select("conv_id", "h", "got"), "conv_id").where("i > h").select(
        "conv_id", (c("i") - c("h") + c("got")).alias("depth"), "c0", "c1", "size")
    lent = sizes.select("conv_id", "base", "h").join(
        turns.where("i <= 8").select(c("conv_id").alias("base"), "i", "c0", "c1", "size"), "base").where("i <= h").select(
        "conv_id", c("i").alias("depth"), "c0", "c1", "size")
    length = sizes.select("conv_id", (c("got") + F.greatest(c("n") - c("h"), F.lit(0))).alias("length"))
    return own.union(lent), length


def _band(depth: Column) -> Column:
    """Band of a depth from 1: (0, 16], (16, 256], (256, 256 + BAND], ..."""
    deep = (F.floor((depth - 1 - EDGES[-1]) / BAND) + len(EDGES)).cast("int")
    out = deep
    for b in reversed(range(len(EDGES))):
        out = F.when(depth <= EDGES[b], F.lit(b)).otherwise(out)
    return out


def band_start(band: int) -> int:
    """The depth at which a band's chains begin (a node of the band above)."""
    return 0 if band == 0 else EDGES[band - 1] if band <= len(EDGES) else EDGES[-1] + (band - len(EDGES)) * BAND


def _paths(batches):
    """Hashes of a band's turns and the key at its start -> keys on the way, 16 bytes a
    node, the band's start first, and the sizes of the nodes' last texts."""
    for batch in batches:
        paths, sizes = [], []
        for k0, k1, h0, h1, size in zip(*(batch.column(i) for i in range(2, 7))):
            way = np.stack([np.bitwise_xor.accumulate(np.r_[np.int64(k.as_py()), np.asarray(h.values, np.int64)])
                            for k, h in ((k0, h0), (k1, h1))], 1)
            paths.append(way.astype(">i8").tobytes())
            sizes.append([0, *size.as_py()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(paths, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))],
            names=["conv_id", "band", "path", "sizes"])


def chains(turns: DataFrame, length: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, band, path, sizes) of every conversation, (conv_id, length, path key)."""
    c = F.col
    hashed = turns.select("conv_id", "depth", F.xxhash64("depth", "c0", "c1").alias("h0"),
                          F.xxhash64("c1", "depth", "c0").alias("h1"), "size", _band(c("depth")).alias("band"))
    parts = hashed.groupBy("conv_id", "band").agg(
        F.sort_array(F.collect_list(F.struct("depth", "h0", "h1", "size"))).alias("t"),   # at most BAND turns
        F.bit_xor("h0").alias("x0"), F.bit_xor("h1").alias("x1"))
    parts = staged(parts, "chain-parts")
    w = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({k: F.coalesce(F.bit_xor(x).over(w), F.lit(0).cast("long"))
                               for k, x in (("k0", "x0"), ("k1", "x1"))})
    way = parts.select("conv_id", "band", "k0", "k1", "t.h0", "t.h1", "t.size") \
        .mapInArrow(_paths, "conv_id long, band int, path binary, sizes array<long>")
    ends = length.join(parts.groupBy("conv_id").agg(F.bit_xor("x0").alias("e0"), F.bit_xor("x1").alias("e1")),
                       "conv_id", "left").select("conv_id", "length", *(F.coalesce(e, F.lit(0).cast("long")).alias(e)
                                                                        for e in ("e0", "e1")))
    return staged(way, "chains"), staged(ends, "chain-ends")


# One schema for what a peeling task writes: closed nodes, open chains, survivors.
SUMS = ("n", "least", "children", "leaves", "saved")
PEELED = ("kind string, path binary, sizes array<long>, depth long, key binary, parent binary, "
          + ", ".join(f"{s} array<long>" for s in SUMS))
_PEELED = pa.schema([("kind", pa.string()), ("path", pa.binary()), ("sizes", pa.list_(pa.int64())),
                     ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary())]
                    + [(s, pa.list_(pa.int64())) for s in SUMS])
_NONE = np.iinfo(np.int64).max


class Peel:
    """Peels the rows of one task, which come sorted by path.  An open node is
    [key, size, n, least, children, leaves, saved]; its sums are what was merged into
    it so far."""

    def __init__(self, start: int, last: bool):
        self.start, self.last, self.open, self.out = start, last, [], []
        self.first_path: list | None = None             # the first row's nodes
        self.shared = 0                                 # open nodes that lie on the first chain
        self.left: list = []                            # nodes of the first chain that were stripped

    def strip(self, keep: int) -> None:
        """Close the open nodes beyond the first ``keep``, deepest first."""
        while len(self.open) > keep:
            at = len(self.open) - 1
            node = self.open.pop()
            if at < self.shared:                        # may go on in the task before
                self.left.append(node)
                self.shared = at
            elif at == 0:
                self.out.append(("start", node[0], None, self.start, node[0], None, *([x] for x in node[2:])))
            else:
                key, size, n, least, children, leaves, saved = node
                leaves, saved = leaves or 1, saved + (n - 1) * size
                up = self.open[-1]
                up[2] += n
                up[3] = min(up[3], least)
                up[4] += 1
                up[5] += leaves
                up[6] += saved
                self.out.append(("node", None, None, self.start + at, key, up[0],
                                 [n], [least], [children], [leaves], [saved]))

    def row(self, path: bytes, sizes: list, sums: list[list]) -> None:
        keys = [path[i:i + KEY] for i in range(0, len(path), KEY)]
        same = 0
        while same < min(len(keys), len(self.open)) and self.open[same][0] == keys[same]:
            same += 1
        self.strip(same)
        for key, size in zip(keys[same:], sizes[same:]):
            self.open.append([key, size, 0, _NONE, 0, 0, 0])
        for node, (n, least, children, leaves, saved) in zip(self.open[::-1], zip(*(s[::-1] for s in sums))):
            node[2] += n
            node[3] = min(node[3], least)
            node[4] += children
            node[5] += leaves
            node[6] += saved
        if self.first_path is None:
            self.first_path = keys
            self.shared = 0 if self.last else len(keys)

    def chain(self, nodes: list, blank: list) -> None:
        """An open chain: ``blank`` nodes lead to ``nodes``, which carry the sums."""
        way = blank + nodes
        self.out.append(("chain", b"".join(x[0] for x in way), [x[1] for x in way], None, None, None,
                         *([x[i] for x in nodes] for i in range(2, 7))))

    def finish(self) -> None:
        if self.last:
            self.strip(0)
        elif self.open or self.left:
            if self.left:                               # a stripped chain hangs on the open one
                self.chain(self.left[::-1], self.open[:self.shared])
            if self.open:
                self.chain(self.open, [])

    def take(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        cols = zip(*out) if out else [[] for _ in _PEELED]
        return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(cols, _PEELED)], schema=_PEELED)


def _peeler(start: int, last: bool):
    def run(batches):
        peel = Peel(start, last)
        for batch in batches:
            for row in batch.to_pylist():
                peel.row(row["path"], row["sizes"], [row[s] for s in SUMS])
            yield peel.take()
        peel.finish()
        yield peel.take()
    return run


def _peel(rows: DataFrame, start: int) -> list[DataFrame]:
    """What each round over one band's chains wrote, the last round with no chain left."""
    spark = rows.sparkSession
    tasks, written = max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), []
    while True:
        last = tasks == 1
        dealt = rows.coalesce(1) if last else rows.repartitionByRange(tasks, "path")
        dealt = dealt.select("path", "sizes", *SUMS).sortWithinPartitions("path")
        written.append(staged(dealt.mapInArrow(_peeler(start, last), PEELED), "peeled"))
        if last:
            return written
        rows = written[-1].where("kind = 'chain'")
        tasks = 1 if 2 * tasks <= LAST_CHAINS else -(-4 * tasks // LAST_CHAINS)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 of every node of the rebuilt conversations."""
    c = F.col
    ways, ends = chains(*rebuild(conversations))
    same = ["length", "e0", "e1"]
    alike = staged(ends.groupBy(*same).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "alike")
    deepest = alike.agg(F.max("length")).first()[0]
    if deepest is None:
        return conversations.sparkSession.createDataFrame([], NODE)
    one = lambda x: F.array(x.cast("long"))
    zero = F.lit(0)
    fresh = {"n": one(c("n")), "least": one(c("conv_id")), "children": one(zero), "leaves": one(zero),
             "saved": one(zero)}
    alike = alike.withColumn("band", F.when(c("length") == 0, F.lit(0)).otherwise(_band(c("length"))))
    found, survivors = [], None
    band = 0
    while band_start(band + 1) < deepest:
        band += 1
    for b in range(band, -1, -1):
        way = ways.where(c("band") == b).select("conv_id", "path", "sizes")
        rows = alike.where((c("band") == b) & (c("length") > 0)).join(way, "conv_id") \
            .select("path", "sizes", *(v.alias(k) for k, v in fresh.items()))
        if b == 0:                                      # conversations without turns end in the root
            rows = rows.union(alike.where("length = 0").select(
                F.lit(bytes(KEY)), F.array(zero.cast("long")), *(v.alias(k) for k, v in fresh.items())))
        if survivors is not None:
            rows = rows.union(survivors.select(c("least")[0].alias("conv_id"), *SUMS).join(way, "conv_id")
                              .select("path", "sizes", *SUMS))
        written = _peel(rows, band_start(b))
        found += [w.where("kind = 'node'") for w in written]
        survivors = reduce(DataFrame.union, (w.where("kind = 'start'") for w in written))
    root = survivors.withColumn("leaves", F.array(F.greatest(c("leaves")[0], F.lit(1).cast("long"))))
    nodes = staged(reduce(DataFrame.union, found, root).select("depth", "key", "parent", *(c(s)[0].alias(s) for s in SUMS)), "nodes")
    tops = nodes.where("children > 0").select(c("key").alias("parent"), (c("depth") + 1).alias("depth"),
                                              c("least").alias("parent_conv_id"))
    out = nodes.join(tops.hint("merge"), ["parent", "depth"], "left").join(_ends(ends).hint("merge"),
                                                                          ["depth", "key"], "left")
    return out.select(c("least").alias("conv_id"), "depth", "parent_conv_id", c("n").alias("n_convs"),
                      c("children").alias("n_children"), c("leaves").alias("n_leaves"),
                      c("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


def _streamed(batches):
    """SHA-256 over each key's rows, which follow each other in order."""
    depth = key = state = None
    done: list[tuple] = []

    def take():
        out = pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(
            zip(*done) if done else [[], [], []], (pa.int64(), pa.binary(), pa.string()))],
            names=["depth", "key", "ends_sha256"])
        done.clear()
        return out

    for batch in batches:
        for d, k, _, ids in zip(*(batch.column(i) for i in range(4))):
            d, k, ids = d.as_py(), k.as_py(), ids.as_py().encode()
            if state is not None and (d, k) == (depth, key):
                state.update(b"," + ids)
                continue
            if state is not None:
                done.append((depth, key, state.hexdigest()))
            depth, key, state = d, k, hashlib.sha256(ids)
        yield take()
    if state is not None:
        done.append((depth, key, state.hexdigest()))
        yield take()


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of the nodes in which conversations end."""
    c = F.col
    key = F.concat(*(F.unhex(F.lpad(F.hex(e), 16, "0")) for e in ("e0", "e1")))
    part = F.shiftright("conv_id", ID_BITS)
    rows = ends.groupBy(c("length").alias("depth"), key.alias("key"), part.alias("part")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return rows.repartition("depth", "key").sortWithinPartitions("depth", "key", "part") \
        .mapInArrow(_streamed, "depth long, key binary, ends_sha256 string")


ORACLE = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
inv AS (
  SELECT conv_id, list_reduce(
    list_transform(range(0, len(CAST(conv_id AS VARCHAR))),
                   lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i + 1]) AS BIGINT)),
    lambda a, x: list_reduce([CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7],
      lambda s, k: xor(s >> 1, (s & 1) * 3988292384), xor(a, x)), CAST(4294967295 AS BIGINT)) AS inverse
  FROM ids),
crc AS (SELECT conv_id, xor(inverse, 4294967295) AS crc FROM inv),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
size AS (
  SELECT c.conv_id, c.crc % 9 AS h, c.conv_id - c.conv_id % 5 AS base,
         least(c.crc % 9, coalesce((SELECT count(*) FROM own b WHERE b.conv_id = c.conv_id - c.conv_id % 5), 0)) AS got
  FROM crc c),
turns AS (
  SELECT s.conv_id, o.i AS d, o.role, o.text FROM size s JOIN own o ON o.conv_id = s.base AND o.i <= s.h
  UNION ALL
  SELECT s.conv_id, s.got + o.i - s.h, o.role, o.text FROM size s JOIN own o ON o.conv_id = s.conv_id AND o.i > s.h),
keyed AS (
  SELECT conv_id, d, octet_length(encode(text)) AS size,
         md5(string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS k
  FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
way AS (SELECT conv_id, d, size, k, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS pk,
               d = max(d) OVER (PARTITION BY conv_id) AS ends FROM keyed),
node AS (SELECT d, k, any_value(pk) AS pk, any_value(size) AS size, min(conv_id) AS least, count(*) AS n,
                string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids
         FROM way GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS c FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT n.*, coalesce(c, 0) AS c FROM node n LEFT JOIN kids USING (d, k)),
under AS (
  SELECT a.d, a.k, sum((u.c = 0)::INT) AS leaves, sum((u.n - 1) * u.size) AS saved
  FROM full_node u JOIN way a ON a.conv_id = u.least AND a.d <= u.d GROUP BY a.d, a.k)
SELECT f.least AS conv_id, CAST(f.d AS BIGINT) AS depth, p.least AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs,
       CAST(f.c AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves,
       CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM full_node f JOIN under u USING (d, k) LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.pk
"""
