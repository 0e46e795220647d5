r"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Three base kinds of spans are read from every whole text: ``assign`` (a
password, secret, token or API key set to a value), ``access`` (an access key
id) and ``hex`` (a long lower-case hexadecimal run).  The method adds ``bare``
spans: credential-like tokens without a keyword (letters and digits mixed, 20
characters or more) that no base span touches.  Hashes of all candidate values
are then counted over distinct repositories and owners: a value seen under more
than ``max_owners`` owners or ``max_repos`` repositories is a widely copied
example; any other is an owner-specific, live-looking credential.  A ``bare``
span counts as a secret only if it is owner-specific; base spans always stay.

Offsets come from the pieces between the matches (``split``) and the matches
themselves, both in code points.  Counting runs in two partial aggregates, so a
value copied into a third of all documents moves as one row per task.

Edge cases: null or empty text has no spans (the digest of an empty string);
a null repository or owner counts as one of its own; rows that share a doc_id are
kept apart; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hepark.llm.common import id_text, staged

# The patterns of the base kinds.  The one for hex keeps the
# minimum length, which leaves the leftmost maximal runs the same.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BARE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "bare")


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0, min_value: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    state = F.struct(F.lit(0).alias("at"),
                     F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    rows = F.arrays_zip(found.alias("whole"), values.alias("value"),
                        F.slice(between, F.lit(1), F.size(found)).alias("gap"))
    spans = F.aggregate(rows, state, step, lambda a: a["out"])
    if min_value:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= min_value)
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(none)


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its base spans and its bare candidates."""
    keep = [c for c in ("__repo", "__owner") if c in docs.columns]
    own = [F.col(c) for c in keep]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *own)
    text = F.col("text")
    docs = docs.select("doc_id", *keep, _spans(text, ASSIGN, 0, 2, 12).alias("a"),
                       _spans(text, ACCESS, 1).alias("b"), _spans(text, HEX, 2).alias("c"),
                       _spans(text, BARE, 3).alias("bare"))
    base = F.array_sort(F.concat("a", "b", "c"))
    return docs.select("doc_id", *keep, F.size("a").cast("long").alias("n_assign"),
                       F.size("b").cast("long").alias("n_access"), F.size("c").cast("long").alias("n_hex"),
                       base.alias("base"),
                       F.filter("bare", lambda s: F.regexp_like(s["value"], F.lit("[0-9]")) & F.regexp_like(
                           s["value"], F.lit("[A-Za-z]")) & ~F.exists(F.concat("a", "b", "c"), lambda t: (
                           t["start"] < s["end"]) & (s["start"] < t["end"]))).alias("bare"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 repo_col: str | None = None, owner_col: str = "source",
                 max_repos: int = 3, max_owners: int = 1) -> DataFrame:
    """doc_id, counts, ``base_spans`` and ``spans`` (text digests), ``found``
    (the spans with their corpus counts) and ``n_live``, the number of
    owner-specific credentials.  ``repo_col`` None: each document is a
    repository of its own."""
    own = docs.withColumn("__repo", F.col(repo_col or id_col).cast("string")) \
        .withColumn("__owner", F.col(owner_col).cast("string"))
    rows = staged(candidates(own, id_col, text_col), "secret-candidates")
    each = rows.where((F.size("base") > 0) | (F.size("bare") > 0)) \
        .withColumn("row", F.monotonically_increasing_id())
    each = staged(each, "secret-rows")
    one = each.select("row", "__repo", "__owner", F.explode(F.concat("base", "bare")).alias("s")) \
        .withColumn("key", F.sha2(F.col("s.value"), 256))
    repos = one.groupBy("key", "__repo").agg(F.lit(1).alias("x")).groupBy("key").agg(F.count("*").alias("repos"))
    owners = one.groupBy("key", "__owner").agg(F.lit(1).alias("x")).groupBy("key").agg(F.count("*").alias("owners"))
    spread_over = staged(repos.join(owners, "key"), "secret-owners")
    told = one.join(spread_over, "key").withColumn(
        "live", (F.col("repos") <= max_repos) & (F.col("owners") <= max_owners))
    told = told.where((F.col("s.kind") != 3) | F.col("live")).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "s.value", "repos", "owners", "live")))
        .alias("found"))
    with_spans = each.join(told, "row", "left").drop("row")
    empty = rows.where((F.size("base") == 0) & (F.size("bare") == 0)) \
        .withColumn("found", F.lit(None).cast(with_spans.schema["found"].dataType))
    both = empty.unionByName(with_spans)
    found = F.coalesce("found", F.array().cast(with_spans.schema["found"].dataType))
    return both.select("doc_id", "n_assign", "n_access", "n_hex", _digest(F.col("base")).alias("base_spans"),
                       _digest(found).alias("spans"), found.alias("found"),
                       F.size(F.filter(found, lambda s: s["live"])).cast("long").alias("n_live"))


def query(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"),
        "spans", "n_live")
