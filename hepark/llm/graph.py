"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hepark.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id on a link, the smallest id reachable.

    Alternates large-star and small-star steps until the links stop changing: a
    number of rounds logarithmic in the longest chain.  Neighbourhoods are only
    ever aggregated (least neighbour) and joined, never collected."""
    links = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u > v").distinct(), "links")

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = staged(large.where("u > v"), "links-large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        links = staged(small, "links-small")
        after = mark(links)
        if after == before:
            break
        before = after
    found = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = found.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    return staged(found.union(roots), "components")
