"""Connected components of a link table by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import stored

#: Links that a task reads at least while there are more tasks than cores; a shuffle writes files for every task, however few its rows.
LINKS = 1 << 17


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that a link names; ``root`` is the smallest node reachable.

    Alternates two joins: every node hands its smallest neighbour to its larger neighbours, then to its
    smaller ones, until nothing changes. Links become stars in a few rounds. Each round groups by node, and a
    node only keeps what it hands on, so no component is gathered. Null ends are left out; no link, no rows.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct())
    state = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count(F.lit(1))
    cores = edges.sparkSession.sparkContext.defaultParallelism
    before = edges.agg(*state).first()
    while True:
        edges = edges.coalesce(max(cores, before[1] // LINKS))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = stored(large.join(small, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())
        after = new.agg(*state).first()
        if before == after:
            break
        edges, before = new, after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
