"""Connected components by alternating large-star and small-star rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from celltide.runtime import checkpoint


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (a, b), where component_id is the least id reachable.

    Each round hangs the neighbours of an id under the least of them: first the larger ones, then the
    smaller ones. Ids are only compared, so a component's hub leaves each task as one row per neighbour;
    rounds grow with the logarithm of a component's diameter. Self links are allowed; an empty table has no components.
    """
    edges = checkpoint(links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"),
    ).filter("a <> b").distinct())
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = checkpoint(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        edges = checkpoint(hung.select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"),
        ).select("e.a", "e.b").filter("a <> b").distinct())
    every = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return every.join(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")), "id", "left").select(
        "id", F.coalesce("m", "id").alias("component_id"),
    )
