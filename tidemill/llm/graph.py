"""Connected components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.llm.common import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: for every node of links a, b, the least node of its component.

    Alternates large-star and small-star steps until the links no longer change; each round is written to the shared
    folder, so lineage stays short and a lost executor costs one round. Self-links and nulls are dropped, no links give
    no rows.
    """
    edges = links.select(F.col("a"), F.col("b")).filter("a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = written(small.select("e.a", F.col("e.m").alias("b")).filter("a <> b").distinct(), "links")
        discard(edges)
        edges = now
        after = _state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
