"""Connected components by alternating large and small stars, without gathering a neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.llm.common import attach, checkpointed


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, for every node of ``links`` (a, b: bigint).

    A large star links the larger neighbours of a node to the smallest one, a small star does so
    with the node and its smaller neighbours. Both only need the minimum of a neighbourhood, an
    aggregate that combines before the shuffle, and attach it to the links, dealt over shares. The
    number of rounds grows with the logarithm of the nodes. Each round is written to the shared
    checkpoint folder, so a lost executor costs one round at most. Links from a node to itself and
    NULLs are ignored.
    """
    edges = links.filter("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct()
    edges = checkpointed(edges)
    seen = _state(edges)
    while True:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = attach(both.filter("v > u"), least, "u", "v").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = attach(large, least, "u", "v")
        small = small.filter("v <> m").selectExpr("v AS u", "m AS v").unionByName(least.toDF("u", "v"))
        edges = checkpointed(small.distinct())
        now = _state(edges)
        if now == seen:
            return edges.toDF("node", "root")
        seen = now


def _state(edges: DataFrame) -> tuple:
    """A digest of all links: their number and two sums over hashes."""
    sums = [F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())
