"""Connected components of an edge table, by large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm.store import materialise

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of `edges` (columns a, b); alone are those with a = b or a NULL.

    A large-star step links a node's larger neighbours to its smallest one, a small-star step its smaller neighbours; the number of
    edges never grows, and after a number of rounds that grows with the logarithm of the nodes all hang on their smallest node.
    Each round is a written table, so nothing is kept on one machine and lost work is redone from the round before.
    """
    links = edges.where("a is not null and b is not null and a <> b")
    links = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _fingerprint(links)
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                                     F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        links = materialise(small.where("u <> v").distinct(), "links")
        now = _fingerprint(links)
        if now == state:
            top = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top)
        state = now
    raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
