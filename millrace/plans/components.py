"""Connected components over a DataFrame of links (large-star / small-star).

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is two
aggregate-and-join steps; the aggregates combine map-side, and the joins are plain
equi-joins that AQE may split, so a star with very many leaves does not meet in one task.
Every round's links are written to the shared folder, and those of the round before removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.durable import discard, durable


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    mix = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(mix.cast("decimal(38,0)")), F.bit_xor(mix)).first())


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``links(u, v)`` of one orderable type -> ``(node, component)``, component being the least node reachable.

    Nodes without a link other than to themselves are absent. Null ends and self links are ignored.
    """
    links = links.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = durable(links.distinct())
    before = _state(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        last, links = links, durable(_small_star(_large_star(links)))
        discard(last)
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
