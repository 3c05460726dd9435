"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node that it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(least, "u")
        .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        .where("u > v")
    )


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The stored links, and a mark by which two rounds tell that nothing changed."""
    seen = Observation()
    sums = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    out = stored(edges.observe(seen, F.count("*").alias("n"), sums.alias("sum")), "links")
    return out, (seen.get["n"], int(seen.get["sum"] or 0))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has a link.

    ``edges`` has two columns of one orderable type, ``u`` and ``v``; direction, repeats, self
    links and nulls don't matter. Returns ``node``, ``root``; nodes without a link to another
    node aren't listed. Each round is written to the shared folder. A round keeps at most as many
    rows as there are links, and only minima and joins by node are used, so that a node with very
    many links is combined before the shuffle and split by skewed-join handling after it.
    """
    edges = edges.toDF("u", "v").where("u <> v").distinct()
    edges, seen = _written(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        before = edges
        edges, now = _written(_small_star(_large_star(before)).distinct())
        discard(before)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
