"""Connected components of links, by stars, with every round a distributed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowtriage.llm.common import store
from flowtriage.session import released


def _state(edges: DataFrame) -> tuple:
    """Count and combined hash of the edges: two numbers that tell whether a round changed them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _toward_least(edges: DataFrame, up: bool) -> DataFrame:
    """Links each node's larger (up) or smaller neighbours, itself among the smaller, to its least neighbour.

    The least neighbour is an aggregate that is summed before it is shuffled, and comes back by a join whose large
    keys can be split: the centre of a large star is not gathered into one task.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sides = both if up else both.filter("v < u")
    least = sides.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
    joined = sides.join(least, "u")
    if up:
        linked = joined.filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(least.select("u", F.col("_m").alias("v")))
    return linked.filter("u <> v").distinct()


@released
def components(links: DataFrame) -> DataFrame:
    """`node` and `root`, the least node it can reach, for each node of links (columns u and v, any comparable type).

    Rounds end when the links no longer change, at most about the squared logarithm of the largest component; each
    round is a stored table. Loops and repeated links count once. No links give no rows.
    """
    edges = store(links.select("u", "v").filter("u <> v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = store(_toward_least(_toward_least(edges, up=True), up=False), "links")
        state, last = _state(edges), state
        if state == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
