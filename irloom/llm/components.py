"""Connected components of a link table, by alternating star contraction.

Each round points all neighbours of a node to the smallest node near it, first the
larger ones, then the smaller ones; the rounds needed grow with the logarithm of the
longest chain. Links stay in the cluster and are written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from irloom.llm.common import cut


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The table as written, with a count and a digest that tell whether two link tables are the same."""
    seen = Observation()
    out = cut(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")))
    return out, (seen.get["n"], seen.get["digest"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node that has a link to another one."""
    e, state = _written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(below.select("u", "m"))
        before = state
        e, state = _written(small.distinct())
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
