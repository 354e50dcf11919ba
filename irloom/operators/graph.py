"""Closures over containment and edges: frontier loops that join, take what is new, and stop when nothing is.

Each round's result is written to the folder in spark.checkpoint.dir, which cuts the
lineage and survives a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.operators.aggregate import numbered
from irloom.operators.state import Grown, cut


def fixpoint_up(start: DataFrame, parents: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """The usrs in `start` and all their ancestors by `parents` (usr, parent_usr)."""
    reached = Grown(start.distinct())
    for _ in range(most_rounds):
        up = reached.last.join(parents, "usr").select(F.col("parent_usr").alias("usr")).distinct()
        if not reached.add(up.join(reached.all(), "usr", "left_anti")):
            return reached.all()
    raise RuntimeError(f"no end after {most_rounds} rounds")


def closure(edges: DataFrame, roots: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """root, node and depth of everything reachable by edges (src, dst) from each root (column node), itself at depth 0."""
    edges = cut(edges.select("src", "dst"))  # read in each round
    reached = Grown(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct())
    for depth in range(1, most_rounds):
        step = reached.last.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        if not reached.add(step.join(reached.all(), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth"))):
            return reached.all()
    raise RuntimeError(f"no end after {most_rounds} rounds")


def ancestors(symbols: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """usr, ancestor and distance (1: the parent); a walk stops at an unknown parent and when it meets a symbol again."""
    parents = symbols.where(F.coalesce("parent_usr", F.lit("")) != "").select("usr", "parent_usr")
    known = symbols.select(F.col("usr").alias("k_usr"))
    links = cut(parents.join(known, parents.parent_usr == F.col("k_usr"), "left_semi"))
    reached = Grown(links.where("usr <> parent_usr").select("usr", F.col("parent_usr").alias("ancestor"), F.lit(1).alias("distance")))
    up = links.select(F.col("usr").alias("ancestor"), F.col("parent_usr").alias("next"))
    for distance in range(2, most_rounds):
        step = reached.last.join(up, "ancestor").select("usr", F.col("next").alias("ancestor"), F.lit(distance).alias("distance")).where("usr <> ancestor")
        if not reached.add(step.join(reached.all(), ["usr", "ancestor"], "left_anti")):
            return reached.all()
    raise RuntimeError(f"no end after {most_rounds} rounds")


def qualifier(symbols: DataFrame, kinds: list[int], sep: str = "::") -> DataFrame:
    """usr and its qualified name by walking up through ancestors of the given kinds, outermost first."""
    names = symbols.where(F.col("kind").isin(kinds)).select(F.col("usr").alias("ancestor"), F.col("spelling").alias("part"))
    parts = ancestors(symbols).join(names, "ancestor").groupBy("usr").agg(F.transform(F.sort_array(F.collect_list(F.struct("distance", "part")), asc=False), lambda x: x["part"]).alias("parts"))
    return symbols.select("usr", "spelling").join(parts, "usr", "left").select("usr", F.concat_ws(sep, "parts", "spelling").alias("qualified"))


def preorder(symbols: DataFrame, kinds: list[int]) -> DataFrame:
    """root, usr, depth and path of everything below each root, entered only through the given kinds; path sorts to preorder."""
    key = F.struct(F.col("kind"), F.col("line"), F.col("qualified_name"), F.col("usr"))
    rows = cut(symbols.select("usr", F.coalesce("parent_usr", F.lit("")).alias("parent_usr"), F.col("kind").isin(kinds).alias("opens"), key.alias("key")))
    reached = Grown(rows.where("parent_usr = ''").select(F.col("usr").alias("root"), "usr", "opens", F.lit(0).alias("depth"), F.array("key").alias("path")))
    below = rows.select(F.col("usr").alias("c_usr"), "parent_usr", F.col("opens").alias("c_opens"), "key")
    depth = 0
    while True:
        depth += 1
        step = reached.last.where("opens").join(below, F.col("usr") == F.col("parent_usr"))
        step = step.select("root", F.col("c_usr").alias("usr"), F.col("c_opens").alias("opens"), F.lit(depth).alias("depth"), F.concat("path", F.array("key")).alias("path"))
        if not reached.add(step.join(reached.all().select("root", "usr"), ["root", "usr"], "left_anti")):
            return reached.all().drop("opens")


def interned(rows: DataFrame, key: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Per key the ids of its paths in order, and the dimension (id, path); ids from 0 in order of path."""
    ids = numbered(rows.select(path).distinct(), [], [path], "id")
    return rows.join(ids, path).groupBy(key).agg(F.sort_array(F.collect_set("id")).alias("ids")), ids.select("id", path)
