"""Containment as a forest: levels from the roots, values folded upward, and intervals that make a subtree a range.

Rows have usr and parent_usr, '' at a root; each has one parent, so what no root leads to (a
cycle, or a parent that is not there) is in no level. A round places one level and writes
it and the rest once, so rows are read until they are placed and no longer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irloom.operators.state import cut


def weighted(rows: DataFrame, by: list[str], order: list[str], weight: str, to: str = "before") -> DataFrame:
    """Adds as `to` the sum of `weight` over the rows of the same `by` that come before in `order`, which must tell rows apart.

    Rows are dealt by range and summed where they lie, a part of a key at a time; a table with a row for
    each part of each key then shifts the sums. So a key that holds most rows is spread like any other.
    """
    keys = [*by, *order]
    dealt = cut(rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    inside = W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = dealt.withColumn(to, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    parts = dealt.groupBy(*by, "__part").agg(F.sum(weight).alias("__sum"))
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__shift"))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return summed.join(parts, same).select(*rows.columns, (F.col(to) + F.col("__shift")).cast("long").alias(to))


def levels(rows: DataFrame, inherit: list[str] | None = None) -> list[DataFrame]:
    """A table a depth, with `depth`; the columns in `inherit` are those of the root above."""
    inherit = inherit or []
    rest = cut(rows)
    at = rest.where("parent_usr = ''").withColumn("depth", F.lit(0))
    rest = rest.where("parent_usr <> ''")
    found = []
    while not at.isEmpty():
        found.append(at)
        above = at.select(F.col("usr").alias("__up"), *(F.col(c).alias(f"__{c}") for c in inherit), F.lit(True).alias("__hit"))
        tried = cut(rest.join(above, F.col("parent_usr") == F.col("__up"), "left").drop("__up"))
        hit = F.coalesce("__hit", F.lit(False))
        at = tried.where(hit).select(*(F.col(f"__{c}").alias(c) if c in inherit else F.col(c) for c in rows.columns), F.lit(len(found)).alias("depth"))
        rest = tried.where(~hit).select(*rows.columns)
    return found


def fold_up(found: list[DataFrame], combine: dict[str, Column], own: Callable[[], dict[str, Column]]) -> list[DataFrame]:
    """The levels, leaves first: `combine` aggregates the children's results (as below_<name>, NULL without children), `own` makes a row's results of that."""
    out, below = [], None
    for level in reversed(found):
        if below is not None:
            agg = below.groupBy(F.col("parent_usr").alias("__up")).agg(*(c.alias(f"below_{n}") for n, c in combine.items()))
            level = level.join(agg, F.col("usr") == F.col("__up"), "left").drop("__up")
        else:
            level = level.select("*", *(F.lit(None).alias(f"below_{n}") for n in combine))
        below = cut(level.withColumns(own()).drop(*(f"below_{n}" for n in combine)))
        out.append(below)
    return out[::-1]


def together(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def intervals(rows: DataFrame, order: list[str], inherit: list[str] | None = None, one_line: bool = False) -> DataFrame | None:
    """The rows with depth, size (of the subtree) and start: the place in preorder, siblings by `order` and usr.

    A subtree is start <= x < start + size. A root starts at 0, with one_line behind the root
    before it. None if there is no root.
    """
    found = levels(rows, inherit)
    if not found:
        return None
    sized = fold_up(found, {"size": F.sum("size")}, lambda: {"size": (1 + F.coalesce(F.col("below_size").cast("long"), F.lit(0))).cast("long")})
    placed = cut(weighted(together(sized), ["parent_usr"], [*order, "usr"], "size"), "depth")
    out = [cut(placed.where("depth = 0").withColumn("start", F.col("before") if one_line else F.lit(0).cast("long")))]
    for depth in range(1, len(found)):
        above = out[-1].select(F.col("usr").alias("__up"), F.col("start").alias("__start"))
        out.append(cut(placed.where(F.col("depth") == depth).join(above, F.col("parent_usr") == F.col("__up")).withColumn("start", F.col("__start") + 1 + F.col("before")).drop("__up", "__start")))
    return together(out).drop("before")
