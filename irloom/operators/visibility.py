"""Which symbols are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irloom.operators.graph import fixpoint_up
from irloom.operators.query import empty


def documented_below(symbols: DataFrame) -> DataFrame:
    """usr of every symbol with a documented descendant; cycles end because each is added once."""
    start = symbols.where((F.col("is_documented").cast("int") == 1) & ~empty("parent_usr")).select(F.col("parent_usr").alias("usr")).distinct()
    return fixpoint_up(start, symbols.where(~empty("parent_usr")).select("usr", "parent_usr"))


def visible(symbols: DataFrame, in_scope: Column | None = None, include_undocumented: bool = False) -> DataFrame:
    """Symbols in the file scope that are documented, or have a documented descendant; or all of them."""
    rows = symbols if in_scope is None else symbols.where(in_scope)
    if include_undocumented:
        return rows
    below = documented_below(symbols).withColumn("__below", F.lit(True))
    return rows.join(below, "usr", "left").where((F.col("is_documented").cast("int") == 1) | F.col("__below")).drop("__below")
