"""Every query of the engine by name, with the SQL that checks it.

Modules of this package register queries with `query`; SQL may name the views of
`irloom.sources.views`, which are put in front as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from irloom.sources.views import VIEW_SQL, VIEWS

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["lookups", "joins", "graphs", "merges", "aggregates", "orders", "scalars", "comments", "incremental", "pages", "pagesets", "storage", "outputs"]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The statement with the views that it names in front."""
    named = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)]
    if not named:
        return sql
    views = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in named)
    if m := re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.IGNORECASE):
        return f"WITH {m[1] or ''}{views},\n{sql[m.end() :]}"
    return f"WITH {views}\n{sql}"


class Views:
    """The views over one folder of tables: v.symbols is the view ir_symbols, v("part") a table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if f"ir_{name}" not in VIEWS:
            raise AttributeError(name)
        return VIEWS[f"ir_{name}"](self.spark, self.sf_dir)

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Views as a query, and its oracle."""

    def keep(f: Callable[[Views], DataFrame]):
        assert name not in _queries, name
        _queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _oracles[name] = with_views(sql)
        return f

    return keep


def _load() -> None:
    for m in MODULES:
        import_module(f"irloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
