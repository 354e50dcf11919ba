"""Queries of section D: closures and hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.operators import graph, query as q
from irloom.operators.aggregate import numbered
from irloom.operators.visibility import documented_below
from irloom.plans.joins import UP
from irloom.plans.lookups import DOCUMENTED_BELOW
from irloom.plans.registry import query
from irloom.sources.schema import CONTAINER_KINDS


@query("d1_ancestors", UP + "SELECT usr, ancestor, distance FROM up")
def _(v):
    return graph.ancestors(v.symbols)


@query("d2_documented_below", DOCUMENTED_BELOW + "SELECT usr FROM up")
def _(v):
    return documented_below(v.symbols)


@query(
    "d3_include_closure",
    "WITH RECURSIVE reach AS (SELECT DISTINCT r_regionkey + 1990 AS root, CAST(r_regionkey + 1990 AS BIGINT) AS node FROM region UNION SELECT root, dst FROM reach JOIN ir_include_edges ON src = node) SELECT CAST(root AS BIGINT) AS root, node FROM reach",
)
def _(v):
    roots = v("region").select((F.col("r_regionkey") + 1990).cast("long").alias("node"))
    return graph.closure(v.include_edges, roots).select("root", "node")


PRE = """
WITH RECURSIVE walk AS (
  SELECT usr AS root, usr, kind, 0 AS depth, lpad(CAST(kind AS VARCHAR), 3, '0') || lpad(CAST(line AS VARCHAR), 12, '0') || usr AS path FROM ir_symbols WHERE coalesce(parent_usr, '') = ''
  UNION ALL SELECT root, s.usr, s.kind, depth + 1, path || '/' || lpad(CAST(s.kind AS VARCHAR), 3, '0') || lpad(CAST(line AS VARCHAR), 12, '0') || s.usr FROM walk JOIN ir_symbols s ON s.parent_usr = walk.usr WHERE walk.kind IN (1, 2, 3, 4, 16)
)
"""


@query("d5_preorder", PRE + "SELECT root, usr, depth, CAST(row_number() OVER (PARTITION BY root ORDER BY path) AS BIGINT) AS position FROM walk")
def _(v):
    walk = graph.preorder(v.symbols, CONTAINER_KINDS)
    return numbered(walk, ["root"], ["path"]).select("root", "usr", "depth", (F.col("position") + 1).alias("position"))


@query(
    "d6_namespace_hubs",
    PRE + ", entries AS (SELECT DISTINCT parent_usr AS usr FROM ir_symbols WHERE kind <> 1 UNION SELECT usr FROM ir_symbols WHERE kind = 1 AND is_documented = 1), keep AS (SELECT usr FROM entries UNION SELECT s.parent_usr FROM keep JOIN ir_symbols s ON s.usr = keep.usr WHERE s.kind = 1 AND s.parent_usr IS NOT NULL) SELECT w.usr, w.depth FROM walk w WHERE w.kind = 1 AND w.usr IN (SELECT usr FROM keep)",
)
def _(v):
    s = v.symbols
    spaces = s.where("kind = 1").select("usr", "parent_usr")
    filled = s.where("kind <> 1").select(F.col("parent_usr").alias("usr")).where(~q.empty("usr")).distinct()
    kept = graph.fixpoint_up(filled.union(s.where("kind = 1 AND is_documented = 1").select("usr")), spaces.where(~q.empty("parent_usr")))
    depth = graph.preorder(s.where("kind = 1"), [1]).select("usr", "depth")
    return depth.join(kept, "usr")


@query("d7_qualified_names", UP + "SELECT s.usr, coalesce(q || '::', '') || s.spelling AS qualified FROM ir_symbols s LEFT JOIN (SELECT usr, string_agg(part, '::' ORDER BY distance DESC) AS q FROM up JOIN ir_symbols a ON a.usr = up.ancestor WHERE a.kind = 1 GROUP BY up.usr) x ON x.usr = s.usr".replace("SELECT usr, string_agg", "SELECT up.usr, string_agg"))
def _(v):
    return graph.qualifier(v.symbols, [1])


@query("d8_interned_dependencies", "WITH d AS (SELECT o_custkey AS input, o_orderpriority || CAST(o_orderkey % 97 AS VARCHAR) AS dep FROM orders), ids AS (SELECT dep, row_number() OVER (ORDER BY dep) - 1 AS id FROM (SELECT DISTINCT dep FROM d)) SELECT input, string_agg(CAST(id AS VARCHAR), chr(31) ORDER BY id) AS ids FROM (SELECT DISTINCT input, id FROM d JOIN ids USING (dep)) GROUP BY input")
def _(v):
    rows = v("orders").select(F.col("o_custkey").alias("input"), F.concat("o_orderpriority", (F.col("o_orderkey") % 97).cast("string")).alias("dep"))
    lists, _ = graph.interned(rows, "input", "dep")
    return lists.select("input", q.joined(F.transform("ids", lambda x: x.cast("string"))).alias("ids"))
