"""Queries of section G: ordering and positions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irloom.operators import aggregate as a, query as q
from irloom.plans.registry import query
from irloom.sources.schema import FUNCTION_KINDS


@query("g1_sort_orders", "SELECT usr, CAST(row_number() OVER (PARTITION BY file_id ORDER BY kind, line, qualified_name, usr) AS BIGINT) AS position FROM ir_symbols")
def _(v):
    order = ["kind", "line", "qualified_name", "usr"]
    return a.numbered(v.symbols.select("file_id", *order), ["file_id"], order).select("usr", (F.col("position") + 1).alias("position"))


@query("g2_canonical_inputs", "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS BIGINT) AS position FROM documents")
def _(v):
    return a.numbered(v("documents").select("source", "lang", "doc_id"), ["source"], ["lang", "doc_id"]).select("source", "doc_id", (F.col("position") + 1).alias("position"))


@query("g3_first_lines", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:20], chr(31)) AS head FROM documents")
def _(v):
    return v("documents").select("doc_id", q.joined(F.slice(F.split("text", "\n"), 1, 20)).alias("head"))


@query("g4_most_common", "WITH t AS (SELECT unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS target FROM pages) SELECT target, count(*) AS n FROM t GROUP BY target ORDER BY n DESC, target LIMIT 20")
def _(v):
    return a.most_common(v("pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("target")), "target")


@query("g5_positions", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal FROM lineitem")
def _(v):
    return a.positions(v("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("g6_first_declarations", "SELECT usr, row_number() OVER (PARTITION BY file_id, spelling, kind IN (5, 6, 7, 8, 15) ORDER BY kind, line, usr) > 1 AND kind NOT IN (5, 6, 7, 8, 15) AS degraded FROM ir_symbols")
def _(v):
    return a.first_declarations(v.symbols, "file_id", "spelling", ["kind", "line", "usr"], F.col("kind").isin(FUNCTION_KINDS)).select("usr", "degraded")


@query(
    "g7_unique_stems",
    "WITH n AS (SELECT DISTINCT spelling AS name, regexp_replace(spelling, '[^A-Za-z]+', '_', 'g') AS s FROM ir_symbols), c AS (SELECT name, s, count(*) OVER (PARTITION BY lower(s)) AS claims FROM n), t AS (SELECT name, CASE WHEN claims > 1 THEN s || '_' || left(sha256(name), 8) ELSE s END AS s FROM c) SELECT name, s || repeat('_', CAST(row_number() OVER (PARTITION BY lower(s) ORDER BY name) - 1 AS INTEGER)) AS stem FROM t",
)
def _(v):
    return a.unique_stems(v.symbols.select(F.col("spelling").alias("name")).distinct(), F.regexp_replace("name", "[^A-Za-z]+", "_"))


@query("g8_group_pages", "SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN coalesce(parent_group_id, '') = '' THEN 0 ELSE 1 END, title, id) AS BIGINT) AS position FROM ir_groups")
def _(v):
    order = W.orderBy(F.when(q.empty("parent_group_id"), 0).otherwise(1), "title", "id")
    return v.groups.select("id", F.row_number().over(order).cast("long").alias("position"))  # groups are few


@query(
    "g9_comment_blocks",
    "WITH r AS (SELECT conv_id, turn, role, turn - row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS island FROM conversations) SELECT conv_id, role = 'user' AS family, min(turn) AS first_line, max(turn) AS last_line, string_agg(role, chr(31) ORDER BY turn) AS texts FROM r GROUP BY conv_id, role = 'user', island",
)
def _(v):
    return a.islands(v("conversations"), "conv_id", "turn", F.col("role") == "user", F.col("role")).select("conv_id", "family", "first_line", "last_line", q.joined(F.col("texts")).alias("texts"))
