"""Queries of section B: projections, filters and ordered lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.operators import query as q
from irloom.operators.aggregate import numbered
from irloom.operators.visibility import documented_below, visible
from irloom.plans.registry import query

NONE = "coalesce(parent_usr, '') = ''"


@query("b1_symbols_by_name", "SELECT usr, qualified_name, CAST(row_number() OVER (PARTITION BY kind ORDER BY qualified_name, usr) AS BIGINT) AS position FROM ir_symbols")
def _(v):
    return numbered(v.symbols.select("kind", "usr", "qualified_name"), ["kind"], ["qualified_name", "usr"]).select("usr", "qualified_name", (F.col("position") + 1).alias("position"))


@query("b2_symbol_lookup", "SELECT r.from_usr, r.ordinal, s.* FROM ir_references r JOIN ir_symbols s ON s.usr = r.to_usr WHERE ref_kind = 2")
def _(v):
    return v.references.where("ref_kind = 2").select("from_usr", "ordinal", F.col("to_usr").alias("usr")).join(v.symbols, "usr")


@query("b3_roots", f"SELECT usr, kind, qualified_name FROM ir_symbols WHERE {NONE}")
def _(v):
    return q.roots(v.symbols).select("usr", "kind", "qualified_name")


@query("b4_children", f"SELECT parent_usr, string_agg(usr, chr(31) ORDER BY kind, line, qualified_name, usr) AS children FROM ir_symbols WHERE NOT ({NONE}) GROUP BY parent_usr")
def _(v):
    return q.children_of(v.symbols).select("parent_usr", q.joined(F.col("children")).alias("children"))


@query("b5_references", "SELECT from_usr, string_agg(to_spelling, chr(31) ORDER BY ref_kind, ordinal, to_usr NULLS FIRST, to_spelling) AS targets FROM ir_references GROUP BY from_usr")
def _(v):
    return q.references_of(v.references).select("from_usr", q.joined(F.col("targets")).alias("targets"))


@query("b6_bases", "SELECT from_usr, string_agg(to_spelling, chr(31) ORDER BY ref_kind, ordinal, to_usr NULLS FIRST, to_spelling) AS targets FROM (SELECT from_usr, ref_kind - 1 AS ref_kind, to_usr, to_spelling, ordinal FROM ir_references) WHERE ref_kind = 0 GROUP BY from_usr")
def _(v):
    return q.references_of(v.references.withColumn("ref_kind", F.col("ref_kind") - 1), [0]).select("from_usr", q.joined(F.col("targets")).alias("targets"))


@query("b7_friends", "SELECT from_usr, string_agg(to_spelling, chr(31) ORDER BY ref_kind, ordinal, to_usr NULLS FIRST, to_spelling) AS targets FROM (SELECT from_usr, ref_kind + 5 AS ref_kind, to_usr, to_spelling, ordinal FROM ir_references) WHERE ref_kind = 7 GROUP BY from_usr")
def _(v):
    return q.references_of(v.references.withColumn("ref_kind", F.col("ref_kind") + 5), [7]).select("from_usr", q.joined(F.col("targets")).alias("targets"))


@query("b8_parameters", "SELECT l_orderkey AS function_usr, string_agg('part ' || CAST(l_partkey AS VARCHAR), chr(31) ORDER BY l_linenumber, l_partkey) AS names FROM lineitem GROUP BY l_orderkey")
def _(v):
    rows = v("lineitem").select(F.col("l_orderkey").alias("function_usr"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("tie"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"))
    return q.by_position(rows, "function_usr", "idx", "name", "tie").select("function_usr", q.joined(F.col("values")).alias("names"))


@query("b9_template_parameters", "SELECT o_custkey AS owner_usr, string_agg(o_orderpriority, chr(31) ORDER BY o_orderkey) AS names FROM orders GROUP BY o_custkey")
def _(v):
    rows = v("orders").select(F.col("o_custkey").alias("owner_usr"), F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("name"))
    return q.by_position(rows, "owner_usr", "idx", "name").select("owner_usr", q.joined(F.col("values")).alias("names"))


@query("b10_enumerators", "SELECT p_type AS enum_usr, string_agg(p_name, chr(31) ORDER BY p_partkey) AS names FROM part GROUP BY p_type")
def _(v):
    rows = v("part").select(F.col("p_type").alias("enum_usr"), F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"))
    return q.by_position(rows, "enum_usr", "idx", "name").select("enum_usr", q.joined(F.col("values")).alias("names"))


@query("b11_groups", "SELECT id, title, CAST(row_number() OVER (ORDER BY title, id) AS BIGINT) AS position FROM ir_groups")
def _(v):
    from pyspark.sql import Window as W

    return v.groups.select("id", "title", F.row_number().over(W.orderBy("title", "id")).cast("long").alias("position"))  # groups are few: one task orders them, as the report does


@query("b12_group_lookup", "SELECT g.id, g.title, count(*) AS asked FROM ir_group_members m JOIN ir_groups g ON g.id = m.group_id GROUP BY g.id, g.title")
def _(v):
    return v.group_members.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("asked")).join(v.groups.select("id", "title"), "id")


@query("b13_root_groups", "SELECT id, title FROM ir_groups WHERE coalesce(parent_group_id, '') = ''")
def _(v):
    return v.groups.where(q.empty("parent_group_id")).select("id", "title")


@query("b14_subgroups", "SELECT parent_group_id, string_agg(id, chr(31) ORDER BY title, id) AS subgroups FROM ir_groups WHERE coalesce(parent_group_id, '') <> '' GROUP BY parent_group_id")
def _(v):
    return v.groups.where(~q.empty("parent_group_id")).groupBy("parent_group_id").agg(q.joined(q.ordered(["title", "id"], "id")).alias("subgroups"))


@query("b15_group_members", "SELECT group_id, member_usr, CAST(row_number() OVER (PARTITION BY group_id ORDER BY ordinal) AS BIGINT) AS position FROM ir_group_members WHERE coalesce(member_usr, '') <> ''")
def _(v):
    return numbered(q.group_member_usrs(v.group_members), ["group_id"], ["ordinal", "member_usr"]).select("group_id", "member_usr", (F.col("position") + 1).alias("position"))


@query("b16_files", "SELECT id, path, sha256, size_bytes FROM ir_files")
def _(v):
    return v.files.orderBy("path")


@query("b17_raw_comment", "SELECT symbol_usr, value AS raw_text FROM ir_comment_fields WHERE ordinal = 0")
def _(v):
    return v.comment_fields.where("ordinal = 0").select("symbol_usr", F.col("value").alias("raw_text"))


@query("b18_symbol_rows", "SELECT usr, coalesce(parent_usr, '') AS parent_usr, kind, spelling, qualified_name, is_definition = 1 AS is_definition, is_documented = 1 AS is_documented, file_id, line FROM ir_symbols")
def _(v):
    return q.to_symbol(v.symbols)


DOCUMENTED_BELOW = """
WITH RECURSIVE up AS (
  SELECT parent_usr AS usr FROM ir_symbols WHERE is_documented = 1 AND coalesce(parent_usr, '') <> ''
  UNION SELECT s.parent_usr FROM up JOIN ir_symbols s ON s.usr = up.usr WHERE coalesce(s.parent_usr, '') <> ''
)
"""


@query("b19_visible", DOCUMENTED_BELOW + "SELECT usr FROM ir_symbols s WHERE file_id <= 3 AND (is_documented = 1 OR EXISTS (SELECT 1 FROM up WHERE up.usr = s.usr))")
def _(v):
    return visible(v.symbols, F.col("file_id") <= 3).select("usr")


@query("b20_warnings_or_worse", "SELECT pos, text FROM ir_diagnostics WHERE severity >= 2")
def _(v):
    return v.diagnostics.where("severity >= 2").select("pos", "text")


@query("b20_errors_at_top", "SELECT pos, text FROM ir_diagnostics WHERE severity >= 3 AND depth = 0")
def _(v):
    return v.diagnostics.where("severity >= 3 AND depth = 0").select("pos", "text")


@query("b21_visible_children", DOCUMENTED_BELOW + "SELECT parent_usr, string_agg(usr, chr(31) ORDER BY kind, line, qualified_name, usr) AS children FROM ir_symbols s WHERE coalesce(parent_usr, '') <> '' AND (is_documented = 1 OR EXISTS (SELECT 1 FROM up WHERE up.usr = s.usr)) GROUP BY parent_usr")
def _(v):
    return q.children_of(visible(v.symbols)).select("parent_usr", q.joined(F.col("children")).alias("children"))


@query("b21_visible_roots", DOCUMENTED_BELOW + "SELECT usr FROM ir_symbols s WHERE coalesce(parent_usr, '') = '' AND (is_documented = 1 OR EXISTS (SELECT 1 FROM up WHERE up.usr = s.usr))")
def _(v):
    return q.roots(visible(v.symbols)).select("usr")


@query("b21_visible_file_roots", DOCUMENTED_BELOW + "SELECT usr, file_id FROM ir_symbols s WHERE NOT EXISTS (SELECT 1 FROM ir_symbols p WHERE p.usr = s.parent_usr AND p.file_id = s.file_id) AND (is_documented = 1 OR EXISTS (SELECT 1 FROM up WHERE up.usr = s.usr))")
def _(v):
    below = documented_below(v.symbols)
    return q.file_roots(v.symbols).join(below.withColumn("below", F.lit(True)), "usr", "left").where("is_documented = 1 OR below").select("usr", "file_id")


@query("b22_underlying", "SELECT from_usr, min_by(to_spelling, (ordinal, to_spelling)) AS underlying FROM ir_references WHERE ref_kind = 1 GROUP BY from_usr")
def _(v):
    return v.references.where("ref_kind = 1").groupBy("from_usr").agg(F.min_by("to_spelling", F.struct("ordinal", "to_spelling")).alias("underlying"))
