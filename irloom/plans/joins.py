"""Queries of section C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.operators import graph, joins, query as q
from irloom.operators.visibility import visible
from irloom.plans.registry import query
from irloom.sources.schema import CONTAINER_KINDS


@query("c1_group_symbols", "SELECT m.group_id, m.ordinal, s.usr, s.qualified_name FROM ir_group_members m JOIN ir_symbols s ON s.usr = m.member_usr")
def _(v):
    return q.group_symbols(v.group_members, v.symbols).select("group_id", "ordinal", "usr", "qualified_name")


RELATES = "SELECT 'p:' || CAST(doc_id AS VARCHAR) AS symbol_usr, ' ' || source || ' ' AS value, doc_id AS ordinal FROM documents"


@query("c2_related_by_name", f"SELECT trim(f.value) AS related, row_number() OVER (PARTITION BY trim(f.value) ORDER BY s.qualified_name, s.usr, f.ordinal) - 1 AS position, s.usr FROM ({RELATES}) f JOIN ir_symbols s ON s.usr = f.symbol_usr")
def _(v):
    fields = v("documents").select(F.concat(F.lit("p:"), F.col("doc_id").cast("string")).alias("symbol_usr"), F.lit("relates").alias("name"), F.concat(F.lit(" "), "source", F.lit(" ")).alias("value"), F.col("doc_id").alias("ordinal"))
    return q.related_by_name(fields, v.symbols)


@query("c3_file_roots", "SELECT usr, file_id, kind, qualified_name FROM ir_symbols s WHERE NOT EXISTS (SELECT 1 FROM ir_symbols p WHERE p.usr = s.parent_usr AND p.file_id = s.file_id)")
def _(v):
    return q.file_roots(v.symbols).select("usr", "file_id", "kind", "qualified_name")


@query(
    "c4_related",
    """
WITH named AS (SELECT min_by(usr, line) AS usr, qualified_name AS related, min(line) AS rank FROM ir_symbols WHERE kind > 6 AND is_documented = 1 GROUP BY qualified_name),
hits AS (
  SELECT s.usr, n.usr AS other, 0 AS key, rank FROM ir_symbols s JOIN named n ON n.related = s.qualified_name WHERE s.usr <> n.usr
  UNION ALL SELECT s.usr, n.usr, 1, rank FROM ir_symbols s JOIN named n ON n.related = s.spelling WHERE s.usr <> n.usr)
SELECT h.usr, other, min_by(key, (key, rank)) AS key, min_by(rank, (key, rank)) AS rank FROM hits h JOIN ir_symbols o ON o.usr = h.other WHERE o.is_documented = 1 GROUP BY h.usr, other""",
)
def _(v):
    s = v.symbols
    named = s.where("kind > 6 AND is_documented = 1").groupBy(F.col("qualified_name").alias("related")).agg(F.min_by("usr", "line").alias("usr"), F.min("line").alias("rank"))
    return q.related_symbols(s, named, F.col("is_documented") == 1)


@query("c5_reference_targets", "SELECT from_usr, ref_kind, ordinal, to_usr, coalesce(s.qualified_name, to_spelling) AS target FROM ir_references r LEFT JOIN ir_symbols s ON s.usr = r.to_usr")
def _(v):
    return q.resolved_names(v.references, v.symbols).select("from_usr", "ref_kind", "ordinal", "to_usr", "target")


@query(
    "c6_record_recovery",
    """
WITH wanted AS (SELECT DISTINCT o_orderpriority AS name FROM orders UNION SELECT p_name FROM part UNION SELECT r_name FROM region UNION SELECT c_name FROM customer),
hits AS (SELECT name, usr, 0 AS n, line FROM wanted JOIN ir_symbols ON qualified_name = name UNION ALL SELECT name, usr, 1, line FROM wanted JOIN ir_symbols ON spelling = name)
SELECT name, min_by(usr, (n, line, usr)) AS match FROM hits GROUP BY name""",
)
def _(v):
    wanted = v("orders").select(F.col("o_orderpriority").alias("name")).union(v("part").select("p_name")).union(v("region").select("r_name")).union(v("customer").select("c_name")).distinct()
    return joins.first_match(wanted, v.symbols, [("name", "qualified_name"), ("name", "spelling")], ["line"], "name", "usr")


@query(
    "c7_structural_targets",
    """
WITH targets AS (SELECT DISTINCT spelling AS target, file_id FROM ir_symbols WHERE kind IN (1, 2, 3) UNION SELECT 'NATION_' || CAST(n_nationkey AS VARCHAR) || '::' || c_name, CAST(c_custkey % 5 + 1 AS BIGINT) FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT target, t.file_id, min(usr) AS usr FROM targets t JOIN ir_symbols s ON s.file_id = t.file_id AND (s.qualified_name = target OR ends_with(s.qualified_name, '::' || target)) AND s.kind IN (1, 2, 3, 4, 16) GROUP BY target, t.file_id HAVING count(*) = 1""",
)
def _(v):
    inner = v("customer").join(F.broadcast(v("nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # a fixed-size dimension
    targets = v.symbols.where("kind IN (1, 2, 3)").select(F.col("spelling").alias("target"), "file_id").union(inner.select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string"), F.lit("::"), "c_name"), (F.col("c_custkey") % 5 + 1).cast("long"))).distinct()
    return joins.suffix_matches(targets, v.symbols, F.col("kind").isin(CONTAINER_KINDS))


DEPS = "(SELECT CAST(l_orderkey AS VARCHAR) AS input, CAST(l_partkey AS VARCHAR) AS dep FROM lineitem)"


def _deps(v):
    return v("lineitem").select(F.col("l_orderkey").cast("string").alias("input"), F.col("l_partkey").cast("string").alias("dep"))


@query("c8_stale_inputs", f"SELECT DISTINCT input, input IS NULL AS unattributed FROM (SELECT CAST(p_partkey * 2 AS VARCHAR) AS path FROM part WHERE p_size > 45) LEFT JOIN {DEPS} ON dep = path")
def _(v):
    return joins.stale_inputs(v("part").where("p_size > 45").select((F.col("p_partkey") * 2).cast("string").alias("path")), _deps(v))


@query("c9_depends_only_on", f"SELECT dep FROM {DEPS} d LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS i FROM orders WHERE o_orderkey % 20 <> 0) ON i = input GROUP BY dep HAVING bool_and(i IS NOT NULL)")
def _(v):
    return joins.depends_only_on(_deps(v), v("orders").where("o_orderkey % 20 <> 0").select(F.col("o_orderkey").cast("string").alias("input")))


@query(
    "c10_uncovered_files",
    "WITH own AS (SELECT source AS path, lang || CAST(n_chars % 50 AS VARCHAR) AS name FROM documents WHERE doc_id % 2 = 0), ref AS (SELECT 'src' || CAST(page_id % 40 AS VARCHAR) AS path, 'en' || CAST(page_id % 60 AS VARCHAR) AS name FROM pages) SELECT DISTINCT path FROM ref WHERE path NOT IN (SELECT path FROM own) AND name NOT IN (SELECT name FROM own)",
)
def _(v):
    own = v("documents").where("doc_id % 2 = 0").select(F.col("source").alias("path"), F.concat("lang", (F.col("n_chars") % 50).cast("string")).alias("name"))
    ref = v("pages").select(F.concat(F.lit("src"), (F.col("page_id") % 40).cast("string")).alias("path"), F.concat(F.lit("en"), (F.col("page_id") % 60).cast("string")).alias("name"))
    return joins.uncovered(ref, own)


@query(
    "c11_identity_drift",
    """
WITH a AS (SELECT spelling, kind, file_id FROM ir_symbols), b AS (SELECT spelling, CASE WHEN line % 10 = 0 THEN 5 ELSE kind END AS kind, CASE WHEN line % 7 = 0 THEN file_id + 1 ELSE file_id END AS file_id FROM ir_symbols),
oa AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), ob AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a),
p AS (SELECT spelling, kind FROM oa INTERSECT ALL SELECT spelling, kind FROM ob)
SELECT 'a' AS side, * FROM (SELECT spelling, kind FROM oa EXCEPT ALL SELECT * FROM p) UNION ALL SELECT 'b', * FROM (SELECT spelling, kind FROM ob EXCEPT ALL SELECT * FROM p)""",
)
def _(v):
    a = v.symbols.select("spelling", "kind", "file_id", "line")
    b = a.select("spelling", F.when(F.col("line") % 10 == 0, 5).otherwise(F.col("kind")).alias("kind"), F.when(F.col("line") % 7 == 0, F.col("file_id") + 1).otherwise(F.col("file_id")).alias("file_id"))
    left, right = joins.identity_drift(a, b, ["spelling", "kind", "file_id"], ["spelling", "kind"])
    return left.select(F.lit("a").alias("side"), "*").union(right.select(F.lit("b"), "*"))


@query(
    "c12_carried_forward",
    """
WITH prev AS (SELECT * FROM ir_diagnostics WHERE pos % 2 = 0), fresh AS (SELECT * FROM ir_diagnostics WHERE pos % 2 = 1 AND severity >= 3),
re AS (SELECT DISTINCT file FROM ir_diagnostics WHERE file IN ('src/1.hpp', 'src/3.hpp')),
every AS (SELECT severity, text, file, pos, 0 AS batch FROM prev WHERE file NOT IN (SELECT file FROM re) AND (severity, text) NOT IN (SELECT (severity, text) FROM fresh) UNION ALL SELECT severity, text, file, pos, 1 FROM fresh)
SELECT severity, text, arg_min(file, (batch, pos)) AS file, arg_min(pos, (batch, pos)) AS pos, min(batch) AS batch FROM every GROUP BY severity, text""",
)
def _(v):
    d = v.diagnostics
    return joins.carried_forward(d.where("pos % 2 = 0"), d.where("pos % 2 = 1 AND severity >= 3"), d.where(F.col("file").isin("src/1.hpp", "src/3.hpp")))


@query(
    "c13_next_content_line",
    "WITH lines AS (SELECT conv_id AS file, turn AS line, role = 'assistant' AS blank FROM conversations), n AS (SELECT file, line, min(CASE WHEN NOT blank THEN line END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM lines) SELECT file, line, next FROM n WHERE line % 2 = 1",
)
def _(v):
    lines = v("conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), (F.col("role") == "assistant").alias("blank"))
    return joins.next_content_line(lines, lines.where("line % 2 = 1").select("file", "line"))


@query("c14_file_ids", "SELECT d.doc_id, f.id AS file_id FROM (SELECT doc_id, 'src/' || CASE lang WHEN 'en' THEN 'asia' WHEN 'fr' THEN 'africa' ELSE lang END || '.hpp' AS path FROM documents) d LEFT JOIN ir_files f ON f.path = d.path")
def _(v):
    region = F.when(F.col("lang") == "en", "asia").when(F.col("lang") == "fr", "africa").otherwise(F.col("lang"))
    return joins.with_file_ids(v("documents").select("doc_id", F.concat(F.lit("src/"), region, F.lit(".hpp")).alias("path")), v.files).select("doc_id", "file_id")


@query(
    "c15_unresolved_targets",
    "WITH t AS (SELECT unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS target FROM pages) SELECT target, count(*) AS n FROM t WHERE target NOT IN (SELECT source FROM documents UNION SELECT lang FROM documents UNION SELECT 'The') GROUP BY target",
)
def _(v):
    names = v("documents").select(F.col("source").alias("name")).union(v("documents").select("lang")).union(v.spark.range(1).select(F.lit("The")))
    return joins.unresolved_targets(v("pages").select(F.col("html").alias("text")), 'href="/([^"]*)"', names)


UP = """
WITH RECURSIVE up AS (
  SELECT s.usr, p.usr AS ancestor, p.spelling AS part, p.parent_usr AS next, 1 AS distance FROM ir_symbols s JOIN ir_symbols p ON p.usr = s.parent_usr
  UNION ALL SELECT up.usr, p.usr, p.spelling, p.parent_usr, distance + 1 FROM up JOIN ir_symbols p ON p.usr = up.next
)
"""


@query("c16_qualifiers", UP + "SELECT s.usr, coalesce(q || '::', '') || s.spelling AS qualified FROM ir_symbols s LEFT JOIN (SELECT usr, string_agg(part, '::' ORDER BY distance DESC) AS q FROM up GROUP BY usr) USING (usr)")
def _(v):
    return graph.qualifier(v.symbols, CONTAINER_KINDS)


@query("c16_visible_qualifiers", UP + "SELECT s.usr, coalesce(q || '::', '') || s.spelling AS qualified FROM ir_symbols s LEFT JOIN (SELECT usr, string_agg(part, '::' ORDER BY distance DESC) AS q FROM up GROUP BY usr) USING (usr) WHERE s.is_documented = 1 AND s.kind <> 1")
def _(v):
    s = visible(v.symbols, include_undocumented=True)
    return graph.qualifier(s, CONTAINER_KINDS).join(s.where("is_documented = 1 AND kind <> 1").select("usr"), "usr", "left_semi")
