"""Queries of section M over whole page sets: plans with stems and hubs, and pages as fragments with all that is below."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.functions import scalar as s
from irloom.functions.comment import structs_from_fields
from irloom.operators import fingerprints as fp, pages as pg, plan, query as q, render, templates
from irloom.operators.state import cut
from irloom.operators.visibility import visible
from irloom.plans.lookups import DOCUMENTED_BELOW
from irloom.plans.pages import _FIELDS_SQL, FIELDS, SLUG, _block_sql, _case, _stem
from irloom.plans.registry import query

NL = "chr(10)"
RESERVED = ["index"]

#: Namespaces without members: every tenth customer opens one in its nation, and a second one in that; some are documented.
SPACES = """
hollow AS (
  SELECT 'e:' || CAST(c_custkey AS VARCHAR) AS usr, 'n:' || CAST(c_nationkey AS VARCHAR) AS parent_usr, 'Hollow' || CAST(c_custkey % 30 AS VARCHAR) AS spelling, 'hollow::' || CAST(c_custkey AS VARCHAR) AS qualified_name, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS is_documented, c_custkey AS line FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT 'e2:' || CAST(c_custkey AS VARCHAR), 'e:' || CAST(c_custkey AS VARCHAR), 'Inner', 'hollow::' || CAST(c_custkey AS VARCHAR) || '::Inner', CASE WHEN c_custkey % 20 = 0 THEN 1 ELSE 0 END, c_custkey FROM customer WHERE c_custkey % 10 = 0),
sym AS (SELECT usr, coalesce(parent_usr, '') AS parent_usr, kind, spelling, qualified_name, is_documented, line FROM ir_symbols UNION ALL SELECT usr, parent_usr, 1, spelling, qualified_name, is_documented, line FROM hollow)"""


def _with_hollow(v):
    c = v("customer").where("c_custkey % 10 = 0")
    key = F.col("c_custkey").cast("string")
    row = lambda usr, parent, name, qualified, documented: c.select(usr.alias("usr"), parent.alias("parent_usr"), F.lit(1).alias("kind"), name.alias("spelling"), qualified.alias("qualified_name"), F.lit(1).alias("is_definition"), documented.cast("int").alias("is_documented"), F.lit(1).cast("long").alias("file_id"), F.col("c_custkey").cast("long").alias("line"))
    outer, qualified = F.concat(F.lit("e:"), key), F.concat(F.lit("hollow::"), key)
    one = row(outer, F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")), F.concat(F.lit("Hollow"), (F.col("c_custkey") % 30).cast("string")), qualified, F.when(F.col("c_acctbal") > 5000, 1).otherwise(0))
    two = row(F.concat(F.lit("e2:"), key), outer, F.lit("Inner"), F.concat(qualified, F.lit("::Inner")), F.when(F.col("c_custkey") % 20 == 0, 1).otherwise(0))
    return v.symbols.unionByName(one).unionByName(two)


_PAD = "lpad(CAST(line AS VARCHAR), 12, '0')"
WALK = f"""
ns AS (
  SELECT usr, parent_usr, qualified_name, spelling, is_documented, 0 AS depth, '0' || spelling || chr(1) || {_PAD} || chr(1) || qualified_name || chr(1) || usr || chr(2) AS path FROM sym WHERE kind = 1 AND parent_usr = ''
  UNION ALL SELECT s.usr, s.parent_usr, s.qualified_name, s.spelling, s.is_documented, depth + 1, path || '0' || s.spelling || chr(1) || {_PAD.replace('line', 's.line')} || chr(1) || s.qualified_name || chr(1) || s.usr || chr(2) FROM ns JOIN sym s ON s.parent_usr = ns.usr WHERE s.kind = 1),
keep AS (
  SELECT usr, parent_usr FROM ns WHERE is_documented = 1 OR usr IN (SELECT parent_usr FROM sym WHERE kind <> 1)
  UNION SELECT n.usr, n.parent_usr FROM keep JOIN ns n ON n.usr = keep.parent_usr)"""

PLAN = f"""WITH RECURSIVE {SPACES.strip()},{WALK},
hubs AS (SELECT * FROM ns WHERE usr IN (SELECT usr FROM keep)),
scoped AS (SELECT s.*, h.qualified_name AS h_name, h.path FROM sym s JOIN hubs h ON h.usr = s.parent_usr WHERE s.kind <> 1 UNION ALL SELECT *, '', '' FROM sym WHERE parent_usr = '' AND kind <> 1),
parted AS (SELECT *, CASE WHEN kind IN (2, 3, 4, 16) THEN 1 WHEN kind IN (5, 6, 7, 8, 15) AND starts_with(spelling, 'operator') THEN 3 WHEN kind IN (5, 6, 7, 8, 15) THEN 2 WHEN kind IN (11, 13, 14, 17) THEN 4 WHEN kind IN (10, 18) THEN 5 ELSE 6 END AS part FROM scoped),
lumps AS (SELECT part, parent_usr, h_name, path, CASE WHEN part = 2 THEN spelling ELSE '' END AS inside, min_by(qualified_name, (kind, line, qualified_name, usr)) AS first FROM parted WHERE part > 1 GROUP BY ALL),
lumped AS (SELECT *, CASE part WHEN 3 THEN 'Operators' WHEN 4 THEN 'Types' WHEN 5 THEN 'Constants' WHEN 6 THEN 'Other' ELSE inside END AS caption FROM lumps),
planned AS (
  SELECT 'hub' || chr(31) || usr AS page, parent_usr AS scope, 7 AS part, qualified_name AS name, qualified_name AS label, 'Namespace `' || qualified_name || '`' AS title, parent_usr = '' AS top, path || '7' AS walk, spelling AS caption, path AS entry FROM hubs
  UNION ALL SELECT 'record' || chr(31) || usr, parent_usr, 1, qualified_name, qualified_name, '', parent_usr = '', path || '1' || spelling || chr(1) || CAST(kind + 10 AS VARCHAR) || {_PAD} || qualified_name || chr(1) || usr, spelling, path || '1' || spelling || chr(1) || CAST(kind + 10 AS VARCHAR) || {_PAD} || qualified_name || chr(1) || usr FROM parted WHERE part = 1
  UNION ALL SELECT CASE WHEN part = 2 THEN 'function' || chr(31) || parent_usr || chr(31) || inside ELSE 'lump' || chr(31) || parent_usr || chr(31) || CAST(part AS VARCHAR) END, parent_usr, part, CASE WHEN part = 2 THEN first WHEN h_name <> '' THEN h_name || '::' || lower(caption) ELSE lower(caption) END, CASE WHEN part = 2 THEN first WHEN h_name <> '' THEN h_name || '::' || lower(caption) ELSE lower(caption) END,
    CASE WHEN part = 2 THEN 'Function `' || first || '`' ELSE caption || ' in ' || CASE WHEN h_name <> '' THEN '`' || h_name || '`' ELSE 'the global namespace' END END, parent_usr = '', path || CAST(part AS VARCHAR) || inside, caption, path || CAST(part AS VARCHAR) || inside FROM lumped
  UNION ALL SELECT 'group:' || id, coalesce(parent_group_id, ''), 6, 'group_' || id, title, title, true, '9' || CASE WHEN coalesce(parent_group_id, '') = '' THEN '0' ELSE '1' END || title || chr(1) || id, NULL, NULL FROM ir_groups),
"""


def _stems_sql(source: str) -> str:
    slug = SLUG.format("name")
    digest = "left(sha256(name), 8)"
    return f"""
asked AS (SELECT *, {_stem('name')} AS bare FROM {source}),
claimed AS (SELECT *, (SELECT count(DISTINCT name) FROM asked b WHERE lower(b.bare) = lower(a.bare)) > 1 AS contested FROM asked a),
told AS (SELECT *, CASE WHEN contested THEN CASE WHEN length({slug}) > 87 THEN rtrim(left({slug}, 78), '_') || '_' || {digest} ELSE {slug} END || '_' || {digest} ELSE bare END AS s FROM claimed),
stemmed AS (SELECT *, s || repeat('_', CAST(row_number() OVER (PARTITION BY lower(s) ORDER BY walk, page) - 1 + CASE WHEN lower(s) = 'index' THEN 1 ELSE 0 END AS INTEGER)) AS stem FROM told)"""


def _namespace_pages(v):
    return _stemmed(v, _with_hollow(v))


def _stemmed(v, rows):
    pages, seeds, entries = plan.namespace_plan(rows)
    # Read again for what links and what lists the pages.
    return cut(plan.with_stems(pages.unionByName(plan.group_plan(v.groups)), RESERVED)), cut(seeds), entries


@query("m10_page_plan", PLAN + _stems_sql("planned").strip() + " SELECT page, scope, part, name, label, title, top, stem, CAST(row_number() OVER (ORDER BY walk, page) - 1 AS BIGINT) AS position FROM stemmed")
def _(v):
    """Every page of the namespace hierarchy, groups behind; a part and an operator are global functions, types and constants."""
    pages, _, _ = _namespace_pages(v)
    return plan.numbered(pages, [], ["place", "page"]).select("page", "scope", "part", "name", "label", "title", "top", "stem", "position")


@query("m5_hub_entries", PLAN + _stems_sql("planned").strip() + " SELECT scope, CAST(row_number() OVER (PARTITION BY scope ORDER BY entry, page) - 1 AS BIGINT) AS position, stem, caption FROM stemmed WHERE scope <> '' AND page NOT LIKE 'group:%'")
def _(v):
    """What each hub lists: hubs below it, records, functions by name and what else it holds, under the stems that their pages got."""
    pages, _, entries = _namespace_pages(v)
    return plan.hub_entries(entries, pages)


@query("d6_kept_hubs", f"WITH RECURSIVE {SPACES.strip()},{WALK} SELECT usr, depth FROM ns WHERE usr IN (SELECT usr FROM keep)")
def _(v):
    """Empty namespaces included: one stays if it, or one below it, is documented."""
    rows = _with_hollow(v)
    pages, _, _ = plan.namespace_plan(rows)
    hubs = pages.where(F.col("part") == plan.HUB).select(F.element_at(F.split("page", plan.SEP), 2).alias("usr"))
    depth = plan.tree.intervals(plan.shown(rows.where("kind = 1")), ["spelling"]).select("usr", "depth")
    return depth.join(hubs, "usr")


VIS = DOCUMENTED_BELOW.rstrip().replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + ", vis AS (SELECT *, coalesce(parent_usr, '') AS parent FROM ir_symbols s WHERE is_documented = 1 OR EXISTS (SELECT 1 FROM up WHERE up.usr = s.usr))"
_KEY = "lpad(CAST({0}.kind AS VARCHAR), 3, '0') || lpad(CAST({0}.line AS VARCHAR), 12, '0') || {0}.qualified_name || chr(1) || {0}.usr || chr(2)"

CLASSES = VIS + f""",
spaces AS (
  SELECT usr, parent, kind, qualified_name, is_documented, lpad(CAST(kind AS VARCHAR), 3, '0') || lpad('0', 12, '0') || qualified_name || chr(1) || usr || chr(2) AS walk FROM vis WHERE parent = ''
  UNION ALL SELECT c.usr, c.parent, c.kind, c.qualified_name, c.is_documented, walk || {_KEY.format('c')} FROM spaces p JOIN vis c ON c.parent = p.usr WHERE p.kind = 1 AND c.kind IN (1, 2, 3, 4, 16)),
planned AS (
  SELECT usr AS page, parent AS scope, 6 AS part, qualified_name AS name, 'Namespace `' || qualified_name || '`' AS title, walk FROM spaces n WHERE kind = 1 AND (is_documented = 1 OR EXISTS (SELECT 1 FROM vis l WHERE l.parent = n.usr AND l.kind NOT IN (1, 2, 3, 4, 16)))
  UNION ALL SELECT usr, parent, 1, qualified_name, '', walk FROM spaces WHERE kind <> 1),
"""


@query("m5_hub_fragments", PLAN + _stems_sql("planned").strip() + f""",
e AS (SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY entry, page) - 1 AS n, count(*) OVER (PARTITION BY scope) AS m, stem, caption FROM stemmed WHERE scope <> '' AND page NOT LIKE 'group:%')
SELECT 'hub' || chr(31) || scope AS page, 0 AS position, n AS "offset", {render.BODY} AS part, 0 AS piece, CASE WHEN n = 0 THEN {NL} || '```{{toctree}}' || {NL} || ':maxdepth: 1' || {NL} || {NL} ELSE '' END || caption || ' <' || stem || '>' || {NL} || CASE WHEN n = m - 1 THEN '```' || {NL} ELSE '' END AS text FROM e""")
def _(v):
    """The tables of contents of all hubs, an entry a row."""
    pages, _, entries = _namespace_pages(v)
    return render.hub_fragments(pages, plan.hub_entries(entries, pages))


@query("m9_class_plan", CLASSES + _stems_sql("planned").strip() + " SELECT page, scope, part, name, title, stem, CAST(row_number() OVER (ORDER BY walk, page) - 1 AS BIGINT) AS position FROM stemmed")
def _(v):
    """A page a record and a root, a namespace's other members on one of its own."""
    pages, _ = plan.class_plan(visible(v.symbols))
    return plan.numbered(plan.with_stems(pages, RESERVED), [], ["place", "page"]).select("page", "scope", "part", "name", "title", "stem", "position")


_INDEX_SQL = VIS + ", planned AS (SELECT usr AS page, qualified_name AS name, qualified_name AS label, lpad(CAST(kind AS VARCHAR), 3, '0') || qualified_name || chr(1) || usr AS walk FROM vis WHERE parent = '' UNION ALL SELECT 'group:' || id, 'group_' || id, title, '9' || CASE WHEN coalesce(parent_group_id, '') = '' THEN '0' ELSE '1' END || title || chr(1) || id FROM ir_groups)," + _stems_sql("planned")


@query("m4_index_entries", _INDEX_SQL + " SELECT CAST(row_number() OVER (ORDER BY walk, page) - 1 AS BIGINT) AS position, stem, label FROM stemmed")
def _(v):
    """A page a root, groups behind: what the index lists, in order, under the stems that the pages got. Many parts share a name."""
    pages, _ = plan.symbol_plan(visible(v.symbols))
    return plan.index_entries(plan.with_stems(pages.unionByName(plan.group_plan(v.groups)), RESERVED))


@query("m4_index_fragments", _INDEX_SQL + f", n AS (SELECT row_number() OVER (ORDER BY walk, page) - 1 AS position, count(*) OVER () AS m, stem FROM stemmed) SELECT position, CASE WHEN position = 0 THEN '# API' || {NL} || {NL} || '```{{toctree}}' || {NL} || ':maxdepth: 2' || {NL} || {NL} ELSE '' END || stem || {NL} || CASE WHEN position = m - 1 THEN '```' || {NL} ELSE '' END AS text FROM n")
def _(v):
    """The index itself, a stem a row."""
    pages, _ = plan.symbol_plan(visible(v.symbols))
    return render.index_fragments(plan.index_entries(plan.with_stems(pages.unionByName(plan.group_plan(v.groups)), RESERVED)), "API")


def _sides(v):
    """Bases, friends, related functions, enumerators and scopes around enums, of the given tables."""
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k = F.col("c_custkey")
    ref = lambda rows, frm, kind, to, spelling, n: rows.select(frm.alias("from_usr"), F.lit(kind).alias("ref_kind"), to.alias("to_usr"), spelling.alias("to_spelling"), F.lit(n).alias("ordinal"))
    c, sup, p = v("customer"), v("supplier"), v("part")
    refs = ref(c.where("c_custkey % 3 = 0"), text("c:", k), 0, F.when(k % 6 == 0, text("c:", (k / 3).cast("long"))), text("Base", k % 7), 0)
    refs = refs.unionByName(ref(c.where("c_custkey % 5 = 0"), text("c:", k), 0, text("s:", k), text("Sup", k), 1))
    n = F.col("s_suppkey")
    refs = refs.unionByName(ref(sup, text("s:", n), 7, F.when(n % 4 != 0, text("c:", n)), F.when(n % 8 != 0, "F").otherwise(""), 0))
    related = p.where("p_size > 25 AND p_type = 'ECONOMY'").select(text("c:", F.col("p_partkey") % 40).alias("usr"), text("p:", F.col("p_partkey")).alias("other"), F.lit(0).alias("key"), F.col("p_partkey").alias("rank"))
    items = v("lineitem").where("l_linenumber = 1").select("l_partkey", "l_orderkey").distinct()
    enumerators = items.select(text("p:", F.col("l_partkey")).alias("enum_usr"), F.concat(text("v:", F.col("l_orderkey")), F.lit("/"), F.col("l_partkey").cast("string")).alias("usr"), text("E", F.col("l_orderkey")).alias("name"), F.col("l_orderkey").alias("idx"))
    scopes = p.where("p_partkey % 2 = 0").select(text("p:", F.col("p_partkey")).alias("usr"), text("template<typename T> P", F.col("p_partkey")).alias("scope"))
    fields = v.comment_fields.withColumn("name", F.when(F.col("name") == "user", "brief").otherwise("note"))
    told = structs_from_fields(fields)
    comments = told.select(text("c:", F.col("symbol_usr")).alias("symbol_usr"), "comment").unionByName(told.select(text("p:", F.col("symbol_usr")).alias("symbol_usr"), "comment"))
    return {"references": refs, "related": related, "enumerators": enumerators, "scopes": scopes, "comments": comments}


def _fragments_sql(nodes: str) -> str:
    """Fragments of `nodes` (page, position, offset, lvl, usr, kind, qualified_name, degraded; offset -1 where a symbol is shown alone) and `titles` (page, title)."""
    label, directive = _case(s.LABEL, "Symbol"), _case(s.DIRECTIVE, "cpp:type")
    told = f"string_agg(':::{{note}}' || {NL} || text || {NL} || ':::', {NL} || {NL} ORDER BY turn) FILTER (WHERE role <> 'user')"
    bq = "'```'"
    body = f"CASE WHEN degraded THEN {bq} || 'cpp' || {NL} || qualified_name || {NL} || {bq} || {NL} || {NL} || prose || {NL} WHEN kind = 1 THEN prose || {NL} ELSE {bq} || '{{' || {directive} || '}} ' || qualified_name || {NL} || {NL} || prose || {NL} || {bq} || {NL} END"
    ref = lambda kind, lead: f"SELECT from_usr, '{lead}' || string_agg(item, ', ' ORDER BY ordinal, to_usr, item) || '.' || {NL} || {NL} AS text FROM (SELECT from_usr, ordinal, coalesce(to_usr, '') AS to_usr, coalesce('{{cpp:any}}`' || t.qualified_name || '`', '`' || nullif(to_spelling, '') || '`', '') AS item FROM refs LEFT JOIN shown t ON t.usr = to_usr WHERE ref_kind = {kind}) WHERE item <> '' GROUP BY from_usr"
    return f"""{nodes},
told AS (SELECT conv_id, trim(regexp_replace(concat_ws({NL} || {NL}, nullif(max_by(text, turn) FILTER (WHERE role = 'user'), ''), {told}), {NL} || '{{3,}}', {NL} || {NL}, 'g'), {NL}) AS prose FROM conversations GROUP BY conv_id),
talk AS (SELECT 'c:' || CAST(conv_id AS VARCHAR) AS t_usr, prose FROM told UNION ALL SELECT 'p:' || CAST(conv_id AS VARCHAR), prose FROM told),
full_ AS (SELECT n.*, coalesce(prose, '{pg.MISSING}') AS prose FROM nodes n LEFT JOIN talk ON t_usr = usr),
whole AS (SELECT * FROM full_ WHERE "offset" >= 0),
refs AS (
  SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS from_usr, 0 AS ref_kind, CASE WHEN c_custkey % 6 = 0 THEN 'c:' || CAST(c_custkey // 3 AS VARCHAR) END AS to_usr, 'Base' || CAST(c_custkey % 7 AS VARCHAR) AS to_spelling, 0 AS ordinal FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'c:' || CAST(c_custkey AS VARCHAR), 0, 's:' || CAST(c_custkey AS VARCHAR), 'Sup' || CAST(c_custkey AS VARCHAR), 1 FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT 's:' || CAST(s_suppkey AS VARCHAR), 7, CASE WHEN s_suppkey % 4 <> 0 THEN 'c:' || CAST(s_suppkey AS VARCHAR) END, CASE WHEN s_suppkey % 8 <> 0 THEN 'F' ELSE '' END, 0 FROM supplier),
bases AS ({ref(0, render.LEAD[render.BASES])}), friends AS ({ref(7, render.LEAD[render.FRIENDS])}),
related AS (SELECT 'c:' || CAST(p_partkey % 40 AS VARCHAR) AS from_usr, '{render.LEAD[render.RELATED]}' || string_agg('{{cpp:any}}`' || p_name || '`', ', ' ORDER BY p_partkey) || '.' || {NL} || {NL} AS text FROM part JOIN shown ON usr = 'p:' || CAST(p_partkey AS VARCHAR) WHERE p_size > 25 AND p_type = 'ECONOMY' GROUP BY p_partkey % 40),
records AS (SELECT * FROM whole WHERE kind IN (2, 3, 4, 16) AND NOT degraded), enums AS (SELECT * FROM whole WHERE kind = 11 AND NOT degraded),
pushed AS (SELECT *, 'template<typename T> P' || usr[3:] AS scope FROM enums WHERE CAST(usr[3:] AS BIGINT) % 2 = 0),
named AS (SELECT 'p:' || CAST(l_partkey AS VARCHAR) AS e_usr, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) - 1 AS n FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_linenumber = 1))
SELECT page, position, "offset", 0 AS part, 0 AS piece, CASE WHEN lvl = 1 THEN '' ELSE {NL} END || repeat('#', least(lvl, 6)) || ' ' || {label} || ' `' || qualified_name || '`' || {NL} || {NL} AS text FROM whole
UNION ALL SELECT page, position, "offset", 1, 0, text FROM records JOIN bases ON from_usr = usr
UNION ALL SELECT page, position, "offset", 2, 0, text FROM records JOIN friends ON from_usr = usr
UNION ALL SELECT page, position, "offset", 3, 0, text FROM records JOIN related ON from_usr = usr
UNION ALL SELECT page, position, "offset", 2, 0, '```{{cpp:namespace-push}} ' || scope || {NL} || {bq} || {NL} || {NL} FROM pushed
UNION ALL SELECT page, position, "offset", 4, 0, {body} FROM whole
UNION ALL SELECT page, position, "offset", 5, CAST(n AS INTEGER), {NL} || {bq} || '{{cpp:enumerator}} ' || qualified_name || '::E' || CAST(l_orderkey AS VARCHAR) || {NL} || {bq} || {NL} FROM enums JOIN named ON e_usr = usr
UNION ALL SELECT page, position, "offset", 6, 0, {NL} || '```{{cpp:namespace-pop}}' || {NL} || {bq} || {NL} FROM pushed
UNION ALL SELECT page, -1, 0, 4, 0, {NL} || prose || {NL} FROM full_ WHERE "offset" < 0
UNION ALL SELECT page, -1, 0, 0, 0, '# ' || title || {NL} FROM titles"""


_DOWN = f"""walk AS (
  SELECT page, position, usr, kind, qualified_name, 0 AS depth, '' AS path FROM seeds
  UNION ALL SELECT w.page, w.position, c.usr, c.kind, c.qualified_name, depth + 1, path || {_KEY.format('c')} FROM walk w JOIN below c ON c.parent = w.usr WHERE w.kind IN (1, 2, 3, 4, 16))"""


@query("m1_page_fragments", _fragments_sql(VIS + ", shown AS (SELECT * FROM vis), below AS (SELECT * FROM vis), seeds AS (SELECT usr AS page, 0 AS position, usr, kind, qualified_name FROM vis WHERE parent = ''), " + _DOWN + ", titles AS (SELECT '' AS page, '' AS title WHERE false), nodes AS (SELECT page, position, row_number() OVER (PARTITION BY page ORDER BY path) - 1 AS \"offset\", depth + 1 AS lvl, usr, kind, qualified_name, false AS degraded FROM walk)"))
def _(v):
    """A page a root, four levels deep: regions hold nations, these customers and suppliers, these orders."""
    rows = visible(v.symbols)
    pages, seeds = plan.symbol_plan(rows)
    return render.fragments(rows, pages, seeds, **_sides(v))


FILES = """WITH RECURSIVE held AS (SELECT s.*, coalesce(p.usr, '') AS parent FROM ir_symbols s LEFT JOIN ir_symbols p ON p.usr = s.parent_usr AND p.file_id = s.file_id WHERE s.file_id IS NOT NULL),
up AS (SELECT parent AS usr FROM held WHERE is_documented = 1 AND parent <> '' UNION SELECT s.parent FROM up JOIN held s ON s.usr = up.usr WHERE s.parent <> ''),
below AS (SELECT * FROM held s WHERE is_documented = 1 OR EXISTS (SELECT 1 FROM up WHERE up.usr = s.usr)), shown AS (SELECT * FROM below),
seeds AS (SELECT 'file:' || CAST(file_id AS VARCHAR) AS page, row_number() OVER (PARTITION BY file_id ORDER BY kind, qualified_name, usr) - 1 AS position, usr, kind, qualified_name FROM below WHERE parent = ''), """
_FIRST = "ranked AS (SELECT *, first_value(usr) OVER w AS f_usr, first_value(kind) OVER w AS f_kind FROM placed WINDOW w AS (PARTITION BY page, qualified_name, kind <> 1, \"offset\" >= 0 ORDER BY position, \"offset\")), nodes AS (SELECT *, kind <> 1 AND \"offset\" >= 0 AND f_usr <> usr AND NOT (kind IN (5, 6, 7, 8, 15) AND f_kind IN (5, 6, 7, 8, 15)) AS degraded FROM ranked)"


@query("m14_file_fragments", _fragments_sql(FILES + _DOWN + ", titles AS (SELECT 'file:' || CAST(id AS VARCHAR) AS page, 'File `' || path || '`' AS title FROM ir_files WHERE id IN (SELECT file_id FROM below)), placed AS (SELECT page, position, row_number() OVER (PARTITION BY page, position ORDER BY path) - 1 AS \"offset\", depth + 2 AS lvl, usr, kind, qualified_name FROM walk), " + _FIRST))
def _(v):
    """A page a file: what stands in the file, below its roots there; names that a page has twice are degraded."""
    held = plan.within_files(v.symbols)
    rows = visible(held)
    pages, seeds = plan.file_plan(v.files, rows)
    return render.fragments(rows, pages, seeds, **_sides(v))


MEMBERS = PLAN.rstrip().rstrip(",") + """, shown AS (SELECT *, parent_usr AS parent FROM sym), below AS (SELECT * FROM shown),
seeds AS (
  SELECT 'record' || chr(31) || usr AS page, 0 AS position, usr, kind, qualified_name FROM parted WHERE part = 1
  UNION ALL SELECT CASE WHEN part = 2 THEN 'function' || chr(31) || parent_usr || chr(31) || spelling ELSE 'lump' || chr(31) || parent_usr || chr(31) || CAST(part AS VARCHAR) END, row_number() OVER (PARTITION BY parent_usr, part, CASE WHEN part = 2 THEN spelling END ORDER BY spelling, kind, line, qualified_name, usr) - 1, usr, kind, qualified_name FROM parted WHERE part > 1), """


@query("m13_member_fragments", _fragments_sql(MEMBERS + _DOWN + """, titles AS (SELECT page, title FROM planned WHERE title <> '' AND page NOT LIKE 'group:%'),
placed AS (SELECT page, position, row_number() OVER (PARTITION BY page, position ORDER BY path) - 1 AS \"offset\", depth + CASE WHEN page LIKE 'record%' THEN 1 ELSE 2 END AS lvl, usr, kind, qualified_name FROM walk
  UNION ALL SELECT 'hub' || chr(31) || usr, 0, -1, 2, usr, 1, qualified_name FROM hubs), """ + _FIRST))
def _(v):
    """Pages of the namespace hierarchy: hubs with their comment, records, functions by name, operators, types and constants."""
    rows = _with_hollow(v)
    pages, seeds, _ = plan.namespace_plan(rows)
    return render.fragments(rows, pages, seeds, **_sides(v))


def _list_sql(name: str, source: str, key: str, order: str, token: str) -> str:
    """Digests of lists of up to 2^20 tokens: runs, and runs of runs."""
    rs = "chr(30)"
    return f"""
{name}_n AS (SELECT {key}, {token} AS token, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS pos FROM {source}),
{name}_r AS (SELECT {key}, pos // {fp.RUN} AS pos, sha256('0:' || string_agg(token, {rs} ORDER BY pos)) AS token FROM {name}_n GROUP BY {key}, pos // {fp.RUN}),
{name} AS (SELECT {key}, CASE WHEN count(*) = 1 THEN min(token) ELSE sha256('1:' || string_agg(token, {rs} ORDER BY pos)) END AS digest FROM {name}_r GROUP BY {key})"""


_HASH = "sha256(usr || '/' || qualified_name || '/' || CAST(is_documented AS VARCHAR))"
_US = "chr(31)"


def _own_sql(symbols: str) -> str:
    token = lambda *c: f" || {_US} || ".join(c)
    return f"""
hashed AS (SELECT *, {_HASH} AS content_hash FROM {symbols}),
refs AS (
  SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS from_usr, 0 AS ref_kind, CASE WHEN c_custkey % 6 = 0 THEN 'c:' || CAST(c_custkey // 3 AS VARCHAR) ELSE '' END AS to_usr, 'Base' || CAST(c_custkey % 7 AS VARCHAR) AS to_spelling, 0 AS ordinal FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'c:' || CAST(c_custkey AS VARCHAR), 0, 's:' || CAST(c_custkey AS VARCHAR), 'Sup' || CAST(c_custkey AS VARCHAR), 1 FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT 's:' || CAST(s_suppkey AS VARCHAR), 7, CASE WHEN s_suppkey % 4 <> 0 THEN 'c:' || CAST(s_suppkey AS VARCHAR) ELSE '' END, CASE WHEN s_suppkey % 8 <> 0 THEN 'F' ELSE '' END, 0 FROM supplier),
ref_t AS (SELECT r.*, {token("'R'", 'from_usr', 'CAST(ref_kind AS VARCHAR)', 'CAST(ordinal AS VARCHAR)', 'to_usr', 'to_spelling', "'0'", "'T'", "coalesce(h.content_hash, '')")} AS tok FROM refs r LEFT JOIN hashed h ON h.usr = to_usr),{_list_sql('ref_d', 'ref_t', 'from_usr', 'ref_kind, ordinal, to_usr, to_spelling, tok', 'tok')},
rel_t AS (SELECT 'c:' || CAST(p_partkey % 40 AS VARCHAR) AS f_usr, p_partkey, {token("'L'", "'c:' || CAST(p_partkey % 40 AS VARCHAR)", 'usr', 'qualified_name', 'content_hash')} AS tok FROM part JOIN hashed ON usr = 'p:' || CAST(p_partkey AS VARCHAR) WHERE p_size > 25 AND p_type = 'ECONOMY'),{_list_sql('rel_d', 'rel_t', 'f_usr', 'p_partkey', 'tok')},
enu_t AS (SELECT 'p:' || CAST(l_partkey AS VARCHAR) AS e_usr, l_orderkey, {token("'N'", "'v:' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR)", "'E' || CAST(l_orderkey AS VARCHAR)", 'CAST(l_orderkey AS VARCHAR)', "'1'", "'E'", "''")} AS tok FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_linenumber = 1) JOIN hashed h ON h.usr = 'p:' || CAST(l_partkey AS VARCHAR) AND h.kind = 11),{_list_sql('enu_d', 'enu_t', 'e_usr', 'l_orderkey', 'tok')},
own AS (SELECT h.*, sha256('S' || {_US} || usr || {_US} || content_hash || chr(30) || coalesce(a.digest, '') || chr(30) || coalesce(b.digest, '') || chr(30) || coalesce(c.digest, '')) AS own FROM hashed h LEFT JOIN ref_d a ON a.from_usr = h.usr LEFT JOIN rel_d b ON b.f_usr = h.usr LEFT JOIN enu_d c ON c.e_usr = h.usr)"""


def _subtrees_sql(parent: str, most: int = 4) -> str:
    """Digests from the leaves of a forest that is `most` levels deep at the most; parts are roots and have nothing below."""
    opens = "kind IN (1, 2, 3, 4, 16)"
    steps = [f"depths AS (SELECT usr, {parent} AS up, 0 AS depth FROM own WHERE {parent} = '' UNION ALL SELECT o.usr, o.{parent}, depth + 1 FROM depths d JOIN own o ON o.{parent} = d.usr), leveled AS (SELECT o.*, depth FROM own o JOIN depths USING (usr))"]
    steps.append(f"sub{most} AS (SELECT usr, {parent} AS up, kind, line, qualified_name, sha256(own || chr(30)) AS subtree FROM leveled WHERE depth = {most})")
    for d in range(most - 1, -1, -1):
        steps.append(_list_sql(f"kids{d}", f"sub{d + 1}", "up", "kind, line, qualified_name, usr", "subtree").strip())
        steps.append(f"sub{d} AS (SELECT usr, {parent} AS up, kind, line, qualified_name, sha256(own || chr(30) || CASE WHEN {opens} THEN coalesce(digest, '') ELSE '' END) AS subtree FROM leveled LEFT JOIN kids{d} k ON k.up = usr WHERE depth = {d})")
    steps.append("subtrees AS (" + " UNION ALL ".join(f"SELECT usr, subtree FROM sub{d}" for d in range(most + 1)) + ")")
    return ", ".join(steps)


def _digests(v, rows):
    """Subtree digests of the symbols; their content hash is one of key, name and flag here."""
    sides = _sides(v)
    # Read for each kind of token and for the subtrees, so it is a table.
    hashed = cut(rows.withColumn("content_hash", F.sha2(F.concat_ws("/", "usr", "qualified_name", F.col("is_documented").cast("string")), 256)))
    own = fp.own_digests(hashed, sides["references"].withColumn("access", F.lit(0)), sides["related"], sides["enumerators"].withColumns({"value": F.col("idx"), "value_is_signed": F.lit(1)}))
    return hashed, fp.subtree_digests(hashed, own)


@query("l6_plan_fingerprints", MEMBERS.rstrip().rstrip(",") + "," + _stems_sql("planned") + "," + _own_sql("shown") + "," + _subtrees_sql("parent") + f""",
seeded AS (SELECT page, position, s.usr, t.subtree AS token FROM seeds s JOIN subtrees t USING (usr) UNION ALL SELECT 'hub' || {_US} || usr, 0, usr, own FROM hubs JOIN own USING (usr)),{_list_sql('seed_d', 'seeded', 'page', 'position', 'token')},
toc AS (SELECT 'hub' || {_US} || scope AS page, entry, page AS p, 'TOC' || {_US} || stem AS tok FROM stemmed WHERE scope <> '' AND page NOT LIKE 'group:%'),{_list_sql('toc_d', 'toc', 'page', 'entry, p', 'tok')},
grp AS (SELECT 'group:' || id AS page, 'G' || {_US} || id || {_US} || title || {_US} || {_US} AS digest FROM ir_groups),
gs AS (SELECT 'group:' || parent_group_id AS page, g.title, id, 'GS' || {_US} || id || {_US} || stem AS tok FROM ir_groups g JOIN stemmed t ON t.page = 'group:' || id WHERE coalesce(parent_group_id, '') <> ''),{_list_sql('gs_d', 'gs', 'page', 'title, id', 'tok')},
gm AS (SELECT 'group:' || group_id AS page, ordinal, usr, 'GM' || {_US} || usr || {_US} || content_hash AS tok FROM ir_group_members JOIN hashed ON usr = member_usr),{_list_sql('gm_d', 'gm', 'page', 'ordinal, usr', 'tok')}
SELECT s.page, sha256(coalesce(a.digest, '') || chr(30) || coalesce(b.digest, '') || chr(30) || coalesce(c.digest, '') || chr(30) || coalesce(d.digest, '') || chr(30) || coalesce(e.digest, '')) AS fingerprint FROM stemmed s LEFT JOIN seed_d a USING (page) LEFT JOIN toc_d b USING (page) LEFT JOIN grp c USING (page) LEFT JOIN gs_d d USING (page) LEFT JOIN gm_d e USING (page)""")
def _(v):
    """Every page of the namespace hierarchy and of the groups: seeds with what is below, entries of hubs, members of groups."""
    hashed, subtrees = _digests(v, _with_hollow(v))
    pages, seeds, entries = _stemmed(v, hashed)
    contents = plan.hub_entries(entries, pages).select(F.concat(F.lit("hub\x1f"), "scope").alias("page"), "position", "stem")
    members = q.group_symbols(v.group_members, hashed).select("group_id", "ordinal", "usr", "content_hash")
    return fp.page_fingerprints(pages, seeds, subtrees, contents, groups=v.groups, members=members)


@query("l6_file_fingerprints", FILES + _own_sql("below").strip() + ", " + _subtrees_sql("parent") + f""",
seeded AS (SELECT page, position, subtree AS token FROM seeds JOIN subtrees USING (usr)),{_list_sql('seed_d', 'seeded', 'page', 'position', 'token')}
SELECT page, sha256(digest || chr(30) || 'FILEPATH' || {_US} || path) AS fingerprint FROM seed_d JOIN ir_files ON page = 'file:' || CAST(id AS VARCHAR)""")
def _(v):
    """Every file's page: its roots there with what is below in the file, and its path."""
    rows = visible(plan.within_files(v.symbols))
    _, subtrees = _digests(v, rows)
    pages, seeds = plan.file_plan(v.files, rows)
    return fp.page_fingerprints(pages, seeds, subtrees, files=v.files.select(F.concat(F.lit("file:"), F.col("id").cast("string")).alias("page"), "path"))


def _comment_partials() -> dict[str, str]:
    """A comment's prose and its field list as templates, a loop or a line a field."""
    prose = ["{% macro body(model) %}{% if model is none %}", pg.MISSING, "{% else %}{% if model.brief %}{{ model.brief }}\n\n{% endif %}{% for x in model.detail %}{{ x }}\n\n{% endfor %}"]
    prose += ["{% for x in model." + f + " %}" + opening.replace("{", '{{ "{" }}', 1) + "{{ x }}\n:::\n\n{% endfor %}" for f, opening in pg.BLOCKS.items()]
    prose += ["{% if model." + f + " %}*" + t + ': {{ model.' + f + ' | join(", ") }}.*\n\n{% endif %}' for f, t in pg.LINES_OF.items()]
    prose += ["{% if model.see %}" + pg.SEE + "{% for x in model.see %}{{ xref(x | trim) }}{% if not loop.last %}, {% endif %}{% endfor %}{% endif %}{% endif %}{% endmacro %}"]
    directed = "{% macro line(name, x) %}:{{ name }} {{ bare(x.arg) }}: {% if direction(x.arg) %}**[{{ direction(x.arg) }}]** {% endif %}{{ x.value }}\n{% endmacro %}"
    fields = directed + "{% macro fields(model) %}{% if model is not none %}" + "".join("{% for x in model." + f + ' %}{{ line("' + f + '", x) }}{% endfor %}' for f in ("tparam", "param")) + "{% if model.returns %}:returns: {{ model.returns }}\n{% endif %}"
    fields += "".join("{% for x in model." + f + " %}:" + f + " {{ x.arg }}: {{ x.value }}\n{% endfor %}" for f in ("retval", "throws")) + "{% endif %}{% endmacro %}"
    return {"partials/prose": "".join(prose), "partials/fields": fields}


def _by_template(rows, text: str):
    """The comments' texts by a template that imports the partials."""
    partials = _comment_partials()
    functions = {
        "xref": lambda x: templates.Value(pg.link(x.text())), "direction": lambda x: templates.Value(s.split_direction(x.text())[0]), "bare": lambda x: templates.Value(s.split_direction(x.text())[1]),
    }
    made = templates.compiled(text, {"comment": F.col("comment")}, {"comment": rows.schema["comment"].dataType}, functions, partials.__getitem__)
    return rows.select("symbol_usr", made.alias("text"))


@query("k5_prose_by_template", _block_sql())
def _(v):
    """Comment blocks again (m2), from a template with loops, conditions, filters and a macro that is imported."""
    name = F.element_at(F.array(*map(F.lit, FIELDS)), ((F.col("ordinal") + F.col("symbol_usr")) % len(FIELDS) + 1).cast("int"))
    rows = structs_from_fields(v.comment_fields.withColumn("name", name))
    return _by_template(rows, '{% import "partials/prose" as p %}{% set told = p.body(comment) %}{{ told }}').withColumn("text", F.regexp_replace("text", "\n\n$", ""))


@query("k5_fields_by_template", _FIELDS_SQL)
def _(v):
    """Field lists again (m3), from a template whose macro calls another one."""
    k = F.col("ordinal") % 5
    name = F.element_at(F.array(*map(F.lit, ["param", "tparam", "returns", "retval", "throws"])), (k + 1).cast("int"))
    rows = v.comment_fields.select("symbol_usr", name.alias("name"), F.when(k == 0, F.concat(F.lit("[in,out] "), "name")).otherwise(F.col("name")).alias("arg"), "value", "ordinal")
    return _by_template(structs_from_fields(rows), '{% import "partials/fields" as p %}{{ p.fields(comment) }}').withColumn("text", F.regexp_replace("text", "\n$", ""))


@query("m6_group_fragments", "WITH planned AS (SELECT 'group:' || id AS page, 'group_' || id AS name, '9' || CASE WHEN coalesce(parent_group_id, '') = '' THEN '0' ELSE '1' END || title || chr(1) || id AS walk FROM ir_groups)," + _stems_sql("planned") + f""",
g AS (SELECT *, 'About ' || title AS brief, CASE WHEN id > 'src1' THEN 'Text of ' || id || '.' ELSE '' END AS detail FROM ir_groups)
SELECT 'group:' || id AS page, 0 AS position, 0 AS "offset", 1 AS part, 0 AS piece, {NL} || brief || {NL} AS text FROM g
UNION ALL SELECT 'group:' || id, 0, 1, 2, 0, {NL} || detail || {NL} FROM g WHERE detail <> ''
UNION ALL SELECT 'group:' || parent_group_id, 1, n, 1, 0, CASE WHEN n = 0 THEN {NL} || '**Subgroups**' || {NL} || {NL} ELSE '' END || '- {{doc}}`' || stem || '`' || {NL} FROM (SELECT g.*, stem, row_number() OVER (PARTITION BY parent_group_id ORDER BY title, id) - 1 AS n FROM g JOIN stemmed ON page = 'group:' || id WHERE coalesce(parent_group_id, '') <> '')
UNION ALL SELECT 'group:' || group_id, 2, n, 2, 0, CASE WHEN n = 0 THEN {NL} || '**Members**' || {NL} || {NL} ELSE '' END || '- {{cpp:any}}`' || qualified_name || '`' || {NL} FROM (SELECT group_id, qualified_name, row_number() OVER (PARTITION BY group_id ORDER BY ordinal, usr) - 1 AS n FROM ir_group_members JOIN ir_symbols ON usr = member_usr)""")
def _(v):
    """Group pages below their titles: prose, links to subgroups under the stems that they got, members."""
    groups = v.groups.select("id", "title", "parent_group_id", F.concat(F.lit("About "), "title").alias("brief"), F.when(F.col("id") > "src1", F.concat(F.lit("Text of "), "id", F.lit("."))).alias("detail"))
    pages = plan.with_stems(plan.group_plan(groups), RESERVED)
    return render.group_fragments(pages, groups, q.group_symbols(v.group_members, v.symbols))


_STALE = "p.kind <> 5 AND p.line % 3 = 0"


@query("m12_replayed_pages", "SELECT page, CASE WHEN replayed THEN count(*) ELSE 1 END AS blocks, CASE WHEN replayed THEN NULL ELSE sum(length(text)) END AS chars, replayed FROM (SELECT f.page, f.text, NOT (" + _STALE + ") AS replayed FROM (" + _fragments_sql(VIS + ", shown AS (SELECT * FROM vis), below AS (SELECT * FROM vis), seeds AS (SELECT usr AS page, 0 AS position, usr, kind, qualified_name FROM vis WHERE parent = ''), " + _DOWN + ", titles AS (SELECT '' AS page, '' AS title WHERE false), nodes AS (SELECT page, position, row_number() OVER (PARTITION BY page ORDER BY path) - 1 AS \"offset\", depth + 1 AS lvl, usr, kind, qualified_name, false AS degraded FROM walk)") + ") f JOIN ir_symbols p ON p.usr = f.page) GROUP BY page, replayed")
def _(v):
    """Pages by root, a memo in which a third of the parts' pages have another fingerprint: only these are rendered again, the others are what the memo holds, a block a fragment."""
    rows = visible(v.symbols)
    hashed, subtrees = _digests(v, rows)
    pages, seeds = plan.symbol_plan(rows)
    marks = fp.page_fingerprints(pages, seeds, subtrees)
    stale = rows.where("kind <> 5 AND line % 3 = 0").select(F.col("usr").alias("page"), F.lit(True).alias("stale"))
    memo = marks.join(stale, "page", "left").select("page", F.when(F.col("stale"), "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    sides = _sides(v)
    once = render.fragments(rows, pages, seeds, **sides)
    texts = plan.numbered(once, ["page"], ["position", "offset", "part", "piece"], "block").select("page", "block", "text")
    found = render.replayed(pages, marks, memo, texts, lambda some: render.fragments(rows, some, seeds.join(some.select("page"), "page", "left_semi"), **sides))
    chars = F.when(~F.col("replayed"), F.col("chars"))
    return found.groupBy("page", "replayed").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars")).select("page", "replayed", F.when(F.col("replayed"), F.col("blocks")).otherwise(F.lit(1)).alias("blocks"), chars.alias("chars"))
