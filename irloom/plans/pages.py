"""Queries of section M: page plans and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.functions import scalar as s
from irloom.functions.comment import structs_from_fields
from irloom.operators import aggregate as a, incremental as inc, pages, query as q
from irloom.plans.registry import query
from irloom.plans.scalars import SLUG
from irloom.sources.schema import FUNCTION_KINDS, RECORD_KINDS


def _stem(name: str, tag: str = "") -> str:
    room = 96 - (len(tag) + 1 if tag else 0)
    x = SLUG.format(name)
    return f"(CASE WHEN length({x}) > {room} THEN rtrim(left({x}, {room - 9}), '_') || '_' || left(sha256({name}), 8) ELSE {x} END || '{'_' + tag if tag else ''}')"


def _case(values: dict[int, str], default: str = "") -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in values.items()) + f" ELSE '{default}' END"


def _body(inner: str, fence: str = "'```'") -> str:
    return f"'# ' || {_case(s.LABEL, 'Symbol')} || ' `' || qualified_name || '`' || chr(10) || chr(10) || {fence} || '{{' || {_case(s.DIRECTIVE)} || '}} ' || qualified_name || chr(10) || chr(10) || {inner} || chr(10) || {fence} || chr(10)"


BODY = _body(f"'{pages.MISSING}'")


@query("m1_symbol_bodies", f"""
WITH c AS (SELECT 'c:' || CAST(conv_id AS VARCHAR) AS c_usr, max_by(text, turn) FILTER (WHERE role = 'user') AS brief, string_agg(':::{{note}}' || chr(10) || text || chr(10) || ':::', chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role <> 'user') AS notes FROM conversations GROUP BY conv_id)
SELECT usr, trim(regexp_replace({_body(f"CASE WHEN c_usr IS NULL THEN '{pages.MISSING}' ELSE concat_ws(chr(10) || chr(10), nullif(brief, ''), notes) END")}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), chr(10)) || chr(10) AS text FROM ir_symbols LEFT JOIN c ON c_usr = usr""")
def _(v):
    """Customers have the conversation of their number as their comment; the other symbols have none."""
    comments = _comments(v).withColumn("symbol_usr", F.concat(F.lit("c:"), F.col("symbol_usr").cast("string")))
    return pages.symbol_body(v.symbols, comments)


def _comments(v):
    name = F.when(F.col("name") == "user", "brief").otherwise("note")
    return structs_from_fields(v.comment_fields.withColumn("name", name))


#: A field for each turn of a conversation, and where its text stands in a comment block.
FIELDS = ["see", "since", "brief", "note", "todo", "detail", "warning", "author", "deprecated", "pre", "version", "post", "bug", "date", "invariant"]
PLACE = {n: k for k, n in enumerate(["brief", "detail", *pages.BLOCKS, *pages.LINES_OF, "see"])}


def _block_sql() -> str:
    nl = "chr(10)"
    place = "CASE name " + " ".join(f"WHEN '{n}' THEN {k}" for n, k in PLACE.items()) + " END"
    opening = "CASE name " + " ".join("WHEN '{}' THEN {}".format(n, " || chr(10)".join(f"'{x}'" if x else "''" for x in o.split(chr(10))).replace(" || chr(10)''", " || chr(10)")) for n, o in pages.BLOCKS.items()) + " END"
    lines = "CASE name " + " ".join(f"WHEN '{n}' THEN '*{t}: '" for n, t in pages.LINES_OF.items()) + " END"
    quoted = ", ".join(f"'{n}'" for n in FIELDS)
    return f"""
WITH f AS (SELECT conv_id AS symbol_usr, turn, list_extract([{quoted}], CAST((turn + conv_id) % {len(FIELDS)} + 1 AS BIGINT)) AS name, text FROM conversations),
each AS (SELECT symbol_usr, {place} AS place, turn, CASE WHEN name IN ('brief', 'detail') THEN text ELSE {opening} || text || {nl} || ':::' END AS t FROM f WHERE name NOT IN ('since', 'version', 'date', 'author', 'see') AND NOT (name = 'brief' AND text = '')),
joined AS (SELECT symbol_usr, {place} AS place, 0 AS turn, CASE WHEN name = 'see' THEN '{pages.SEE}' || string_agg(trim(text), ', ' ORDER BY turn) ELSE {lines} || string_agg(text, ', ' ORDER BY turn) || '.*' END AS t FROM f WHERE name IN ('since', 'version', 'date', 'author', 'see') GROUP BY symbol_usr, name),
every AS (SELECT * FROM each UNION ALL SELECT * FROM joined),
told AS (SELECT symbol_usr, string_agg(t, {nl} || {nl} ORDER BY place, turn) AS text FROM every GROUP BY symbol_usr)
SELECT symbol_usr, coalesce(text, '') AS text FROM (SELECT DISTINCT conv_id AS symbol_usr FROM conversations) LEFT JOIN told USING (symbol_usr)"""


@query("m2_comment_blocks", _block_sql())
def _(v):
    """Each turn is another field, so conversations hold all of them; their texts are prose, which a see-also leaves as it stands."""
    name = F.element_at(F.array(*map(F.lit, FIELDS)), ((F.col("ordinal") + F.col("symbol_usr")) % len(FIELDS) + 1).cast("int"))
    return structs_from_fields(v.comment_fields.withColumn("name", name)).select("symbol_usr", pages.comment_block(F.col("comment")).alias("text"))


_FIELDS_SQL = """
WITH f AS (SELECT conv_id AS symbol_usr, turn, role, text, turn % 5 AS k FROM conversations), w AS (
  SELECT symbol_usr, CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE k END AS place, turn, CASE k WHEN 0 THEN ':param ' || role || ': **[in,out]** ' || text WHEN 1 THEN ':tparam ' || role || ': ' || text WHEN 3 THEN ':retval ' || role || ': ' || text ELSE ':throws ' || role || ': ' || text END AS t FROM f WHERE k <> 2
  UNION ALL SELECT symbol_usr, 2, 0, ':returns: ' || max_by(text, turn) FROM f WHERE k = 2 GROUP BY symbol_usr HAVING max_by(text, turn) <> '')
SELECT conv_id AS symbol_usr, coalesce((SELECT string_agg(t, chr(10) ORDER BY place, turn) FROM w WHERE symbol_usr = conv_id), '') AS text FROM (SELECT DISTINCT conv_id FROM conversations)"""


@query("m3_field_lists", _FIELDS_SQL)
def _(v):
    k = F.col("ordinal") % 5
    name = F.element_at(F.array(*map(F.lit, ["param", "tparam", "returns", "retval", "throws"])), (k + 1).cast("int"))
    rows = v.comment_fields.select("symbol_usr", name.alias("name"), F.when(k == 0, F.concat(F.lit("[in,out] "), "name")).otherwise(F.col("name")).alias("arg"), "value", "ordinal")
    return structs_from_fields(rows).select("symbol_usr", pages.field_list(F.col("comment")).alias("text"))


@query("m4_index_pages", f"WITH n AS (SELECT kind, qualified_name, row_number() OVER (PARTITION BY kind ORDER BY qualified_name, usr) - 1 AS position FROM ir_symbols WHERE coalesce(parent_usr, '') = '') SELECT kind, CAST(position // {pages.LINES} AS BIGINT) AS block, CASE WHEN position // {pages.LINES} = 0 THEN '# Index' || chr(10) || chr(10) ELSE '' END || string_agg(qualified_name, chr(10) ORDER BY position) || chr(10) AS text FROM n GROUP BY kind, position // {pages.LINES}")
def _(v):
    return pages.index_page(q.roots(v.symbols).select("kind", F.col("qualified_name").alias("stem"), "usr"), "Index", ["kind"], ["stem", "usr"])


@query("m5_hub_pages", f"SELECT parent_usr, kind, line // {pages.LINES} AS block, '```{{toctree}}' || chr(10) || ':maxdepth: 1' || chr(10) || chr(10) || string_agg({_case(s.LABEL, 'Symbol')} || ' ' || spelling || ' <' || {_stem('qualified_name')} || '>', chr(10) ORDER BY line, usr) || chr(10) || '```' || chr(10) AS text FROM ir_symbols WHERE coalesce(parent_usr, '') <> '' AND kind IN (1, 2, 3) GROUP BY 1, 2, 3")
def _(v):
    return pages.hub_page(v.symbols.where("coalesce(parent_usr, '') <> '' AND kind IN (1, 2, 3)"))


@query("m6_group_pages", f"""
WITH subs AS (SELECT parent_group_id AS p, string_agg('- {{doc}}`group_' || {SLUG.format('id')} || '`', chr(10) ORDER BY id) AS x FROM ir_groups WHERE coalesce(parent_group_id, '') <> '' GROUP BY 1)
SELECT id, CAST(-1 AS BIGINT) AS block, '# ' || title || coalesce(chr(10) || chr(10) || '**Subgroups**' || chr(10) || chr(10) || x, '') || chr(10) AS text FROM ir_groups LEFT JOIN subs ON p = id
UNION ALL SELECT group_id, ordinal // {pages.LINES}, string_agg('- {{cpp:any}}`' || qualified_name || '`', chr(10) ORDER BY ordinal, usr) || chr(10) FROM ir_group_members JOIN ir_symbols ON usr = member_usr GROUP BY 1, 2""")
def _(v):
    return pages.group_page(v.groups, q.group_symbols(v.group_members, v.symbols))


@query("m7_root_pages", f"WITH n AS (SELECT usr, {_stem('qualified_name')} AS s FROM ir_symbols WHERE coalesce(parent_usr, '') = ''), c AS (SELECT usr, s, count(*) OVER (PARTITION BY lower(s)) AS claims FROM n), t AS (SELECT usr, CASE WHEN claims > 1 THEN s || '_' || left(sha256(usr), 8) ELSE s END AS s FROM c) SELECT usr, s || repeat('_', CAST(row_number() OVER (PARTITION BY lower(s) ORDER BY usr) - 1 AS INTEGER)) AS stem FROM t")
def _(v):
    return pages.symbol_pages(v.symbols)


@query("m8_file_pages", f"SELECT id, {_stem('path')} AS stem FROM ir_files f WHERE EXISTS (SELECT 1 FROM ir_symbols s WHERE s.file_id = f.id AND NOT EXISTS (SELECT 1 FROM ir_symbols p WHERE p.usr = s.parent_usr AND p.file_id = s.file_id))")
def _(v):
    return pages.file_pages(v.files, v.symbols)


@query("m9_class_pages", f"SELECT usr, {_stem('qualified_name')} AS stem FROM ir_symbols WHERE kind IN (2, 3, 4, 16) UNION ALL SELECT usr, {_stem('qualified_name', 'ns')} FROM ir_symbols WHERE kind = 1 AND usr IN (SELECT parent_usr FROM ir_symbols WHERE kind NOT IN (1, 2, 3, 4, 16))")
def _(v):
    return pages.class_pages(v.symbols, RECORD_KINDS)


PAGE_STEM = f"""CASE WHEN kind IN (5, 6, 7, 8, 15) THEN {_stem("coalesce(parent_usr, '')", 'functions')} WHEN kind = 1 THEN {_stem('qualified_name', 'ns')} WHEN kind IN (2, 3, 4, 16) THEN {_stem('qualified_name')} WHEN kind IN (11, 13, 14, 17) THEN {_stem("coalesce(parent_usr, '')", 'types')} WHEN kind IN (10, 18) THEN {_stem("coalesce(parent_usr, '')", 'constants')} ELSE {_stem("coalesce(parent_usr, '')", 'other')} END"""


@query("m10_namespace_pages", f"SELECT stem, count(*) AS members, min(usr) AS first, max(usr) AS last FROM (SELECT usr, {PAGE_STEM} AS stem FROM ir_symbols) GROUP BY stem")
def _(v):
    """Which page holds each symbol: records and namespaces one of their own, the others the one of their bucket and scope."""
    placed = pages.namespace_pages(v.symbols)
    return placed.groupBy("stem").agg(F.count("*").alias("members"), F.min("usr").alias("first"), F.max("usr").alias("last"))


@query("m11_degraded", "WITH c AS (SELECT kind, spelling, min_by(usr, (1 - is_documented, CASE WHEN coalesce(file_id, 0) = 0 THEN -1 ELSE file_id END, line, usr)) AS first FROM ir_symbols GROUP BY kind, spelling) SELECT usr, usr <> first AS degraded FROM ir_symbols JOIN c USING (kind, spelling)")
def _(v):
    first = a.canonical(v.symbols, ["kind", "spelling"]).withColumnRenamed("usr", "first")
    return v.symbols.join(first, ["kind", "spelling"]).select("usr", (F.col("usr") != F.col("first")).alias("degraded"))


@query("m12_rendered_pages", f"SELECT usr AS stem, CASE WHEN usr LIKE 'p:%' AND line % 3 <> 0 THEN 'kept' ELSE {BODY} END AS text FROM ir_symbols")
def _(v):
    """Pages of parts are in the memo, a third of them under another fingerprint; the others are rendered."""
    body = pages.symbol_body(v.symbols).select(F.col("usr").alias("stem"), F.sha2("text", 256).alias("fingerprint"), F.col("text").alias("fresh"))
    stale = F.substring("stem", 3, 20).cast("long") % 3 == 0
    memo = body.where("stem LIKE 'p:%'").select("stem", F.when(stale, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit("kept").alias("text"))
    return inc.memo_hits(body, memo).select("stem", F.coalesce("text", "fresh").alias("text"))


@query("m13_member_pages", f"SELECT usr, {BODY} AS text FROM ir_symbols WHERE kind IN (5, 6, 7, 8, 15)")
def _(v):
    return pages.symbol_body(v.symbols.where(F.col("kind").isin(FUNCTION_KINDS)))


@query("m14_file_texts", f"SELECT file_id, kind, line // {pages.LINES} AS block, string_agg({BODY}, chr(10) ORDER BY line, usr) AS text FROM ir_symbols s WHERE NOT EXISTS (SELECT 1 FROM ir_symbols p WHERE p.usr = s.parent_usr AND p.file_id = s.file_id) GROUP BY 1, 2, 3")
def _(v):
    """A file's text in blocks, by kind and then by lines, so no file is one row."""
    body = q.file_roots(v.symbols).join(pages.symbol_body(v.symbols), "usr")
    return pages.in_blocks(body, ["file_id"], "text")


@query("k4_template_names", f"SELECT usr, CASE WHEN kind = 6 THEN 'custom-method' ELSE {_case(s.TEMPLATE)} END AS template FROM ir_symbols")
def _(v):
    return v.symbols.select("usr", s.lookup(s.TEMPLATE | {6: "custom-method"}, "kind").alias("template"))
