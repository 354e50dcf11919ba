"""Queries of section E: merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.operators import merge
from irloom.plans.registry import query
from irloom.sources.schema import FUNCTION_KINDS


@query("e1_symbol_upsert", "SELECT usr, max_by(spelling, (is_definition, seq)) AS spelling, max_by(payload, (is_definition, seq)) AS payload, max(is_definition) AS is_definition, max(is_documented) AS is_documented FROM ir_symbol_writes GROUP BY usr")
def _(v):
    return merge.upsert_symbols(v.symbol_writes)


GROUP_WRITES = """
SELECT 'g' || CAST(user_id AS VARCHAR) AS id, event_id AS seq, event_type IN ('signup', 'error') AS is_definition,
  CASE WHEN event_id % 3 = 0 THEN 'g' || CAST(user_id AS VARCHAR) ELSE event_type || CAST(event_id % 7 AS VARCHAR) END AS title,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'b' || CAST(event_id % 11 AS VARCHAR) END AS brief,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'd' || CAST(event_id % 13 AS VARCHAR) END AS detail,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'p' || CAST(event_id % 17 AS VARCHAR) END AS parent FROM events"""


def _group_writes(v):
    e, text = v("events"), lambda p, m: F.concat(F.lit(p), (F.col("event_id") % m).cast("string"))
    gid = F.concat(F.lit("g"), F.col("user_id").cast("string"))
    return e.select(gid.alias("id"), F.col("event_id").alias("seq"), F.col("event_type").isin("signup", "error").alias("is_definition"), F.when(F.col("event_id") % 3 == 0, gid).otherwise(F.concat("event_type", (F.col("event_id") % 7).cast("string"))).alias("title"), F.when(F.col("event_id") % 4 == 0, "").otherwise(text("b", 11)).alias("brief"), F.when(F.col("event_id") % 5 == 0, "").otherwise(text("d", 13)).alias("detail"), F.when(F.col("event_id") % 2 == 1, text("p", 17)).alias("parent"))


@query(
    "e2_group_upsert",
    f"""
WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM ({GROUP_WRITES})),
f AS (
  SELECT id, n, is_definition AS d, title, brief, detail, parent FROM w WHERE n = 1
  UNION ALL
  SELECT w.id, w.n, f.d OR w.is_definition,
    CASE WHEN w.is_definition AND f.d THEN w.title WHEN w.is_definition AND w.title <> w.id THEN w.title WHEN f.title = f.id THEN w.title ELSE f.title END,
    CASE WHEN w.is_definition AND f.d THEN w.brief WHEN w.is_definition AND w.brief <> '' THEN w.brief WHEN f.brief = '' THEN w.brief ELSE f.brief END,
    CASE WHEN w.is_definition AND f.d THEN w.detail WHEN w.is_definition AND w.detail <> '' THEN w.detail WHEN f.detail = '' THEN w.detail ELSE f.detail END,
    CASE WHEN w.is_definition AND f.d THEN w.parent WHEN w.is_definition AND w.parent IS NOT NULL THEN w.parent WHEN f.parent IS NULL THEN w.parent ELSE f.parent END
  FROM f JOIN w ON w.id = f.id AND w.n = f.n + 1
)
SELECT id, arg_max(title, n) AS title, arg_max(brief, n) AS brief, arg_max(detail, n) AS detail, max_by(parent, CASE WHEN n = m THEN 1 ELSE 0 END) AS parent, arg_max(d, n) AS is_definition FROM f JOIN (SELECT id, max(n) AS m FROM w GROUP BY id) USING (id) WHERE n = m GROUP BY id""",
)
def _(v):
    return merge.upsert_groups(_group_writes(v))


@query("e3_last_writer_wins", "SELECT user_id AS owner, event_type AS slot, max_by(value, event_id) AS value, max_by(props, event_id) AS props FROM events GROUP BY 1, 2")
def _(v):
    return merge.last_by_key(v("events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("slot"), F.col("event_id").alias("seq"), "value", "props"), ["owner", "slot"])


@query("e4_append_references", "SELECT from_usr, to_spelling, count(*) AS n FROM (SELECT * FROM ir_references UNION ALL SELECT * FROM ir_references WHERE ref_kind = 1) GROUP BY ALL")
def _(v):
    return merge.append(v.references, v.references.where("ref_kind = 1")).groupBy("from_usr", "to_spelling").agg(F.count("*").alias("n"))


BATCHED = "(SELECT conv_id AS key, turn // 2 AS batch, role, turn FROM conversations)"


def _batched(v):
    return v("conversations").select(F.col("conv_id").alias("key"), F.floor(F.col("turn") / 2).cast("int").alias("batch"), "role", "turn")


@query("e5_replace_fields", f"SELECT key, role, turn FROM {BATCHED} JOIN (SELECT key, max(batch) AS last FROM {BATCHED} GROUP BY key) USING (key) WHERE batch = last AND role = 'user'")
def _(v):
    rows = _batched(v)
    return merge.replace_sets(rows.where("role = 'user'"), rows.select("key", "batch"), "key").select("key", "role", "turn")


@query("e6_replace_memberships", "WITH m AS (SELECT lang AS member, source AS group_id, doc_id % 9 AS batch, doc_id FROM documents) SELECT member, group_id, doc_id FROM m WHERE batch = (SELECT max(batch) FROM m x WHERE x.member = m.member)")
def _(v):
    rows = v("documents").select(F.col("lang").alias("member"), F.col("source").alias("group_id"), (F.col("doc_id") % 9).alias("batch"), "doc_id")
    return merge.replace_sets(rows, rows.select("member", "batch"), "member").select("member", "group_id", "doc_id")


@query(
    "e7_file_upsert",
    "WITH old AS (SELECT p_partkey AS id, 'src/' || CAST(p_partkey AS VARCHAR) AS path, p_name AS sha256 FROM part WHERE p_partkey % 2 = 0), new AS (SELECT 'src/' || CAST(p_partkey AS VARCHAR) AS path, p_brand AS sha256 FROM part WHERE p_partkey % 3 = 0) SELECT id, path, coalesce(new.sha256, old.sha256) AS sha256 FROM old LEFT JOIN new USING (path) UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY path), path, sha256 FROM new WHERE path NOT IN (SELECT path FROM old)",
)
def _(v):
    p = v("part").withColumn("path", F.concat(F.lit("src/"), F.col("p_partkey").cast("string")))
    return merge.upsert_files(p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), "path", F.col("p_name").alias("sha256")), p.where("p_partkey % 3 = 0").select("path", F.col("p_brand").alias("sha256")))


@query("e8_replaced_files", "SELECT id FROM ir_files WHERE path IN ('src/asia.hpp') OR id IN (SELECT file_id FROM ir_symbols WHERE kind = 1 AND parent_usr IS NULL AND line < 2)")
def _(v):
    anchors = v.symbols.where("kind = 1 AND parent_usr IS NULL AND line < 2").select(F.col("file_id").alias("id")).join(v.files, "id")
    return merge.replaced_files(v.files.where("path = 'src/asia.hpp'"), anchors, v.files)


@query("e9_delete_files", "WITH kept AS (SELECT usr FROM ir_symbols WHERE file_id NOT IN (1, 2)) SELECT 'symbols' AS name, count(*) AS n FROM kept UNION ALL SELECT 'references', count(*) FROM ir_references r WHERE NOT EXISTS (SELECT 1 FROM ir_symbols s WHERE s.usr = r.from_usr AND s.file_id IN (1, 2)) UNION ALL SELECT 'group_members', count(*) FROM ir_group_members m WHERE NOT EXISTS (SELECT 1 FROM ir_symbols s WHERE s.usr = m.member_usr AND s.file_id IN (1, 2))")
def _(v):
    left = merge.delete_files({"symbols": v.symbols, "references": v.references, "group_members": v.group_members}, v.files.where("id IN (1, 2)"), {"references": "from_usr", "group_members": "member_usr"})
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("e10_vanished_files", "SELECT DISTINCT url AS path FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 <> 0)")
def _(v):
    p = v("pages").withColumnRenamed("url", "path")
    return merge.vanished(p.select("path").distinct(), p.where("page_id % 3 <> 0"))


@query(
    "e11_unit_dedup",
    "WITH r AS (SELECT user_id AS usr, event_id AS pos, CASE WHEN event_id % 2 = 0 THEN 5 ELSE 2 END AS kind, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_definition, props AS signature FROM events), g AS (SELECT usr, arg_min(kind, pos) AS kind, arg_min(signature, pos) AS s1, arg_min(is_definition, pos) AS d1, max(is_definition) AS is_definition, arg_min(signature, pos) FILTER (WHERE is_definition = 1) AS s2 FROM r GROUP BY usr) SELECT usr, kind, is_definition, CASE WHEN d1 = 0 AND is_definition = 1 AND kind IN (5, 6, 7, 8, 15) THEN s2 ELSE s1 END AS signature FROM g",
)
def _(v):
    rows = v("events").select(F.col("user_id").alias("usr"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 2 == 0, 5).otherwise(2).alias("kind"), F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("is_definition"), F.col("props").alias("signature"))
    return merge.dedup_in_unit(rows, FUNCTION_KINDS)


@query("e12_first_comment", "SELECT user_id AS usr, min_by(event_type, event_id) AS raw_text FROM events GROUP BY user_id")
def _(v):
    return merge.first_by_key(v("events").select(F.col("user_id").alias("usr"), F.col("event_id").alias("pos"), F.col("event_type").alias("raw_text")), "usr")


@query("e13_group_block_merge", "SELECT id, max(is_definition) AS is_definition, count(*) AS blocks FROM (" + GROUP_WRITES + ") GROUP BY id")
def _(v):
    merged = merge.upsert_groups(_group_writes(v)).select("id", "is_definition")
    return merged.join(_group_writes(v).groupBy("id").agg(F.count("*").alias("blocks")), "id")


@query("e14_batch_merge", "SELECT source AS path, arg_min(lang, (doc_id % 4, doc_id)) AS digest FROM documents GROUP BY source")
def _(v):
    rows = v("documents").select(F.col("source").alias("path"), F.struct(F.col("doc_id") % 4, F.col("doc_id")).alias("pos"), F.col("lang").alias("digest"))
    return merge.first_by_key(rows, "path")


@query(
    "e15_diagnostic_dedup",
    "WITH u AS (SELECT *, sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS unit FROM ir_diagnostics), h AS (SELECT min_by(file, pos) AS file, min_by(unit, pos) AS unit FROM u WHERE depth = 0 GROUP BY severity, text) SELECT pos, severity, text, CAST(unit AS BIGINT) AS unit FROM u WHERE (file, unit) IN (SELECT (file, unit) FROM h)",
)
def _(v):
    return merge.merge_diagnostics(v.diagnostics, "file").select("pos", "severity", "text", F.col("unit").cast("long").alias("unit"))


@query("e16_foreign_keys", "SELECT 'members' AS name, count(*) AS n FROM ir_group_members WHERE member_usr NOT IN (SELECT usr FROM ir_symbols) UNION ALL SELECT 'references', count(*) FROM ir_references WHERE from_usr NOT IN (SELECT usr FROM ir_symbols) UNION ALL SELECT 'symbols', count(*) FROM ir_symbols WHERE file_id NOT IN (SELECT id FROM ir_files)")
def _(v):
    checks = {"members": merge.dangling(v.group_members, "member_usr", v.symbols, "usr"), "references": merge.dangling(v.references, "from_usr", v.symbols, "usr"), "symbols": merge.dangling(v.symbols, "file_id", v.files, "id")}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in checks.items()]
    return out[0].union(out[1]).union(out[2])


@query("e17_stub_groups", "SELECT id, title FROM ir_groups WHERE id <> 'src5' UNION ALL SELECT DISTINCT group_id, group_id FROM ir_group_members WHERE group_id NOT IN (SELECT id FROM ir_groups WHERE id <> 'src5')")
def _(v):
    return merge.stub_groups(v.groups.where("id <> 'src5'"), v.group_members.select(F.col("group_id").alias("id")))


@query("e18_memberships", "WITH e AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS group_id, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) SELECT group_id, p_partkey AS member, row_number() OVER (PARTITION BY group_id ORDER BY p_partkey, i) - 1 AS ordinal FROM e WHERE group_id <> ''")
def _(v):
    return merge.memberships(v("part").withColumn("pos", F.col("p_partkey")), "p_partkey", "p_name", "pos")


@query("x7_documented_here", "SELECT usr FROM ir_symbols WHERE NOT (is_definition = 0 AND is_documented = 0)")
def _(v):
    return v.symbols.where("NOT (is_definition = 0 AND is_documented = 0)").select("usr")
