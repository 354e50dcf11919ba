"""Queries of sections F and H: aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.functions import scalar
from irloom.operators import aggregate as a, query as q
from irloom.plans.registry import query
from irloom.sources.schema import TABLES, CONST_LEAF_KINDS, FUNCTION_KINDS, TYPE_LEAF_KINDS


@query("f1_counts", "SELECT (SELECT count(*) FROM ir_symbols) AS symbols, (SELECT count(*) FROM ir_references) AS refs, (SELECT count(*) FROM ir_files) AS files")
def _(v):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(v.symbols, "symbols").join(F.broadcast(one(v.references, "refs"))).join(F.broadcast(one(v.files, "files")))  # one row each


@query("f2_severity_counts", "SELECT severity, count(*) AS n FROM ir_diagnostics GROUP BY severity")
def _(v):
    return v.diagnostics.groupBy("severity").agg(F.count("*").alias("n"))


@query("f3_documented_per_file", "SELECT path, count(*) AS n, count(DISTINCT qualified_name) AS names FROM ir_symbols s JOIN ir_files f ON f.id = s.file_id WHERE is_documented = 1 GROUP BY path")
def _(v):
    rows = v.symbols.where("is_documented = 1").join(v.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("qualified_name").alias("names"))


@query("f4_summary", "SELECT event_type, count(value) AS n, min(value) AS min, median(value) AS median, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stddev FROM events GROUP BY event_type")
def _(v):
    return a.summary(v("events"), "event_type", "value").withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query(
    "f5_ratios",
    "WITH m AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'signup') AS a, avg(value) FILTER (WHERE event_type = 'click') AS b, avg(value) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN b <> 0 THEN a / b END, 6) AS click_ratio, round(CASE WHEN c <> 0 THEN a / c END, 6) AS purchase_ratio FROM m",
)
def _(v):
    return a.ratios(v("events"), "user_id", "event_type", "value", ["signup", "click", "purchase"]).select("user_id", F.round("click_ratio", 6).alias("click_ratio"), F.round("purchase_ratio", 6).alias("purchase_ratio"))


@query("f6_ordered_children", "SELECT coalesce(parent_usr, '') AS parent, CAST(row_number() OVER (PARTITION BY coalesce(parent_usr, '') ORDER BY kind, line, qualified_name, usr) - 1 AS BIGINT) AS position, usr FROM ir_symbols")
def _(v):
    """A row a child with its place, so a parent of most symbols is spread like any other."""
    order = ["kind", "line", "qualified_name", "usr"]
    children = v.symbols.select(F.coalesce("parent_usr", F.lit("")).alias("parent"), *order)
    return a.numbered(children, ["parent"], order).select("parent", "position", "usr")


@query(
    "f7_comment_structs",
    "SELECT symbol_usr, max_by(value, ordinal) FILTER (WHERE name = 'user') AS brief, string_agg(value, chr(31) ORDER BY ordinal) FILTER (WHERE name = 'assistant') AS sees FROM ir_comment_fields GROUP BY symbol_usr",
)
def _(v):
    from irloom.functions.comment import structs_from_fields

    rows = v.comment_fields.withColumn("name", F.when(F.col("name") == "user", "brief").when(F.col("name") == "assistant", "see").otherwise(F.col("name")))
    return structs_from_fields(rows).select("symbol_usr", F.col("comment.brief").alias("brief"), F.when(F.size("comment.see") > 0, q.joined(F.col("comment.see"))).alias("sees"))


@query(
    "f8_struct_fields",
    "WITH b AS (SELECT symbol_usr, 'brief' AS name, max_by(value, ordinal) AS value, 0 AS p, 0 AS o FROM ir_comment_fields WHERE name = 'user' GROUP BY symbol_usr UNION ALL SELECT symbol_usr, 'see', value, 1, ordinal FROM ir_comment_fields WHERE name = 'assistant') SELECT symbol_usr, name, value, CAST(row_number() OVER (PARTITION BY symbol_usr ORDER BY p, o) - 1 AS INTEGER) AS ordinal FROM b WHERE value <> ''",
)
def _(v):
    from irloom.functions.comment import fields_from_structs, structs_from_fields

    rows = v.comment_fields.withColumn("name", F.when(F.col("name") == "user", "brief").when(F.col("name") == "assistant", "see").otherwise(F.col("name")))
    return fields_from_structs(structs_from_fields(rows.where(F.col("name").isin("brief", "see")))).select("symbol_usr", "name", "value", "ordinal")


@query("f9_canonical", "SELECT kind, spelling, min_by(usr, (1 - is_documented, CASE WHEN coalesce(file_id, 0) = 0 THEN -1 ELSE file_id END, line, usr)) AS usr FROM ir_symbols GROUP BY kind, spelling")
def _(v):
    return a.canonical(v.symbols, ["kind", "spelling"])


@query("f10_overloads", "WITH f AS (SELECT coalesce(parent_usr, '') AS scope, CASE WHEN starts_with(spelling, 'operator') THEN 'operator*' ELSE spelling END AS name, line, usr FROM ir_symbols WHERE kind IN (5, 6, 7, 8, 15)) SELECT scope, name, row_number() OVER (PARTITION BY scope, name ORDER BY line, usr) - 1 AS position, usr FROM f")
def _(v):
    return a.overloads(v.symbols.where(F.col("kind").isin(FUNCTION_KINDS)))


@query("f11_buckets", "WITH b AS (SELECT coalesce(parent_usr, '') AS scope, CASE WHEN kind IN (11, 13, 14, 17) THEN 'types' WHEN kind IN (10, 18) THEN 'constants' ELSE 'other' END AS bucket, spelling, line, usr FROM ir_symbols) SELECT scope, bucket, CAST(row_number() OVER (PARTITION BY scope, bucket ORDER BY spelling, line, usr) - 1 AS BIGINT) AS position, usr FROM b")
def _(v):
    return a.buckets_by_scope(v.symbols, TYPE_LEAF_KINDS, CONST_LEAF_KINDS)


@query("f12_contested_stems", "SELECT lower(regexp_replace(spelling, '[0-9]+$', '')) AS stem, count(DISTINCT qualified_name) AS names FROM ir_symbols GROUP BY 1 HAVING count(DISTINCT qualified_name) > 1")
def _(v):
    return a.contested(v.symbols.select(F.col("qualified_name").alias("name"), "spelling"), F.regexp_replace("spelling", "[0-9]+$", ""))


@query("f14_documented_ratio", "SELECT file_id, sum(is_documented) / nullif(count(*), 0) AS ratio, sum(is_documented) / nullif(count(*), 0) >= 0.3 AS enough FROM ir_symbols GROUP BY file_id")
def _(v):
    ratio = F.try_divide(F.sum("is_documented"), F.count("*"))
    return v.symbols.groupBy("file_id").agg(ratio.alias("ratio"), (ratio >= 0.3).alias("enough"))


@query("f15_comment_checks", "SELECT symbol_usr, count(*) FILTER (WHERE trim(value) <> '' AND name = 'system') AS unrendered, count(*) FILTER (WHERE NOT regexp_full_match(split_part(value, ' ', 1), '[A-Za-z]+')) AS malformed FROM ir_comment_fields GROUP BY symbol_usr")
def _(v):
    first = F.split_part("value", F.lit(" "), F.lit(1))
    return v.comment_fields.groupBy("symbol_usr").agg(F.count(F.when((F.trim("value") != "") & (F.col("name") == "system"), 1)).alias("unrendered"), F.count(F.when(~F.rlike(first, F.lit("^[A-Za-z]+$")), 1)).alias("malformed"))


@query("f16_xref_counters", "WITH t AS (SELECT unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS target FROM pages) SELECT count(*) AS total, count(DISTINCT target) AS targets, count(*) FILTER (WHERE target NOT IN (SELECT p_name FROM part)) AS unresolved FROM t")
def _(v):
    found = v("pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("target"))
    names = v("part").select(F.col("p_name").alias("target")).distinct().withColumn("known", F.lit(True))
    return found.groupBy("target").agg(F.count("*").alias("n")).join(names, "target", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("targets"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)), F.lit(0)).alias("unresolved"))


@query("f17_batches", "SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 8) AS BIGINT) AS batch FROM documents")
def _(v):
    return a.chunks(v("documents").select("doc_id", "source"), "source", "doc_id", 8)


@query("h1_bag_intersection", "SELECT spelling, count(*) AS n FROM (SELECT spelling FROM ir_symbols WHERE kind > 6 INTERSECT ALL SELECT p_name FROM part WHERE p_partkey % 2 = 0) GROUP BY spelling")
def _(v):
    return a.bag_intersection(v.symbols.where("kind > 6").select("spelling"), v("part").where("p_partkey % 2 = 0").select("p_name")).groupBy("spelling").agg(F.count("*").alias("n"))


@query("h1_bag_difference", "SELECT spelling, count(*) AS n FROM (SELECT spelling FROM ir_symbols WHERE kind > 6 EXCEPT ALL SELECT p_name FROM part WHERE p_partkey % 2 = 0) GROUP BY spelling")
def _(v):
    return a.bag_difference(v.symbols.where("kind > 6").select("spelling"), v("part").where("p_partkey % 2 = 0").select("p_name")).groupBy("spelling").agg(F.count("*").alias("n"))


@query("h2_subset", "SELECT o_custkey, len(list_filter(list(o_orderpriority), lambda x: x NOT IN ('1-URGENT', '2-HIGH', '5-LOW'))) = 0 AS subset FROM orders GROUP BY o_custkey")
def _(v):
    return v("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("own")).select("o_custkey", a.is_subset(F.col("own"), F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "5-LOW"]))).alias("subset"))


@query("h3_union_first_wins", "SELECT p_name AS path, 'part' AS origin FROM part GROUP BY p_name UNION ALL SELECT DISTINCT source, 'doc' FROM documents WHERE source NOT IN (SELECT p_name FROM part)")
def _(v):
    parts = v("part").select(F.col("p_name").alias("path")).distinct().withColumn("origin", F.lit("part"))
    docs = v("documents").select(F.col("source").alias("path")).distinct().withColumn("origin", F.lit("doc"))
    return a.union_first_wins([parts, docs], "path")


@query("h4_pages_to_prune", "SELECT DISTINCT url FROM pages WHERE page_id % 2 = 0 EXCEPT SELECT url FROM pages WHERE page_id % 2 = 1")
def _(v):
    p = v("pages").select("page_id", "url")
    return p.where("page_id % 2 = 0").select("url").distinct().join(p.where("page_id % 2 = 1").select("url"), "url", "left_anti")


@query("h5_unused_targets", "SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT unnest(string_split(text, ' ')) FROM documents) AND p_name NOT IN (SELECT o_orderpriority FROM orders)")
def _(v):
    used = v("documents").select(F.explode(F.split("text", " ")).alias("name")).distinct().union(v("orders").select("o_orderpriority").distinct())
    return v("part").select(F.col("p_name").alias("name")).distinct().join(used, "name", "left_anti")


@query("h6_wide_fields", "SELECT usr, field, value FROM (SELECT usr, unnest(['parent_usr', 'spelling', 'is_documented', 'file_id', 'line']) AS field, unnest([coalesce(parent_usr, ''), spelling, CAST(is_documented AS VARCHAR), CAST(file_id AS VARCHAR), CAST(line AS VARCHAR)]) AS value FROM ir_symbols)")
def _(v):
    """What a page depends on by value: each symbol's columns that the content hash leaves out."""
    s = v.symbols
    wide = [c for c in scalar.WIDE_FIELDS if c in s.columns and c not in scalar.HASHED_FIELDS]
    each = F.array(*(F.struct(F.lit(c).alias("field"), scalar.dep_value(c).alias("value")) for c in wide))
    return s.select("usr", F.inline(each))
