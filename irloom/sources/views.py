"""The driver's tables presented as tables of the model, each with the same definition in SQL for the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _int(condition):
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("string")
    region, nation = t("region"), F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")))  # fixed-size dimensions

    def row(df, usr, parent, kind, spelling, qualified, documented, file_id, line):
        return df.select(usr.alias("usr"), parent.alias("parent_usr"), kind.cast("int").alias("kind"), spelling.alias("spelling"), qualified.alias("qualified_name"), F.lit(1).alias("is_definition"), documented.alias("is_documented"), file_id.cast("long").alias("file_id"), line.cast("long").alias("line"))

    c, sep, zero = F.col, F.lit("::"), F.lit(0)
    customers = t("customer").join(nation, c("c_nationkey") == c("n_nationkey"))
    suppliers = t("supplier").join(nation, c("s_nationkey") == c("n_nationkey"))
    orders = t("orders").join(t("customer").select("c_custkey", "c_name"), c("o_custkey") == c("c_custkey"))
    part_kind = F.lit(17)
    for value, kind in (("SMALL", 13), ("PROMO", 18), ("MEDIUM", 10), ("LARGE", 11), ("ECONOMY", 5)):
        part_kind = F.when(c("p_type") == value, F.lit(kind)).otherwise(part_kind)
    rows = [
        row(region, _key("r:", "r_regionkey"), none, F.lit(1), c("r_name"), c("r_name"), zero, c("r_regionkey") + 1, c("r_regionkey")),
        row(nation, _key("n:", "n_nationkey"), _key("r:", "n_regionkey"), F.lit(1), c("n_name"), F.concat("r_name", sep, "n_name"), zero, c("n_regionkey") + 1, c("n_nationkey")),
        row(customers, _key("c:", "c_custkey"), _key("n:", "c_nationkey"), F.lit(2), c("c_name"), F.concat("r_name", sep, "n_name", sep, "c_name"), _int(c("c_acctbal") > 5000), c("n_regionkey") + 1, c("c_custkey")),
        row(suppliers, _key("s:", "s_suppkey"), _key("n:", "s_nationkey"), F.lit(3), c("s_name"), F.concat("r_name", sep, "n_name", sep, "s_name"), _int(c("s_acctbal") > 5000), c("n_regionkey") + 1, c("s_suppkey")),
        row(orders, _key("o:", "o_orderkey"), _key("c:", "o_custkey"), F.lit(6), c("o_orderpriority"), F.concat("c_name", sep, "o_orderpriority"), _int(c("o_orderstatus") == "P"), c("o_orderkey") % 5 + 1, c("o_orderkey")),
        row(t("part"), _key("p:", "p_partkey"), F.lit(""), part_kind, F.when(c("p_size") == 1, F.concat(F.lit("operator"), "p_brand")).otherwise(c("p_name")), c("p_name"), _int(c("p_size") > 25), c("p_partkey") % 5 + 1, c("p_partkey")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    gone = F.col("l_returnflag") == "R"
    parts = items.select(_key("o:", "l_orderkey").alias("from_usr"), F.lit(1).alias("ref_kind"), F.when(~gone, _key("p:", "l_partkey")).alias("to_usr"), _key("part ", "l_partkey").alias("to_spelling"), _int(~gone).alias("is_resolved"), F.lit(0).alias("access"), F.col("l_linenumber").alias("ordinal"))
    suppliers = items.select(_key("o:", "l_orderkey").alias("from_usr"), F.lit(2).alias("ref_kind"), _key("s:", "l_suppkey").alias("to_usr"), _key("supplier ", "l_suppkey").alias("to_spelling"), F.lit(1).alias("is_resolved"), F.lit(0).alias("access"), F.lit(-1).alias("ordinal"))
    return parts.unionByName(suppliers)


def symbol_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), _key("u:", "user_id").alias("usr"), _int(F.col("event_type") == "signup").alias("is_definition"), _int(F.col("event_type") == "purchase").alias("is_documented"), F.col("event_type").alias("spelling"), F.col("value").alias("payload"))


def comment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("symbol_usr"), F.col("role").alias("name"), F.lit("").alias("arg"), F.col("text").alias("value"), F.col("turn").alias("ordinal"))


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("group_id"), F.concat(F.lit("c:"), (F.col("doc_id") * 2).cast("string")).alias("member_usr"), F.col("doc_id").alias("ordinal"))


def include_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    n = part.agg(F.count("*").alias("n"))
    up = part.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))
    round_ = part.join(F.broadcast(n)).select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 7 % F.col("n")).alias("dst"))  # one row
    return up.union(round_).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.concat(F.lit("src/"), F.lower("r_name"), F.lit(".hpp")).alias("path"), F.sha2("r_name", 256).alias("sha256"), F.length("r_name").cast("long").alias("size_bytes"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group per source of documents; src1, src2, ... are below src0, whose parent is empty."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.concat(F.lit("Group "), F.min("lang")).alias("title"), F.count("*").alias("size")).select("id", "title", F.when(F.col("id") == "src0", F.lit("")).when(F.col("id") > "src2", F.lit(None).cast("string")).otherwise(F.lit("src0")).alias("parent_group_id"))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as diagnostics in order: severities 0 to 4 by type, every third one a note of the one before."""
    severity = F.lit(0)
    for value, s in (("click", 1), ("view", 2), ("purchase", 3), ("error", 4)):
        severity = F.when(F.col("event_type") == value, F.lit(s)).otherwise(severity)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), severity.alias("severity"), F.when(F.col("event_id") % 3 == 2, 1).otherwise(0).alias("depth"), F.concat("event_type", F.lit(" "), F.floor(F.col("value") / 10).cast("string")).alias("text"), F.concat(F.lit("src/"), (F.col("user_id") % 20).cast("string"), F.lit(".hpp")).alias("file"), (F.col("event_id") % 100).cast("long").alias("line"), F.lit(1).alias("column"))


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"ir_symbols": symbols, "ir_references": references, "ir_symbol_writes": symbol_writes, "ir_comment_fields": comment_fields, "ir_group_members": group_members, "ir_include_edges": include_edges, "ir_files": files, "ir_groups": groups, "ir_diagnostics": diagnostics}

VIEW_SQL: dict[str, str] = {
    "ir_symbols": """
SELECT 'r:' || CAST(r_regionkey AS VARCHAR) AS usr, CAST(NULL AS VARCHAR) AS parent_usr, 1 AS kind, r_name AS spelling, r_name AS qualified_name, 1 AS is_definition, 0 AS is_documented, CAST(r_regionkey + 1 AS BIGINT) AS file_id, CAST(r_regionkey AS BIGINT) AS line FROM region
UNION ALL SELECT 'n:' || CAST(n_nationkey AS VARCHAR), 'r:' || CAST(n_regionkey AS VARCHAR), 1, n_name, r_name || '::' || n_name, 1, 0, CAST(n_regionkey + 1 AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'c:' || CAST(c_custkey AS VARCHAR), 'n:' || CAST(c_nationkey AS VARCHAR), 2, c_name, r_name || '::' || n_name || '::' || c_name, 1, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END, CAST(n_regionkey + 1 AS BIGINT), c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 's:' || CAST(s_suppkey AS VARCHAR), 'n:' || CAST(s_nationkey AS VARCHAR), 3, s_name, r_name || '::' || n_name || '::' || s_name, 1, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END, CAST(n_regionkey + 1 AS BIGINT), s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'o:' || CAST(o_orderkey AS VARCHAR), 'c:' || CAST(o_custkey AS VARCHAR), 6, o_orderpriority, c_name || '::' || o_orderpriority, 1, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, CAST(o_orderkey % 5 + 1 AS BIGINT), o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'p:' || CAST(p_partkey AS VARCHAR), '', CASE p_type WHEN 'ECONOMY' THEN 5 WHEN 'LARGE' THEN 11 WHEN 'MEDIUM' THEN 10 WHEN 'PROMO' THEN 18 WHEN 'SMALL' THEN 13 ELSE 17 END, CASE WHEN p_size = 1 THEN 'operator' || p_brand ELSE p_name END, p_name, 1, CASE WHEN p_size > 25 THEN 1 ELSE 0 END, CAST(p_partkey % 5 + 1 AS BIGINT), p_partkey FROM part""",
    "ir_references": """
SELECT 'o:' || CAST(l_orderkey AS VARCHAR) AS from_usr, 1 AS ref_kind, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'p:' || CAST(l_partkey AS VARCHAR) END AS to_usr, 'part ' || CAST(l_partkey AS VARCHAR) AS to_spelling, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS is_resolved, 0 AS access, l_linenumber AS ordinal FROM lineitem
UNION ALL SELECT 'o:' || CAST(l_orderkey AS VARCHAR), 2, 's:' || CAST(l_suppkey AS VARCHAR), 'supplier ' || CAST(l_suppkey AS VARCHAR), 1, 0, -1 FROM lineitem""",
    "ir_symbol_writes": "SELECT event_id AS seq, 'u:' || CAST(user_id AS VARCHAR) AS usr, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_definition, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_documented, event_type AS spelling, value AS payload FROM events",
    "ir_comment_fields": "SELECT conv_id AS symbol_usr, role AS name, '' AS arg, text AS value, turn AS ordinal FROM conversations",
    "ir_group_members": "SELECT source AS group_id, 'c:' || CAST(doc_id * 2 AS VARCHAR) AS member_usr, doc_id AS ordinal FROM documents",
    "ir_include_edges": "SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM part UNION SELECT p_partkey, (p_partkey * 7) % (SELECT count(*) FROM part) FROM part",
    "ir_files": "SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 'src/' || lower(r_name) || '.hpp' AS path, sha256(r_name) AS sha256, CAST(length(r_name) AS BIGINT) AS size_bytes FROM region",
    "ir_groups": "SELECT source AS id, 'Group ' || min(lang) AS title, CASE WHEN source = 'src0' THEN '' WHEN source > 'src2' THEN NULL ELSE 'src0' END AS parent_group_id FROM documents GROUP BY source",
    "ir_diagnostics": "SELECT event_id AS pos, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 0 END AS severity, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS depth, event_type || ' ' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS text, 'src/' || CAST(user_id % 20 AS VARCHAR) || '.hpp' AS file, event_id % 100 AS line, 1 AS \"column\" FROM events",
}
