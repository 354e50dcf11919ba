"""Queries of the sinks and scans that keep what did not change: bucketed snapshots, page sets, file scans, the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.operators import aggregate as a
from irloom.operators.state import shared_dir
from irloom.plans.registry import query
from irloom.sources import buckets, jsonarray, outputs
from irloom.streaming import ingest


def _stored(v):
    symbols = v.symbols.select("usr", "kind", "qualified_name", "file_id", "line")
    return {"symbols": symbols, "references": v.references.select("from_usr", "ref_kind", "to_usr", "ordinal")}


_AGAIN = "file_id = 1 AND line % 2 = 0"


@query("a7_touched_buckets", f"""
WITH s AS (SELECT usr, kind, qualified_name, file_id, line, file_id % 4 <> 1 AS reused FROM ir_symbols WHERE file_id <> 1 UNION ALL SELECT usr, kind, 'again::' || qualified_name, file_id, line, false FROM ir_symbols WHERE {_AGAIN}),
r AS (SELECT s.usr, count(*) AS n FROM ir_references JOIN ir_symbols s ON s.usr = from_usr WHERE file_id <> 1 GROUP BY s.usr)
SELECT s.*, coalesce(n, 0) AS "references" FROM s LEFT JOIN r USING (usr)""")
def _(v):
    """One of five files is replaced: of four buckets the one that it shares with another file is written anew, the others stand."""
    path, tables = shared_dir(v.spark), _stored(v)
    first = buckets.create(v.spark, path, tables, 4)
    fresh = tables["symbols"].where(_AGAIN).withColumn("qualified_name", F.concat(F.lit("again::"), "qualified_name"))
    second = buckets.replace_files(v.spark, path, {"symbols": fresh, "references": tables["references"].limit(0)}, v.files.where("id = 1").select("id"))
    state = buckets.changed_folders(v.spark, path, first, second).where("table = 'symbols'").select("bucket", (F.col("state") == "reused").alias("reused"))
    now = buckets.read(v.spark, path, tables)
    n = now["references"].groupBy(F.col("from_usr").alias("usr")).agg(F.count("*").alias("references"))
    rows = now["symbols"].withColumn("bucket", buckets.bucket_of(F.col("file_id"), 4)).join(state, "bucket").join(n, "usr", "left")
    return rows.select("usr", "kind", "qualified_name", "file_id", "line", "reused", F.coalesce("references", F.lit(0)).alias("references"))


class _Stopped(Exception):
    pass


def _stop_at(step: str):
    def after(done: str) -> None:
        if done == step:
            raise _Stopped

    return after


def _pages(v, changed: int):
    """name and text of the pages; every `changed`-th has another text, those with a number that 7 divides are not there."""
    p = v("pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".md")).alias("name"), F.col("html").alias("text"))
    return p.where("page_id % 7 <> 0").select("name", F.when(F.col("page_id") % changed == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))


@query("a10_page_set", "SELECT name, bytes, sha256(text) AS digest FROM (SELECT 'p' || CAST(page_id AS VARCHAR) || '.md' AS name, CASE WHEN page_id % 5 = 0 THEN html || '!' ELSE html END AS text, CAST(strlen(html) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS bytes FROM pages WHERE page_id % 7 <> 0)")
def _(v):
    """A set is written, the next run stops before its intent, one behind it, one while it switches; what stands then is the last set."""
    path = shared_dir(v.spark)
    every = v("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".md")).alias("name"), F.col("html").alias("text"))
    outputs.put_pages(v.spark, path, every)
    for pages, step in ((every.where("name LIKE '%1.md'"), "staged"), (_pages(v, 3), "intended"), (_pages(v, 5), "applied")):
        try:
            outputs.put_pages(v.spark, path, pages, _stop_at(step))
        except _Stopped:
            pass  # what the query is about
    outputs.recover(v.spark, path)
    files = v.spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query("l1_scanned_files", """
SELECT 'p' || CAST(page_id AS VARCHAR) || '.md' AS name, CASE WHEN page_id % 11 = 0 THEN 'gone' WHEN page_id % 13 = 0 THEN 'new' WHEN page_id % 5 = 0 THEN 'changed' WHEN page_id % 3 = 0 THEN 'healed' ELSE 'same' END AS status,
  page_id % 11 <> 0 AND (page_id % 13 = 0 OR page_id % 5 = 0 OR page_id % 3 = 0) AS was_read, CASE WHEN page_id % 11 <> 0 THEN sha256(html) END AS sha256 FROM pages""")
def _(v):
    """Files that the query writes: of some the stored time is another, of some the digest too, some are new or gone; only those are read."""
    path = shared_dir(v.spark)
    number = F.regexp_extract("name", r"p(\d+)\.md", 1).cast("long")
    every = v("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".md")).alias("name"), F.col("html").alias("text"))
    outputs.put_pages(v.spark, path, every.where(number % 11 != 0))
    listed = outputs.listing(v.spark, path, "*.md").withColumn("name", F.element_at(F.split("path", "/"), -1))
    kept = listed.join(every.select("name", F.sha2("text", 256).alias("sha256")), "name").where(number % 13 != 0)
    other = (number % 5 == 0) | (number % 3 == 0)
    stored = kept.select("path", F.when(other, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"), "size", F.when(number % 5 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    gone = every.where(number % 11 == 0).select(F.concat(F.lit(f"{path}/"), "name").alias("path"), F.lit(1).cast("long").alias("mtime_ns"), F.lit(1).cast("long").alias("size"), F.lit("x").alias("sha256"))
    found = outputs.scan(stored.unionByName(gone), listed)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "status", "was_read", "sha256")


@query("a11_ordered_log", """
WITH c AS (SELECT severity, count(*) AS n FROM ir_diagnostics GROUP BY severity),
head AS (SELECT unnest(['# diagnostics', '# generated: then', '# inputs: 5 file(s)', '# parse: full', '# totals: ' || (SELECT string_agg(CAST(n AS VARCHAR) || ' ' || ['ignored', 'note', 'warning', 'error', 'fatal'][severity + 1] || '(s)', ', ' ORDER BY severity) FROM c), '']) AS line, -1 AS pos, unnest([0, 1, 2, 3, 4, 5]) AS k),
body AS (SELECT repeat('  ', depth) || text AS line, pos, 1 AS k FROM ir_diagnostics UNION ALL SELECT '', pos, 0 FROM ir_diagnostics WHERE depth = 0 AND pos <> (SELECT min(pos) FROM ir_diagnostics))
SELECT row_number() OVER (ORDER BY pos, k) - 1 AS position, line FROM (SELECT * FROM head UNION ALL SELECT * FROM body)""")
def _(v):
    """The whole text, line by line: a header, groups apart, notes indented below theirs; written twice, the second log replaces the first."""
    path = f"{shared_dir(v.spark)}/log"
    outputs.write_log(v.spark, path, v.diagnostics.limit(3), 1, "before")
    outputs.write_log(v.spark, path, v.diagnostics, 5, "then")
    return a.numbered(outputs.read_log(v.spark, path), [], ["part", "block", "at"]).select("position", "line")


@query("l14_keyed_state", "SELECT usr, max_by(spelling, (is_definition, seq)) AS spelling, max_by(payload, (is_definition, seq)) AS payload, max(seq) FILTER (WHERE is_definition = d) AS seq, max(is_definition) AS is_definition, max(is_documented) AS is_documented FROM (SELECT *, max(is_definition) OVER (PARTITION BY usr) AS d FROM ir_symbol_writes) GROUP BY usr")
def _(v):
    """The later half of the log comes first; the stream is started again for the earlier half, in which a third of the later one is repeated."""
    path = shared_dir(v.spark)
    writes = v.symbol_writes
    middle = writes.agg(F.max("seq")).first()[0] // 2
    late = F.col("seq") > middle
    writes.where(late).repartition(4, "seq").write.parquet(f"{path}/log")
    ingest.keep_symbols(v.spark, f"{path}/log", writes.schema, f"{path}/state", 2)
    writes.where(~late | (F.col("seq") % 3 == 0)).repartition(4, "seq").write.mode("append").parquet(f"{path}/log")
    return ingest.keep_symbols(v.spark, f"{path}/log", writes.schema, f"{path}/state", 2)


@query("a8_split_array", "SELECT p_partkey AS id, '/build' AS directory, 'src/' || p_name || '.cpp' AS file, 'c++ \"' || p_brand || '\" {[' || CAST(p_size AS VARCHAR) || '\\ ' || p_name AS command, sha256('[\n' || (SELECT string_agg('{\"id\":' || CAST(p_partkey AS VARCHAR) || ',\"directory\":\"/build\",\"file\":\"src/' || p_name || '.cpp\",\"command\":\"c++ \\\"' || p_brand || '\\\" {[' || CAST(p_size AS VARCHAR) || '\\\\ ' || p_name || '\"}', ',\n' ORDER BY p_partkey) FROM part) || '\n]\n') AS digest FROM part")
def _(v):
    """A compilation database with an entry a part, one JSON array that many tasks read; commands hold quotes, brackets and backslashes."""
    path = f"{shared_dir(v.spark)}/commands"
    entry = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.lit("/build").alias("directory"), F.concat(F.lit("src/"), "p_name", F.lit(".cpp")).alias("file"), F.concat(F.lit('c++ "'), "p_brand", F.lit('" {['), F.col("p_size").cast("string"), F.lit("\\ "), "p_name").alias("command")))
    jsonarray.write(v.spark, path, v("part").select(F.col("p_partkey").alias("at"), entry.alias("entry")))
    return jsonarray.read(v.spark, path, "id long, directory string, file string, command string", split_bytes=4096)
