"""Queries of the sources, sinks and streams of sections A, F13 and L14, over folders they write themselves."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.operators import incremental as inc
from irloom.operators.state import shared_dir
from irloom.plans.registry import query
from irloom.sources import outputs, snapshot
from irloom.sources.schema import TABLES
from irloom.streaming import ingest


def _tables(v):
    one = lambda t, **c: t.withColumns(c)
    s = v.symbols
    text = {c: F.lit("") for c in ("display_name", "signature", "type_repr", "content_hash")}
    return {"symbols": one(s, **text, access=F.lit(0), storage=F.lit(0), col=F.lit(1)), "references": v.references, "files": v.files, "meta": v.spark.createDataFrame([("tool", "irloom")], "key string, value string")}


@query("a1_resolved_inputs", """
WITH f AS (SELECT 'p' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN '.hpp' ELSE '[1].cpp' END AS name, CAST(strlen(html) AS BIGINT) AS length FROM pages)
SELECT CASE WHEN name = 'p1[1].cpp' THEN 0 WHEN ends_with(name, '.hpp') THEN 1 ELSE 3 END AS pos, name, length FROM f WHERE name = 'p1[1].cpp' OR ends_with(name, '.hpp') OR starts_with(name, 'p2')""")
def _(v):
    """A file a page: a path that exists beats a glob, a file counts where it is first named, folders are left out."""
    path = shared_dir(v.spark)
    ending = F.when(F.col("page_id") % 3 == 0, ".hpp").otherwise("[1].cpp")
    outputs.put_pages(v.spark, path, v("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), ending).alias("name"), F.col("html").alias("text")))
    found = snapshot.resolve_inputs(v.spark, [f"{path}/{p}" for p in ("p1[1].cpp", "*.hpp", "p1[1].cpp", "p2*", ".state")])
    return found.select("pos", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("a3_snapshot_scan", "SELECT usr, kind, qualified_name, is_documented = 1 AS is_documented FROM ir_symbols")
def _(v):
    path = shared_dir(v.spark)
    snapshot.write(v.spark, path, _tables(v))
    return snapshot.read(v.spark, path)["symbols"].select("usr", "kind", "qualified_name", "is_documented")


@query("a5_full_replace", "SELECT 'new' AS snapshot, from_usr, ref_kind, to_usr, ordinal FROM ir_references WHERE ordinal > 2 UNION ALL SELECT 'old', from_usr, ref_kind, to_usr, ordinal FROM ir_references WHERE ordinal <= 2")
def _(v):
    """Two snapshots one after another; a reader that is left on the first still has it whole."""
    path = shared_dir(v.spark)
    columns = ["from_usr", "ref_kind", "to_usr", "ordinal"]
    snapshot.write(v.spark, path, _tables(v) | {"references": v.references.where("ordinal <= 2")})
    old = snapshot.read(v.spark, path)["references"]
    snapshot.write(v.spark, path, _tables(v) | {"references": v.references.where("ordinal > 2")})
    new = snapshot.read(v.spark, path)["references"]
    return new.select(F.lit("new").alias("snapshot"), *columns).union(old.select(F.lit("old"), *columns))


@query("a6_streamed_replace", "SELECT usr, max_by(spelling, (is_definition, seq)) AS spelling, max(is_definition) AS is_definition, max(is_documented) AS is_documented FROM ir_symbol_writes GROUP BY usr")
def _(v):
    """Batches go to a staged log that becomes the next snapshot; a batch that fails leaves the one before."""
    path = shared_dir(v.spark)
    writes = v.symbol_writes.drop("payload")
    snapshot.write_streamed(v.spark, path, _tables(v)["meta"], (writes.where(F.col("seq") % 3 == k) for k in (2, 0, 1)))

    def broken():
        yield writes.where("seq < 5")
        raise OSError("the writer stopped")

    try:
        snapshot.write_streamed(v.spark, path, _tables(v)["meta"], broken())
    except OSError:
        pass  # the point of this part of the query
    return snapshot.read(v.spark, path)["symbols"].select("usr", "spelling", *(F.col(c).cast("int").alias(c) for c in ("is_definition", "is_documented")))


@query("a7_snapshot_part", "SELECT usr, kind, qualified_name, line FROM ir_symbols WHERE file_id <> 1 UNION ALL SELECT usr, kind, 'again::' || qualified_name, line FROM ir_symbols WHERE file_id = 1 AND line % 2 = 0")
def _(v):
    path = shared_dir(v.spark)
    tables = _tables(v)
    snapshot.write(v.spark, path, tables)
    fresh = tables["symbols"].where("file_id = 1 AND line % 2 = 0").withColumn("qualified_name", F.concat(F.lit("again::"), "qualified_name"))
    declared = TABLES["symbols"]
    fresh = fresh.select(*((F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared.fields))
    snapshot.write_part(v.spark, path, {"symbols": fresh}, v.files.where("id = 1").select("id"))
    return snapshot.read(v.spark, path)["symbols"].select("usr", "kind", "qualified_name", "line")


@query("a8_compile_commands", "SELECT '/build' AS directory, path AS file, 'c++ ' || CASE WHEN id % 2 = 0 THEN '-O' || CAST(id AS VARCHAR) || ' ' ELSE '' END || path AS arguments, (SELECT sha256('[' || string_agg('{\"directory\":\"/build\",\"file\":\"' || path || '\",\"arguments\":[\"c++\",' || CASE WHEN id % 2 = 0 THEN '\"-O' || CAST(id AS VARCHAR) || '\",' ELSE '' END || '\"' || path || '\"]}', ',' ORDER BY id) || ']') FROM ir_files) AS digest FROM ir_files")
def _(v):
    path = f"{shared_dir(v.spark)}/compile_commands.json"
    rows = v.files.orderBy("id").collect()  # one row a file of the fixed dimension
    entries = ({"directory": "/build", "file": r.path, "arguments": ["c++", *([f"-O{r.id}"] if r.id % 2 == 0 else []), r.path]} for r in rows)
    snapshot.write_small(v.spark, path, json.dumps(list(entries), separators=(",", ":")).encode())
    return snapshot.compile_commands(v.spark, path).select("directory", "file", F.array_join("arguments", " ").alias("arguments"), "digest")


@query("a12_documented_entities", "SELECT CAST(p_partkey AS VARCHAR) || ' ' || p_name AS name, 'class' AS kind FROM part WHERE p_partkey % 3 <> 0")
def _(v):
    """Another tool's XML: a third of the entities have a brief, a third a detailed description, the others blanks."""
    path = shared_dir(v.spark)
    key = F.col("p_partkey")
    told = [F.when(key % 3 == k, F.col("p_type")).otherwise(F.lit(" ")) for k in (1, 2)]
    rows = v("part").select(F.lit("class").alias("_kind"), F.concat(key.cast("string"), F.lit(" "), "p_name").alias("compoundname"), told[0].alias("briefdescription"), told[1].alias("detaileddescription"))
    rows.write.format("xml").option("rowTag", "compounddef").option("rootTag", "doxygen").save(path)
    return snapshot.documented_entities(v.spark, path)


@query("f13_directory_statistics", "SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(octet_length(encode('src/' || lower(r_name) || '.hpp'))) AS BIGINT) AS bytes FROM region")
def _(v):
    path = shared_dir(v.spark)
    for r in v.files.collect():  # one row a file of the fixed dimension
        snapshot.write_small(v.spark, f"{path}/{r.id % 2}/{r.id}", r.path.encode())
    return snapshot.directory_statistics(v.spark, path)


@query("l11_reset_caches", "SELECT 'current' AS cache, page_id, url FROM pages UNION ALL SELECT 'saved again', page_id, url FROM pages WHERE page_id % 2 = 0")
def _(v):
    """Caches of this version, of an older one, with a damaged file, and one that never was; the last is then saved again."""
    base, ddl = shared_dir(v.spark), {"outputs": "page_id long, url string"}
    rows = v("pages").select(F.col("page_id").cast("long").alias("page_id"), "url")
    for name, version in (("current", inc.CACHE_VERSION), ("older", "0"), ("damaged", inc.CACHE_VERSION)):
        inc.save_cache(v.spark, f"{base}/{name}", {"outputs": rows}, version)
    snapshot.write_small(v.spark, f"{base}/damaged/outputs/part-x.parquet", b"no table")
    opened = {n: inc.open_cache(v.spark, f"{base}/{n}", ddl)["outputs"] for n in ("current", "older", "damaged", "missing")}
    inc.save_cache(v.spark, f"{base}/missing", {"outputs": rows.where("page_id % 2 = 0")})
    opened["saved again"] = inc.open_cache(v.spark, f"{base}/missing", ddl)["outputs"]
    out = [df.select(F.lit(n).alias("cache"), "page_id", "url") for n, df in opened.items()]
    return reduce(DataFrame.union, out)


@query("l14_streamed_upsert", "SELECT usr, max_by(spelling, (is_definition, seq)) AS spelling, max_by(payload, (is_definition, seq)) AS payload, max(is_definition) AS is_definition, max(is_documented) AS is_documented FROM ir_symbol_writes GROUP BY usr")
def _(v):
    path = shared_dir(v.spark)
    v.symbol_writes.repartition(6, "seq").write.parquet(f"{path}/log")
    return ingest.fold_symbols(v.spark, f"{path}/log", v.symbol_writes.schema, f"{path}/state", 2)
