"""Queries of section L: incremental state, and of the page sinks of section A."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.functions import scalar as s
from irloom.operators import incremental as inc
from irloom.operators.pages import LINES
from irloom.operators.state import shared_dir
from irloom.plans.registry import query

STORED = "(SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, p_partkey * 10 AS mtime_ns, CAST(p_size AS BIGINT) AS size, p_name AS sha256 FROM part)"
CURRENT = "(SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, p_partkey * 10 + p_partkey % 2 AS mtime_ns, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 6 = 1 THEN p_brand ELSE p_name END AS sha256 FROM part WHERE p_partkey % 10 <> 3)"
CHANGES = f"SELECT path, CASE WHEN c.sha256 IS NULL THEN 'gone' WHEN s.mtime_ns = c.mtime_ns AND s.size = c.size THEN 'same' WHEN s.sha256 = c.sha256 THEN 'healed' ELSE 'changed' END AS status FROM {STORED} s LEFT JOIN {CURRENT} c USING (path)"


def _changes(v):
    p, path, size = v("part"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("size")
    stored = p.select(path, (F.col("p_partkey") * 10).alias("mtime_ns"), size, F.col("p_name").alias("sha256"))
    current = p.where("p_partkey % 10 <> 3").select(path, (F.col("p_partkey") * 10 + F.col("p_partkey") % 2).alias("mtime_ns"), size, F.when(F.col("p_partkey") % 6 == 1, F.col("p_brand")).otherwise(F.col("p_name")).alias("sha256"))
    return inc.input_changes(stored, current)


def _dependencies(v):
    return v("lineitem").select(F.col("l_orderkey").alias("input"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dep"))


@query("l1_input_changes", CHANGES)
def _(v):
    return _changes(v)


@query("l2_parse_validity", f"SELECT count(*) FILTER (WHERE status IN ('gone', 'changed')) = 0 AS valid FROM ({CHANGES})")
def _(v):
    return _changes(v).agg((F.count(F.when(F.col("status").isin("gone", "changed"), 1)) == 0).alias("valid"))


@query("l3_parse_status", f"WITH h AS (SELECT input FROM ({CHANGES}) c LEFT JOIN (SELECT l_orderkey AS input, 'p' || CAST(l_partkey AS VARCHAR) AS dep FROM lineitem) d ON dep = path WHERE status IN ('gone', 'changed')) SELECT CASE WHEN count(*) = 0 THEN 'current' WHEN bool_or(input IS NULL) THEN 'all' ELSE 'some' END AS status, count(DISTINCT input) AS stale FROM h")
def _(v):
    return inc.parse_status(_changes(v), _dependencies(v))


@query("l4_partial_record", "SELECT input, dep, count(*) AS n FROM (SELECT l_orderkey AS input, l_partkey AS dep FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 5 = 0) GROUP BY ALL")
def _(v):
    rows = v("lineitem").select(F.col("l_orderkey").alias("input"), F.col("l_partkey").alias("dep"))
    new = v("lineitem").where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("input"), F.col("l_suppkey").alias("dep"))
    return inc.partial_record(rows, new, new).groupBy("input", "dep").agg(F.count("*").alias("n"))


@query("l5_trusted_times", "SELECT event_id, CASE WHEN event_id * 1000000 < 5000000000 - 2000000000 THEN event_id * 1000000 END AS mtime FROM events")
def _(v):
    return v("events").select("event_id", (F.col("event_id") * 1_000_000).alias("t")).select("event_id", inc.trusted_mtime("t", 5_000_000_000).alias("mtime"))


PAGES = f"(SELECT page, sha256(string_agg(digest, chr(30) ORDER BY kind, block)) AS fingerprint FROM (SELECT file_id AS page, kind, line // {LINES} AS block, sha256(string_agg(usr || chr(31) || spelling, chr(30) ORDER BY line, usr)) AS digest FROM ir_symbols GROUP BY ALL) GROUP BY page)"


def _pages(v):
    tokens = v.symbols.select(F.col("file_id").alias("page"), "kind", F.floor(F.col("line") / LINES).alias("block"), "line", "usr", s.dep_token("usr", "spelling").alias("token"))
    return inc.fingerprints(tokens, "page", ["kind", "block"], ["line", "usr"], "token")


@query("l6_page_fingerprints", f"SELECT * FROM {PAGES}")
def _(v):
    return _pages(v)


@query("l7_memo_lookup", f"WITH p AS (SELECT CAST(page AS VARCHAR) AS stem, fingerprint FROM {PAGES}), m AS (SELECT stem, CASE WHEN stem = '2' THEN 'old' ELSE fingerprint END AS fingerprint, 'text ' || stem AS text FROM p WHERE stem <> '4') SELECT p.stem, p.fingerprint, m.text FROM p LEFT JOIN m USING (stem, fingerprint)")
def _(v):
    p = _pages(v).select(F.col("page").cast("string").alias("stem"), "fingerprint")
    memo = p.where("stem <> '4'").select("stem", F.when(F.col("stem") == "2", "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.concat(F.lit("text "), "stem").alias("text"))
    return inc.memo_hits(p, memo).select("stem", "fingerprint", "text")


@query("l8_memo_update", "SELECT url AS stem, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'old' END AS text FROM pages WHERE page_id % 4 <> 1")
def _(v):
    p = v("pages").withColumnRenamed("url", "stem")
    memo = p.where("page_id % 3 <> 0 OR page_id % 2 = 0").select("page_id", "stem", F.lit("old").alias("text"))
    fresh = p.where("page_id % 3 = 0").select("page_id", "stem", F.lit("new").alias("text"))
    key = lambda df: df.withColumn("stem", F.concat(F.col("page_id").cast("string"), F.lit(" "), "stem"))  # noqa: E731  urls repeat
    out = inc.memo_update(key(memo), key(fresh), key(p.where("page_id % 4 <> 1").select("page_id", "stem")))
    return out.select(F.substring_index("stem", " ", -1).alias("stem"), "text")


SUMMARY = """CASE c_custkey % 5 WHEN 0 THEN '{"pages":"' || CAST(c_custkey AS VARCHAR) || '"}' WHEN 1 THEN '[1]' WHEN 2 THEN 'pages' ELSE '{}' END"""


@query("l9_render_validity", f"SELECT c_custkey, c_custkey % 7 <> 0 AND c_custkey % 4 <> 3 AND c_nationkey % 3 <> 0 AND json_valid({SUMMARY}) AND json_type(CASE WHEN json_valid({SUMMARY}) THEN {SUMMARY} ELSE '0' END) = 'OBJECT' AS is_current FROM customer")
def _(v):
    """A cache a customer: most have a recorded render, some of another fingerprint, some parsed anew since."""
    c = v("customer")
    summary = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('{"pages":"'), F.col("c_custkey").cast("string"), F.lit('"}'))).when(F.col("c_custkey") % 5 == 1, "[1]").when(F.col("c_custkey") % 5 == 2, "pages").otherwise("{}")
    print_of = lambda column: F.sha2(F.col(column).cast("string"), 256)
    meta = c.select("c_custkey", F.lit("parse_fingerprint").alias("key"), F.lit("first").alias("value"))
    rendered = c.where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 3, "old").otherwise(print_of("c_name")).alias("fingerprint"), summary.alias("summary"))
    meta = inc.record_render(meta, rendered.withColumn("fingerprint", F.lit("before")), ["c_custkey"])
    meta = inc.record_render(meta, rendered, ["c_custkey"])
    meta = inc.record_parse(meta, c.where("c_nationkey % 3 = 0").select("c_custkey", F.lit("second").alias("fingerprint")), ["c_custkey"])
    return inc.render_validity(meta, c.select("c_custkey", print_of("c_name").alias("fingerprint")), ["c_custkey"])


@query("l12_memo_modes", "SELECT c_custkey AS config, coalesce(bool_and(p_size % 10 <> 0) FILTER (WHERE p_size % 4 <> 0), true) AS memoise, coalesce(bool_and(p_size % 10 <> 0) FILTER (WHERE p_size % 4 <> 0), false) AS wide FROM customer LEFT JOIN part ON p_partkey % 500 = c_custkey GROUP BY c_custkey")
def _(v):
    """Configurations with template files of their own: some without any, some whose templates all declare that they may be replayed."""
    size = F.col("p_size")
    content = F.when(size % 10 != 0, F.concat(F.lit("{# own\n page-cache #}\n"), "p_name")).when(size % 20 == 0, F.lit("{# own #} page-cache {# x #}")).otherwise(F.col("p_name"))
    templates = v("part").select((F.col("p_partkey") % 500).alias("config"), F.concat("p_name", F.when(size % 4 != 0, ".md.jinja").otherwise(".md")).alias("path"), content.alias("content"))
    return inc.memo_modes(v("customer").select(F.col("c_custkey").alias("config")), templates)


@query("l10_damaged_outputs", "SELECT 'p' || CAST(p_partkey AS VARCHAR) AS name FROM part WHERE p_partkey % 5 = 0 OR (p_partkey % 7 = 0 AND p_name <> p_brand)")
def _(v):
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name")
    return inc.damaged_outputs(v("part").select(name, F.col("p_name").alias("digest")), v("part").where("p_partkey % 5 <> 0").select(name, F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("digest")))


@query("a9_changed_pages", "SELECT page_id, page_id % 6 = 0 OR page_id % 7 = 0 AS written, CASE WHEN page_id % 6 = 0 THEN html || 'x' ELSE html END AS html FROM pages")
def _(v):
    """Pages as they stand after a second run: every sixth differs, every seventh is new; only those are written."""
    path = shared_dir(v.spark)
    p = v("pages").select("page_id", "html")
    old = p.where("page_id % 7 <> 0")
    new = p.withColumn("html", F.when(F.col("page_id") % 6 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")))
    inc.write_changed(v.spark, path, old, "page_id", "html")
    inc.write_changed(v.spark, path, new, "page_id", "html")
    return inc.written_pages(v.spark, path, "page_id", "html").select("page_id", (F.col("run") == 1).alias("written"), "html")


@query("a10_page_actions", "SELECT page_id AS name, CASE WHEN page_id % 5 = 0 THEN 'delete' WHEN page_id % 3 = 0 THEN 'insert' ELSE 'unchanged' END AS action FROM pages")
def _(v):
    p = v("pages").select(F.col("page_id").alias("name"), F.sha2("html", 256).alias("digest"))
    return inc.output_changes(p.where("name % 5 <> 0"), p.where("name % 5 = 0 OR name % 3 <> 0"))


@query("a11_diagnostics_log", f"SELECT file, pos // {LINES} AS block, string_agg(repeat('  ', depth) || text, chr(10) ORDER BY pos) AS log FROM ir_diagnostics GROUP BY ALL")
def _(v):
    """A file's log in blocks of consecutive diagnostics."""
    from irloom.operators.query import ordered

    block = F.floor(F.col("pos") / LINES).cast("long").alias("block")
    return v.diagnostics.groupBy("file", block).agg(F.array_join(ordered(["pos"], F.concat(F.repeat(F.lit("  "), F.col("depth")), "text")), "\n").alias("log"))


@query("a13_meta_lookup", "SELECT r_name AS value FROM region WHERE r_regionkey = 2")
def _(v):
    from irloom.operators.query import Store

    meta = v("region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("value"))
    return v.spark.createDataFrame([(Store(meta=meta).meta("2"),)], "value string")


@query("a4_whole_scan", "SELECT s.*, f.path FROM ir_symbols s LEFT JOIN ir_files f ON f.id = s.file_id")
def _(v):
    return v.symbols.join(v.files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")


@query("a7_partial_replace", "SELECT usr, spelling FROM ir_symbols WHERE file_id NOT IN (1, 2) UNION ALL SELECT usr, 'new ' || spelling FROM ir_symbols WHERE file_id = 2 AND line % 2 = 0")
def _(v):
    from irloom.operators import merge

    kept = merge.delete_files({"symbols": v.symbols}, v.files.where("id IN (1, 2)"), {})["symbols"]
    new = v.symbols.where("file_id = 2 AND line % 2 = 0").withColumn("spelling", F.concat(F.lit("new "), "spelling"))
    return merge.append(kept.select("usr", "spelling"), new.select("usr", "spelling"))


@query("x10_finalized", "SELECT usr, c.symbol_usr IS NOT NULL AS is_documented FROM ir_symbols LEFT JOIN (SELECT DISTINCT 'c:' || CAST(conv_id AS VARCHAR) AS symbol_usr FROM conversations) c ON symbol_usr = usr")
def _(v):
    c = v("conversations").select(F.concat(F.lit("c:"), F.col("conv_id").cast("string")).alias("usr")).distinct().withColumn("d", F.lit(True))
    return v.symbols.join(c, "usr", "left").select("usr", F.coalesce("d", F.lit(False)).alias("is_documented"))


@query("x11_file_rows", "SELECT url AS path, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes FROM pages")
def _(v):
    return v("pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size_bytes"))
