"""Section L: change detection, reuse decisions and memoised outputs, as joins of snapshots."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors import PySparkException as SparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.sources.snapshot import exists

RACY_NS = 2_000_000_000


def input_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path and status of every known input: gone, same (by time and size), healed (new time, same digest) or changed.

    A digest is only needed where time or size differ.
    """
    j = stored.alias("s").join(current.alias("c"), "path", "left")
    same = F.col("s.mtime_ns").isNotNull() & (F.col("s.mtime_ns") == F.col("c.mtime_ns")) & (F.col("s.size") == F.col("c.size"))
    status = F.when(F.col("c.sha256").isNull(), "gone").when(same, "same").when(F.col("s.sha256") == F.col("c.sha256"), "healed").otherwise("changed")
    return j.select("path", status.alias("status"))


def trusted_mtime(mtime_ns: str, started_ns: int):
    """The time of a file, unless it is so young that a change within the clock's step would not show."""
    return F.when(F.col(mtime_ns) < started_ns - RACY_NS, F.col(mtime_ns))


def parse_status(changes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row: current, some (with how many inputs are stale) or all (a changed path that no input is known to depend on)."""
    changed = changes.where(F.col("status").isin("gone", "changed")).select("path")
    hits = changed.join(dependencies, changed.path == dependencies.dep, "left")
    g = hits.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("input").isNull()), F.lit(False)).alias("unknown"), F.count_distinct("input").alias("stale"))
    return g.select(F.when(F.col("n") == 0, "current").when(F.col("unknown"), "all").otherwise("some").alias("status"), "stale")


def partial_record(old: DataFrame, new: DataFrame, reparsed: DataFrame) -> DataFrame:
    """Dependency rows after a partial parse: those of reparsed inputs are replaced."""
    return old.join(reparsed.select("input").distinct(), "input", "left_anti").unionByName(new)


def fingerprints(tokens: DataFrame, page: str, block: list[str], order: list[str], token: str) -> DataFrame:
    """Per page the digest of the digests of its blocks, in order; a block's is that of its tokens in order, each joined by a record separator.

    `block` cuts a page's tokens into runs of bounded size, so a page with most of the
    tokens is still many groups.
    """
    joined = lambda keys, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*keys, c))), lambda x: x[c]), "\x1e")
    parts = tokens.groupBy(page, *block).agg(F.sha2(joined(order, token), 256).alias("digest"))
    return parts.groupBy(page).agg(F.sha2(joined(block, "digest"), 256).alias("fingerprint"))


def memo_hits(pages: DataFrame, memo: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Pages with the stored text where stem and key match; NULL where they must be rendered."""
    return pages.join(memo.select("stem", key, "text"), ["stem", key], "left")


def memo_update(memo: DataFrame, fresh: DataFrame, planned: DataFrame) -> DataFrame:
    """The memo with fresh pages replacing those of their stem, and pages no longer planned left out."""
    kept = memo.join(fresh.select("stem"), "stem", "left_anti").unionByName(fresh)
    return kept.join(planned.select("stem").distinct(), "stem", "left_semi")


def output_changes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """name and action (insert, update, unchanged, delete) for a set of pages (name, digest)."""
    j = new.select("name", F.col("digest").alias("n")).join(stored.select("name", F.col("digest").alias("s")), "name", "full_outer")
    action = F.when(F.col("s").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("n") == F.col("s"), "unchanged").otherwise("update")
    return j.select("name", action.alias("action"))


def written_pages(spark: SparkSession, path: str, name: str, text: str) -> DataFrame:
    """The pages that stand below `path`: of each name the one of the last run that wrote it."""
    rows = spark.read.parquet(f"{path}/pages")
    last = rows.groupBy(F.col(name).alias("__name")).agg(F.max("run").alias("__run"))
    return rows.join(last, (F.col(name) == F.col("__name")) & (F.col("run") == F.col("__run"))).drop("__name", "__run").where(F.col(text).isNotNull())


def written_digests(spark: SparkSession, path: str, name: str) -> DataFrame:
    """name and digest of the pages that stand below `path`; no text is read."""
    last = spark.read.parquet(f"{path}/pages").groupBy(name).agg(F.max_by("digest", "run").alias("digest"))
    return last.where("digest IS NOT NULL").select(F.col(name).alias("name"), "digest")


def write_changed(spark: SparkSession, path: str, pages: DataFrame, name: str, text: str) -> None:
    """Write the pages whose text differs from what stands below `path`, as one more run; pages that are gone leave a mark."""
    pages = pages.withColumn("digest", F.sha2(text, 256))
    run = 0
    if exists(spark, f"{path}/pages"):
        run = spark.read.parquet(f"{path}/pages").agg(F.max("run")).first()[0] + 1
        actions = output_changes(pages.select(F.col(name).alias("name"), "digest"), written_digests(spark, path, name)).where("action <> 'unchanged'").select(F.col("name").alias(name), "action")
        pages = actions.join(pages, name, "left").drop("action")
    pages.write.parquet(f"{path}/pages/run={run}")


def damaged_outputs(recorded: DataFrame, listed: DataFrame) -> DataFrame:
    """Recorded outputs that are gone or whose size or digest differs."""
    j = recorded.alias("r").join(listed.alias("l"), "name", "left")
    return j.where(F.col("l.digest").isNull() | (F.col("l.digest") != F.col("r.digest"))).select("name")


RENDER_KEYS = ["render_fingerprint", "render_summary"]
CACHE_VERSION = "1"


def put_meta(meta: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Meta rows (by, key, value) with those of `new` in place of theirs."""
    keys = [*by, "key"]
    return meta.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*meta.columns))


def record_render(meta: DataFrame, renders: DataFrame, by: list[str]) -> DataFrame:
    """Meta after renders (by, fingerprint, summary as JSON)."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in zip(RENDER_KEYS, ("fingerprint", "summary"), strict=True)))
    return put_meta(meta, renders.select(*by, F.inline(pairs)), by)


def record_parse(meta: DataFrame, parses: DataFrame, by: list[str]) -> DataFrame:
    """Meta after parses (by, fingerprint): the new fingerprint stands and the render record is gone, in one table."""
    stale = meta.join(parses.select(*by), by, "left_semi").where(F.col("key").isin(RENDER_KEYS))
    left = meta.join(stale.select(*by, "key"), [*by, "key"], "left_anti")
    return put_meta(left, parses.select(*by, F.lit("parse_fingerprint").alias("key"), F.col("fingerprint").alias("value")), by)


def render_validity(meta: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """by, is_current: whether the recorded render has the wanted fingerprint and a summary that is a JSON object."""
    of = {k: F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in RENDER_KEYS}
    recorded = meta.groupBy(*by).agg(*of.values())
    told = F.from_json("render_summary", "map<string,string>").isNotNull() & F.rlike("render_summary", F.lit(r"^\s*\{"))
    same = F.col("render_fingerprint") == F.col("fingerprint")
    return wanted.join(recorded, by, "left").select(*by, F.coalesce(same & told, F.lit(False)).alias("is_current"))


def open_cache(spark: SparkSession, path: str, tables: dict[str, str], version: str = CACHE_VERSION) -> dict[str, DataFrame]:
    """The tables of a cache below `path`, given with their schemas as DDL; all empty if its version is another or it cannot be read.

    Each file's footer is read, no column of it: what is cut off or is no table shows there.
    """

    def read(name: str) -> DataFrame:
        df = spark.read.schema(tables[name]).parquet(f"{path}/{name}")
        df.count()
        return df

    empty = {n: spark.createDataFrame([], ddl) for n, ddl in tables.items()}
    try:
        meta = spark.read.schema("key string, value string").parquet(f"{path}/meta").where("key = 'cache_version'").first()
        return {n: read(n) for n in tables} if meta is not None and meta.value == version else empty
    except (AnalysisException, Py4JJavaError, SparkException):
        return empty


def save_cache(spark: SparkSession, path: str, tables: dict[str, DataFrame], version: str = CACHE_VERSION) -> None:
    """Tables first, the version last: a cache that was not finished has none and counts as empty."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([("cache_version", version)], "key string, value string").write.mode("overwrite").parquet(f"{path}/meta")


#: A template says in a comment that pages made of it may be replayed.
DECLARED = r"(?s)\{#(?:(?!#\}).)*?\bpage-cache\b.*?#\}"


def memo_modes(configs: DataFrame, templates: DataFrame, by: str = "config", suffix: str = ".jinja") -> DataFrame:
    """Per configuration whether pages may be memoised, and on the wide fingerprint: `templates` (by, path, content) are
    the files of its own template directories. Without any it may; with some only if all declare it, and then widely."""
    own = templates.where(F.endswith("path", F.lit(suffix))).groupBy(by).agg(F.bool_and(F.rlike("content", F.lit(DECLARED))).alias("all_declare"))
    return configs.select(by).join(own, by, "left").select(by, F.coalesce("all_declare", F.lit(True)).alias("memoise"), F.coalesce("all_declare", F.lit(False)).alias("wide"))
