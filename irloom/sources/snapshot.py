"""Snapshots of the model: every table as Parquet below a version folder, and a pointer that is switched last.

The pointer is one small file, replaced by an atomic rename, so a reader sees the old
snapshot or the new one and never none. All paths go through Spark's file systems.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.operators import merge
from irloom.sources.schema import SCHEMA_VERSION, TABLES


class NotFoundError(Exception):
    """There is no snapshot at the path."""


class NotASnapshotError(Exception):
    """The path holds no meta table."""


class InputError(Exception):
    """A pattern names no file, or a file does not hold what it should."""


class VersionError(Exception):
    """The snapshot has another schema version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def local_path(fs, path) -> str | None:
    """The path on this machine, if the file system is the local one."""
    uri = fs.makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_small(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of a few bytes, written next to its place and moved there by an atomic rename that replaces the old one."""
    fs, target = _fs(spark, path)
    _, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    if here := local_path(fs, target):  # Hadoop's local file system has no rename that replaces in one step
        there = local_path(fs, beside)
        os.makedirs(os.path.dirname(here), exist_ok=True)
        with open(there, "wb") as f:
            f.write(data)
        os.replace(there, here)
        return
    out = fs.create(beside, False)
    out.write(data)
    out.close()
    package = spark._jvm.org.apache.hadoop.fs
    kind = getattr(package, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    package.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(target), options)


def current(spark: SparkSession, path: str) -> str:
    if not exists(spark, f"{path}/CURRENT"):
        raise NotFoundError(path)
    return spark.read.text(f"{path}/CURRENT").first().value


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of the current snapshot, with their declared types."""
    base = f"{path}/{current(spark, path)}"
    if not exists(spark, f"{base}/meta"):
        raise NotASnapshotError(path)
    tables = {n: spark.read.schema(t).parquet(f"{base}/{n}") for n, t in TABLES.items() if exists(spark, f"{base}/{n}")}
    row = tables["meta"].where("key = 'schema_version'").first()
    if row is None or row.value != SCHEMA_VERSION:
        raise VersionError(f"{path}: {row.value if row else None}, not {SCHEMA_VERSION}")
    return tables


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Full replace: a new version folder, then the pointer. A table that is not given is empty, a column NULL."""
    version = uuid.uuid4().hex
    for name, schema in TABLES.items():
        df = tables.get(name)
        df = spark.createDataFrame([], schema) if df is None else df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
        if name == "meta":
            df = df.where("key <> 'schema_version'").union(spark.createDataFrame([("schema_version", SCHEMA_VERSION)], schema))
        df.write.option("compression", "zstd").parquet(f"{path}/{version}/{name}")
    write_small(spark, f"{path}/CURRENT", version.encode())
    return version


def drop_old(spark: SparkSession, path: str) -> int:
    """Remove the versions that the pointer does not name, for when no reader is left on them; how many."""
    keep = current(spark, path)
    fs, p = _fs(spark, path)
    old = [f.getPath() for f in fs.listStatus(p) if f.isDirectory() and f.getPath().getName() != keep]
    for folder in old:
        if not fs.delete(folder, True):
            raise OSError(f"cannot remove {folder}")
    return len(old)


def write_streamed(spark: SparkSession, path: str, meta: DataFrame, batches: Iterable[DataFrame]) -> str:
    """Full replace by batches of symbol writes (a `seq` column orders them): each is appended to a staged log, the log
    is folded into a new version, and the pointer is switched. A failed batch leaves the old snapshot as it is."""
    log = f"{path}/staged-{uuid.uuid4().hex}"
    for batch in batches:
        batch.write.mode("append").parquet(log)
    if not exists(spark, log):
        return write(spark, path, {"meta": meta})
    symbols = merge.upsert_symbols(spark.read.parquet(log).withColumn("at", F.col("seq")), "usr")
    version = write(spark, path, {"meta": meta, "symbols": symbols})
    fs, staged = _fs(spark, log)
    if not fs.delete(staged, True):
        raise OSError(f"cannot remove {log}")
    return version


def write_part(spark: SparkSession, path: str, batch: dict[str, DataFrame], replaced: DataFrame) -> str:
    """Replace the rows of files (replaced: file_id as id) by a batch, in a new snapshot."""
    children = {"function_parameters": "function_usr", "template_parameters": "owner_usr", "references": "from_usr", "comments": "symbol_usr", "comment_fields": "symbol_usr", "group_members": "member_usr"}
    kept = merge.delete_files(read(spark, path), replaced, children)
    return write(spark, path, {n: merge.append(df, batch[n]) if n in batch else df for n, df in kept.items()})


def resolve_inputs(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """pos, path and length of the files that patterns name, each once, at the first pattern that names it.

    A path that exists is taken as it stands, though it may hold characters of a glob;
    directories are left out; a pattern that names nothing at all is an error.
    """
    found: dict[str, tuple[int, int]] = {}
    for pos, pattern in enumerate(patterns):
        fs, p = _fs(spark, pattern)
        named = [fs.getFileStatus(p)] if fs.exists(p) else sorted(fs.globStatus(p) or [], key=lambda f: f.getPath().toString())
        if not named:
            raise InputError(f"no file matches {pattern!r}")
        for f in named:
            if f.isFile():
                found.setdefault(f.getPath().toString(), (pos, f.getLen()))
    rows = pa.table({"pos": pa.array((pos for pos, _ in found.values()), pa.int32()), "path": pa.array(found, pa.string()), "length": pa.array((n for _, n in found.values()), pa.int64())})
    return spark.createDataFrame(rows, "pos int, path string, length long")  # of rows as tuples, tasks would start Python


COMMANDS = "array<struct<directory:string,file:string,command:string,arguments:array<string>>>"


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a compilation database (a JSON array, not empty), each with the digest of the file's bytes, from one read."""
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("digest"))
    entries = raw.where(F.rlike("text", F.lit(r"^\s*\["))).select("digest", F.explode(F.from_json("text", COMMANDS)).alias("e")).where("e IS NOT NULL").select("e.*", "digest")
    if entries.isEmpty():
        raise InputError(f"{path} is no JSON array of compile commands, or an empty one")
    return entries


ENTITY = "compoundname string, `_kind` string, briefdescription string, detaileddescription string"


def documented_entities(spark: SparkSession, path: str, row_tag: str = "compounddef") -> DataFrame:
    """name and kind of the entities in another tool's XML output that have a brief or a detailed description."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(ENTITY).load(path)
    told = F.coalesce(F.trim(F.concat_ws("", "briefdescription", "detaileddescription")), F.lit("")) != ""
    return rows.where(told).select(F.col("compoundname").alias("name"), F.col("_kind").alias("kind"))


def directory_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
