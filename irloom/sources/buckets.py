"""A7, E9: snapshots laid out by file bucket, so that replacing files rewrites only the buckets they are in.

A symbol lies in the bucket of its file, and what hangs on a symbol (parameters, references, comments)
in its symbol's. Every version has a manifest, a small table of (table, bucket, folder); a new version
names the folders of untouched buckets again and only touched ones are written anew. The pointer to
the version is switched last, so a reader has one version or the other, and a writer that stops leaves
folders that no manifest names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.operators import merge
from irloom.sources.snapshot import NotFoundError, _fs, current, exists, write_small

#: Tables that hang on a symbol, with the column that names it.
CHILDREN = {"function_parameters": "function_usr", "template_parameters": "owner_usr", "references": "from_usr", "comments": "symbol_usr", "comment_fields": "symbol_usr", "group_members": "member_usr"}
BUCKETS = 64
MANIFEST = "table string, bucket int, folder string, rows long"


def bucket_of(file_id: Column, buckets: int) -> Column:
    """Ids are counted up, so their remainder deals them out; what has no file is in the last bucket."""
    return F.coalesce(F.pmod(file_id, F.lit(buckets)), F.lit(buckets)).cast("int")


def _bucketed(tables: dict[str, DataFrame], buckets: int) -> dict[str, DataFrame]:
    """The tables with their bucket; what names a symbol that is not there lies with what has no file."""
    symbols = tables["symbols"]
    out = {"symbols": symbols.withColumn("bucket", bucket_of(F.col("file_id"), buckets))}
    homes = symbols.select(F.col("usr").alias("h_usr"), bucket_of(F.col("file_id"), buckets).alias("bucket"))
    for name, df in tables.items():
        if name in CHILDREN:
            out[name] = df.join(homes, F.col(CHILDREN[name]) == F.col("h_usr"), "left").drop("h_usr").withColumn("bucket", F.coalesce("bucket", F.lit(buckets)))
    return out


def _write(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Writes each table's buckets below a folder of this version; the rows of the manifest."""
    version, rows = uuid.uuid4().hex, None
    for name, df in tables.items():
        folder = f"data/{name}/{version}"
        # By bucket and a hash of the row: a bucket may hold most rows and is then several files.
        df.repartition("bucket", F.pmod(F.xxhash64(*[c for c in df.columns if c != "bucket"]), F.lit(16))).write.partitionBy("bucket").parquet(f"{path}/{folder}")
        counts = spark.read.schema(df.schema).parquet(f"{path}/{folder}").groupBy("bucket").agg(F.count("*").alias("rows"))
        listed = counts.select(F.lit(name).alias("table"), "bucket", F.concat(F.lit(f"{folder}/bucket="), F.col("bucket").cast("string")).alias("folder"), "rows")
        rows = listed if rows is None else rows.unionByName(listed)
    return rows


def _commit(spark: SparkSession, path: str, manifest: DataFrame, buckets: int) -> str:
    version = uuid.uuid4().hex
    manifest.select("table", "bucket", "folder", "rows", F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/manifests/{version}")  # a row a bucket and table
    write_small(spark, f"{path}/CURRENT", version.encode())
    return version


def manifest(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, buckets int").parquet(f"{path}/manifests/{version or current(spark, path)}")


def create(spark: SparkSession, path: str, tables: dict[str, DataFrame], buckets: int = BUCKETS) -> str:
    """A first version of `symbols` and what hangs on them; the layout's number of buckets stays."""
    return _commit(spark, path, _write(spark, path, _bucketed(tables, buckets)), buckets)


def read(spark: SparkSession, path: str, names: dict[str, DataFrame | str], version: str | None = None, only: list[int] | None = None) -> dict[str, DataFrame]:
    """Tables by name, with their schemas given as DDL or as a frame's; of some buckets only, if these are given."""
    if version is None and not exists(spark, f"{path}/CURRENT"):
        raise NotFoundError(path)
    listed = manifest(spark, path, version)
    listed = listed if only is None else listed.where(F.col("bucket").isin(only))
    folders: dict[str, list[str]] = {}
    for r in listed.select("table", "folder").collect():  # a row a bucket and table
        folders.setdefault(r.table, []).append(f"{path}/{r.folder}")
    out = {}
    for name, schema in names.items():
        schema = schema if isinstance(schema, str) else schema.schema
        out[name] = spark.read.schema(schema).parquet(*sorted(folders[name])) if name in folders else spark.createDataFrame([], schema)
    return out


def replace_files(spark: SparkSession, path: str, batch: dict[str, DataFrame], replaced: DataFrame) -> str:
    """Replaces the rows of files (`replaced`: id) by a batch; only buckets of these and of the batch's files are read and written.

    `batch` has a frame, maybe without rows, for every table that is kept.
    """
    old = manifest(spark, path)
    buckets = old.first().buckets
    files = replaced.select(F.col("id").alias("file_id")).union(batch["symbols"].select("file_id"))
    touched = sorted(r.bucket for r in files.select(bucket_of(F.col("file_id"), buckets).alias("bucket")).distinct().collect())  # one number a bucket at most
    kept = merge.delete_files(read(spark, path, batch, only=touched), replaced, {n: c for n, c in CHILDREN.items() if n in batch})
    merged = {n: merge.append(df, batch[n].select(*df.columns)) for n, df in kept.items()}
    written = _write(spark, path, _bucketed(merged, buckets))
    return _commit(spark, path, old.where(~F.col("bucket").isin(touched)).select("table", "bucket", "folder", "rows").unionByName(written), buckets)


def changed_folders(spark: SparkSession, path: str, before: str, after: str) -> DataFrame:
    """table, bucket and state (reused, written, gone) between two versions."""
    a = manifest(spark, path, before).select("table", "bucket", F.col("folder").alias("old"))
    b = manifest(spark, path, after).select("table", "bucket", F.col("folder").alias("new"))
    state = F.when(F.col("old") == F.col("new"), "reused").when(F.col("new").isNull(), "gone").otherwise("written")
    return a.join(b, ["table", "bucket"], "full_outer").select("table", "bucket", state.alias("state"))


def drop_unnamed(spark: SparkSession, path: str) -> int:
    """Remove the folders that the current version does not name, for when no reader is left on older ones; how many."""
    named = {r.folder for r in manifest(spark, path).select("folder").collect()}  # a row a bucket and table
    fs, _ = _fs(spark, path)
    dropped = 0
    for table in {n.split("/")[1] for n in named}:
        for version in fs.listStatus(_fs(spark, f"{path}/data/{table}")[1]):
            for bucket in fs.listStatus(version.getPath()):
                name = f"data/{table}/{version.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in named:
                    fs.delete(bucket.getPath(), True)
                    dropped += 1
    return dropped
