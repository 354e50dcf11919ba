"""Files that a run writes and the next one finds: page sets with an intent log, scans that read only what differs, ordered logs.

A page set is applied in steps that can be done again: what changes is staged, an intent is written,
the files are put and removed, the manifest is switched, the intent goes. A run that
stops before the intent has changed nothing; one that stops behind it is finished by the next.
Files are written and read by tasks through pyarrow's file systems (a local or mounted path,
hdfs, s3, gs), each put by a move where the file system has one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.operators.incremental import RACY_NS, output_changes
from irloom.operators.state import cut
from irloom.sources.snapshot import _fs, exists, write_small

RECORD = "name string, digest string"
CHUNK = 1 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """name and digest of the pages that the manifest has."""
    if not exists(spark, f"{path}/.state/CURRENT"):
        return spark.createDataFrame(pa.table({n: pa.array([], pa.string()) for n in ("name", "digest")}), RECORD)  # of an empty list, tasks would start Python
    version = spark.read.text(f"{path}/.state/CURRENT").first().value
    return spark.read.schema(RECORD).parquet(f"{path}/.state/{version}/manifest")


def _putter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts the files of batches (name, text) and removes those whose text is null; texts go out as the bytes they are, none is unpacked."""

    def put(batches):
        fs, base = file_system(path)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                target = f"{base}/{name.as_py()}"
                if not text.is_valid:
                    if fs.get_file_info(target).type == pafs.FileType.File:
                        fs.delete_file(target)
                else:
                    beside = f"{base}/.{name.as_py()}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(beside, compression=None) as out:
                        out.write(text.as_buffer())
                    fs.move(beside, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return put


def _apply(spark: SparkSession, path: str, run: str) -> int:
    """Puts and removes the files of a staged run; doing it again gives the same."""
    staged = spark.read.schema("name string, text string").parquet(f"{path}/.state/{run}/changes")
    return staged.select("name", "text").mapInArrow(_putter(path), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _finish(spark: SparkSession, path: str, run: str, after: Callable[[str], None]) -> int:
    n = _apply(spark, path, run)
    after("applied")
    write_small(spark, f"{path}/.state/CURRENT", run.encode())
    after("switched")
    fs, intent = _fs(spark, f"{path}/.state/INTENT")
    fs.delete(intent, False)
    return n


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a run that stopped behind its intent; whether there was one."""
    if not exists(spark, f"{path}/.state/INTENT"):
        return False
    _finish(spark, path, spark.read.text(f"{path}/.state/INTENT").first().value, lambda step: None)
    return True


def put_pages(spark: SparkSession, path: str, pages: DataFrame, after: Callable[[str], None] = lambda step: None) -> int:
    """Make the files below `path` the given pages (name, text): new and changed ones are written, others that the manifest has removed.

    Returns how many files were touched. `after` is told each step (staged, intended, applied, switched) when it is done.
    """
    recover(spark, path)
    run = uuid.uuid4().hex
    rows = cut(pages.select("name", "text").withColumn("digest", F.sha2("text", 256)))
    actions = output_changes(rows.select("name", "digest"), recorded(spark, path)).where("action <> 'unchanged'")
    actions.select("name").join(rows.select("name", "text"), "name", "left").write.parquet(f"{path}/.state/{run}/changes")
    rows.select("name", "digest").write.parquet(f"{path}/.state/{run}/manifest")
    after("staged")
    write_small(spark, f"{path}/.state/INTENT", run.encode())
    after("intended")
    return _finish(spark, path, run, after)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, mtime_ns and size of the files below a folder; the contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def digests(files: DataFrame) -> DataFrame:
    """path and sha256 of the files that `path` names, each read in chunks by the task that has its row."""

    def run(batches):
        fs, name = None, None
        for batch in batches:
            paths, found = batch.column(0).to_pylist(), []
            for p in paths:
                fs, name = file_system(p)
                h = hashlib.sha256()
                try:
                    with fs.open_input_stream(name, compression=None) as source:
                        while data := source.read(CHUNK):
                            h.update(data)
                    found.append(h.hexdigest())
                except FileNotFoundError:
                    found.append(None)  # gone since it was listed
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], names=["path", "sha256"])

    return files.select("path").mapInArrow(run, "path string, sha256 string")


def scan(stored: DataFrame, listed: DataFrame, started_ns: int | None = None) -> DataFrame:
    """path, status (same, healed, changed, gone, new), sha256, mtime_ns, size and was_read of all inputs, known and listed.

    `stored` has path, mtime_ns, size and sha256. First the listing alone is compared; only files whose time or size
    differs are read. A file younger than the clock can tell gets no time, so the next scan reads it again.
    """
    j = stored.select("path", F.col("mtime_ns").alias("s_mtime"), F.col("size").alias("s_size"), F.col("sha256").alias("s_sha")).join(listed.select("path", "mtime_ns", "size", F.lit(True).alias("there")), "path", "full_outer")
    same = F.col("s_mtime").isNotNull() & (F.col("s_mtime") == F.col("mtime_ns")) & (F.col("s_size") == F.col("size"))
    j = cut(j.withColumn("same", F.coalesce(same, F.lit(False))))
    read = digests(j.where("there AND NOT same").repartition(F.col("path"))).withColumn("was_read", F.lit(True))
    j = j.join(cut(read), "path", "left")
    status = F.when(F.col("there").isNull() | (F.col("was_read") & F.col("sha256").isNull()), "gone").when(F.col("same"), "same").when(F.col("s_sha").isNull(), "new").when(F.col("s_sha") == F.col("sha256"), "healed").otherwise("changed")
    mtime = F.col("mtime_ns") if started_ns is None else F.when(F.col("mtime_ns") < started_ns - RACY_NS, F.col("mtime_ns"))
    return j.select("path", status.alias("status"), F.coalesce("sha256", F.when(F.col("same"), F.col("s_sha"))).alias("sha256"), mtime.alias("mtime_ns"), "size", F.coalesce("was_read", F.lit(False)).alias("was_read"))


# Names of severities from 0.
SEVERITY = ["ignored", "note", "warning", "error", "fatal"]


def log_header(records: DataFrame, inputs: int, generated: str, partial: int | None = None) -> list[str]:
    counts = {r.severity: r["count"] for r in records.groupBy("severity").count().collect()}  # a row a severity
    totals = ", ".join(f"{counts[n]} {name}(s)" for n, name in enumerate(SEVERITY) if counts.get(n))
    scope = "full" if partial is None else f"incremental, {partial} of {inputs} translation unit(s) re-parsed"
    return ["# diagnostics", f"# generated: {generated}", f"# inputs: {inputs} file(s)", f"# parse: {scope}", f"# totals: {totals or 'none'}", ""]


def write_log(spark: SparkSession, path: str, records: DataFrame, inputs: int, generated: str, partial: int | None = None) -> None:
    """Replace the log at `path` by records (pos, severity, depth, text), in order of pos.

    A log is a folder of text files whose names sort: the header, then parts of one total order, each written by the task
    that has that range. It is staged whole and then moved into the old one's place: a run that stops leaves a whole log or, between the two moves, the old one beside.
    """
    staged = f"{path}.{uuid.uuid4().hex}"
    lines = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.split(F.regexp_replace("text", "\n$", ""), "\r\n|\r|\n"))
    indented = F.array_join(F.transform(lines, lambda x: F.concat(F.repeat(F.lit("  "), F.col("depth")), x)), "\n")
    first = records.agg(F.min("pos")).first()[0]
    gap = F.when((F.col("depth") == 0) & (F.col("pos") != F.lit(first)), F.lit("\n")).otherwise(F.lit(""))
    ordered = records.repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.select(F.concat(gap, indented).alias("value")).write.text(f"{staged}/body")
    write_small(spark, f"{staged}/body/header.txt", ("\n".join(log_header(records, inputs, generated, partial)) + "\n").encode())
    fs, body = _fs(spark, f"{staged}/body")
    target = _fs(spark, path)[1]
    old = _fs(spark, f"{path}.{uuid.uuid4().hex}")[1]
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(body, target):
        raise OSError(f"cannot move the log to {path}")
    fs.delete(_fs(spark, staged)[1], True)
    fs.delete(old, True)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """part, block, at and line: the log's lines, which these three sort."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return rows.withColumn("part", F.when(F.col("part") == "header.txt", F.lit("")).otherwise(F.col("part")))
