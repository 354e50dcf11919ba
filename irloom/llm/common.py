"""Pieces shared by the training-data operators: reading, sessions, shared folders, sampling, block gathers."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes handed to Python at a time; bounds what a worker holds when texts are long.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: the default of 10,000 rows is over a GB when texts are long.

    The bound is the same for all, and says nothing of rows, so what else runs in the session keeps its batches.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one all executors share (spark.checkpoint.dir); on one machine, as in tests, a local one may do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "irloom-checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/irloom-{uuid.uuid4().hex}"


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Write to the shared folder and read again: cuts lineage, and survives a lost executor. Also the files' path; they go when the application ends, if not before by discard()."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """cut_at without the path."""
    return cut_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove what cut_at() wrote, once nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """About `limit` rows at most, picked by a hash of the key; all rows if there are fewer.

    The pick depends on the key alone, so a rerun takes the same rows. The count that
    sets the share reads the key column only.
    """
    n = df.count()
    if n <= limit:
        return df
    buckets = 1 << 20
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(buckets)) < int(buckets * limit / n))


_held: dict[Hashable, Any] = {}


def worker_memo(owner: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker remembers between tasks, of one owner at a time.

    Workers serve all stages of a session, so what an earlier stage remembered goes, and
    its memory is handed back, before another begins.
    """
    if owner not in _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library keeps or returns freed memory by itself
        _held[owner] = make()
    return _held[owner]


def digest(*parts: bytes) -> str:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(8, "little") + p)
    return h.hexdigest()


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The concatenation of flat[starts[i] : starts[i] + lengths[i]] for i in which."""
    n = lengths[which]
    total = int(n.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(starts[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return flat[shift + np.arange(total)]


def text_blocks(batches, columns: list[str], max_bytes: int) -> Iterator[list[list]]:
    """Join Arrow batches to blocks of about max_bytes of text; the last of `columns` is the text."""
    held, size = [[] for _ in columns], 0
    for batch in batches:
        for to, c in zip(held, columns, strict=True):
            to.extend(batch.column(batch.schema.get_field_index(c)).to_pylist())
        size += sum(len(t) for t in held[-1][-batch.num_rows :] if t) if batch.num_rows else 0
        if size >= max_bytes:
            yield held
            held, size = [[] for _ in columns], 0
    if held[0]:
        yield held
