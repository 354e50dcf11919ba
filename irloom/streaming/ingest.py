"""Streamed ingest of a write log: batches of files, folded into state in the order of an explicit sequence number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irloom.operators import merge


def follow(spark: SparkSession, log_dir: str, schema: T.StructType, checkpoint: str, step: Callable[[DataFrame, int], None], files_per_batch: int = 8) -> None:
    """Hand all files of a log to `step`, a bounded number at a time; a restart goes on behind the last finished batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_dir)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fold_symbols(spark: SparkSession, log_dir: str, schema: T.StructType, state_dir: str, files_per_batch: int = 8) -> DataFrame:
    """The upserted symbols of a log. A batch writes its own fold once, by number, so a repeated batch changes nothing;
    the last write wins by (is_definition, seq), so folds merge in any order."""

    def step(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in ("usr", "is_definition", "is_documented", "seq")]
        last = merge.upsert_symbols(batch.withColumn("at", batch["seq"]), "usr")
        last.select("usr", *rest, "is_definition", "is_documented", last["at"].alias("seq")).write.mode("overwrite").parquet(f"{state_dir}/folds/batch={number}")

    follow(spark, log_dir, schema, f"{state_dir}/checkpoint", step, files_per_batch)
    return merge.upsert_symbols(spark.read.parquet(f"{state_dir}/folds").drop("batch"), "usr")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keep_symbols(spark: SparkSession, log_dir: str, schema: T.StructType, checkpoint: str, files_per_batch: int = 8) -> DataFrame:
    """The upserted symbols of a log, kept as keyed state of the stream itself.

    A row of state a symbol: its winning write by (is_definition, seq) and whether it was ever
    documented. RocksDB holds it on the executors' disks, its changes go to the checkpoint with each batch of
    so many files, and a restart goes on behind the last finished batch with the state as it was then. A
    late write loses to a later one and a repeated one changes nothing, so no watermark is needed. The state is
    read from the checkpoint; no batch's output is kept.
    """
    rest = [n for n in schema.names if n not in ("usr", "is_documented")]
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_dir)
        kept = stream.groupBy("usr").agg(F.max_by(F.struct(*rest), F.struct("is_definition", "seq")).alias("last"), F.max("is_documented").alias("is_documented"))
        kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    state = spark.read.format("statestore").load(checkpoint)
    last, documented = (state.schema["value"].dataType.names[n] for n in (0, -1))
    return state.select("key.usr", F.col("value")[last].alias("last"), F.col("value")[documented].alias("is_documented")).select("usr", *(F.col("last")[n].alias(n) for n in rest), "is_documented")
