"""Exact top-k inner-product search by distributed histogram selection.

All scores of all queries are computed once, in blocks of queries against blocks of
candidates; a block keeps its first k of each query, since no other score of it is among
a query's first k. Over what is kept, each pass counts the scores in equal steps of the
interval that is known to hold a query's k-th score; the step where the count from above
reaches k is the next interval, until it is a single value. What is above that value
stays, and of the candidates that tie at it those with the smallest ids.

Cases: vectors that are null, empty, or hold a component that is null or not finite take no part; vectors meet only those of their length, and a query without any such other vector
has no rows; a query with fewer than k candidates gets all; a row is never a candidate of
a query with its own id; repeated rows of another id count each; of several vectors under
one query id the smallest in order is asked for; scores of any size rank by their exact value,
and those beyond 64 bits are given as the largest or smallest long; an empty table gives no rows;
extra columns are ignored.

A score of FAR or more in size is kept as FAR with a text beside it that sorts as the whole
number does; where a query's k-th score is one of these, histograms of ever longer beginnings
of that text go on, until few enough are left.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irloom.llm.common import cut, text_batches

K, SCALE = 5, 256
CANDIDATES, QUERIES, STEPS = 8192, 256, 1024
#: Candidates scored at a time, and salts by which a block of queries is dealt to its pairs.
AT_ONCE, SALTS = 1024, 16
#: Scores from here on are told apart by their text, from DIGITS of it on and twice as many a pass, while a query has over LEFT of them.
FAR, DIGITS, LEFT = 10**37, 3, 10_000


def clean(items: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return items.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """One row per block of about `size` rows and one vector length: block, dim, ids, matrix, as bytes."""
    many = max(1, -(-n // size))

    def run(key, batches):
        import pyarrow.compute as pc

        table = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        order = pc.sort_indices(table, [("id", "ascending")])
        table = table.take(order)
        ids = table.column("id").to_numpy().astype("<i8")
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ints = np.where(np.abs(flat) < 2.0**45, np.floor(flat * SCALE) / SCALE, flat).astype("<f8")  # whole numbers over SCALE, exact at any size
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "m": pa.array([ints.tobytes()], pa.binary())})

    placed = rows.select(F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias("block"), F.size("v").alias("dim"), "id", "v")
    return placed.groupBy("block", "dim").applyInArrow(run, "block int, dim int, ids binary, m binary")


def whole(x: float) -> int:
    return int(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE


def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these hold them, else in Python's integers."""
    with np.errstate(over="ignore"):
        small = a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) * SCALE * SCALE < 2**53
    if small:
        return ((a * SCALE) @ (b * SCALE).T).astype(np.int64)
    ints = np.frompyfunc(whole, 1, 1)
    return ints(a).dot(ints(b).T)


def sortable(n: int) -> str:
    """A text that sorts among others as the number does: sign, number of digits, digits, the latter as complements if negative."""
    digits = str(abs(n))
    if n >= 0:
        return f"1{len(digits):04d}{digits}"
    return "0" + "".join(str(9 - int(d)) for d in f"{len(digits):04d}{digits}")


def first_k(row: dict, k: int) -> list[list[tuple[int, int]]]:
    """Per query of the block (-score, id) of its first k candidates in it."""
    q, c = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
    a, b = (np.frombuffer(row[m], "<f8").reshape(-1, row["dim"]) for m in ("q_m", "c_m"))
    best: list[list[tuple[int, int]]] = [[] for _ in q]
    for at in range(0, len(c), AT_ONCE):
        ids, s = c[at : at + AT_ONCE], score(a, b[at : at + AT_ONCE])
        other = q[:, None] != ids[None, :]
        if s.dtype != object:
            s = np.where(other, s, np.iinfo(np.int64).min)
            low = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(q), np.iinfo(np.int64).min)
            other &= s >= low[:, None]
        for i, held in enumerate(best):
            keep = np.flatnonzero(other[i])
            best[i] = sorted([*held, *((-int(x), int(n)) for x, n in zip(s[i, keep], ids[keep], strict=True))])[:k]
    return best


def block_best(pairs: DataFrame, k: int) -> DataFrame:
    """id, vec_id, score and far of the first k candidates of each query in each block of candidates, ties to smaller ids."""

    def run(batches):
        for batch in batches:
            q, v, x, far = [], [], [], []
            for row in batch.to_pylist():
                for n, best in zip(np.frombuffer(row["q_ids"], "<i8").tolist(), first_k(row, k), strict=True):
                    q += [n] * len(best)
                    v += [a for _, a in best]
                    x += [Decimal(max(-FAR, min(FAR, -b))) for b, _ in best]
                    far += [sortable(-b) if abs(b) >= FAR else None for b, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(x, pa.decimal128(38, 0)), pa.array(far, pa.string())], names=["id", "vec_id", "score", "far"])

    return pairs.mapInArrow(run, "id long, vec_id long, score decimal(38,0), far string")


def far_lows(found: DataFrame, k: int) -> DataFrame:
    """id and beginning: of the k-th text, or enough of it that at most LEFT texts at or above it are left.

    `found` has id, far and room, the number of rows that the query still needs from these.
    """
    known = found.groupBy("id").agg(F.max("room").alias("room"), F.count("*").alias("n")).withColumn("beginning", F.when(F.col("n") >= 0, "")).where(F.col("n") > LEFT)
    done, length = None, 0
    while not (known := cut(known)).isEmpty():
        length = max(DIGITS, 2 * length)
        cuts = found.select("id", "far").join(known.select("id", "room", "beginning"), "id").where(F.startswith("far", F.col("beginning")))
        histogram = cuts.groupBy("id", "room", F.substring("far", 1, length).alias("bin")).agg(F.count("*").alias("m"), F.max(F.length("far")).alias("longest"))
        running = histogram.withColumn("run", F.sum("m").over(W.partitionBy("id").orderBy(F.desc("bin"))))
        reached = running.groupBy("id", "room").agg(F.min(F.when(F.col("run") >= F.col("room"), F.struct("run", "bin", "m", "longest"))).alias("at"))
        reached = cut(reached.where("at IS NOT NULL").select("id", F.col("room") - (F.col("at.run") - F.col("at.m")), F.col("at.m").alias("n"), F.col("at.bin").alias("beginning"), (F.col("at.longest") <= length).alias("whole")).toDF("id", "room", "n", "beginning", "whole"))
        over = (F.col("n") > LEFT) & ~F.col("whole")
        ended = reached.where(~over).select("id", "beginning")
        done = ended if done is None else done.unionByName(ended)
        known = reached.where(over).select("id", "room", "n", "beginning")
    return done


def kth_scores(found: DataFrame, k: int) -> DataFrame:
    """id and low: each query's k-th score, or its smallest if it has fewer, by refining histograms.

    Each pass counts, per query, the scores in equal steps of the interval that holds the
    k-th; the step in which the count from above reaches k is the next interval. A score
    above the interval counts in its topmost step, which none but they can fill up to k.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    low, high = found.agg(F.min("score"), F.max("score")).first()
    known = found.select("id").distinct().withColumn("low", whole(F.lit(low)))
    width = int(high) - int(low) + 1 if low is not None else 1
    while width > 1:
        step = -(-width // STEPS)
        top = -(-width // step)
        over = F.least(F.col("score") - F.col("low"), F.lit(Decimal(top * step)))
        binned = found.join(known, "id").where(F.col("score") >= F.col("low")).select("id", over.alias("over")).selectExpr("id", f"over DIV {step}BD AS bin")
        histogram = binned.groupBy("id", "bin").agg(F.count("*").alias("m"))
        running = histogram.withColumn("run", F.sum("m").over(W.partitionBy("id").orderBy(F.desc("bin"))))
        reached = running.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("run") >= k, F.col("bin"))), F.min("bin")).alias("bin"))
        known = cut(known.join(reached, "id").select("id", whole(F.col("low") + F.col("bin") * F.lit(Decimal(step))).alias("low")))
        width = step
    return known


def top_k(items: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best; `is_query` is a condition on `id_col`."""
    spark = items.sparkSession
    rows = cut(clean(items, id_col, vector_col))
    asked = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    asked = cut(asked.groupBy("id").agg(F.min("v").alias("v")))
    n = rows.count()
    candidates = cut(blocks(rows, CANDIDATES, n))
    queries = cut(blocks(asked, QUERIES, asked.count()))
    # Only numbers of blocks are paired; a block of queries joins its pairs by salts, so it may have all of them.
    numbers = F.sequence(F.lit(0), F.lit(max(1, -(-n // CANDIDATES)) - 1))
    pairs = queries.select("block", "dim", F.explode(numbers).alias("c_block")).withColumn("salt", F.pmod(F.col("c_block"), F.lit(SALTS)))
    matrices = queries.select("block", "dim", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = pairs.join(matrices, ["block", "dim", "salt"]).select("dim", "c_block", "q_ids", "q_m")
    pairs = pairs.join(candidates.select(F.col("block").alias("c_block"), "dim", F.col("ids").alias("c_ids"), F.col("m").alias("c_m")), ["c_block", "dim"])
    text_batches(spark)
    found = cut(block_best(pairs, k))
    # What is at or above a query's k-th score: fewer than k rows and those that tie at it.
    left = found.join(kth_scores(found, k), "id").where(F.col("score") >= F.col("low"))
    if not found.where("far IS NOT NULL").isEmpty():
        left = cut(left)
        above = left.where("score > low").groupBy("id").agg(F.count("*").alias("above"))
        tied = left.where("far IS NOT NULL AND score = low").join(above, "id", "left").select("id", "far", (F.lit(k) - F.coalesce("above", F.lit(0))).alias("room"))
        if (lows := far_lows(tied, k)) is not None:
            left = left.join(lows, "id", "left").where(F.col("beginning").isNull() | (F.col("score") > F.col("low")) | (F.col("far") >= F.col("beginning"))).drop("beginning")
    order = [F.desc("score"), F.desc("far"), F.asc("vec_id")]
    ranked = left.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(*order)).cast("int")).where(F.col("rank") <= k)
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", F.greatest(-most, F.least(most, "score")).cast("long").alias("score"))
