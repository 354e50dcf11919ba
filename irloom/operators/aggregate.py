"""Sections F, G and H: aggregation, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irloom.operators.query import ordered
from irloom.operators.state import cut


def numbered(rows: DataFrame, by: list[str], order: list[str], to: str = "position") -> DataFrame:
    """Adds as `to` the place from 0, in `order`, among the rows that agree in `by`; order must tell rows apart.

    Rows are dealt out by range and numbered where they lie; a table with a row for each
    part of each key then shifts them. So a key that holds most rows is spread like any other.
    """
    keys = [*by, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    dealt = cut(dealt)
    parts = dealt.groupBy(*by, "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return dealt.join(parts, same).select(*rows.columns, (F.col("__id") - F.col("__first") + F.col("__before")).alias(to))


def summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, min, median, mean and sample deviation, which is 0 for one value."""
    return rows.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"))


def ratios(rows: DataFrame, group: str, stage: str, value: str, stages: list[str]) -> DataFrame:
    """Each later stage's mean as a factor of the first's; NULL where it is missing or zero."""
    wide = rows.groupBy(group).pivot(stage, stages).agg(F.avg(value))
    return wide.select(group, *(F.try_divide(F.col(f"`{stages[0]}`"), F.col(f"`{s}`")).alias(f"{s}_ratio") for s in stages[1:]))


def canonical(symbols: DataFrame, identity: list[str]) -> DataFrame:
    """Per identity the usr that stands for it: documented first, then by file (none or 0 first), line, usr."""
    file = F.when(F.coalesce("file_id", F.lit(0)) == 0, F.lit(-1)).otherwise(F.col("file_id"))
    return symbols.groupBy(*identity).agg(F.min_by("usr", F.struct(1 - F.col("is_documented").cast("int"), file, "line", "usr")).alias("usr"))


def buckets_by_scope(symbols: DataFrame, types: list[int], constants: list[int]) -> DataFrame:
    """scope, bucket (types, constants, other), position and usr of its members by (spelling, line, usr)."""
    bucket = F.when(F.col("kind").isin(types), "types").when(F.col("kind").isin(constants), "constants").otherwise("other")
    rows = symbols.select(F.coalesce("parent_usr", F.lit("")).alias("scope"), bucket.alias("bucket"), "spelling", "line", "usr")
    return numbered(rows, ["scope", "bucket"], ["spelling", "line", "usr"]).select("scope", "bucket", "position", "usr")


def overloads(symbols: DataFrame) -> DataFrame:
    """scope, name, position and usr: functions of a scope by spelling, all operators together, a row each."""
    name = F.when(F.startswith("spelling", F.lit("operator")), F.lit("operator*")).otherwise(F.col("spelling"))
    rows = symbols.select(F.coalesce("parent_usr", F.lit("")).alias("scope"), name.alias("name"), "line", "usr")
    return numbered(rows, ["scope", "name"], ["line", "usr"]).select("scope", "name", "position", "usr")


def contested(names: DataFrame, stem: Column) -> DataFrame:
    """Stems, without regard to case, that more than one name claims."""
    return names.groupBy(F.lower(stem).alias("stem")).agg(F.count_distinct("name").alias("names")).where("names > 1")


def chunks(rows: DataFrame, key: str, pos: str, size: int) -> DataFrame:
    """Batches of at most `size` consecutive rows of a key; a batch is named by its key and number."""
    return numbered(rows, [key], [pos], "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def most_common(rows: DataFrame, value: str, limit: int = 20) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(limit)


def positions(rows: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """Places among the rows of an owner; owners have few rows each."""
    return rows.withColumn("ordinal", (F.row_number().over(W.partitionBy(owner).orderBy(*order)) - 1).cast("long"))


def first_declarations(rows: DataFrame, page: str, name: str, order: list[str], exempt: Column) -> DataFrame:
    """Adds `degraded`: another declaration of the name comes before on the page, and neither is exempt."""
    first = rows.where(~exempt).groupBy(F.col(page).alias("__page"), F.col(name).alias("__name")).agg(F.min(F.struct(*order)).alias("__first"))
    joined = rows.join(first, F.col(page).eqNullSafe(F.col("__page")) & F.col(name).eqNullSafe(F.col("__name")), "left")
    return joined.withColumn("degraded", ~exempt & (F.struct(*order) != F.col("__first"))).drop("__page", "__name", "__first")


def unique_stems(names: DataFrame, stem: Column, name: str = "name") -> DataFrame:
    """name and a stem of its own, without regard to case.

    Contested stems are tagged with a digest; where equal ones remain, all but the first by
    name get underscores, more and more until no other name has the stem.
    """
    tagged = names.select(name, stem.alias("s"))
    claims = tagged.groupBy(F.lower("s").alias("key")).agg(F.count("*").alias("claims"))
    tagged = tagged.join(claims, F.lower("s") == F.col("key"))
    open_ = tagged.select(name, F.when(F.col("claims") > 1, F.concat("s", F.lit("_"), F.left(F.sha2(F.col(name), 256), F.lit(8)))).otherwise(F.col("s")).alias("s"))
    done = None
    while True:
        first = open_.groupBy(F.lower("s").alias("key")).agg(F.min(name).alias("first"))
        at = open_.join(first, F.lower("s") == F.col("key"))
        won = at.where(F.col(name) == F.col("first")).select(name, F.col("s").alias("stem"))
        if done is None:
            done = cut(won)
        else:  # a stem that an earlier round gave away is taken
            taken = done.select(F.lower("stem").alias("key")).distinct()
            done = cut(done.union(won.join(taken, F.lower("stem") == F.col("key"), "left_anti")))
        left = open_.join(done.select(name), name, "left_anti").select(name, F.concat("s", F.lit("_")).alias("s"))
        open_ = cut(left)
        if open_.isEmpty():
            return done


def islands(rows: DataFrame, partition: str, line: str, family: Column, text: Column) -> DataFrame:
    """Runs of consecutive lines of one family: first and last line, and the texts in order."""
    w = W.partitionBy(partition).orderBy(line)
    rows = rows.withColumn("__f", family)
    starts = F.coalesce((F.col(line) - F.lag(line).over(w) != 1) | (F.col("__f") != F.lag("__f").over(w)), F.lit(True))
    runs = rows.withColumn("__new", starts.cast("int")).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(partition, "run").agg(F.first("__f").alias("family"), F.min(line).alias("first_line"), F.max(line).alias("last_line"), ordered([line], text).alias("texts"))


def bag_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def union_first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    every = None
    for n, p in enumerate(parts):
        p = p.withColumn("__n", F.lit(n))
        every = p if every is None else every.unionByName(p)
    return every.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("__n"))).where("__r = 1").drop("__r", "__n")
