"""Section C: joins beyond the plain lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_match(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], order: list[str], left_id: str, right_id: str) -> DataFrame:
    """Each left row's first right row: by the first key that matches, then by `order`."""
    hits = None
    for n, (a, b) in enumerate(keys):
        r = right.select(F.col(right_id).alias("__r"), F.col(b).alias("__k"), F.struct(*order).alias("__o"))
        h = left.select(F.col(left_id).alias("__l"), F.col(a).alias("__k")).join(r, "__k").select("__l", "__r", F.lit(n).alias("__n"), "__o")
        hits = h if hits is None else hits.union(h)
    return hits.groupBy("__l").agg(F.min_by("__r", F.struct("__n", "__o", "__r")).alias("__r")).select(F.col("__l").alias(left_id), F.col("__r").alias("match"))


def suffix_matches(targets: DataFrame, symbols: DataFrame, compatible: Column) -> DataFrame:
    """target and the one symbol of the same file whose qualified name is the target or ends in '::' and it; none if several.

    `targets` has (target, file_id, want); both sides meet on the target's last component, so the suffix is only tested within equal leaves.
    """
    leaf = F.element_at(F.split("target", "::"), -1)
    t = targets.withColumn("leaf", leaf)
    s = symbols.select(F.col("usr"), F.col("qualified_name"), F.col("kind"), F.col("file_id").alias("s_file"), F.element_at(F.split("qualified_name", "::"), -1).alias("s_leaf"))
    ends = (F.col("qualified_name") == F.col("target")) | F.endswith(F.col("qualified_name"), F.concat(F.lit("::"), "target"))
    hits = t.join(s, (F.col("leaf") == F.col("s_leaf")) & (F.col("file_id") == F.col("s_file")) & ends & compatible)
    return hits.groupBy("target", "file_id").agg(F.count("*").alias("n"), F.min("usr").alias("usr")).where("n = 1").select("target", "file_id", "usr")


def stale_inputs(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Inputs that depend on a changed path, and whether a changed path is of no input (then all must be parsed again)."""
    hits = changed.join(dependencies, changed.path == dependencies.dep, "left")
    return hits.select("input", F.col("input").isNull().alias("unattributed")).distinct()


def depends_only_on(dependencies: DataFrame, inputs: DataFrame) -> DataFrame:
    """Dependencies all of whose inputs are among the given ones."""
    given = inputs.select("input").distinct().withColumn("__in", F.lit(True))
    return dependencies.join(given, "input", "left").groupBy("dep").agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("only")).where("only").select("dep")


def uncovered(reference: DataFrame, own: DataFrame) -> DataFrame:
    """Reference files (path, name) that we have no file for and of which some name is unknown to us."""
    missing = reference.join(own.select("path").distinct(), "path", "left_anti")
    return missing.join(own.select("name").distinct(), "name", "left_anti").select("path").distinct()


def identity_drift(a: DataFrame, b: DataFrame, key: list[str], loose: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bag difference of identities between two tables, pairs that agree on `loose` columns taken off again: what is only in a, only in b."""
    only_a, only_b = a.select(*key).exceptAll(b.select(*key)), b.select(*key).exceptAll(a.select(*key))
    paired = only_a.select(*loose).intersectAll(only_b.select(*loose))
    return only_a.select(*loose).exceptAll(paired), only_b.select(*loose).exceptAll(paired)


def carried_forward(previous: DataFrame, fresh: DataFrame, reparsed: DataFrame) -> DataFrame:
    """Diagnostics of files not parsed again, that are not among the fresh ones, then the fresh; of equal (severity, text) the first stays."""
    old = previous.join(reparsed.select("file").distinct(), "file", "left_anti").join(fresh.select("severity", "text").distinct(), ["severity", "text"], "left_anti")
    every = old.select("severity", "text", "file", "pos", F.lit(0).alias("batch")).union(fresh.select("severity", "text", "file", "pos", F.lit(1).alias("batch")))
    return every.groupBy("severity", "text").agg(F.min_by(F.struct("file", "pos", "batch"), F.struct("batch", "pos")).alias("r")).select("severity", "text", "r.file", "r.pos", "r.batch")


def next_content_line(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Comment blocks (file, line) with the next line below that is not blank; `lines` has (file, line, blank)."""
    lines = lines.withColumn("next", F.min(F.when(~F.col("blank"), F.col("line"))).over(W.partitionBy("file").orderBy("line").rowsBetween(1, W.unboundedFollowing)))
    return blocks.join(lines.select("file", "line", "next"), ["file", "line"])


def with_file_ids(rows: DataFrame, files: DataFrame) -> DataFrame:
    """file_id of each row's path; NULL for a path that is no file."""
    return rows.join(files.select("path", F.col("id").alias("file_id")), "path", "left")


def unresolved_targets(texts: DataFrame, pattern: str, names: DataFrame) -> DataFrame:
    """Targets that a pattern finds in texts, and how often, of those that are no name."""
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("target")).groupBy("target").agg(F.count("*").alias("n"))
    return found.join(names.select(F.col("name").alias("target")).distinct(), "target", "left_anti")
