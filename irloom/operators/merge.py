"""Section E: upsert, replace and delete with the model's precedence rules, as aggregations over an ordered write log.

Order is an explicit column (`seq`); nothing depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irloom.operators.aggregate import numbered
from irloom.operators.tree import weighted


def upsert_symbols(writes: DataFrame, key: str = "usr", flags: tuple[str, ...] = ("is_definition", "is_documented"), seq: str = "seq") -> DataFrame:
    """One row per key: the last definition if there is one, else the last declaration; flags never go back.

    A definition is not overwritten by a declaration, so the winner is the largest by
    (is_definition, seq) and one partial aggregation suffices.
    """
    rest = [c for c in writes.columns if c not in (key, *flags, seq)]
    last = F.max_by(F.struct(*rest), F.struct(F.col("is_definition"), F.col(seq))).alias("__r")
    return writes.groupBy(key).agg(last, *(F.max(f).alias(f) for f in flags)).select(key, *(F.col(f"__r.{c}").alias(c) for c in rest), *flags)


def upsert_groups(writes: DataFrame, key: str = "id", fields: tuple[str, ...] = ("title", "brief", "detail", "parent"), seq: str = "seq") -> DataFrame:
    """One row per group, merged field by field in order of writing.

    A definition after a definition replaces every field; a definition replaces what it
    fills; anything fills a field not yet set; else the stored value stands. A title is
    unset if it is the id, a text if it is '', a parent if it is NULL.

    So the last definition's value counts if it is set; else the first set value of another
    write, which must come behind the last definition where there are several. Two partial
    aggregations tell that, and no group's writes meet in one task.
    """

    def is_set(f: str) -> Column:
        value = F.col(f).cast("string")
        return F.coalesce(value != F.col(key) if f == "title" else value.isNotNull() if f == "parent" else value != "", F.lit(False))

    defines = F.col("is_definition").cast("boolean")
    last = writes.groupBy(F.col(key).alias("__key")).agg(F.count(F.when(defines, 1)).alias("__defs"), F.max(F.when(defines, F.col(seq))).alias("__last"))
    rows = writes.join(last, F.col(key).eqNullSafe(F.col("__key")))
    is_last = F.coalesce(F.col(seq) == F.col("__last"), F.lit(False)) & defines
    counts = ~defines & ((F.col("__defs") < 2) | (F.col(seq) > F.col("__last")))

    def merged(f: str) -> Column:
        value = F.col(f).cast("string")
        own = F.max(F.when(is_last & is_set(f), value))
        other = F.min_by(value, F.when(counts & is_set(f), F.col(seq)))
        nothing = F.first(key).cast("string") if f == "title" else F.lit(None).cast("string") if f == "parent" else F.lit("")
        return F.coalesce(own, other, nothing).alias(f)

    return rows.groupBy(key).agg(*(merged(f) for f in fields), F.max(F.col("__defs") > 0).alias("is_definition"))


def last_by_key(writes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row written for each key; other keys of the same owner stay."""
    rest = [c for c in writes.columns if c not in (*keys, seq)]
    return writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """References have no key: a bag."""
    return old.unionByName(new)


def replace_sets(rows: DataFrame, touched: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """Rows of each key's last batch; `touched` (key, batch) also names batches that leave a key no rows."""
    last = touched.groupBy(key).agg(F.max(batch).alias("__last"))
    return rows.join(last, key).where(F.col(batch) == F.col("__last")).drop("__last")


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files by path: known paths keep their id and take the new digest; new ones get the ids after the largest, by path."""
    known = old.join(new.select("path", F.col("sha256").alias("n_sha")), "path", "left").select("id", "path", F.coalesce("n_sha", "sha256").alias("sha256"))
    fresh = new.join(old.select("path"), "path", "left_anti")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new_ids = numbered(fresh, [], ["path"], "id").join(F.broadcast(top))  # top is one row
    return known.union(new_ids.select((F.col("top") + F.col("id") + 1).alias("id"), "path", "sha256"))


def replaced_files(asked: DataFrame, anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of the files to replace: those asked for and those that new symbols are anchored in."""
    return files.join(asked.select("path").union(anchors.select("path")).distinct(), "path", "left_semi").select("id")


def delete_files(tables: dict[str, DataFrame], ids: DataFrame, children: dict[str, str]) -> dict[str, DataFrame]:
    """Tables without the symbols of files and, by `children` (table to its symbol column), what hangs on them.

    Symbols go by their file, a short key of few values, so that their rows are not sent by usr.
    """
    files = ids.select(F.col("id").alias("file_id"))
    gone = tables["symbols"].join(files, "file_id", "left_semi").select("usr")
    out = dict(tables)
    out["symbols"] = tables["symbols"].join(files, "file_id", "left_anti")
    for name, column in children.items():
        out[name] = tables[name].join(gone.select(F.col("usr").alias(column)), column, "left_anti")
    return out


def vanished(candidates: DataFrame, reached: DataFrame) -> DataFrame:
    return candidates.join(reached.select("path").distinct(), "path", "left_anti")


def dedup_in_unit(rows: DataFrame, function_kinds: list[int], key: str = "usr", pos: str = "pos") -> DataFrame:
    """The first row of a key; a later definition turns on the flag and, for functions, gives its signature."""
    rest = [c for c in rows.columns if c not in (key, pos, "is_definition", "signature")]
    defined = F.min_by(F.when(F.col("is_definition") == 1, F.col("signature")), F.when(F.col("is_definition") == 1, F.col(pos)))
    first = F.min_by(F.struct(*rest, "signature", F.col("is_definition").alias("__d")), pos)
    g = rows.groupBy(key).agg(first.alias("__r"), F.max("is_definition").alias("is_definition"), defined.alias("__s"))
    later = (F.col("__r.__d") == 0) & (F.col("is_definition") == 1) & F.col("__r.kind").isin(function_kinds)
    return g.select(key, *(F.col(f"__r.{c}").alias(c) for c in rest), "is_definition", F.when(later, F.col("__s")).otherwise(F.col("__r.signature")).alias("signature"))


def first_by_key(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, pos)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), pos).alias("__r")).select(key, *(F.col(f"__r.{c}").alias(c) for c in rest))


def diagnostic_units(rows: DataFrame, partition: str) -> DataFrame:
    """Adds `unit`: the number of the depth-0 record that a note follows, counted within each partition column."""
    heads = rows.withColumn("__head", F.when(F.col("depth") == 0, 1).otherwise(0))
    return weighted(heads, [partition], ["pos"], "__head", "unit").withColumn("unit", F.col("unit") + F.col("__head")).drop("__head")


def merge_diagnostics(rows: DataFrame, partition: str) -> DataFrame:
    """Of units with equal head (severity, text) only the first stays, with its notes."""
    units = diagnostic_units(rows, partition)
    heads = units.where("depth = 0").groupBy("severity", "text").agg(F.min_by(F.struct(partition, "unit"), "pos").alias("u")).select(F.col(f"u.{partition}").alias(partition), F.col("u.unit").alias("unit"))
    return units.join(heads, [partition, "unit"], "left_semi")


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key names no parent: must be none."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def stub_groups(groups: DataFrame, referenced: DataFrame) -> DataFrame:
    """Groups with a stub (title is the id) for each referenced id that there is none of."""
    stubs = referenced.select("id").distinct().join(groups.select("id"), "id", "left_anti")
    return groups.select("id", "title").union(stubs.select("id", F.col("id")))


def memberships(rows: DataFrame, key: str, ids: str, pos: str) -> DataFrame:
    """group_id, member and ordinal from a column of ids with spaces between, numbered per group as discovered."""
    each = rows.select(key, pos, F.posexplode(F.filter(F.split(ids, " +"), lambda x: x != "")).alias("i", "group_id"))
    return numbered(each, ["group_id"], list(dict.fromkeys([pos, "i", key])), "ordinal").select("group_id", F.col(key).alias("member"), "ordinal")
