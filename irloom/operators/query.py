"""The query API: filters, ordered lookups and joins over the tables of the model.

`Store` answers one key at a time; the functions below answer all keys at once, which is
how the engine's own queries use them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEP = "\x1f"


def empty(c: Column | str) -> Column:
    """NULL and '' mean the same: none."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def joined(values: Column, sep: str = SEP) -> Column:
    return F.array_join(values, sep)


def ordered(order: list[str], value: str | Column) -> Column:
    """The group's values in the given order, as an array; null values are left out."""
    v = F.col(value) if isinstance(value, str) else value
    return F.transform(F.filter(F.sort_array(F.collect_list(F.struct(*order, v.alias("__v")))), lambda x: x["__v"].isNotNull()), lambda x: x["__v"])


def to_symbol(symbols: DataFrame) -> DataFrame:
    """Readers' form of a symbol: no NULL texts, flags as booleans."""
    texts = [c for c, t in symbols.dtypes if t == "string"]
    flags = [c for c in ("is_definition", "is_documented") if c in symbols.columns]
    return symbols.select(*(F.coalesce(c, F.lit("")).alias(c) if c in texts else F.col(c).cast("boolean").alias(c) if c in flags else F.col(c) for c in symbols.columns))


def roots(symbols: DataFrame) -> DataFrame:
    return symbols.where(empty("parent_usr"))


def file_roots(symbols: DataFrame) -> DataFrame:
    """Symbols of a file whose parent is not in that file; a NULL file keeps its row."""
    parents = symbols.select(F.col("usr").alias("p_usr"), F.col("file_id").alias("p_file"))
    return symbols.join(parents, (F.col("parent_usr") == F.col("p_usr")) & (F.col("file_id") == F.col("p_file")), "left_anti")


def children_of(symbols: DataFrame) -> DataFrame:
    """parent_usr and the usrs of its children by (kind, line, qualified name, usr)."""
    return symbols.where(~empty("parent_usr")).groupBy("parent_usr").agg(ordered(["kind", "line", "qualified_name", "usr"], "usr").alias("children"))


def references_of(references: DataFrame, kinds: list[int] | None = None) -> DataFrame:
    """from_usr and its targets by (kind, ordinal, target, spelling): resolved or as written."""
    rows = references if kinds is None else references.where(F.col("ref_kind").isin(kinds))
    return rows.groupBy("from_usr").agg(ordered(["ref_kind", "ordinal", "to_usr", "to_spelling"], "to_spelling").alias("targets"))


def by_position(rows: DataFrame, owner: str, position: str, value: str, tie: str | None = None) -> DataFrame:
    """Parameters, template parameters or enumerators of each owner in order."""
    return rows.groupBy(owner).agg(ordered([position, tie or value], value).alias("values"))


def group_member_usrs(members: DataFrame) -> DataFrame:
    return members.where(~empty("member_usr"))


def group_symbols(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """Memberships with their symbol; members that name none are dropped."""
    return members.join(symbols, members.member_usr == symbols.usr)


def related_by_name(fields: DataFrame, symbols: DataFrame, field: str = "relates") -> DataFrame:
    """related (a name, trimmed, not empty), position and usr of the symbols whose comment has a `field` with it, a row each."""
    named = fields.where(F.col("name") == field).select("symbol_usr", F.trim("value").alias("related"), "ordinal").where(F.col("related") != "")
    from irloom.operators.aggregate import numbered

    rows = named.join(symbols.select("usr", "qualified_name"), named.symbol_usr == F.col("usr"))
    return numbered(rows, ["related"], ["qualified_name", "usr", "ordinal"]).select("related", "position", "usr")


def related_symbols(symbols: DataFrame, named: DataFrame, visible: Column) -> DataFrame:
    """usr and related usr: by qualified name first, then by spelling; once each, not itself, only visible ones.

    `named` has (related, rank, usr); rank orders the symbols of a name.
    """
    shown = named.join(symbols.where(visible).select("usr"), "usr").select(F.col("usr").alias("other"), "related", "rank")
    one = symbols.select("usr", F.col("qualified_name").alias("related"), F.lit(0).alias("key"))
    two = symbols.select("usr", F.col("spelling").alias("related"), F.lit(1).alias("key"))
    hits = one.unionByName(two).join(shown, "related").where(F.col("usr") != F.col("other"))
    first = F.row_number().over(W.partitionBy("usr", "other").orderBy("key", "rank"))
    return hits.withColumn("n", first).where("n = 1").select("usr", "other", "key", "rank")


def resolved_names(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with `target`: the target's qualified name if it resolves, else as written."""
    names = symbols.select(F.col("usr").alias("t_usr"), "qualified_name")
    return references.join(names, references.to_usr == F.col("t_usr"), "left").withColumn("target", F.coalesce("qualified_name", "to_spelling")).drop("t_usr", "qualified_name")


class Store:
    """One key at a time, over DataFrames of the model's tables."""

    def __init__(self, **tables: DataFrame):
        self.t = tables

    def meta(self, key: str) -> str | None:
        row = self.t["meta"].where(F.col("key") == key).first()
        return row.value if row else None

    def symbols(self, kind: int | None = None) -> DataFrame:
        s = to_symbol(self.t["symbols"])
        return (s if kind is None else s.where(F.col("kind") == kind)).orderBy("qualified_name", "usr")

    def symbol(self, usr: str) -> DataFrame:
        return to_symbol(self.t["symbols"].where(F.col("usr") == usr))

    def roots(self) -> DataFrame:
        return to_symbol(roots(self.t["symbols"])).orderBy("kind", "qualified_name", "usr")

    def children(self, parent: str) -> DataFrame:
        return to_symbol(self.t["symbols"].where(F.col("parent_usr") == parent)).orderBy("kind", "line", "qualified_name", "usr")

    def file_roots(self, file_id: int) -> DataFrame:
        return to_symbol(file_roots(self.t["symbols"]).where(F.col("file_id") == file_id)).orderBy("kind", "qualified_name", "usr")

    def references(self, usr: str, kind: int | None = None) -> DataFrame:
        r = self.t["references"].where(F.col("from_usr") == usr)
        return (r if kind is None else r.where(F.col("ref_kind") == kind)).orderBy("ref_kind", "ordinal", "to_usr", "to_spelling")

    def bases(self, usr: str) -> DataFrame:
        return self.references(usr, 0)

    def friends(self, usr: str) -> DataFrame:
        return self.references(usr, 7)

    def parameters(self, usr: str) -> DataFrame:
        return self.t["function_parameters"].where(F.col("function_usr") == usr).orderBy("idx")

    def template_parameters(self, usr: str) -> DataFrame:
        return self.t["template_parameters"].where(F.col("owner_usr") == usr).orderBy("idx")

    def enumerators(self, usr: str) -> DataFrame:
        return self.t["enumerators"].where(F.col("enum_usr") == usr).orderBy("idx")

    def groups(self) -> DataFrame:
        return self.t["groups"].orderBy("title", "id")

    def group(self, group_id: str) -> DataFrame:
        return self.t["groups"].where(F.col("id") == group_id)

    def root_groups(self) -> DataFrame:
        return self.t["groups"].where(empty("parent_group_id")).orderBy("title", "id")

    def subgroups(self, group_id: str) -> DataFrame:
        return self.t["groups"].where(F.col("parent_group_id") == group_id).orderBy("title", "id")

    def group_members(self, group_id: str) -> DataFrame:
        return group_member_usrs(self.t["group_members"]).where(F.col("group_id") == group_id).orderBy("ordinal")

    def group_symbols(self, group_id: str) -> DataFrame:
        return group_symbols(self.t["group_members"].where(F.col("group_id") == group_id), self.t["symbols"]).orderBy("ordinal")

    def files(self) -> DataFrame:
        return self.t["files"].orderBy("path")

    def raw_comment(self, usr: str) -> DataFrame:
        return self.t["comments"].where(F.col("symbol_usr") == usr)
