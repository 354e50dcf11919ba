"""Comment structs: field rows to structs and back (section F7, F8), and the grammar that makes them (section J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.operators.query import ordered

# The fields of a comment in their order, and which hold a list of texts.
SCALARS = ["brief", "returns"]
LISTS = ["detail", "see", "since", "deprecated", "note", "warning", "pre", "post", "invariant", "todo", "bug", "author", "version", "date"]
PAIRS = ["param", "tparam", "retval", "throws"]
ORDER = ["brief", "detail", "param", "tparam", "returns", "retval", "throws", *LISTS[1:]]


def structs_from_fields(fields: DataFrame) -> DataFrame:
    """symbol_usr and a struct: of a scalar the last row counts, lists are in order, other names go to a map."""
    known = [*SCALARS, *LISTS, *PAIRS]
    of = lambda n: F.when(F.col("name") == n, F.col("value"))
    cols = [F.max_by("value", F.when(F.col("name") == n, F.col("ordinal"))).alias(n) for n in SCALARS]
    cols += [ordered(["ordinal"], of(n)).alias(n) for n in LISTS]
    pair = lambda n: F.when(F.col("name") == n, F.struct("arg", "value"))
    cols += [ordered(["ordinal"], pair(n)).alias(n) for n in PAIRS]
    rest = F.filter(F.sort_array(F.collect_list(F.struct("ordinal", "name", "value"))), lambda x: ~x["name"].isin(known))
    names = F.array_distinct(F.transform(rest, lambda x: x["name"]))
    grouped = fields.groupBy("symbol_usr").agg(*cols, rest.alias("__rest"), names.alias("__names"))
    custom = F.map_from_entries(F.transform("__names", lambda n: F.struct(n, F.transform(F.filter("__rest", lambda x: x["name"] == n), lambda x: x["value"]))))
    return grouped.select("symbol_usr", F.struct(*known, custom.alias("custom")).alias("comment"))


def fields_from_structs(structs: DataFrame) -> DataFrame:
    """Rows (symbol_usr, name, arg, value, ordinal) in the fixed order of fields, custom ones last by name."""
    row = lambda name, arg, value: F.struct(name.alias("name"), arg.alias("arg"), value.alias("value"))
    c, none = F.col("comment"), F.lit("")
    of_scalar = lambda n: F.filter(F.array(row(F.lit(n), none, F.coalesce(c[n], none))), lambda x: x["value"] != "")
    of_list = lambda n: F.transform(c[n], lambda x: row(F.lit(n), none, x))
    of_pair = lambda n: F.transform(c[n], lambda x: row(F.lit(n), F.coalesce(x["arg"], none), x["value"]))
    parts = [(of_scalar if n in SCALARS else of_pair if n in PAIRS else of_list)(n) for n in ORDER]
    parts.append(F.flatten(F.transform(F.array_sort(F.map_keys(c["custom"])), lambda k: F.transform(c["custom"][k], lambda x: row(k, none, x)))))
    return structs.select("symbol_usr", F.posexplode(F.concat(*parts)).alias("ordinal", "r")).select("symbol_usr", "r.name", "r.arg", "r.value", "ordinal")
