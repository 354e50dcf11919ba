"""I22, I25, I26: declarations as text, qualified by their scopes with the template heads that these need."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irloom.functions import rewrite, scalar as s
from irloom.operators import graph
from irloom.operators.state import cut
from irloom.sources.schema import CONTAINER_KINDS, FUNCTION_KINDS, KIND, RECORD_KINDS


def _or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _head(signature: str | Column) -> Column:
    """A template head and a blank, or nothing."""
    repaired = rewrite.text_udf(rewrite.repair_split_operators)(_or_empty(signature))
    return F.when(repaired != "", F.concat(repaired, F.lit(" "))).otherwise(F.lit(""))


def qualified_members(symbols: DataFrame) -> DataFrame:
    """The symbols with heads (of all templated scopes around each, outermost first) and qualified (its name behind theirs, with their arguments).

    Only symbols that are parents are walked up from; the others take over what is around their parent, and it.
    """
    parent = F.coalesce("parent_usr", F.lit(""))
    inner = symbols.join(symbols.select(parent.alias("usr")).where("usr <> ''").distinct(), "usr", "left_semi")
    record = F.col("kind").isin(RECORD_KINDS)
    part = F.concat("spelling", F.when(record, s.spec_suffix("display_name", "spelling")).otherwise(F.lit("")))
    head = F.when(record, _head("signature")).otherwise(F.lit(""))
    inner = cut(inner.select("usr", "parent_usr", F.col("kind").isin(CONTAINER_KINDS).alias("scope"), part.alias("part"), head.alias("head")))
    own = inner.where("scope").select(F.col("usr").alias("ancestor"), "part", "head")
    around = graph.ancestors(inner).join(own, "ancestor").groupBy("usr").agg(F.sort_array(F.collect_list(F.struct("distance", "part", "head", "ancestor")), asc=False).alias("around"))
    none = F.array().cast("array<struct<distance:int,part:string,head:string,ancestor:string>>")
    itself = F.array(F.struct(F.lit(0).alias("distance"), "part", "head", F.col("usr").alias("ancestor")))
    scopes = inner.join(around, "usr", "left").select(F.lit(True).alias("__below"), F.col("usr").alias("__key"), F.concat(F.coalesce("around", none), F.when(F.col("scope"), itself).otherwise(none)).alias("__around"))
    # a symbol without a parent has a key of its own, so that they are not all one partition's
    rows = symbols.withColumns({"__below": parent != "", "__key": F.when(parent != "", parent).otherwise(F.col("usr"))})
    rows = rows.join(scopes, ["__below", "__key"], "left").withColumn("__around", F.coalesce(F.filter("__around", lambda x: x["ancestor"] != F.col("usr")), none))
    names = {"heads": F.array_join(F.col("__around")["head"], ""), "qualified": F.concat_ws("::", F.col("__around")["part"], "spelling")}
    return rows.withColumns(names).drop("__below", "__key", "__around")


def member_qualifiers(symbols: DataFrame) -> DataFrame:
    """usr, heads and qualified of all symbols."""
    return qualified_members(symbols).select("usr", "heads", "qualified")


def _called(signature: Column, spelling: Column, qualified: Column) -> Column:
    """The signature with the qualified name in place of the spelling that is called, if it stands there by itself."""
    at = F.instr(signature, F.concat(spelling, F.lit("(")))
    before, behind = F.substr(signature, F.lit(1), at - 1), F.substr(signature, at + F.length(spelling))
    alone = (at > 0) & ~F.rlike(before, F.lit(r"[\w:~]$"))
    return F.when(alone, F.concat(before, qualified, behind))


def signatures(symbols: DataFrame, bases: Column | None = None) -> DataFrame:
    """usr and the declaration of every symbol by its kind; `bases` is the clause behind a record's name."""
    rows = qualified_members(symbols)
    is_kind = lambda *names: F.col("kind").isin([KIND[n] for n in names])
    head = _head("signature")
    bare = F.when(_or_empty("signature") == "", F.concat("spelling", F.lit("()"))).otherwise(F.col("signature"))
    bare = F.when(is_kind("constructor", "destructor"), rewrite.text_udf(rewrite.without_injected_arguments)(bare)).otherwise(bare)
    bare = rewrite.text_udf(lambda x: rewrite.strip_recovery_defaults(rewrite.repair_split_operators(x)))(bare)
    function = F.coalesce(F.concat("heads", _called(bare, F.col("spelling"), F.col("qualified"))), bare)
    target = rewrite.text_udf(rewrite.parenthesize_comparisons)(_or_empty("type_repr"))
    alias = F.concat("heads", "qualified", F.when(target != "", F.concat(F.lit(" = "), target)).otherwise(F.lit("")))
    text = F.when(F.col("kind").isin(FUNCTION_KINDS), function)
    text = text.when(is_kind("variable", "field"), F.concat("heads", head, s.with_array_extent("type_repr", F.col("qualified"))))
    text = text.when(is_kind("typedef", "type_alias"), alias)
    text = text.when(is_kind("enum") & (F.col("heads") != ""), F.col("spelling"))
    text = text.when(is_kind("macro"), F.coalesce(F.nullif("signature", F.lit("")), "spelling"))
    text = text.when(is_kind("concept"), F.concat(head, "qualified_name"))
    text = text.when(F.col("kind").isin(RECORD_KINDS), F.concat("heads", head, "qualified", s.spec_suffix("display_name", "spelling"), bases if bases is not None else F.lit("")))
    return rows.select("usr", text.otherwise(F.col("qualified_name")).alias("signature"))


SCOPE = "start int, base string, args string"


def _scope_before(signature: str, spelling: str) -> tuple[int, str, str] | None:
    """Where the scope in front of a called spelling starts, and it without and of its last argument list."""
    end = signature.rfind(f"::{spelling}(")
    if end < 0:
        return None
    items = rewrite.tree(signature[:end])
    at = max((i + 1 for i, x in enumerate(items) if not str(x).strip()), default=0)
    scope = rewrite.spelled(items[at:])
    return (len(rewrite.spelled(items[:at])), *rewrite.split_scope_arguments(scope)) if scope else None


def _scopes(signatures: pd.Series, spellings: pd.Series) -> pd.DataFrame:
    found = [_scope_before(a, b) or (None, None, None) for a, b in zip(signatures, spellings, strict=True)]
    return pd.DataFrame(found, columns=["start", "base", "args"]).astype({"start": "Int32"})


def recovered(definitions: DataFrame, records: DataFrame) -> DataFrame:
    """usr and signature of definitions that spell their scope (usr, spelling, qualified_name, signature).

    The scope becomes that of the record it names, with the template heads it needs;
    where it names none the signature stays. `records` are symbols.
    """
    _scopes.__annotations__ = {"signatures": pd.Series, "spellings": pd.Series, "return": pd.DataFrame}
    last = lambda c: F.element_at(F.split(c, "::"), -1)
    rows = definitions.withColumn("s", F.pandas_udf(_scopes, SCOPE)("signature", "spelling"))
    around = F.regexp_replace("qualified_name", "::[^:]*$", "")
    rows = rows.withColumn("expected", F.when(last(F.col("s.base")) == last(around), around))
    own = qualified_members(records).where(F.col("kind").isin(RECORD_KINDS))
    own = own.groupBy(F.col("qualified_name").alias("expected")).agg(F.min_by(F.struct(F.concat("heads", _head("signature")).alias("heads"), "qualified"), "usr").alias("r"))
    joined = rows.join(own, "expected", "left")
    written = F.length(F.concat("s.base", "s.args"))
    text = F.concat("r.heads", F.substr("signature", F.lit(1), F.col("s.start")), "r.qualified", "s.args", F.substr(F.col("signature"), F.col("s.start") + written + 1))
    return joined.select("usr", F.coalesce(text, "signature").alias("signature"))


def enum_scopes(symbols: DataFrame) -> DataFrame:
    """usr and the scope to push for each enum that is below a template; '' where its plain name is enough."""
    parents = symbols.select(F.col("usr").alias("parent_usr"), "display_name", F.col("spelling").alias("p_spelling"), F.col("signature").alias("p_signature"))
    parents = parents.join(member_qualifiers(symbols).withColumnRenamed("usr", "parent_usr"), "parent_usr")
    rows = symbols.where(F.col("kind") == KIND["enum"]).select("usr", "parent_usr").join(parents, "parent_usr", "left")

    def suffixes(given: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([rewrite.scope_suffix(a or "", b or "") for a, b in zip(given, heads, strict=True)])

    suffixes.__annotations__ = {"given": pd.Series, "heads": pd.Series, "return": pd.Series}
    suffix = F.pandas_udf(suffixes, "string")(s.spec_suffix("display_name", "p_spelling"), _or_empty("p_signature"))
    heads = F.concat("heads", _head("p_signature"))
    return rows.select("usr", F.when(_or_empty(heads) != "", F.concat(heads, "qualified", suffix)).otherwise(F.lit("")).alias("scope"))
