"""Section M: which pages there are, in which order, under which stems, and what each shows.

A plan has a row a page: page (its key), mode columns (scope, part), name, label, title, top (whether
the index lists it) and `place`, an array that sorts pages in the order in which they are walked. Seeds
are the symbols that a page shows, in order: deep ones with what is below them, the others alone.
Stems are given out once over all pages, groups included, and then joined wherever a page is linked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irloom.functions import scalar as s
from irloom.operators import tree
from irloom.operators.aggregate import numbered
from irloom.operators.query import SEP, empty
from irloom.operators.state import cut
from irloom.sources.schema import CONST_LEAF_KINDS, FUNCTION_KINDS, KIND, RECORD_KINDS, TYPE_LEAF_KINDS

NAMESPACE = KIND["namespace"]
GLOBAL = "(global namespace)"
# The pages of a scope in the order in which they are walked; the caption and the title of those that hold many members.
SUBSPACES, RECORDS, FUNCTIONS, OPERATORS, TYPES, CONSTANTS, OTHER, HUB = range(8)
LUMPED = {OPERATORS: ("operators", "Operators"), TYPES: ("types", "Types"), CONSTANTS: ("constants", "Constants"), OTHER: ("other", "Other")}

PLACE = "array<struct<n:bigint,text:string>>"
PAGES = ["page", "scope", "part", "name", "label", "title", "top", "place"]
SEEDS = ["page", "usr", "deep", "place"]


def shown(symbols: DataFrame) -> DataFrame:
    """The columns that planning reads, no NULLs among their texts."""
    has = set(symbols.columns)
    text = lambda c: F.coalesce(F.col(c) if c in has else F.lit(None).cast("string"), F.lit("")).alias(c)
    rows = symbols.select("usr", text("parent_usr"), "kind", text("spelling"), text("qualified_name"), text("display_name"), text("signature"), (F.col("is_documented").cast("int") == 1).alias("documented"), "file_id", "line")
    return rows.withColumn("suffix", F.when(F.col("kind").isin(RECORD_KINDS), s.spec_suffix("display_name", "spelling")).otherwise(F.lit("")))


class _n:
    """A number in a place."""

    def __init__(self, c: str | Column):
        self.column = F.col(c) if isinstance(c, str) else c


def _place(*parts: Column | _n | int) -> Column:
    """Numbers and texts one after another, as something that sorts."""
    pair = lambda n, text: F.struct(n.cast("long").alias("n"), text.alias("text"))
    return F.array(*(pair(F.lit(p), F.lit("")) if isinstance(p, int) else pair(p.column, F.lit("")) if isinstance(p, _n) else pair(F.lit(0), p) for p in parts))


def _siblings() -> tuple[Column | _n, ...]:
    """The order of children among themselves."""
    return _n("kind"), _n("line"), F.col("qualified_name"), F.col("usr")


def _page(key: Column, scope: Column, part: int | Column, name: Column, label: Column, title: Column, top: Column, place: Column) -> list[Column]:
    part = F.lit(part) if isinstance(part, int) else part
    return [c.alias(n) for n, c in zip(PAGES, (key, scope, part.cast("int"), name, label, title, top, place.cast(PLACE)), strict=True)]


def page_name() -> Column:
    return F.concat(F.coalesce(F.nullif("qualified_name", F.lit("")), "spelling"), "suffix")


def symbol_plan(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A page a root, in the order of roots."""
    roots = shown(symbols).where("parent_usr = ''")
    place = _place(_n("kind"), F.col("qualified_name"), F.col("usr"))
    pages = roots.select(*_page(F.col("usr"), F.lit(""), RECORDS, page_name(), page_name(), F.lit(""), F.lit(True), place))
    return pages, roots.select(F.col("usr").alias("page"), "usr", F.lit(True).alias("deep"), _place(0).cast(PLACE).alias("place"))


def within_files(symbols: DataFrame) -> DataFrame:
    """Symbols with a file, each cut off from a parent in another one, so a file's own are a forest."""
    up = symbols.select(F.col("usr").alias("p_usr"), F.col("file_id").alias("p_file"))
    rows = symbols.where("file_id IS NOT NULL").join(up, (F.col("parent_usr") == F.col("p_usr")) & (F.col("file_id") == F.col("p_file")), "left")
    return rows.withColumn("parent_usr", F.coalesce("p_usr", F.lit(""))).drop("p_usr", "p_file")


def file_plan(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A page a file that has roots of its own, named by its last path segment. `symbols` are the visible ones of within_files()."""
    roots = shown(symbols).where("parent_usr = ''")
    page = F.concat(F.lit("file:"), F.col("file_id").cast("string"))
    seeds = roots.select(page.alias("page"), "usr", F.lit(True).alias("deep"), _place(_n("kind"), F.col("qualified_name"), F.col("usr")).cast(PLACE).alias("place"))
    name = F.element_at(F.split("path", "/"), -1)
    held = files.join(roots.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi")
    pages = held.select(*_page(F.concat(F.lit("file:"), F.col("id").cast("string")), F.lit(""), OTHER, name, name, F.concat(F.lit("File `"), "path", F.lit("`")), F.lit(True), _place(F.col("path"))))
    return pages, seeds


def class_plan(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A page a record and a root that is none; a page for what else a namespace holds, where it holds any or is documented."""
    rows = cut(shown(symbols))
    spaces = rows.where(F.col("kind") == NAMESPACE).select(F.col("usr").alias("s_usr"))
    own = rows.where(F.col("kind").isin([NAMESPACE, *RECORD_KINDS]) & (F.col("parent_usr") != "")).join(spaces, F.col("parent_usr") == F.col("s_usr"), "left_semi").unionByName(rows.where("parent_usr = ''"))
    own = own.withColumn("o_line", F.when(F.col("parent_usr") == "", F.lit(0)).otherwise(F.col("line")).cast("long"))
    walked = tree.intervals(own, ["kind", "o_line", "qualified_name"], one_line=True)
    if walked is None:
        none = rows.limit(0)
        return none.select(*_page(F.col("usr"), F.lit(""), 0, page_name(), page_name(), F.lit(""), F.lit(True), _place(0))), none.select(F.col("usr").alias("page"), "usr", F.lit(True).alias("deep"), _place(0).cast(PLACE).alias("place"))
    walked = cut(walked)
    leaves = rows.where(~F.col("kind").isin([NAMESPACE, *RECORD_KINDS]))
    reached = walked.where(F.col("kind") == NAMESPACE)
    filled = leaves.select(F.col("parent_usr").alias("l_usr")).distinct()
    spaces = reached.join(filled.withColumn("filled", F.lit(True)), F.col("usr") == F.col("l_usr"), "left").where(F.col("documented") | F.col("filled"))
    label = F.coalesce(F.nullif("qualified_name", F.lit("")), F.lit(GLOBAL))
    title = F.concat(F.lit("Namespace `"), label, F.lit("`"))
    place = _place(_n("start"))
    pages = spaces.select(*_page(F.col("usr"), F.col("parent_usr"), OTHER, page_name(), label, title, F.lit(True), place))
    alone = walked.where(F.col("kind") != NAMESPACE)
    pages = pages.unionByName(alone.select(*_page(F.col("usr"), F.col("parent_usr"), RECORDS, page_name(), page_name(), F.lit(""), F.lit(True), place)))
    one = _place(0).cast(PLACE).alias("place")
    seeds = alone.select(F.col("usr").alias("page"), "usr", F.lit(True).alias("deep"), one).unionByName(spaces.select(F.col("usr").alias("page"), "usr", F.lit(False).alias("deep"), one))
    listed = leaves.join(spaces.select(F.col("usr").alias("page")), F.col("parent_usr") == F.col("page"))
    return pages, seeds.unionByName(listed.select("page", "usr", F.lit(True).alias("deep"), _place(1, *_siblings()).cast(PLACE).alias("place")))


def namespace_plan(symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hubs, records, functions by name and what else a scope holds; also the entries of each scope.

    Hubs are planned leaves first: one is kept if it has members, or a hub below it is kept,
    or it is documented, so a documented one without anything stays.
    """
    rows = cut(shown(symbols))
    spaces, members = rows.where(F.col("kind") == NAMESPACE), rows.where(F.col("kind") != NAMESPACE)
    order = ["spelling", "line", "qualified_name"]
    walked = tree.intervals(spaces, order, one_line=True)
    last = F.lit(1 << 62)
    if walked is None:
        hubs = spaces.limit(0).withColumns({"depth": F.lit(0), "after": last})
    else:
        # After all that is below it, before the next: a scope's place in postorder.
        hubs = walked.withColumn("after", F.col("start") + F.col("size") - 1 - F.col("depth"))
        filled = members.select(F.col("parent_usr").alias("m_usr")).distinct().withColumn("filled", F.lit(True))
        hubs = hubs.join(filled, F.col("usr") == F.col("m_usr"), "left").drop("m_usr")
        found = tree.levels(hubs.drop("depth").withColumn("keep", F.col("documented") | F.coalesce("filled", F.lit(False))))
        kept = tree.fold_up(found, {"keep": F.bool_or("keep")}, lambda: {"keep": F.col("keep") | F.coalesce(F.col("below_keep").cast("boolean"), F.lit(False))})
        hubs = cut(tree.together(kept).where("keep"))
    scopes = hubs.select(F.col("usr").alias("h_usr"), F.col("qualified_name").alias("h_name"), "after")
    scoped = members.where("parent_usr <> ''").join(scopes, F.col("parent_usr") == F.col("h_usr")).drop("h_usr")
    scoped = cut(scoped.unionByName(members.where("parent_usr = ''").withColumns({"h_name": F.lit(""), "after": last})))

    key = lambda tag, *c: F.concat_ws(SEP, F.lit(tag), *c)
    top = F.col("parent_usr") == ""
    own = F.coalesce(F.nullif("qualified_name", F.lit("")), "spelling")
    pages = hubs.select(*_page(key("hub", F.col("usr")), F.col("parent_usr"), HUB, own, own, F.concat(F.lit("Namespace `"), F.coalesce(F.nullif("qualified_name", F.lit("")), F.lit(GLOBAL)), F.lit("`")), top, _place(_n("after"), HUB)))
    seeds = hubs.select(key("hub", F.col("usr")).alias("page"), "usr", F.lit(False).alias("deep"), _place(0).cast(PLACE).alias("place"))
    entries = hubs.select(F.col("parent_usr").alias("scope"), key("hub", F.col("usr")).alias("page"), F.col("spelling").alias("caption"), _place(SUBSPACES, F.col("spelling"), _n("line"), F.col("qualified_name"), F.col("usr")).cast(PLACE).alias("place"))

    records = scoped.where(F.col("kind").isin(RECORD_KINDS))
    inside = (F.col("spelling"), *_siblings())
    pages = pages.unionByName(records.select(*_page(key("record", F.col("usr")), F.col("parent_usr"), RECORDS, page_name(), page_name(), F.lit(""), top, _place(_n("after"), RECORDS, *inside))))
    seeds = seeds.unionByName(records.select(key("record", F.col("usr")).alias("page"), "usr", F.lit(True).alias("deep"), _place(0).cast(PLACE).alias("place")))
    entries = entries.unionByName(records.select(F.col("parent_usr").alias("scope"), key("record", F.col("usr")).alias("page"), F.concat("spelling", "suffix").alias("caption"), _place(RECORDS, *inside).cast(PLACE).alias("place")))

    function, kind = F.col("kind").isin(FUNCTION_KINDS), F.col("kind")
    rest = scoped.where(~kind.isin(RECORD_KINDS)).withColumn("part", F.when(function & F.startswith("spelling", F.lit("operator")), OPERATORS).when(function, FUNCTIONS).when(kind.isin(TYPE_LEAF_KINDS), TYPES).when(kind.isin(CONST_LEAF_KINDS), CONSTANTS).otherwise(OTHER))
    rest = rest.withColumn("page", F.when(F.col("part") == FUNCTIONS, key("function", F.col("parent_usr"), F.col("spelling"))).otherwise(F.concat(key("lump", F.col("parent_usr")), F.lit(SEP), F.col("part").cast("string"))))
    first = F.min_by(own, F.struct("signature", "kind", "line", "qualified_name", "usr"))
    lumps = rest.groupBy("page", "parent_usr", "part", "h_name", "after").agg(first.alias("first"), F.min("spelling").alias("spelling"))
    of = lambda i: s.lookup({p: x[i] for p, x in LUMPED.items()}, "part")
    named = F.col("part") == FUNCTIONS
    base = F.when(F.col("h_name") != "", F.concat("h_name", F.lit("::"), of(0))).otherwise(of(0))
    where = F.when(F.col("h_name") != "", F.concat(F.lit("`"), "h_name", F.lit("`"))).otherwise(F.lit("the global namespace"))
    caption = F.when(named, F.col("spelling")).otherwise(of(1))
    title = F.when(named, F.concat(F.lit("Function `"), "first", F.lit("`"))).otherwise(F.concat(of(1), F.lit(" in "), where))
    inside = F.when(named, F.col("spelling")).otherwise(F.lit(""))
    lumps = cut(lumps.select("*", caption.alias("caption"), inside.alias("inside")))
    name = F.when(named, F.col("first")).otherwise(base)
    pages = pages.unionByName(lumps.select(*_page(F.col("page"), F.col("parent_usr"), F.col("part"), name, name, title, top, _place(_n("after"), _n("part"), F.col("inside")))))
    seeds = seeds.unionByName(rest.select("page", "usr", F.lit(True).alias("deep"), _place(F.when(named, F.lit("")).otherwise(F.col("spelling")), F.col("signature"), *_siblings()).cast(PLACE).alias("place")))
    entries = entries.unionByName(lumps.select(F.col("parent_usr").alias("scope"), "page", "caption", _place(_n("part"), F.col("inside")).cast(PLACE).alias("place")))
    return pages, seeds, entries


def group_plan(groups: DataFrame) -> DataFrame:
    """A page a group, behind all others, those without a parent first."""
    label = F.coalesce(F.nullif("title", F.lit("")), "id")
    nested = F.when(empty("parent_group_id"), 0).otherwise(1)
    return groups.select(*_page(F.concat(F.lit("group:"), "id"), F.coalesce("parent_group_id", F.lit("")), OTHER, F.concat(F.lit("group_"), "id"), label, label, F.lit(True), _place(_n(F.lit((1 << 62) + 1)), _n(nested), F.coalesce("title", F.lit("")), F.col("id"))))


def with_stems(pages: DataFrame, reserved: list[str] | None = None) -> DataFrame:
    """Adds `stem`, a file name of its own for every page, without regard to case.

    A stem that more than one name asks for gets each name's digest; pages that still agree, those of one name, get
    underscores in the order of the walk, and so do those that meet a reserved stem.
    """
    asked = cut(pages.withColumn("__bare", s.stem("name")))
    claims = asked.groupBy(F.lower("__bare").alias("__key")).agg((F.min("name") != F.max("name")).alias("contested"))
    tagged = F.concat(s.fitted("name", s.MAX_STEM - 9), F.lit("_"), s.short_digest("name"))
    told = asked.join(claims, F.lower("__bare") == F.col("__key")).withColumn("__stem", F.when(F.col("contested"), tagged).otherwise(F.col("__bare"))).drop("__key", "__bare", "contested")
    ranked = numbered(told.withColumn("__low", F.lower("__stem")), ["__low"], ["place", "page"], "__rank")
    tail = F.col("__rank").cast("int")
    for r in sorted({r.casefold() for r in reserved or []}, key=len):  # each reserved stem that is met shifts those behind it
        beyond = F.lit(len(r)) - F.length("__low")
        met = (beyond >= 0) & (F.concat("__low", F.repeat(F.lit("_"), F.greatest(beyond, F.lit(0)))) == r) & (beyond <= tail)
        tail = F.when(met, tail + 1).otherwise(tail)
    tail = F.repeat(F.lit("_"), tail)
    return ranked.withColumn("stem", F.concat("__stem", tail)).drop("__stem", "__low", "__rank")


def index_entries(pages: DataFrame) -> DataFrame:
    """position, stem and label of what the index lists, in the order of the walk."""
    return numbered(pages.where("top").select("stem", "label", "place", "page"), [], ["place", "page"]).select("position", "stem", "label")


def hub_entries(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """scope, position, stem and caption of what each hub lists, under the stems that the pages got."""
    rows = entries.join(pages.select("page", "stem"), "page")
    return numbered(rows.where("scope <> ''"), ["scope"], ["place", "page"]).select("scope", "position", "stem", "caption")
