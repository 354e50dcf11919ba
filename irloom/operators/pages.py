"""Section M: page planning and rendering as grouped, ordered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irloom.functions import scalar as s
from irloom.functions.grammar import LINK
from irloom.operators.aggregate import numbered, unique_stems
from irloom.operators.query import file_roots, ordered, roots
from irloom.sources.schema import CONST_LEAF_KINDS, FUNCTION_KINDS, RECORD_KINDS, TYPE_LEAF_KINDS

# What a comment block writes for its fields, in order.
MISSING = "*No documentation provided.*"
BLOCKS = {"deprecated": ":::{deprecated} ", "warning": ":::{warning}\n", "note": ":::{note}\n"} | {
    field: f":::{{admonition}} {title}\n" for field, title in {"pre": "Precondition", "post": "Postcondition", "invariant": "Invariant", "bug": "Bug", "todo": "To do"}.items()
}
LINES_OF = {"since": "Since", "version": "Version", "date": "Date", "author": "Author"}
SEE, URLS = "**See also:** ", "^(?i:https?|mailto):"

#: Source lines whose texts make a block of a page.
LINES = 1000


def in_blocks(rows: DataFrame, page: list[str], text: str) -> DataFrame:
    """page, kind, block and text: the texts of a page in order of kind and line, cut into blocks of so many lines."""
    block = F.floor(F.col("line") / LINES).cast("long").alias("block")
    return rows.groupBy(*page, "kind", block).agg(F.array_join(ordered(["line", "usr"], text), "\n").alias(text))


def namespace_pages(symbols: DataFrame) -> DataFrame:
    """usr and the stem of the page it is on: its own for namespaces and records, else that of its bucket in its scope."""
    scope = F.coalesce("parent_usr", F.lit(""))
    kind = F.col("kind")
    stem = F.when(kind.isin(FUNCTION_KINDS), s.stem(scope, "functions")).when(kind == 1, s.stem("qualified_name", "ns")).when(kind.isin(RECORD_KINDS), s.stem("qualified_name"))
    stem = stem.when(kind.isin(TYPE_LEAF_KINDS), s.stem(scope, "types")).when(kind.isin(CONST_LEAF_KINDS), s.stem(scope, "constants")).otherwise(s.stem(scope, "other"))
    return symbols.select("usr", stem.alias("stem"))


def lines(*parts: Column) -> Column:
    """Parts that are not NULL, a line each."""
    return F.concat_ws("\n", *parts)


def link(target: Column) -> Column:
    """A free-text target as markup: a URL, prose as it stands, a C++ name as a role, anything else as code."""
    text = F.trim(target)
    name = F.regexp_extract(text, f"^{LINK.pattern.replace('(?P<', '(?<')}$", 1)
    bare = F.regexp_replace(text, r"(?:\(\s*\)|[.,;:()\s])+$", "")
    role = F.when(name != "", F.concat(F.lit("{cpp:any}`"), name, F.lit("`"))).when(bare != "", F.concat(F.lit("`"), bare, F.lit("`"))).otherwise(F.lit(""))
    return F.when(F.rlike(text, F.lit(URLS)), F.concat(F.lit("<"), text, F.lit(">"))).when(F.rlike(text, F.lit(r"\s")), text).otherwise(role)


def comment_block(comment: Column) -> Column:
    """A comment's prose: brief, paragraphs, a fenced block per admonition, a line for dates and the like, and what to see."""
    none = F.array().cast("array<string>")
    of = lambda field: F.coalesce(comment[field], none)
    parts = [F.filter(F.array(comment["brief"]), lambda x: x != ""), of("detail")]

    def fenced(field: str, opening: str) -> Column:
        return F.transform(of(field), lambda x: F.concat(F.lit(opening), x, F.lit("\n:::")))

    parts += [fenced(field, opening) for field, opening in BLOCKS.items()]
    some = lambda field, text: F.filter(F.array(F.when(F.size(of(field)) > 0, text)), lambda x: x.isNotNull())
    parts += [some(field, F.concat(F.lit(f"*{title}: "), F.array_join(of(field), ", "), F.lit(".*"))) for field, title in LINES_OF.items()]
    parts.append(some("see", F.concat(F.lit(SEE), F.array_join(F.transform(of("see"), link), ", "))))
    return F.when(comment.isNull(), F.lit(MISSING)).otherwise(F.array_join(F.concat(*parts), "\n\n"))


def field_list(comment: Column) -> Column:
    """A comment's parameters, results and exceptions as a field list; of a parameter its direction leads the description."""

    def of(field: str, name: str, directed: bool = False) -> Column:
        def line(x: Column) -> Column:
            arg = F.coalesce(x["arg"], F.lit(""))
            direction, bare = s.split_direction(arg) if directed else (F.lit(""), arg)
            prefix = F.when(direction != "", F.concat(F.lit("**["), direction, F.lit("]** "))).otherwise(F.lit(""))
            return F.concat(F.lit(f":{name} "), bare, F.lit(": "), prefix, x["value"])

        return F.coalesce(F.transform(comment[field], line), F.array().cast("array<string>"))

    returns = F.filter(F.array(F.when(comment["returns"] != "", F.concat(F.lit(":returns: "), comment["returns"]))), lambda x: x.isNotNull())
    return F.array_join(F.concat(of("tparam", "tparam", True), of("param", "param", True), returns, of("retval", "retval"), of("throws", "throws")), "\n")


def index_page(stems: DataFrame, title: str, by: list[str], order: list[str]) -> DataFrame:
    """by, block and text: a heading and the stems in order, so many lines a block; the first block has the heading."""
    placed = numbered(stems.select(*by, *order), by, order).withColumn("block", F.floor(F.col("position") / LINES).cast("long"))
    text = F.concat(F.array_join(ordered(["position"], "stem"), "\n"), F.lit("\n"))
    blocks = placed.groupBy(*by, "block").agg(text.alias("text"))
    return blocks.withColumn("text", F.when(F.col("block") == 0, F.concat(F.lit(f"# {title}\n\n"), "text")).otherwise(F.col("text")))


def hub_page(children: DataFrame) -> DataFrame:
    """Per namespace and block of its children a table of contents: their labels and stems, in order."""
    entry = F.concat(s.lookup(s.LABEL, "kind", "Symbol"), F.lit(" "), "spelling", F.lit(" <"), s.stem("qualified_name"), F.lit(">"))
    block = F.floor(F.col("line") / LINES).cast("long").alias("block")
    return children.groupBy("parent_usr", "kind", block).agg(F.concat(F.lit("```{toctree}\n:maxdepth: 1\n\n"), F.array_join(ordered(["line", "usr"], entry), "\n"), F.lit("\n```\n")).alias("text"))


def group_page(groups: DataFrame, members: DataFrame, size: int = LINES) -> DataFrame:
    """id, block and text: title, subgroups and members of each group, the members in blocks of so many ordinals; the first block leads."""
    subs = groups.where(F.coalesce("parent_group_id", F.lit("")) != "").groupBy(F.col("parent_group_id").alias("id")).agg(F.array_join(ordered(["id"], F.concat(F.lit("- {doc}`group_"), s.slug("id"), F.lit("`"))), "\n").alias("subs"))
    head = F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), "id"), F.when(F.col("subs").isNotNull(), F.concat(F.lit("\n\n**Subgroups**\n\n"), "subs")).otherwise(F.lit("")))
    heads = groups.join(subs, "id", "left").select("id", F.lit(-1).cast("long").alias("block"), s.normalize(head).alias("text"))
    block = F.floor(F.col("ordinal") / size).cast("long").alias("block")
    listed = members.groupBy(F.col("group_id").alias("id"), block).agg(F.concat(F.array_join(ordered(["ordinal", "usr"], F.concat(F.lit("- {cpp:any}`"), "qualified_name", F.lit("`"))), "\n"), F.lit("\n")).alias("text"))
    return heads.union(listed.join(groups.select("id"), "id", "left_semi"))


def symbol_pages(symbols: DataFrame) -> DataFrame:
    """A page per root, each with a stem of its own."""
    return unique_stems(roots(symbols), s.stem("qualified_name"), "usr")


def file_pages(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A page per file that has roots of its own."""
    return files.join(file_roots(symbols).select(F.col("file_id").alias("id")).distinct(), "id", "left_semi").select("id", s.stem("path").alias("stem"))


def class_pages(symbols: DataFrame, records: list[int]) -> DataFrame:
    """A page per record; a page of leaves per namespace that holds any."""
    own = symbols.where(F.col("kind").isin(records)).select("usr", s.stem("qualified_name").alias("stem"))
    spaces = symbols.where("kind = 1")
    leaves = symbols.where(~F.col("kind").isin([1, *records])).select(F.col("parent_usr").alias("usr")).distinct()
    return own.union(spaces.join(leaves, "usr", "left_semi").select("usr", s.stem("qualified_name", "ns")))


def symbol_body(symbols: DataFrame, comments: DataFrame | None = None, signatures: DataFrame | None = None, level: int = 1) -> DataFrame:
    """usr and text of every symbol's own part of a page: heading, directive and, inside its fence, comment and field list.

    `comments` (symbol_usr, comment) and `signatures` (usr, signature) may be left out: then
    nothing is documented, and a declaration is the qualified name.
    """
    rows = symbols.select("usr", "kind", "qualified_name")
    rows = rows.join(comments.select(F.col("symbol_usr").alias("usr"), "comment"), "usr", "left") if comments is not None else rows
    rows = rows.join(signatures.select("usr", "signature"), "usr", "left") if signatures is not None else rows.withColumn("signature", F.col("qualified_name"))
    body = comment_block(F.col("comment")) if comments is not None else F.lit(MISSING)
    fields = F.coalesce(field_list(F.col("comment")), F.lit("")) if comments is not None else F.lit("")
    function = F.col("kind").isin(FUNCTION_KINDS)
    rows = rows.select("usr", "kind", "qualified_name", F.coalesce("signature", "qualified_name").alias("signature"), body.alias("body"), F.when(function, fields).otherwise(F.lit("")).alias("fields"))
    fence = s.fence(F.concat("body", "fields"))
    head = F.concat(s.heading_marker(F.lit(level)), F.lit(" "), s.lookup(s.LABEL, "kind", "Symbol"), F.lit(" `"), "qualified_name", F.lit("`"))
    opening = F.concat(fence, F.lit("{"), s.lookup(s.DIRECTIVE, "kind"), F.lit("} "), "signature")
    listed = F.when(F.col("fields") != "", F.concat(F.lit("\n\n"), "fields")).otherwise(F.lit(""))
    return rows.select("usr", s.normalize(F.concat(head, F.lit("\n\n"), opening, F.lit("\n\n"), "body", listed, F.lit("\n"), fence)).alias("text"))
