"""Queries of sections J and K: the comment grammar over whole columns, and other parsers in its place."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.functions import grammar, scalar as s
from irloom.functions.rewrite import list_udf, text_udf
from irloom.operators import templates
from irloom.operators.state import shared_dir
from irloom.plans.comment_shapes import SHAPES
from irloom.plans.registry import query
from irloom.sources import snapshot
from irloom.sources.schema import FUNCTION_KINDS


def kind_case(values: dict[int, str], default: str = "") -> str:
    """SQL of a constant map over the kind."""
    return "CASE kind " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in values.items()) + f" ELSE '{default}' END"


def _raw(v):
    """Texts as comments: the first line is a brief, later ones parameters, notes and plain lines in turn."""
    each = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i == 0, "/// @brief ").when(i % 3 == 1, "/// @param[in] ").when(i % 3 == 2, "/// @note ").otherwise("///\n/// "), x))
    return v("documents").select("doc_id", F.array_join(each, "\n").alias("raw"))


def compact(raw: str) -> str:
    """A comment's fields that are not empty, as JSON with sorted keys."""
    return grammar.fields_json({k: x for k, x in grammar.parse(raw).items() if x not in ("", [], {})})


def _shape(v, choose):
    """A row a part: a shape, with the part's type as its word."""
    shapes = F.array(*(F.lit(raw) for raw, _ in SHAPES))
    return v("part").select("p_partkey", F.replace(F.element_at(shapes, (choose % len(SHAPES) + 1).cast("int")), F.lit("%w"), F.col("p_type")).alias("raw"))


def _shape_sql(column: str, values: list[str]) -> str:
    quoted = ", ".join("({}, '{}')".format(k, x.replace("'", "''")) for k, x in enumerate(values))
    return f"SELECT p_partkey, replace(r, '%w', p_type) AS {column} FROM part JOIN (VALUES {quoted}) t(k, r) ON p_partkey % {len(values)} = k"


@query("j1_comment_structs", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) SELECT doc_id, trim(regexp_replace(x[1], '\\s+', ' ', 'g')) AS brief, CAST((len(x) + 1) // 3 AS INTEGER) AS params, CAST(len(x) // 3 AS INTEGER) AS notes FROM l")
def _(v):
    parsed = _raw(v).select("doc_id", grammar.parse_column("raw").alias("c"))
    return parsed.select("doc_id", "c.brief", F.size("c.param").alias("params"), F.size("c.note").alias("notes"))


WORDS = ["param[in]", "param[inout]", "tparam[in,out]", "param[up]", "code{.py}", "code{c}", "code{unparsed}", "brief", "param[out]x", "code{"]


@query("j4_command_words", "SELECT p_partkey, r AS parts FROM part JOIN (VALUES (0, 'param|in|'), (1, 'param|in,out|'), (2, 'tparam|in,out|'), (3, 'param[up]||'), (4, 'code||py'), (5, 'code||c'), (6, 'code||'), (7, 'brief||'), (8, 'param[out]x||'), (9, 'code{||')) t(k, r) ON p_partkey % 10 = k")
def _(v):
    words = v("part").select("p_partkey", F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % 10 + 1).cast("int")).alias("w"))
    return words.select("p_partkey", F.array_join(list_udf(grammar.command_word)("w"), "|").alias("parts"))


@query("j5_fences", "SELECT p_partkey, repeat('`', greatest(3, p_size % 7 + 1)) || CASE WHEN p_size % 2 = 0 THEN 'py' ELSE 'cpp' END || chr(10) || p_name || chr(10) || chr(10) || '  ' || repeat('`', p_size % 7) || 'x' || chr(10) || repeat('`', greatest(3, p_size % 7 + 1)) AS block FROM part")
def _(v):
    """Blank lines around a block go, its indent too, and the fence is longer than any run of backticks in it."""
    text = F.concat(F.lit("\n  \n   "), "p_name", F.lit("\n \n     "), F.repeat(F.lit("`"), F.col("p_size") % 7), F.lit("x\n\n"))
    block = lambda language: text_udf(lambda x: grammar.fenced("code", language, x.split("\n")))(text)
    return v("part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, block("py")).otherwise(block("")).alias("block"))


#: Prose with inline commands, and the markup it becomes.
MARKUP = [
    ('see \\c code. and @p arg,', 'see `code`. and `arg`,'),
    ('a @b bold word and \\e it (\\em them) \\a arg', 'a **bold** word and *it* (*them*) *arg*'),
    ('(see \\ref pack_rows) @ref Grid::operator[].', '(see {cpp:any}`pack_rows`) {cpp:any}`Grid::operator[]`.'),
    ('\\ref a::b "the title" end', '{cpp:any}`the title <a::b>` end'),
    ('@ref 1x and \\link a::b, more', '`1x` and {cpp:any}`a::b`, more'),
    ('one \\n two ann@c.test \\unknown x', 'one two ann@c.test \\unknown x'),
]


@query("j6_inline_markup", "SELECT p_partkey, p_brand || ' ' || r AS text FROM part JOIN (VALUES " + ", ".join(f"({k}, '{x}')" for k, (_, x) in enumerate(MARKUP)) + f") t(k, r) ON p_partkey % {len(MARKUP)} = k")
def _(v):
    prose = F.element_at(F.array(*(F.lit(x) for x, _ in MARKUP)), (F.col("p_partkey") % len(MARKUP) + 1).cast("int"))
    return v("part").select("p_partkey", text_udf(grammar.inline)(F.concat("p_brand", F.lit(" "), prose)).alias("text"))


#: Tokens, and the name and the punctuation behind it that they are.
LINKS = [
    ('pack_rows)', ['pack_rows', ')']),
    ('Grid::operator[]', ['Grid::operator[]', '']),
    ('Grid::operator[].', ['Grid::operator[]', '.']),
    ('operator.', ['', '']),
    ('a::operator()', ['a::operator()', '']),
    ('foo().', ['foo', '().']),
    ('x-y', ['', '']),
    ('Grid::operator<<=,', ['Grid::operator<<=', ',']),
    ('operatorx', ['operatorx', '']),
    ('1a', ['', '']),
    ('a::b::c!', ['a::b::c', '!']),
    ('A::operator bool', ['', '']),
]


@query("j7_link_targets", "SELECT p_partkey, r AS parts FROM part JOIN (VALUES " + ", ".join(f"({k}, '{'|'.join(x)}')" for k, (_, x) in enumerate(LINKS)) + f") t(k, r) ON p_partkey % {len(LINKS)} = k")
def _(v):
    token = F.element_at(F.array(*(F.lit(x) for x, _ in LINKS)), (F.col("p_partkey") % len(LINKS) + 1).cast("int"))
    return v("part").select("p_partkey", F.array_join(list_udf(lambda x: grammar.link_parts(x) or ("", ""))(token), "|").alias("parts"))


@query("j8_routed_commands", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS notes FROM events GROUP BY user_id")
def _(v):
    command = F.when(F.col("event_type") == "error", "/// @remark x").otherwise("/// @sa x")
    raw = v("events").groupBy("user_id").agg(F.array_join(F.collect_list(command), "\n").alias("raw"))
    return raw.select("user_id", F.size(grammar.parse_column("raw")["note"]).cast("long").alias("notes"))


@query("j9_leads", _shape_sql("lead", [want.get("brief", "") + "|" + "/".join(want.get("detail", [])) for _, want in SHAPES]))
def _(v):
    """The brief, and the paragraphs that are not the brief, of every shape."""
    parsed = _shape(v, F.col("p_partkey")).select("p_partkey", grammar.parse_column(F.col("raw")).alias("c"))
    return parsed.select("p_partkey", F.concat_ws("|", "c.brief", F.array_join("c.detail", "/")).alias("lead"))


@query("j10_stripped_markers", "SELECT doc_id, regexp_replace(text, '[ \\t\\r]+(\\n|$)', '\\1', 'g') AS text FROM documents")
def _(v):
    raw = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("  /// "), x)), "\n")
    return v("documents").select("doc_id", text_udf(lambda x: "\n".join(grammar.content(x)))(raw).alias("text"))


_TAKES = {**dict.fromkeys(["ingroup", "defgroup", "addtogroup"], "line"), **dict.fromkeys(["internal", "endinternal", "endcode", "endverbatim"], "nothing"), **dict.fromkeys(["class", "struct", "union", "enum", "namespace", "fn", "var", "typedef", "relates"], "name"), **dict.fromkeys(["li", "arg"], "item"), **dict.fromkeys(["brief", "note"], "paragraph")}


@query("j11_command_classes", "WITH c AS (SELECT list_extract([" + ", ".join(f"'{c}'" for c in _TAKES) + f"], CAST(p_partkey % {len(_TAKES)} + 1 AS BIGINT)) AS command, p_partkey FROM part) SELECT p_partkey, command, CASE " + " ".join(f"WHEN command = '{c}' THEN '{t}'" for c, t in _TAKES.items()) + " END AS takes FROM c")
def _(v):
    """What a command takes, seen from what becomes of the line behind it; the line is a part's name."""
    command = F.element_at(F.array(*map(F.lit, _TAKES)), (F.col("p_partkey") % len(_TAKES) + 1).cast("int"))
    rows = v("part").select("p_partkey", command.alias("command"), "p_name")
    parsed = rows.select("p_partkey", "command", "p_name", grammar.parse_column(F.concat(F.lit("@"), "command", F.lit(" "), "p_name", F.lit("\nnext line."))).alias("c"))
    first, one = lambda c: F.get(c, F.lit(0)), F.element_at(F.split("p_name", " "), 1)
    own = F.coalesce(first(F.element_at("c.custom", F.col("command"))), F.when(F.col("command") == "brief", F.col("c.brief")), first(F.col("c.note")))
    takes = F.when(own == F.col("p_name"), "line").when(own == "", "nothing").when(own == one, "name").when(F.size("c.detail") + F.length("c.brief") == 0, "paragraph").when(F.startswith(first(F.col("c.detail")), F.lit("- ")) | F.startswith("c.brief", F.lit("- ")), "item").otherwise("paragraph")
    return parsed.select("p_partkey", "command", takes.alias("takes"))


@query("j13_group_blocks", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ingroup' WHEN 1 THEN 'defgroup' WHEN 2 THEN 'addtogroup' ELSE 'class' END AS command, CASE p_partkey % 4 WHEN 0 THEN p_type || ' other' WHEN 1 THEN p_type || ' The ' || p_brand WHEN 2 THEN p_type ELSE p_type END AS argument, CASE WHEN p_partkey % 4 = 3 THEN 'of ' || p_brand ELSE 'What it is.' END AS brief, CASE WHEN p_partkey % 4 = 3 THEN 'What it is.' ELSE '' END AS detail FROM part")
def _(v):
    """Group and structural commands take their line or a name; the prose behind them stays prose."""
    kind = F.col("p_partkey") % 4
    line = F.when(kind == 0, F.concat(F.lit("@ingroup "), "p_type", F.lit(" other"))).when(kind == 1, F.concat(F.lit("@defgroup "), "p_type", F.lit(" The "), "p_brand")).when(kind == 2, F.concat(F.lit("@addtogroup "), "p_type")).otherwise(F.concat(F.lit("@class "), "p_type", F.lit(" of "), "p_brand"))
    parsed = v("part").select("p_partkey", grammar.parse_column(F.concat(F.lit("/**\n * "), line, F.lit("\n * What it is.\n */"))).alias("c"))
    command = F.map_keys("c.custom")[0]
    return parsed.select("p_partkey", command.alias("command"), F.element_at("c.custom", command)[0].alias("argument"), "c.brief", F.array_join("c.detail", "").alias("detail"))


@query("j16_comment_json", _shape_sql("json", [json.dumps(want, sort_keys=True, ensure_ascii=False) for _, want in SHAPES]))
def _(v):
    return _shape(v, F.col("p_partkey")).select("p_partkey", text_udf(compact)("raw").alias("json"))


def _named_parts(v):
    return v("part").select("p_partkey", F.concat(F.lit("/// @brief "), "p_name", F.lit("\n/// "), "p_type").alias("raw"))


@query("k1_registered_parsers", "SELECT name, built_in, p_partkey, CASE WHEN name = 'doxygen' THEN '' ELSE '@brief ' END || p_name || ' ' || p_type AS brief FROM part, (VALUES ('doxygen', true), ('plain', true), ('shout', false)) t(name, built_in)")
def _(v):
    """Every part's comment by each registered parser: those that are built in, and one that is registered and taken away again."""
    others = set(grammar.available_parsers()) - set(grammar.BUILT_IN)  # a session may have some of its own
    grammar.register_parser("shout", grammar.plain)
    try:
        each = [_named_parts(v).select(F.lit(n).alias("name"), F.lit(n in grammar.BUILT_IN).alias("built_in"), "p_partkey", grammar.parse_column(F.col("raw"), grammar.PARSERS[n])["brief"].alias("brief")) for n in grammar.available_parsers() if n not in others]
    finally:
        del grammar.PARSERS["shout"]
    return reduce(DataFrame.union, each)


@query("k2_overrides", "SELECT how, p_partkey, CASE WHEN how = 'default' THEN '' ELSE '@brief ' END || p_name || ' ' || p_type AS brief FROM part, (VALUES ('callable'), ('default'), ('dotted path'), ('environment'), ('name')) t(how)")
def _(v):
    """Another parser given by itself, by name, by path and by the environment; and none."""
    found = {"callable": grammar.resolve_override(grammar.plain), "name": grammar.resolve_override("plain"), "dotted path": grammar.resolve_override("irloom.functions.grammar:plain"), "default": grammar.resolve_override(None, {})}
    found["environment"] = grammar.resolve_override(None, {grammar.OVERRIDE: "plain"})
    each = [_named_parts(v).select(F.lit(how).alias("how"), "p_partkey", grammar.parse_column(F.col("raw"), parser or grammar.parse)["brief"].alias("brief")) for how, parser in found.items()]
    return reduce(DataFrame.union, each)


@query("k3_other_parser", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '@brief ' || rtrim(x[1], ' ' || chr(9) || chr(13)) ELSE trim(regexp_replace(x[1], '\\s+', ' ', 'g')) END AS brief FROM l")
def _(v):
    """Parsers by symbol: every third comment by one that keeps its first line as it stands, the others by the grammar."""

    def first_line(raw):
        return grammar.plain(None) | {"brief": grammar.content(raw)[0]}

    which = F.when(F.col("doc_id") % 3 == 0, "first line").when(F.col("doc_id") % 3 == 1, "doxygen")
    return _raw(v).select("doc_id", grammar.parse_each(F.col("raw"), which, {"first line": first_line, "doxygen": grammar.parse})["brief"].alias("brief"))


@query("k5_template_directories", f"SELECT usr, CASE WHEN kind IN (2, 3, 4, 16) THEN 'first ' || spelling || CASE WHEN is_documented = 1 THEN ' told' ELSE '' END WHEN kind IN (5, 6, 7, 8, 15) THEN 'own ' || usr WHEN kind = 17 THEN 'second ' || qualified_name ELSE '# ' || {kind_case(s.LABEL)} || ' ' || qualified_name || chr(10) || chr(10) || '```{{' || {kind_case(s.DIRECTIVE)} || '}} ' || qualified_name || chr(10) || '```' || chr(10) END AS text FROM ir_symbols")
def _(v):
    """Two directories: the first has classes, the second classes and concepts; functions go by a template of another name; the rest is bundled."""
    path = shared_dir(v.spark)
    for name, text in (("one/class", "first {{ spelling }}{% if told %} told{% endif %}{# a remark #}"), ("two/class", "never"), ("two/concept", "second {{qualified_name}}"), ("two/method", "own {{ usr }}")):
        snapshot.write_small(v.spark, f"{path}/{name}{templates.SUFFIX}", text.encode())
    kind = F.col("kind")
    fields = {c: F.col(c) for c in ("usr", "spelling", "qualified_name")} | {"told": F.when(F.col("is_documented") == 1, "yes"), "label": s.lookup(s.LABEL, "kind"), "directive": s.lookup(s.DIRECTIVE, "kind")}
    names = dict.fromkeys(FUNCTION_KINDS, "method")
    return v.symbols.select("usr", templates.rendered(v.spark, kind, fields, [f"{path}/one", f"{path}/two"], names).alias("text"))
