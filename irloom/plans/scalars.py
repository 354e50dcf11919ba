"""Queries of section I and the plain parts of J: scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from irloom.functions import rewrite, scalar as s
from irloom.operators import query as q, signatures
from irloom.plans.registry import query
from irloom.sources.schema import FUNCTION_KINDS, RECORD_KINDS


@query("i1_hashes", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(v):
    return v("documents").select("doc_id", s.hash_text("text").alias("digest"))


def _frame(x: str) -> str:
    return f"unhex(lpad(to_hex(octet_length(encode({x}))), 16, '0')) || encode({x})"


@query(
    "i2_content_hash",
    f"""
WITH f AS (SELECT * FROM ir_symbols),
p AS (SELECT from_usr, list(to_spelling ORDER BY ordinal, to_spelling) AS ps, count(*) AS n FROM ir_references WHERE ref_kind = 1 GROUP BY from_usr)
SELECT usr, sha256({_frame("usr")} || {_frame("CAST(kind AS VARCHAR)")} || {_frame("qualified_name")} || {_frame("CAST(is_definition AS VARCHAR)")}
  || unhex(lpad(to_hex(coalesce(n, 0)), 16, '0')) || coalesce(list_reduce(list_transform(ps, lambda x: {_frame("x")} || {_frame("x")} || {_frame("''")}), lambda a, b: a || b), ''::BLOB) || {_frame("spelling")}) AS content_hash
FROM f LEFT JOIN p ON from_usr = usr""",
)
def _(v):
    params = v.references.where("ref_kind = 1").groupBy(F.col("from_usr").alias("usr")).agg(q.ordered(["ordinal", "to_spelling"], "to_spelling").alias("ps"))
    rows = v.symbols.join(params, "usr", "left")
    each = F.transform(F.coalesce("ps", F.array().cast("array<string>")), lambda x: F.struct(x.alias("type_repr"), x.alias("name"), F.lit("").alias("default_value")))
    return rows.select("usr", s.content_hash([F.col("usr"), F.col("kind").cast("string"), F.col("qualified_name"), F.col("is_definition").cast("string")], each, F.col("spelling")).alias("content_hash"))


@query("i3_fingerprint", "SELECT sha256('{' || string_agg('\"' || source || '\": true', ', ' ORDER BY source) || '}') AS fingerprint FROM (SELECT DISTINCT source FROM documents)")
def _(v):
    keys = [r[0] for r in v("documents").select("source").distinct().collect()]  # a configuration: few keys, in any order
    return v.spark.createDataFrame([(rewrite.fingerprint({k: True for k in keys}),)], "fingerprint string")


SLUG = "coalesce(nullif(trim(regexp_replace({0}, '[^0-9A-Za-z]+', '_', 'g'), '_'), ''), 'global')"


@query("i4_slugs", f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents")
def _(v):
    return v("documents").select("doc_id", s.slug("text").alias("slug"))


@query("i5_short_digests", "SELECT usr, left(sha256(qualified_name), 8) AS digest FROM ir_symbols")
def _(v):
    return v.symbols.select("usr", s.short_digest("qualified_name").alias("digest"))


@query("i6_stems", f"WITH x AS (SELECT doc_id, text, {SLUG.format('text')} AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 92 THEN rtrim(left(s, 83), '_') || '_' || left(sha256(text), 8) ELSE s END || '_tag' AS stem FROM x")
def _(v):
    return v("documents").select("doc_id", s.stem("text", "tag").alias("stem"))


NAMED = "(SELECT usr, kind, qualified_name, spelling, spelling || CASE WHEN line % 3 = 0 THEN '<int>' WHEN line % 3 = 1 THEN '(int)' ELSE '' END AS display_name FROM ir_symbols)"


def _named(v):
    tail = F.when(F.col("line") % 3 == 0, "<int>").when(F.col("line") % 3 == 1, "(int)").otherwise("")
    return v.symbols.select("usr", "kind", "qualified_name", "spelling", F.concat("spelling", tail).alias("display_name"))


SUFFIX = "CASE WHEN starts_with(substr(display_name, length(spelling) + 1), '<') THEN substr(display_name, length(spelling) + 1) ELSE '' END"


@query("i7_page_names", f"SELECT usr, coalesce(nullif(qualified_name, ''), spelling) || CASE WHEN kind IN (2, 3, 4, 16) THEN {SUFFIX} ELSE '' END AS page FROM {NAMED}")
def _(v):
    return _named(v).select("usr", s.page_name("qualified_name", "spelling", "display_name", F.col("kind").isin(RECORD_KINDS)).alias("page"))


@query("i8_spec_suffixes", f"SELECT usr, {SUFFIX} AS suffix FROM {NAMED}")
def _(v):
    return _named(v).select("usr", s.spec_suffix("display_name", "spelling").alias("suffix"))


#: Signatures with the nestings that the rewriters look for.
FORMS = [
    "void f(int a = <recovery-expr>(g(1), h()), T b)", "template<typename K, long Q = 7>", "std::conditional_t<sizeof(T) >= sizeof(int), A<B, C>, D>", 'bool x = = "a = = b"',
    "Outer<T>::Inner<U, V<W>>", "Foo<Bar<X>>(int)", "Traits<U, V>", "enable_if_t<N == 1 && (M > 2), std::array<int, (N != 3)>>", "template<template<typename> class C, typename... Ts>",
    "::ns::Grid<T>::operator==(const Grid<T>&) const", "int g(S s = <recovery-expr>, std::map<K, V> m = {{1, 2}, {3, 4}})", "~Node<Key, Less<Key>>",
]


def _signatures(v):
    forms = F.array(*map(F.lit, FORMS))
    return v("part").select("p_partkey", F.element_at(forms, (F.col("p_partkey") % len(FORMS) + 1).cast("int")).alias("signature"))


def _literal(x) -> str:
    """SQL of a text, or of the parts of a list behind one another."""
    return "'" + (x if isinstance(x, str) else "|".join(x)).replace("'", "''") + "'"


def _parts(f, text):
    return F.array_join(rewrite.list_udf(f)(text), "|").alias("parts")


def by_form(column: str, expected: list) -> str:
    """SQL of a value for each form, written out."""
    return f"SELECT p_partkey, r AS {column} FROM part JOIN (VALUES {', '.join(f'({k}, {_literal(x)})' for k, x in enumerate(expected))}) t(k, r) ON p_partkey % {len(FORMS)} = k"


def _but(**changed: str) -> list[str]:
    """The forms, some of them changed: f3="..." is the fourth."""
    return [changed.get(f"f{k}", x) for k, x in enumerate(FORMS)]


REWRITTEN = {
    "i9_scope_suffix": (rewrite.scope_suffix_of, ["", "<typename K, long Q = 7>", "<sizeof(T) >= sizeof(int), A<B, C>, D>", "", "<U, V<W>>", "", "", "<N == 1 && (M > 2), std::array<int, (N != 3)>>", "<template<typename> class C, typename... Ts>", "", "", "<Key, Less<Key>>"]),
    "i10_repair_operators": (rewrite.repair_split_operators, _but(f3='bool x == "a = = b"')),
    "i11_strip_defaults": (rewrite.strip_recovery_defaults, _but(f0="void f(int a, T b)", f10="int g(S s, std::map<K, V> m = {{1, 2}, {3, 4}})")),
    "i12_parenthesize": (rewrite.parenthesize_comparisons, _but(f2="std::conditional_t<(sizeof(T) >= sizeof(int)), A<B, C>, D>", f7="enable_if_t<(N == 1 && (M > 2)), std::array<int, (N != 3)>>")),
    "i32_plain_names": (rewrite.plain_name, ["void f", "template", "std::conditional_t", 'bool x = = "a = = b"', "Outer::Inner", "Foo", "Traits", "enable_if_t", "template", "::ns::Grid::operator==", "int g", "~Node"]),
    "i37_injected_names": (rewrite.without_injected_arguments, _but(f1="template", f2="std::conditional_t", f5="Foo(int)", f6="Traits", f7="enable_if_t", f8="template", f11="~Node")),
}
PARTS = {
    "i13_scope_arguments": (rewrite.split_scope_arguments, [[FORMS[0], ""], ["template", "<typename K, long Q = 7>"], ["std::conditional_t", "<sizeof(T) >= sizeof(int), A<B, C>, D>"], [FORMS[3], ""], ["Outer<T>::Inner", "<U, V<W>>"], [FORMS[5], ""], ["Traits", "<U, V>"], ["enable_if_t", "<N == 1 && (M > 2), std::array<int, (N != 3)>>"], ["template", "<template<typename> class C, typename... Ts>"], [FORMS[9], ""], [FORMS[10], ""], ["~Node", "<Key, Less<Key>>"]]),
    "i15_parameter_names": (rewrite.template_parameter_names, [[], ["K", "Q"], ["", "", "D"], [], ["T"], [""], ["U", "V"], ["N", ""], ["C", "Ts"], ["T"], [], ["Key", ""]]),
}
for _name, (_f, _expected) in REWRITTEN.items():
    query(_name, by_form("rewritten", _expected))(lambda v, f=_f: _signatures(v).select("p_partkey", rewrite.text_udf(f)("signature").alias("rewritten")))
for _name, (_f, _expected) in PARTS.items():
    query(_name, by_form("parts", _expected))(lambda v, f=_f: _signatures(v).select("p_partkey", _parts(f, "signature")))


#: Lists, and their parts.
LISTS = [
    ("typename K, long Q = 7", ["typename K", "long Q = 7"]), ("A<B, C>, D", ["A<B, C>", "D"]), ("f(a, b), {1, 2}, x[i, j]", ["f(a, b)", "{1, 2}", "x[i, j]"]), ("", []), (" , ", []), ("one", ["one"]), ("a,,b,", ["a", "b"]),
    ("template<typename, typename> class C, Pair<int, int> P = Pair<int, int>{1, 2}", ["template<typename, typename> class C", "Pair<int, int> P = Pair<int, int>{1, 2}"]),
]


@query("i14_top_level", f"SELECT p_partkey, r AS parts FROM part JOIN (VALUES {', '.join(f'({k}, {_literal(x)})' for k, (_, x) in enumerate(LISTS))}) t(k, r) ON p_partkey % {len(LISTS)} = k")
def _(v):
    text = F.element_at(F.array(*(F.lit(x) for x, _ in LISTS)), (F.col("p_partkey") % len(LISTS) + 1).cast("int"))
    return v("part").select("p_partkey", _parts(rewrite.split_top_level, text))


@query("i16_headings", "SELECT p_partkey, repeat('#', least(p_size, 6)) AS marker FROM part")
def _(v):
    return v("part").select("p_partkey", s.heading_marker("p_size").alias("marker"))


@query("i17_normalized", "SELECT doc_id, trim(regexp_replace(replace(text, ' ', chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g'), chr(10)) || chr(10) AS text FROM documents")
def _(v):
    return v("documents").select("doc_id", s.normalize(F.replace("text", F.lit(" "), F.lit("\n"))).alias("text"))


@query("i18_fences", "SELECT p_partkey, repeat('`', greatest(3, coalesce(p_size % 7, 0) + 1)) AS fence FROM part")
def _(v):
    return v("part").select("p_partkey", s.fence(F.concat("p_name", F.repeat(F.lit("`"), F.col("p_size") % 7), F.lit("x"))).alias("fence"))


@query("i19_relative_paths", "SELECT page_id, CASE WHEN starts_with(url, 'https://m.thth') THEN url WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS path FROM pages")
def _(v):
    return v("pages").select("page_id", s.relative("url", "http:/").alias("path"))


NAME = r"^~?[A-Za-z_]\w*(::~?\w+)*$"


@query("i20_link_classes", f"WITH t AS (SELECT usr, CASE WHEN line % 4 = 0 THEN 'https://x.org/' || spelling WHEN line % 4 = 1 THEN 'c:@' || spelling WHEN line % 4 = 2 THEN qualified_name || '().' ELSE spelling || ' and more' END AS x FROM ir_symbols) SELECT usr, CASE WHEN regexp_matches(x, '^(?i:https?|mailto):') THEN 'url' WHEN starts_with(x, 'c:') THEN 'usr' WHEN regexp_matches(regexp_replace(trim(x), '(?:\\(\\s*\\)|[.,;:()\\s])+$', ''), '{NAME}') THEN 'name' ELSE 'prose' END AS class FROM t")
def _(v):
    line = F.col("line") % 4
    x = F.when(line == 0, F.concat(F.lit("https://x.org/"), "spelling")).when(line == 1, F.concat(F.lit("c:@"), "spelling")).when(line == 2, F.concat("qualified_name", F.lit("()."))).otherwise(F.concat("spelling", F.lit(" and more")))
    return v.symbols.select("usr", s.link_class(x).alias("class"))


@query("i21_xref_targets", r"SELECT usr, CASE WHEN line % 2 = 0 THEN qualified_name ELSE spelling END AS target FROM ir_symbols")
def _(v):
    return v.symbols.select("usr", s.xref_target(F.when(F.col("line") % 2 == 0, F.concat("spelling", F.lit(" <"), "qualified_name", F.lit(">"))).otherwise(F.col("spelling"))).alias("target"))


#: Symbols with templates among the classes, and a signature or a type by kind.
SUFFIXES = "CASE WHEN kind = 2 AND line % 4 = 0 THEN '<T>' WHEN kind = 2 AND line % 4 = 2 THEN '<T*>' WHEN kind = 3 AND line % 3 = 0 THEN '<int>' ELSE '' END"
HEADS = "CASE WHEN kind = 2 AND line % 2 = 0 THEN 'template<typename T>' WHEN kind = 3 AND line % 3 = 0 THEN 'template<>' WHEN kind = 17 THEN 'template<typename U>' ELSE '' END"


def _declared(v):
    bare = F.when(F.col("kind") == 6, F.concat(F.lit("int "), "spelling", F.lit("(S s = <recovery-expr>(g()), bool b = = c) const"))).when(F.col("kind") == 5, F.concat(F.lit("void "), "spelling", F.lit("()"))).when(F.col("kind") == 18, F.concat("spelling", F.lit("(a, b)"))).otherwise(F.expr(HEADS))
    types = F.when(F.col("kind") == 10, "int [4]").when(F.col("kind") == 13, "conditional_t<sizeof(T) >= 4, A, B>").otherwise("")
    return v.symbols.withColumns({"display_name": F.concat("spelling", F.expr(SUFFIXES)), "signature": bare, "type_repr": types})


@query("i22_signatures", f"""
WITH p AS (SELECT usr, qualified_name || {SUFFIXES} AS q, coalesce(nullif({HEADS}, '') || ' ', '') AS heads FROM ir_symbols)
SELECT d.usr, CASE WHEN kind = 6 THEN heads || 'int ' || q || '::' || spelling || '(S s, bool b == c) const' WHEN kind = 5 THEN 'void ' || spelling || '()' WHEN kind = 10 THEN 'int ' || spelling || '[4]' WHEN kind = 13 THEN spelling || ' = conditional_t<(sizeof(T) >= 4), A, B>'
  WHEN kind = 18 THEN spelling || '(a, b)' WHEN kind = 17 THEN 'template<typename U> ' || qualified_name WHEN kind IN (2, 3) THEN coalesce(nullif({HEADS}, '') || ' ', '') || qualified_name || {SUFFIXES} ELSE qualified_name END AS signature
FROM ir_symbols d LEFT JOIN p ON p.usr = parent_usr""")
def _(v):
    return signatures.signatures(_declared(v))


@query("i23_array_extents", "SELECT p_partkey, p_type || ' ' || replace(p_name, ' ', '_') || CASE WHEN p_size % 3 = 0 THEN '' ELSE '[' || CAST(p_size AS VARCHAR) || ']' END AS declaration FROM part")
def _(v):
    kind = F.concat("p_type", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(" ["), F.col("p_size").cast("string"), F.lit("]"))))
    return v("part").select("p_partkey", s.with_array_extent(kind, F.replace("p_name", F.lit(" "), F.lit("_"))).alias("declaration"))


@query("i24_base_clauses", "SELECT from_usr, ': ' || string_agg('public ' || to_spelling, ', ' ORDER BY ordinal, to_spelling) AS clause FROM ir_references WHERE ref_kind = 1 GROUP BY from_usr")
def _(v):
    return v.references.where("ref_kind = 1").groupBy("from_usr").agg(F.concat(F.lit(": "), F.array_join(q.ordered(["ordinal", "to_spelling"], F.concat(s.lookup(s.ACCESS, F.col("access") + 1), F.lit(" "), "to_spelling")), ", ")).alias("clause"))


@query("i25_recovered_scopes", f"""
SELECT o.usr, CASE WHEN o.line % 5 = 0 THEN 'int Other::' || o.spelling || '(int x) const' ELSE CASE WHEN c.line % 2 = 0 THEN 'template<typename T> ' ELSE '' END || 'int ' || c.qualified_name || CASE WHEN c.line % 2 = 0 THEN '<T, A<U>>' ELSE '' END || '::' || o.spelling || '(int x) const' END AS signature
FROM ir_symbols o JOIN ir_symbols c ON c.usr = o.parent_usr WHERE o.kind = 6""")
def _(v):
    """Definitions outside their class that spell its name; every fifth names a class that there is not."""
    rows = _declared(v)
    c = rows.where("kind = 2").select(F.col("usr").alias("parent_usr"), F.col("spelling").alias("c_spelling"), F.col("qualified_name").alias("c_name"), F.col("line").alias("c_line"))
    scope = F.when(F.col("line") % 5 == 0, "Other").otherwise(F.concat("c_spelling", F.when(F.col("c_line") % 2 == 0, "<T, A<U>>").otherwise("")))
    defined = rows.where("kind = 6").join(c, "parent_usr").select("usr", "spelling", F.concat("c_name", F.lit("::"), "spelling").alias("qualified_name"), F.concat(F.lit("int "), scope, F.lit("::"), "spelling", F.lit("(int x) const")).alias("signature"))
    return signatures.recovered(defined, rows.where("kind < 4"))


@query("i26_enum_scopes", "SELECT o.usr, CASE WHEN c.line % 4 = 0 THEN 'template<typename T> ' || c.qualified_name WHEN c.line % 4 = 2 THEN 'template<typename T> ' || c.qualified_name || '<T*>' ELSE '' END AS scope FROM ir_symbols o JOIN ir_symbols c ON c.usr = o.parent_usr WHERE o.kind = 6 UNION ALL SELECT usr, '' FROM ir_symbols WHERE kind = 11")
def _(v):
    """Enums in classes: of a primary template the scope is bare, of a partial specialization it keeps the arguments."""
    return signatures.enum_scopes(_declared(v).withColumn("kind", F.when(F.col("kind") == 6, 11).otherwise(F.col("kind"))))


@query("i27_identity_texts", "SELECT usr, CASE WHEN line % 3 = 2 THEN 'static inline ' || spelling ELSE spelling END AS text FROM ir_symbols")
def _(v):
    head = F.when(F.col("line") % 3 == 0, "constexpr inline  ").when(F.col("line") % 3 == 1, "inline ").otherwise("static inline ")
    return v.symbols.select("usr", s.identity_text(F.concat(head, "spelling")).alias("text"))


def _case(values: dict[int, str]) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in values.items()) + " ELSE '' END"


@query("i28_kind_maps", f"SELECT usr, {_case(s.TEMPLATE)} AS template, {_case(s.DIRECTIVE)} AS directive, {_case(s.LABEL)} AS label FROM ir_symbols")
def _(v):
    return v.symbols.select("usr", s.lookup(s.TEMPLATE, "kind").alias("template"), s.lookup(s.DIRECTIVE, "kind").alias("directive"), s.lookup(s.LABEL, "kind").alias("label"))


@query("i29_kind_sets", "SELECT usr, kind IN (5, 6, 7, 8, 15) AS is_function, kind IN (2, 3, 4, 16) AS is_record FROM ir_symbols")
def _(v):
    return v.symbols.select("usr", F.col("kind").isin(FUNCTION_KINDS).alias("is_function"), F.col("kind").isin(RECORD_KINDS).alias("is_record"))


TOKEN = "usr || chr(31) || coalesce(parent_usr, '') || chr(31) || spelling || chr(31) || CAST(is_documented AS VARCHAR) || chr(31) || CAST(file_id AS VARCHAR)"


@query("i30_dependency_values", f"SELECT usr, {TOKEN} AS token FROM ir_symbols")
def _(v):
    return v.symbols.select("usr", s.dep_token("usr", "parent_usr", "spelling", "is_documented", "file_id").alias("token"))


@query("i31_enum_free_names", "SELECT usr, regexp_replace(qualified_name, '^(.*::)?[^:]+::([^:]+)$', '\\1\\2') AS name FROM ir_symbols")
def _(v):
    return v.symbols.select("usr", s.without_enum_scope("qualified_name").alias("name"))


@query("i33_directions", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'in' WHEN 2 THEN 'out' ELSE 'in,out' END AS direction, p_name AS name, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '[in] ' WHEN 2 THEN '[out] ' ELSE '[in,out] ' END || p_name AS encoded FROM part")
def _(v):
    d = F.element_at(F.array(F.lit(""), F.lit("in"), F.lit("out"), F.lit("in,out")), (F.col("p_size") % 4 + 1).cast("int"))
    rows = v("part").select("p_partkey", s.encode_direction(d, "p_name").alias("encoded"))
    direction, name = s.split_direction("encoded")
    return rows.select("p_partkey", direction.alias("direction"), name.alias("name"), "encoded")


@query("i34_diagnostics_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_valid(props) AND json_extract(props, '$.k') IS NOT NULL")
def _(v):
    kind = T.StructType([T.StructField("k", T.IntegerType())])
    return v("events").select("event_id", F.from_json(F.to_json(F.from_json("props", kind)), kind).alias("r")).where("r.k IS NOT NULL").select("event_id", "r.k")


@query("i35_wide_tokens", "SELECT usr, coalesce(parent_usr, '') || chr(31) || spelling || chr(31) || CAST(line AS VARCHAR) AS token FROM ir_symbols WHERE is_definition = 1")
def _(v):
    return v.symbols.where("is_definition = 1").select("usr", s.dep_token("parent_usr", "spelling", "line").alias("token"))


#: Tokens behind a macro's name, and the signature they make.
MACROS = [("( a , b ) x", "(a, b)"), ("( ) x", "()"), ("x ( a )", ""), ("( a , ... ) ( b )", "(a, ...)"), ("", ""), ("( a , b", "")]


@query("i36_token_lists", f"SELECT p_partkey, p_brand || r AS signature FROM part JOIN (VALUES {', '.join(f'({k}, {_literal(x)})' for k, (_, x) in enumerate(MACROS))}) t(k, r) ON p_partkey % {len(MACROS)} = k")
def _(v):
    behind = F.element_at(F.array(*(F.lit(x) for x, _ in MACROS)), (F.col("p_partkey") % len(MACROS) + 1).cast("int"))
    tokens = v("part").select("p_partkey", F.split(F.rtrim(F.concat("p_brand", F.lit(" "), behind)), " ").alias("tokens"))
    return tokens.select("p_partkey", rewrite.macro_signature("tokens").alias("signature"))


@query("j2_folded_space", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def _(v):
    return v("documents").select("doc_id", s.fold_space("text").alias("text"))


@query("j3_first_tokens", "SELECT doc_id, regexp_extract(text, '^\\s*(\\S*)', 1) AS head, length(regexp_replace(text, '^\\s*\\S*\\s*', '')) AS rest FROM documents")
def _(v):
    head, rest = s.first_token("text")
    return v("documents").select("doc_id", head.alias("head"), F.length(rest).cast("long").alias("rest"))


@query("j12_unroutable_commands", "SELECT usr, regexp_matches(x, '[@\\\\](?:copydoc|dot|image)\\b') AS unroutable FROM (SELECT usr, CASE WHEN line % 3 = 0 THEN '@copydoc ' || spelling WHEN line % 3 = 1 THEN chr(92) || 'dotted ' || spelling ELSE spelling END AS x FROM ir_symbols)")
def _(v):
    x = F.when(F.col("line") % 3 == 0, F.concat(F.lit("@copydoc "), "spelling")).when(F.col("line") % 3 == 1, F.concat(F.lit("\\dotted "), "spelling")).otherwise(F.col("spelling"))
    return v.symbols.select("usr", F.rlike(x, F.lit(r"[@\\](?:copydoc|dot|image)\b")).alias("unroutable"))


@query("j14_copy_notes", "SELECT usr, regexp_extract(x, '[@\\\\]copy(?:doc|brief|details)\\s+(\\S+)', 1) AS target FROM (SELECT usr, CASE WHEN line % 3 = 0 THEN '@copydoc ' || spelling ELSE spelling END AS x FROM ir_symbols) WHERE regexp_matches(x, '[@\\\\]copy(?:doc|brief|details)\\s+(\\S+)')")
def _(v):
    x = F.when(F.col("line") % 3 == 0, F.concat(F.lit("@copydoc "), "spelling")).otherwise(F.col("spelling"))
    return v.symbols.select("usr", F.explode(F.regexp_extract_all(x, F.lit(r"[@\\]copy(?:doc|brief|details)\s+(\S+)"), 1)).alias("target"))
