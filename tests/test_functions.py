import hashlib
import re

from pyspark.sql import functions as F

from irloom.functions import comment, rewrite, scalar


def test_pinned_content_hash(spark):
    fields = ["c:@N@geo@S@Circle@F@area#1", "6", "geo::Circle::area", "double area(int precision) const", "double (int) const", "1", "0", "1"]
    params = F.array(F.struct(F.lit("int").alias("type_repr"), F.lit("precision").alias("name"), F.lit("2").alias("default_value")))
    got = spark.range(1).select(scalar.content_hash([F.lit(x) for x in fields], params, F.lit("/// @brief The area.")).alias("h")).first().h
    assert got == "42f3a18c284f2d4ed8541fbddb47c8789a98a0631c04709add615011f5b01426"


def test_rewriters():
    assert rewrite.split_top_level("typename T, Pair<int, int> P, int A = {1, 2}") == ["typename T", "Pair<int, int> P", "int A = {1, 2}"]
    assert rewrite.template_parameter_names("template<typename K, long Q = 7, typename... Ts>") == ["K", "Q", "Ts"]
    assert rewrite.repair_split_operators('a = = b, "x = = y"') == 'a == b, "x = = y"'
    assert rewrite.strip_recovery_defaults('f(int a = <recovery-expr>(g(1)), T b = <recovery-expr>)') == "f(int a, T b)"
    assert rewrite.parenthesize_comparisons("C<sizeof(T) >= 4, A<B, D>>") == "C<(sizeof(T) >= 4), A<B, D>>"
    assert rewrite.parenthesize_comparisons("a < b") == "a < b"
    assert rewrite.split_scope_arguments("Outer<T>::Inner<U, V<W>>") == ("Outer<T>::Inner", "<U, V<W>>")
    assert rewrite.split_scope_arguments("Outer<T>::Inner") == ("Outer<T>::Inner", "")
    assert rewrite.scope_suffix("<T, N>", "template<typename T, int N>") == "" and rewrite.scope_suffix("<int>", "template<>") == "<int>"
    assert rewrite.without_injected_arguments("Foo<Bar<X>>(int)") == "Foo(int)"


def test_wide_fields_complement_the_hashed():
    from irloom.sources.schema import TABLES

    assert sorted(scalar.HASHED_FIELDS + scalar.WIDE_FIELDS) == sorted(TABLES["symbols"].names)


def test_stems(spark):
    rows = spark.createDataFrame([("a::b",), ("::",), ("x" * 200,)], "n string").select(scalar.stem("n").alias("s")).collect()
    assert rows[0].s == "a_b" and rows[1].s == "global" and len(rows[2].s) == 96


def test_fields_and_structs_are_inverse(spark):
    rows = [("u", "brief", "", "B", 0), ("u", "param", "[in] x", "an x", 1), ("u", "note", "", "one", 2), ("u", "note", "", "two", 3), ("u", "zeta", "", "z", 4)]
    fields = spark.createDataFrame(rows, "symbol_usr string, name string, arg string, value string, ordinal int")
    back = comment.fields_from_structs(comment.structs_from_fields(fields)).orderBy("ordinal").collect()
    assert [tuple(r) for r in back] == rows


def test_slugs_and_stems(spark):
    """Long texts by their start alone, the same as by the whole; each expression names its pattern as often as it has to."""
    texts = ["", "--", "a b", "-a-" * 40, "x" * 96, "y" * 97, "." * 1024 + "b" * 200, "." * 1023 + "b", "ab " * 900, "c" * 86 + "." * 1500 + "d" * 40, None]
    slugs = [None if t is None else re.sub("[^0-9A-Za-z]+", "_", t).strip("_") or "global" for t in texts]
    cut = lambda t, s, room: s if s is None or len(s) <= room else s[: room - 9].rstrip("_") + "_" + hashlib.sha256(t.encode()).hexdigest()[:8]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = rows.select("id", scalar.slug("t").alias("slug"), scalar.stem("t").alias("stem"), scalar.stem("t", "tag").alias("tagged"))
    assert [(r.slug, r.stem, r.tagged) for r in found.orderBy("id").collect()] == [(s, cut(t, s, 96), None if s is None else cut(t, s, 92) + "_tag") for t, s in zip(texts, slugs, strict=True)]
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("[^0-9A-Za-z]+")
    assert plan(scalar.slug("t")) == 1 and plan(scalar.stem("t")) == 2
