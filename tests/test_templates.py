"""Templates compiled to expressions: what each tag and value gives, and what is no template."""

import pytest
from pyspark.sql import functions as F

from irloom.operators import templates
from irloom.operators.templates import TemplateError

ROWS = [("x", ["p", "", "q"], ("n", [("i", ["1", "2"]), ("j", [])]), True, 3), ("", [], None, None, None), (None, None, (None, None), False, 0)]
SCHEMA = "a string, l array<string>, s struct<name:string,items:array<struct<k:string,v:array<string>>>>, f boolean, n int"


def made(spark, text, load=None):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], f"id int, {SCHEMA}").repartition(2)
    fields = ["a", "l", "s", "f", "n"]
    column = templates.compiled(text, {c: F.col(c) for c in fields}, {c: rows.schema[c].dataType for c in fields}, {"twice": lambda v: templates.Value(F.concat(v.text(), v.text()))}, load)
    return [r.t for r in rows.select("id", column.alias("t")).orderBy("id").collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("<{{ a }}>", ["<x>", "<>", "<>"]),
        ("{% for y in l %}{{ loop.index }}{{ y }}{% if not loop.last %},{% endif %}{% endfor %}", ["1p,2,3q", "", ""]),
        ("{% for y in s.items %}[{{ y.k }}{% for z in y.v %}{{ z }}{{ y.k }}{% if loop.first %}!{% endif %}{% endfor %}]{% endfor %}", ["[i1i!2i][j]", "", ""]),
        ("{% if s is none %}none{% elif s.name %}{{ s.name }}{% else %}empty{% endif %}", ["n", "none", "empty"]),
        ("{% if l %}{{ l | join('-') }}{% endif %}", ["p--q", "", ""]),
        ("{% set b = a ~ '+' ~ twice(a) %}{{ b | upper }}", ["X+XX", "+", "+"]),
        ("{{ 'yes' if f and not a == 'y' else 'no' }}", ["yes", "no", "no"]),
        ("{% if a or n %}{{ n | heading }}{% endif %}", ["###", "", ""]),
        ("{{ '  t ' | trim }}{{ l | length }}", ["t3", "t0", "t"]),
        ("{# no #}a\n  {% if f %}\nb\n  {% endif %}\nc\n", ["a\nb\nc\n", "a\nc\n", "a\nc\n"]),
        ("a  {%- if true_ is none %}{% endif -%}  b", None),
        ("{% macro m(x, y) %}({{ x }}{{ y }}){% endmacro %}{{ m(a, '1') }}{{ m(m(a, a), '') }}", ["(x1)((xx))", "(1)(())", "(1)(())"]),
    ],
)
def test_what_templates_give(spark, text, want):
    if want is None:
        with pytest.raises(TemplateError):
            made(spark, text)
    else:
        assert made(spark, text) == want


def test_partials_blocks_and_directories(spark, tmp_path):
    parts = {"p": "{% macro bold(x) %}**{{ x }}**{% endmacro %}", "base": "<{% block head %}H{% endblock %}|{% block body %}B{% endblock %}>", "line": "{{ a }};"}
    assert made(spark, "{% import 'p' as q %}{{ q.bold(a) }}{% include 'line' %}", parts.__getitem__)[0] == "**x**x;"
    assert made(spark, "{% extends 'base' %}{% block body %}{{ a }}{% endblock %}", parts.__getitem__)[0] == "<H|x>"
    (tmp_path / "partials").mkdir()
    (tmp_path / "partials" / f"own{templates.SUFFIX}").write_text("own {{ name }}")
    (tmp_path / f"class{templates.SUFFIX}").write_text('{% include "partials/own" %}!')
    rows = spark.createDataFrame([(2, "C"), (18, "M")], "kind int, name string")
    fields = {c: F.col("name") for c in ("name", "label", "directive", "qualified_name")}
    got = [r.t for r in rows.select(templates.rendered(spark, F.col("kind"), fields, [str(tmp_path)]).alias("t")).collect()]
    assert got[0] == "own C!" and got[1].startswith("# M M")


@pytest.mark.parametrize("text", ["{{ c }}", "{{ a.b }}", "{{ s }}", "{{ l }}", "{% if a %}", "{% endif %}", "{% for x in a %}{% endfor %}", "{% for l %}{% endfor %}", "{{ a | nothing }}", "{{ f( }}", "{{ a b }}", "{{ }}", "{{ nofunc(a) }}", "{% what %}", "{% if a %}{% endfor %}", "{% import 'x' as y %}", "{% macro m(x) %}{% endmacro %}{{ m() }}", "{{ s.nothing }}", "{{ a ? b }}"])
def test_no_templates(spark, text):
    with pytest.raises(TemplateError):
        made(spark, text)
