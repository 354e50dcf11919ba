"""K5: page templates from directories of one's own, before the bundled ones, as column expressions.

A template is compiled once, to one expression over columns: loops become transforms of
arrays, conditions cases, macros and includes are put in where they are called. So pages are rendered in
generated code, and a template that is not well formed or names what is not there is an error before
a job runs.

It knows `{{ value }}`, `{% if %}`, `{% elif %}`, `{% else %}`, `{% for x in list %}` with `loop.index`, `loop.first` and
`loop.last`, `{% set x = value %}`, `{% macro f(a) %}`, `{% import "partial" as p %}`, `{% include "partial" %}`, `{% extends "base" %}`
with `{% block name %}`, and `{# remarks #}`. Values are fields, texts, `a.b`, `a ~ b`, `==`, `!=`, `is none`, `not`, `and`, `or`, `a if c else b`,
filters behind `|` and calls of macros and of functions that are handed in. A line end behind a tag and blanks in front of one go; `-`
inside a tag takes all white space on its side. NULL is empty and none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irloom.functions import scalar as s

SUFFIX = ".md.jinja"
TAG = re.compile(r"\{#.*?#\}|\{\{(?!\{)(?P<v>-?.*?-?)\}\}|\{%(?P<t>-?.*?-?)%\}", re.DOTALL)
TOKEN = re.compile(r"\s*(?:(?P<text>\"[^\"]*\"|'[^']*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|[.()|~,=]))")

#: The bundled templates by stem.
BUNDLED = {name: "# {{ label }} {{ qualified_name }}\n\n```{{{ directive }}} {{ qualified_name }}\n```\n" for name in sorted(set(s.TEMPLATE.values()))}


class TemplateError(Exception):
    """A template that is not well formed, or names a field that there is not."""


@dataclass(frozen=True)
class Value:
    """A column and its type; the type tells what counts as true, and what has fields or elements."""

    column: Column
    type: T.DataType = field(default_factory=T.StringType)

    def text(self) -> Column:
        if isinstance(self.type, (T.ArrayType, T.StructType, T.MapType)):
            raise TemplateError(f"a {self.type.typeName()} is no text")
        return F.coalesce(self.column.cast("string"), F.lit(""))

    def true(self) -> Column:
        if isinstance(self.type, (T.ArrayType, T.MapType)):
            return F.coalesce(F.size(self.column) > 0, F.lit(False))
        if isinstance(self.type, T.BooleanType):
            return F.coalesce(self.column, F.lit(False))
        return self.column.isNotNull() if isinstance(self.type, T.StructType) else self.text() != ""

    def part(self, name: str) -> Value:
        if isinstance(self.type, T.StructType) and name in self.type.names:
            return Value(self.column[name], self.type[name].dataType)
        raise TemplateError(f"no {name!r} in a {self.type.typeName()}")


def _flag(c: Column) -> Value:
    return Value(c, T.BooleanType())


def _joined(v: Value, between: Value | None = None) -> Value:
    if not isinstance(v.type, T.ArrayType):
        raise TemplateError("join of what is no list")
    if between is not None and not isinstance(between, Literal):
        raise TemplateError("join takes a written text")
    return Value(F.coalesce(F.array_join(F.transform(v.column, lambda x: Value(x, v.type.elementType).text()), between.written if between else ""), F.lit("")))


class Literal(Value):
    """A text that is written in the template."""

    def __init__(self, written: str):
        super().__init__(F.lit(written))
        object.__setattr__(self, "written", written)


FILTERS: dict[str, Callable[..., Value]] = {
    "join": _joined, "trim": lambda v: Value(F.btrim(v.text(), F.lit(" \t\r\n"))), "lower": lambda v: Value(F.lower(v.text())), "upper": lambda v: Value(F.upper(v.text())),
    "heading": lambda v: Value(s.heading_marker(v.column.cast("int"))), "length": lambda v: Value(F.size(v.column) if isinstance(v.type, T.ArrayType) else F.length(v.text()), T.IntegerType()),
}


@dataclass(frozen=True)
class Context:
    """What names mean at a place, and where partials come from."""

    names: dict[str, Value]
    functions: dict[str, Callable[..., Value]] = field(default_factory=dict)
    load: Callable[[str], str] | None = None
    blocks: dict[str, list] = field(default_factory=dict)

    def with_names(self, **more: Value) -> Context:
        return replace(self, names=self.names | more)


class Expression:
    """One value of a template, read from its words."""

    def __init__(self, source: str, context: Context):
        self.context, self.words, at = context, [], 0
        source = source.strip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"cannot read {source!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def whole(self) -> Value:
        v = self.choice()
        if self.at != len(self.words):
            raise TemplateError(f"more than a value: {self.words[self.at][1]!r}")
        return v

    def takes(self, *words: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][1] in words and self.words[self.at][0] != "text":
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def choice(self) -> Value:
        v = self.either()
        if self.takes("if"):
            given = self.either()
            other = self.choice() if self.takes("else") else Literal("")
            return Value(F.when(given.true(), v.text()).otherwise(other.text()))
        return v

    def either(self) -> Value:
        v = self.both()
        while self.takes("or"):
            v = _flag(v.true() | self.both().true())
        return v

    def both(self) -> Value:
        v = self.negated()
        while self.takes("and"):
            v = _flag(v.true() & self.negated().true())
        return v

    def negated(self) -> Value:
        return _flag(~self.negated().true()) if self.takes("not") else self.compared()

    def compared(self) -> Value:
        v = self.chained()
        if mark := self.takes("==", "!="):
            same = v.text() == self.chained().text()
            return _flag(same if mark == "==" else ~same)
        if self.takes("is"):
            no = bool(self.takes("not"))
            if not self.takes("none"):
                raise TemplateError("`is` is for none only")
            return _flag(v.column.isNotNull() if no else v.column.isNull())
        return v

    def chained(self) -> Value:
        v = self.filtered()
        while self.takes("~"):
            v = Value(F.concat(v.text(), self.filtered().text()))
        return v

    def arguments(self) -> list[Value]:
        out: list[Value] = []
        while not self.takes(")"):
            if out and not self.takes(","):
                raise TemplateError("arguments without a comma")
            out.append(self.choice())
        return out

    def filtered(self) -> Value:
        v = self.single()
        while self.takes("|"):
            name = self.words[self.at][1] if self.at < len(self.words) else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            v = FILTERS[name](v, *(self.arguments() if self.takes("(") else []))
        return v

    def single(self) -> Value:
        if self.takes("("):
            v = self.choice()
            if not self.takes(")"):
                raise TemplateError("a bracket is left open")
            return v
        if self.at == len(self.words):
            raise TemplateError("a value is missing")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "text":
            return Literal(word[1:-1])
        if kind == "number":
            return Value(F.lit(int(word)), T.IntegerType())
        if kind != "name":
            raise TemplateError(f"{word!r} is no value")
        name, v = word, self.context.names.get(word)
        while True:
            if self.takes("("):
                if name not in self.context.functions:
                    raise TemplateError(f"no function {name!r}")
                v = self.context.functions[name](*self.arguments())
            elif self.takes("."):
                part = self.words[self.at][1] if self.at < len(self.words) else ""
                self.at += 1
                name, v = f"{name}.{part}", None if v is None else v.part(part)
            elif v is None:
                raise TemplateError(f"no field {name!r}")
            else:
                return v


ENDS = {"if": {"elif", "else", "endif"}, "for": {"endfor"}, "macro": {"endmacro"}, "block": {"endblock"}}


def _nodes(text: str) -> list:
    """A template as texts, ("value", source) and (tag, source, sections); a section is (tag, source, nodes)."""
    flat, at = [], 0
    for m in TAG.finditer(text):
        piece, inner, is_tag = text[at : m.start()], m["t"] if m["t"] is not None else m["v"], m["v"] is None
        at = m.end()
        if inner is not None and inner.startswith("-"):
            piece = piece.rstrip()
        elif is_tag:
            line = piece.rsplit("\n", 1)[-1]
            piece = piece[: len(piece) - len(line)] if not line.strip() and ("\n" in piece or not flat) else piece
        flat.append(piece)
        if inner is not None:
            flat.append(("tag" if is_tag else "value", inner.strip("-").strip()))
            if inner.endswith("-"):
                while at < len(text) and text[at].isspace():
                    at += 1
                continue
        if is_tag and text[at : at + 1] == "\n":
            at += 1
    flat.append(text[at:])

    def section(n: int, ends: set[str]) -> tuple[list, int]:
        out = []
        while n < len(flat):
            x = flat[n]
            n += 1
            if isinstance(x, str) or x[0] == "value":
                out.append(x)
                continue
            word, _, rest = x[1].partition(" ")
            if word in ends:
                return out, n - 1
            if word not in ENDS:
                out.append((word, rest.strip(), []))
                continue
            sections = []
            while True:
                body, n = section(n, ENDS[word])
                if n >= len(flat):
                    raise TemplateError(f"no end for {word!r}")
                sections.append((word if not sections else kind, rest if not sections else more, body))
                kind, _, more = flat[n][1].partition(" ")
                n += 1
                if kind.startswith("end"):
                    break
            out.append((word, rest.strip(), sections))
        if ends:
            raise TemplateError(f"none of {sorted(ends)} is there")
        return out, n

    found, _ = section(0, set())
    if stray := [x[0] for x in found if not isinstance(x, str) and x[0] != "value" and (x[0].startswith("end") or x[0] in ("elif", "else"))]:
        raise TemplateError(f"{stray[0]!r} ends nothing")
    return found


def _macros(nodes: list, context: Context) -> dict[str, Callable[..., Value]]:
    out = {}
    for x in nodes:
        if isinstance(x, tuple) and x[0] == "macro":
            m = re.fullmatch(r"(\w+)\s*\(\s*([\w\s,]*)\)", x[1])
            if not m:
                raise TemplateError(f"cannot read macro {x[1]!r}")
            names = [n.strip() for n in m[2].split(",") if n.strip()]

            def call(*given: Value, body=x[2][0][2], names=names, called=m[1]) -> Value:
                if len(given) != len(names):
                    raise TemplateError(f"{called} takes {len(names)} values")
                return Value(_text(body, replace(context, names=dict(zip(names, given, strict=True)), functions=context.functions | out)))

            out[m[1]] = call
    return out


def _round(name: str, items: Value, body: list, context: Context) -> Callable[[Column, Column], Column]:
    """One round of a loop, of its element and number."""
    place = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType())])

    def one(e: Column, i: Column) -> Column:
        loop = F.struct((i + 1).alias("index"), (i == 0).alias("first"), (i == F.size(items.column) - 1).alias("last"))
        return _text(body, context.with_names(**{name: Value(e, items.type.elementType), "loop": Value(loop, place)}))

    return one


def _text(nodes: list, context: Context) -> Column:
    """The text of a list of nodes."""
    parts: list[Column] = []
    context = replace(context, functions=context.functions | _macros(nodes, context))
    for x in nodes:
        if isinstance(x, str):
            if x:
                parts.append(F.lit(x))
            continue
        if x[0] == "value":
            parts.append(Expression(x[1], context).whole().text())
            continue
        word, rest, sections = x
        if word == "if":
            out, given = None, []
            for kind, source, body in sections:
                if kind == "else":
                    out = _text(body, context)
                else:
                    given.append((Expression(source, context).whole().true(), _text(body, context)))
            out = F.lit("") if out is None else out
            for test, body in reversed(given):
                out = F.when(test, body).otherwise(out)
            parts.append(out)
        elif word == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"cannot read loop {rest!r}")
            items = Expression(m[2], context).whole()
            if not isinstance(items.type, T.ArrayType):
                raise TemplateError(f"{m[2]!r} is no list")

            each = _round(m[1], items, sections[0][2], context)
            parts.append(F.coalesce(F.array_join(F.transform(items.column, each), ""), F.lit("")))
        elif word == "set":
            name, _, source = rest.partition("=")
            context = context.with_names(**{name.strip(): Expression(source, context).whole()})
        elif word in ("import", "include", "extends"):
            m = re.fullmatch(r"[\"']([^\"']+)[\"'](?:\s+as\s+(\w+))?", rest)
            if not m or context.load is None:
                raise TemplateError(f"cannot load {rest!r}")
            own = _nodes(context.load(m[1]))
            if word == "include":
                parts.append(_text(own, context))
            elif word == "import":
                context = replace(context, functions=context.functions | {f"{m[2]}.{n}": f for n, f in _macros(own, context).items()})
            else:
                blocks = {b[1]: b[2][0][2] for b in nodes if isinstance(b, tuple) and b[0] == "block"}
                return _text(own, replace(context, blocks=blocks | context.blocks))
        elif word == "block":
            parts.append(_text(context.blocks.get(rest, sections[0][2]), context))
        elif word != "macro":
            raise TemplateError(f"no tag {word!r}")
    return F.concat(*parts) if parts else F.lit("")


def compiled(text: str, fields: dict[str, Column], types: dict[str, T.DataType] | None = None, functions: dict[str, Callable[..., Value]] | None = None, load: Callable[[str], str] | None = None) -> Column:
    """The text of a template over columns; a field whose type is not given is a text. `load` gives the text of a partial."""
    names = {n: Value(c, (types or {}).get(n, T.StringType())) for n, c in fields.items()}
    return _text(_nodes(text), Context(names, functions or {}, load))


def find(spark: SparkSession, directories: list[str], stem: str) -> str:
    """The text of a template: of the first directory that has it, else the bundled one."""
    for directory in directories:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{stem}{SUFFIX}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.option("wholetext", "true").text(path.toString()).first().value
    if stem not in BUNDLED:
        raise TemplateError(f"no template {stem!r}")
    return BUNDLED[stem]


def rendered(spark: SparkSession, kind: Column, fields: dict[str, Column], directories: list[str], names: dict[int, str] | None = None) -> Column:
    """The text of each row by the template of its kind; NULL for a kind without one."""
    out = None
    names = s.TEMPLATE | (names or {})
    for stem in sorted(set(names.values())):
        text = compiled(find(spark, directories, stem), fields, load=lambda name: find(spark, directories, name))
        mine = kind.isin([k for k, n in names.items() if n == stem])
        out = F.when(mine, text) if out is None else out.when(mine, text)
    return out
