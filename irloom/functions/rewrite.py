"""Bracket-aware rewriters of C++ text.

A text is read once into a tree of leaves and bracket groups; each rewriter walks the tree.
Balanced scans have no native expression, so these are Python functions over Arrow batches.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def text_udf(f):
    """f over a column; equal texts of a batch are rewritten once."""

    def run(texts):
        done = {None: None}
        for x in texts:
            if x not in done:
                done[x] = f(x)
        return pd.Series([done[x] for x in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def list_udf(f):
    return F.pandas_udf(lambda s: pd.Series([None if x is None else list(f(x)) for x in s], dtype=object), "array<string>")


def fingerprint(config: dict) -> str:
    """SHA-256 of a configuration as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


# The brackets of C++, its quotes, and what stands in text where a value or an operator was lost.
PAIRS = {"<": ">", "(": ")", "[": "]", "{": "}"}
QUOTES = "\"'"
LOST_VALUE, SPLIT_EQUAL = "= <recovery-expr>", "= ="

_QUOTED = "|".join(rf"{q}[^{q}\\]*(?:\\.[^{q}\\]*)*{q}" for q in QUOTES)
_GAP = {text: re.escape(text).replace(r"\ ", r"\s*" if text == LOST_VALUE else r"\s+") for text in (LOST_VALUE, SPLIT_EQUAL)}
LEXEME = re.compile(rf"(?P<quoted>{_QUOTED})|(?P<lost>\s*{_GAP[LOST_VALUE]})|(?P<split>{_GAP[SPLIT_EQUAL]})|(?P<compares>[<>=!]=)|(?P<arrow>->)|(?P<open>[<(\[{{])|(?P<shut>[>)\]}}])|(?P<comma>,)|(?P<word>\w+)|(?P<rest>.)", re.DOTALL)


@dataclass
class Leaf:
    kind: str
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass
class Group:
    """A bracket and what it holds; `shut` is empty if nothing closes it."""

    open: str
    items: list = field(default_factory=list)
    shut: str = ""

    def __str__(self) -> str:
        return self.open + spelled(self.items) + self.shut

    def is_list(self) -> bool:
        return self.open == "<" and bool(self.shut)


def spelled(items: list) -> str:
    return "".join(map(str, items))


def closes(path: list[Group], bracket: str) -> int:
    """Which of the open groups a bracket closes; 0 for none."""
    at = len(path) - 1
    while at and PAIRS[path[at].open] != bracket and path[at].open == "<":
        at -= 1
    return at if at and PAIRS[path[at].open] == bracket else 0


def tree(text: str) -> list:
    """The text as leaves and groups.

    A closing bracket ends the argument lists left open inside its own group; one that closes nothing is a leaf, as
    is the `>` of a comparison in parentheses.
    """
    path = [Group("")]
    for m in LEXEME.finditer(text):
        if m.lastgroup == "open":
            path.append(Group(m[0]))
            path[-2].items.append(path[-1])
        elif m.lastgroup == "shut" and (at := closes(path, m[0])):
            path[at].shut = m[0]
            del path[at:]
        else:
            path[-1].items.append(Leaf(m.lastgroup, m[0]))
    return path[0].items


def listed(items: list) -> list[list]:
    """Items between commas."""
    out: list[list] = [[]]
    for item in items:
        if isinstance(item, Leaf) and item.kind == "comma":
            out.append([])
        else:
            out[-1].append(item)
    return out


def split_top_level(text: str) -> list[str]:
    """Parts between the commas that no bracket encloses, trimmed, empty ones left out."""
    return [part for items in listed(tree(text)) if (part := spelled(items).strip())]


def first_list(items: list) -> Group | None:
    return next((g for g in items if isinstance(g, Group) and g.is_list()), None)


def template_parameter_names(head: str) -> list[str]:
    """The names a template head declares; '' for one without a name."""
    names = []
    for items in listed(found.items if (found := first_list(tree(head))) else []):
        until = next((i for i, x in enumerate(items) if str(x).lstrip().startswith("=")), len(items))
        own = [x for x in items[:until] if str(x).strip()]
        if own or until < len(items):
            names.append(own[-1].text if own and isinstance(own[-1], Leaf) and own[-1].kind == "word" else "")
    return names


def scope_suffix(suffix: str, head: str) -> str:
    """A specialization's arguments; nothing if they only repeat the parameter names of the head."""
    given = first_list(tree(suffix))
    names = [spelled(items).strip().removesuffix("...").rstrip() for items in listed(given.items)] if given and given.items else []
    return suffix if names != template_parameter_names(head) else ""


def scope_suffix_of(signature: str) -> str:
    return scope_suffix(split_scope_arguments(signature)[1], "template<typename U, typename V>")


def repair_split_operators(text: str) -> str:
    """`= =` becomes `==`, but not in a quoted literal."""
    return "".join(SPLIT_EQUAL.replace(" ", "") if m.lastgroup == "split" else m[0] for m in LEXEME.finditer(text))


def strip_recovery_defaults(signature: str) -> str:
    """Drops defaults that could not be evaluated, with their argument list."""

    def without(items: list) -> list:
        out: list = []
        lost = False
        for item in items:
            after_lost, lost = lost, isinstance(item, Leaf) and item.kind == "lost"
            if lost or (after_lost and isinstance(item, Group) and item.open == "("):
                continue
            out.append(Group(item.open, without(item.items), item.shut) if isinstance(item, Group) else item)
        return out

    return spelled(without(tree(signature)))


def parenthesize_comparisons(target: str) -> str:
    """Template arguments that compare at their top level get parentheses. A list that nothing closes stays."""

    def argument(items: list) -> str:
        compares = any(isinstance(x, Leaf) and x.kind in ("compares", "split") for x in items)
        return f"({spelled(items)})" if compares else shielded(items)

    def shielded(items: list) -> str:
        return "".join(str(x) if isinstance(x, Leaf) or not x.shut else x.open + (",".join(map(argument, listed(x.items))) if x.open == "<" else shielded(x.items)) + x.shut for x in items)

    return shielded(tree(target))


def split_scope_arguments(scope: str) -> tuple[str, str]:
    """What is before a scope's last argument list, and the list, if the scope ends in one."""
    items = tree(scope)
    if items and isinstance(items[-1], Group) and items[-1].is_list():
        return spelled(items[:-1]).rstrip(), str(items[-1])
    return scope, ""


def plain_name(text: str) -> str:
    """A target as a plain qualified name: argument lists dropped, cut at the first parenthesis."""
    kept = itertools.takewhile(lambda x: not (isinstance(x, Group) and x.open == "("), tree(text))
    return spelled([x for x in kept if str(x)[0] not in "<>"]).strip()


def without_injected_arguments(name: str) -> str:
    """`Foo<Bar<X>>(int)` becomes `Foo(int)`: a constructor's name without its class's arguments. Other shapes stay."""
    items = tree(name)
    at = next((i for i, x in enumerate(items) if isinstance(x, Group) and x.open == "<"), 0)
    behind = spelled(items[at + 1 :])
    return spelled(items[:at]) + behind if at and items[at].shut and behind[:1] in ("", "(") else name


def macro_signature(tokens: str | Column) -> Column:
    """A macro's name and, if a parenthesis follows it, the parameters up to the one that closes it."""
    shut = F.array_position(tokens, ")").cast("int")
    has = F.coalesce(F.get(tokens, 1) == "(", F.lit(False)) & (shut > 0)
    inner = F.array_join(F.filter(F.slice(tokens, 3, F.greatest(shut - 3, F.lit(0))), lambda x: x != ","), ", ")
    return F.when(has, F.concat(F.element_at(tokens, 1), F.lit("("), inner, F.lit(")"))).otherwise(F.element_at(tokens, 1))
