"""Section I: scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_STEM, MAX_HEADING = 96, 6
UNIT, RECORD = "\x1f", "\x1e"

# Symbol columns that the content hash covers, in its order.
HASHED_FIELDS = ["usr", "kind", "qualified_name", "signature", "type_repr", "access", "storage", "is_definition"]
# Those it does not cover; a page depends on them by value.
WIDE_FIELDS = ["parent_usr", "spelling", "display_name", "is_documented", "content_hash", "file_id", "line", "col"]

# Per symbol kind its template, directive and label.
TEMPLATE = {1: "namespace", 2: "class", 3: "class", 4: "class", 5: "function", 6: "function", 7: "function", 8: "function", 9: "variable", 10: "variable", 11: "enum", 13: "typedef", 14: "typedef", 15: "function", 16: "class", 17: "concept", 18: "macro"}
DIRECTIVE = {1: "cpp:namespace", 2: "cpp:class", 3: "cpp:struct", 4: "cpp:union", 5: "cpp:function", 6: "cpp:function", 7: "cpp:function", 8: "cpp:function", 9: "cpp:member", 10: "cpp:var", 11: "cpp:enum", 12: "cpp:enumerator", 13: "cpp:type", 14: "cpp:type", 15: "cpp:function", 16: "cpp:class", 17: "cpp:concept", 18: "c:macro"}
LABEL = {1: "Namespace", 2: "Class", 3: "Struct", 4: "Union", 5: "Function", 6: "Method", 7: "Constructor", 8: "Destructor", 9: "Field", 10: "Variable", 11: "Enum", 13: "Typedef", 14: "Type alias", 15: "Function template", 16: "Class template", 17: "Concept", 18: "Macro"}
ACCESS = {1: "public", 2: "protected", 3: "private"}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(values: dict[int, str], key: Column | str, default: str = "") -> Column:
    """A constant map as a CASE, so it stays in generated code."""
    out = None
    for k, x in values.items():
        out = F.when(_c(key) == k, F.lit(x)) if out is None else out.when(_c(key) == k, F.lit(x))
    return out.otherwise(F.lit(default))


def hash_text(c: Column | str) -> Column:
    return F.sha2(_c(c), 256)


def framed(c: Column) -> Column:
    """Bytes of a text behind their number as eight big-endian bytes."""
    return F.concat(framed_length(F.octet_length(c)), F.encode(c, "UTF-8"))


def framed_length(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def content_hash(fields: list[Column], parameters: Column, raw_comment: Column) -> Column:
    """SHA-256 of a symbol's fields, its parameters (an array of structs type_repr, name, default_value) and its comment, each framed."""
    each = F.aggregate(parameters, F.unhex(F.lit("")), lambda acc, p: F.concat(acc, framed(p["type_repr"]), framed(p["name"]), framed(p["default_value"])))
    return F.sha2(F.concat(*map(framed, fields), framed_length(F.size(parameters)), each, framed(raw_comment)), 256)


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c), where c is evaluated once however often `of` names it."""
    return F.element_at(F.transform(F.array(c), of), 1)


def slug(c: Column | str) -> Column:
    s = F.btrim(F.regexp_replace(_c(c), "[^0-9A-Za-z]+", "_"), F.lit("_"))
    return once(s, lambda s: F.when(s == "", F.lit("global")).otherwise(s))


def short_digest(c: Column | str) -> Column:
    return F.left(hash_text(c), F.lit(8))


#: Characters of a text whose slug is tried first, since the slug of a text's start is the start of its slug.
START = 1024


def fitted(c: Column | str, room: int) -> Column:
    """A slug of at most `room` characters: a longer one ends in the digest of the whole name."""
    c = _c(c)
    enough = max(room, len("global"))
    s = once(slug(F.substring(c, 1, START)), lambda p: F.when((F.length(p) > enough) | (F.length(c) <= START), p).otherwise(slug(c)))
    cut = lambda s: F.concat(F.regexp_replace(F.substring(s, 1, room - 9), "_+$", ""), F.lit("_"), short_digest(c))
    return once(s, lambda s: F.when(F.length(s) > room, cut(s)).otherwise(s))


def stem(c: Column | str, tag: str = "") -> Column:
    """A slug that fits a file name: a long one ends in the digest of the whole name; the tag is kept."""
    suffix = f"_{tag}" if tag else ""
    return F.concat(fitted(c, MAX_STEM - len(suffix)), F.lit(suffix))


def spec_suffix(display: Column | str, spelling: Column | str) -> Column:
    """What a specialization's display name has behind its spelling."""
    d, s = F.coalesce(_c(display), F.lit("")), F.coalesce(_c(spelling), F.lit(""))
    rest = F.substr(d, F.length(s) + 1)
    return F.when((s != "") & F.startswith(d, s) & F.startswith(rest, F.lit("<")), rest).otherwise(F.lit(""))


def page_name(qualified: Column | str, spelling: Column | str, display: Column | str, is_record: Column) -> Column:
    name = F.coalesce(F.nullif(_c(qualified), F.lit("")), _c(spelling))
    return F.when(is_record, F.concat(name, spec_suffix(display, spelling))).otherwise(name)


def heading_marker(level: Column | str) -> Column:
    return F.repeat(F.lit("#"), F.least(_c(level), F.lit(MAX_HEADING)))


def normalize(c: Column | str) -> Column:
    """At most one blank line in a row, none at either end, one line end at the end."""
    return F.concat(F.btrim(F.regexp_replace(_c(c), "\n{3,}", "\n\n"), F.lit("\n")), F.lit("\n"))


def fence(c: Column | str) -> Column:
    """Backticks that no run of backticks in the text closes."""
    longest = F.array_max(F.transform(F.regexp_extract_all(_c(c), F.lit("`+"), 0), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def relative(path: Column | str, base: str) -> Column:
    return F.when(F.startswith(_c(path), F.lit(base + "/")), F.substr(_c(path), F.lit(len(base) + 2))).otherwise(_c(path))


def link_class(c: Column | str) -> Column:
    """What a free-text target is: a URL, a symbol key, a name, or prose."""
    cleaned = F.regexp_replace(F.trim(_c(c)), r"(?:\(\s*\)|[.,;:()\s])+$", "")
    return F.when(F.rlike(_c(c), F.lit("^(?i:https?|mailto):")), "url").when(F.startswith(_c(c), F.lit("c:")), "usr").when(F.rlike(cleaned, F.lit(r"^~?[A-Za-z_]\w*(::~?\w+)*$")), "name").otherwise("prose")


def xref_target(c: Column | str) -> Column:
    """The target of a role's body: of `title <target>` the target."""
    explicit = F.regexp_extract(_c(c), r"<([^<>]*)>\s*$", 1)
    return F.when(F.rlike(_c(c), F.lit(r"<[^<>]*>\s*$")), explicit).otherwise(_c(c))


# Specifiers in front of a declaration that do not tell two apart.
IDENTITY_SPECIFIERS = ["constexpr", "consteval", "constinit", "inline"]


def identity_text(c: Column | str) -> Column:
    """A declaration without the specifiers in front of it that do not tell two apart."""
    return F.regexp_replace(_c(c), rf"^(?:(?:{'|'.join(IDENTITY_SPECIFIERS)})\s+)*", "")


def dep_value(c: Column | str) -> Column:
    """How a value goes into a dependency token: flags as 0 and 1, NULL as nothing."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def dep_token(*columns: Column | str) -> Column:
    return F.concat_ws(UNIT, *map(dep_value, columns))


def without_enum_scope(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "^(.*::)?[^:]+::([^:]+)$", "$1$2")


def with_array_extent(type_repr: Column | str, name: Column | str) -> Column:
    """`int [4]` and x become `int x[4]`."""
    base, extent = F.regexp_extract(_c(type_repr), r"^([^\[]*?)\s*((?:\[[^\]]*\])*)$", 1), F.regexp_extract(_c(type_repr), r"^([^\[]*?)\s*((?:\[[^\]]*\])*)$", 2)
    return F.concat(base, F.lit(" "), _c(name), extent)


def encode_direction(direction: Column | str, name: Column | str) -> Column:
    return F.when(_c(direction) == "", _c(name)).otherwise(F.concat(F.lit("["), _c(direction), F.lit("] "), _c(name)))


def split_direction(c: Column | str) -> tuple[Column, Column]:
    pattern = r"^\[(in|out|in,out)\] *(.*)$"
    told = F.rlike(_c(c), F.lit(pattern))
    return F.when(told, F.regexp_extract(_c(c), pattern, 1)).otherwise(F.lit("")), F.when(told, F.regexp_extract(_c(c), pattern, 2)).otherwise(_c(c))


def fold_space(c: Column | str) -> Column:
    """ASCII white space folded to single blanks, none at either end."""
    return F.btrim(F.regexp_replace(_c(c), "[ \t\n\u000b\f\r]+", " "), F.lit(" "))


def first_token(c: Column | str) -> tuple[Column, Column]:
    pattern = "^[ \t\n\u000b\f\r]*([^ \t\n\u000b\f\r]*)[ \t\n\u000b\f\r]*"
    return F.regexp_extract(_c(c), pattern, 1), F.regexp_replace(_c(c), pattern, "")
