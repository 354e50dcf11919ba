"""The relational model: table types, keys and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "4"


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}


def _table(spec: str) -> T.StructType:
    """A struct from "name type, ..."; unlike DDL it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in spec.split(","))])


TABLES: dict[str, T.StructType] = {
    "meta": _table("key string, value string"),
    "files": _table("id long, path string, sha256 string, size_bytes long"),
    "symbols": _table("usr string, parent_usr string, kind int, spelling string, qualified_name string, display_name string, signature string, type_repr string, access int, storage int, is_definition boolean, is_documented boolean, content_hash string, file_id long, line int, col int"),
    "function_parameters": _table("function_usr string, idx int, name string, type_repr string, default_value string"),
    "template_parameters": _table("owner_usr string, idx int, param_kind int, name string, type_repr string, default_repr string"),
    "enumerators": _table("usr string, enum_usr string, name string, value long, value_is_signed boolean, idx int"),
    "references": _table("from_usr string, ref_kind int, to_usr string, to_spelling string, is_resolved boolean, access int, ordinal int"),
    "comments": _table("symbol_usr string, raw_text string, format string"),
    "comment_fields": _table("symbol_usr string, name string, arg string, value string, ordinal int"),
    "groups": _table("id string, title string, brief string, detail string, parent_group_id string, is_definition boolean"),
    "group_members": _table("group_id string, member_usr string, ordinal int"),
    "diagnostics": _table("pos long, severity int, depth int, text string, file string, line int, column int"),
}

# The persisted numbers of each enumeration, in order from 0.
SYMBOL_KINDS = ["unknown", "namespace", "class", "struct", "union", "function", "method", "constructor", "destructor", "field", "variable", "enum", "enumerator", "typedef", "type_alias", "function_template", "class_template", "concept", "macro"]
ACCESS_KINDS = ["none", "public", "protected", "private"]
STORAGE_KINDS = ["none", "static", "extern", "register", "thread_local", "auto"]
REFERENCE_KINDS = ["base_class", "param_type", "return_type", "field_type", "variable_type", "underlying_type", "enum_integer_type", "friend"]
SEVERITIES = ["ignored", "note", "warning", "error", "fatal"]

#: Keys whose rows must be unique, and (column, table, key) of each foreign key.
KEYS = {"meta": ["key"], "files": ["id"], "symbols": ["usr"], "function_parameters": ["function_usr", "idx"], "template_parameters": ["owner_usr", "idx"], "enumerators": ["usr"], "comments": ["symbol_usr"], "groups": ["id"]}
FOREIGN_KEYS = {
    "symbols": [("file_id", "files", "id")],
    "function_parameters": [("function_usr", "symbols", "usr")],
    "template_parameters": [("owner_usr", "symbols", "usr")],
    "enumerators": [("enum_usr", "symbols", "usr")],
    "references": [("from_usr", "symbols", "usr")],
    "comments": [("symbol_usr", "symbols", "usr")],
    "comment_fields": [("symbol_usr", "symbols", "usr")],
    "group_members": [("group_id", "groups", "id")],
}

# Which kinds belong together.
KIND = {name: n for n, name in enumerate(SYMBOL_KINDS)}
FUNCTION_KINDS = [KIND[k] for k in ("function", "method", "constructor", "destructor", "function_template")]
RECORD_KINDS = [KIND[k] for k in ("class", "struct", "union", "class_template")]
CONTAINER_KINDS = [KIND["namespace"], *RECORD_KINDS]
TYPE_LEAF_KINDS = [KIND[k] for k in ("enum", "typedef", "type_alias", "concept")]
CONST_LEAF_KINDS = [KIND[k] for k in ("variable", "macro")]
