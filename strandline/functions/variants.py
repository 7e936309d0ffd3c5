"""Type questions about VARIANT values: missing, null, and which kind of JSON value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(value: Column, path: str) -> Column:
    """The value at ``path`` as VARIANT; null if it is missing."""
    return F.try_variant_get(value, path, "variant")


_KINDS = {
    "VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number",
    "OBJECT": "object", "ARRAY": "array",
}


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_map(value: Column) -> Column:
    """The fields of an object as a map; null if it is none."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def kind_of(value: Column) -> Column:
    """The same as ``kind`` of a column that is cheap to name again; fields of objects and items of arrays are not looked at."""
    names = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    scalar = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    found = F.when(value.isNull(), "missing").when(as_map(value).isNotNull(), "object").when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), "array")
    return found.otherwise(F.coalesce(F.element_at(names, scalar), F.lit("other")))


def kind(value: Column, path: str = "$") -> Column:
    """missing, null, string, boolean, integer, number, object, array or other."""
    names = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    schema = F.schema_of_variant(at(value, path))
    return F.when(schema.isNull(), "missing").otherwise(F.coalesce(F.element_at(names, F.regexp_extract(schema, "^[A-Z]+", 0)), F.lit("other")))


def text(value: Column, path: str) -> Column:
    return F.when(kind(value, path) == "string", F.try_variant_get(value, path, "string"))


def number(value: Column, path: str) -> Column:
    """A number; booleans and numeric strings are none."""
    return F.when(kind(value, path).isin("integer", "number"), F.try_variant_get(value, path, "double"))


def truthy(value: Column, path: str) -> Column:
    """What Python's bool() says of the value; false if it is missing."""
    k = kind(value, path)
    return (
        F.when(k.isin("missing", "null"), False)
        .when(k == "boolean", F.try_variant_get(value, path, "boolean"))
        .when(k.isin("integer", "number"), F.try_variant_get(value, path, "double") != 0)
        .when(k == "string", F.try_variant_get(value, path, "string") != "")
        .when(k == "array", F.size(F.try_variant_get(value, path, "array<variant>")) > 0)
        .otherwise(F.size(F.try_variant_get(value, path, "map<string,variant>")) > 0)
    )
