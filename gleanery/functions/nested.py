"""Nested records as VARIANT: look-ups by dotted path, and flattening to leaf rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCALAR, LIST, EMPTY = "scalar", "list", "empty_object"
OPEN = "open"


def _json_path(names) -> str:
    quoted = (n.replace("\\", "\\\\").replace("'", "\\'") for n in names)
    return "$" + "".join(f"['{n}']" for n in quoted)


def nested_value(record: Column, dotted: str) -> Column:
    """VARIANT at the path. SQL null means "not there"; a stored null is a VARIANT null."""
    return F.try_variant_get(record, _json_path(dotted.split(".")), "variant")


def nested_get(record: Column, dotted: str, default: Column | None = None) -> Column:
    """JSON text at the path, or the default when the path does not lead anywhere."""
    v = nested_value(record, dotted)
    default = F.lit(None).cast("string") if default is None else default
    return F.when(v.isNotNull(), F.to_json(v)).otherwise(default)


def nested_section(record: Column, name: str) -> Column:
    """JSON text of one top-level object, `{}` if it is missing or not an object."""
    v = nested_value(record, name)
    return F.when(_as_object(v).isNotNull(), F.to_json(v)).otherwise(F.lit("{}"))


def _as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def leaves(json: Column, levels: int = 8) -> Column:
    """array<struct<path, kind, value_json>> of a JSON object's leaves, as far as `levels` go.

    Lists and empty objects are leaves. Values come out in one canonical spelling
    (sorted names, shortest numbers), so equal values have equal text. What is nested
    deeper comes out as an object of kind OPEN; operators.merge.to_leaves goes on with those.
    """
    nodes = F.array(
        F.struct(F.array().cast("array<string>").alias("path"), F.parse_json(json).alias("v"))
    )

    def open_up(node: Column) -> Column:
        obj = _as_object(node["v"])
        children = F.transform(
            F.map_entries(obj),
            lambda e: F.struct(
                F.concat(node["path"], F.array(e["key"])).alias("path"), e["value"].alias("v")
            ),
        )
        return F.when(F.size(obj) > 0, children).otherwise(F.array(node))

    for _ in range(levels):
        nodes = F.flatten(F.transform(nodes, open_up))

    def finish(node: Column) -> Column:
        obj = _as_object(node["v"])
        kind = (
            F.when(F.size(obj) > 0, F.lit(OPEN))
            .when(obj.isNotNull(), F.lit(EMPTY))
            .when(_as_list(node["v"]).isNotNull(), F.lit(LIST))
            .otherwise(F.lit(SCALAR))
        )
        return F.struct(
            node["path"].alias("path"), kind.alias("kind"), F.to_json(node["v"]).alias("value_json")
        )

    return F.transform(nodes, finish)


def list_elements(list_json: Column) -> Column:
    """Elements of a JSON list as JSON texts."""
    return F.transform(_as_list(F.parse_json(list_json)), lambda v: F.to_json(v))
