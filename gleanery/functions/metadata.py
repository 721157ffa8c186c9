"""Metadata columns: defaults, copy with changes, JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import METADATA

_DEFAULTS = {
    "processing_state": lambda: F.lit("pending"),
    "tags": lambda: F.array().cast("array<string>"),
    "extra_json": lambda: F.lit("{}"),
}


def with_defaults(df: DataFrame) -> DataFrame:
    """All metadata columns present; missing ones get their default or null."""
    missing = {
        f.name: _DEFAULTS.get(f.name, lambda: F.lit(None))().cast(f.dataType)
        for f in METADATA.fields
        if f.name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def copy(df: DataFrame, **changes: Column) -> DataFrame:
    """The given fields replaced, all others kept."""
    unknown = set(changes) - set(METADATA.fieldNames())
    if unknown:
        raise ValueError(f"not metadata fields: {sorted(unknown)}")
    return df.withColumns(changes)


def to_json(df: DataFrame, name: str = "metadata_json") -> DataFrame:
    fields = [
        F.try_parse_json("extra_json").alias("extra") if n == "extra_json" else F.col(n)
        for n in METADATA.fieldNames()
    ]
    return df.withColumn(name, F.to_json(F.struct(*fields)))


def from_json(json: Column) -> Column:
    """Struct of the metadata fields. Nulls were dropped on writing, so defaults re-apply."""
    ddl = ", ".join(
        "extra variant" if f.name == "extra_json" else f"{f.name} {f.dataType.simpleString()}"
        for f in METADATA.fields
    )
    m = F.from_json(json, ddl)
    out = []
    for f in METADATA.fields:
        c = F.to_json(m["extra"]) if f.name == "extra_json" else m[f.name]
        if f.name in _DEFAULTS:
            c = F.coalesce(c, _DEFAULTS[f.name]())
        out.append(c.alias(f.name))
    return F.struct(*out)
