"""Small helpers for writing DuckDB oracle text (string building only)."""

from __future__ import annotations

from pyspark.sql import types as T

DUCK_TYPES = {
    T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN", T.DoubleType: "DOUBLE", T.TimestampNTZType: "TIMESTAMP",
    T.DateType: "DATE",
}


def duck_type(dt: T.DataType) -> str:
    return DUCK_TYPES[type(dt)]


def conform_select(table: str, have: tuple[str, ...], schema: T.StructType, wanted: tuple[str, ...]) -> str:
    """SELECT of ``wanted`` columns from ``table``; absent ones become typed NULLs."""
    types = {f.name: f.dataType for f in schema.fields}
    parts = []
    for c in wanted:
        if c in have:
            parts.append(f"CAST({c} AS {duck_type(types[c])}) AS {c}")
        else:
            parts.append(f"CAST(NULL AS {duck_type(types[c])}) AS {c}")
    return f"SELECT {', '.join(parts)} FROM {table}"
