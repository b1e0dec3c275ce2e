"""What is known about each column: the small, driver-side half of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROW = "_row"
SUMMARY = "_is_summary"


class SpecError(ValueError):
    """A question or dashboard item that does not fit the table."""


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    data_type: str = "text"
    role: str = "attribute"
    semantic_type: str = "text"
    meaning: str | None = None
    time_format: str | None = None
    unique_count: int = 0
    missing_count: int = 0
    hidden: bool = False


def physical_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text"


def data_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in (ROW, SUMMARY)]


def columns_from_schema(df: DataFrame) -> dict[str, ColumnInfo]:
    """Roles guessed from types alone, for callers that did not run ``infer_roles``."""
    roles = {"number": "measure", "date": "time", "boolean": "dimension", "text": "dimension"}
    out = {}
    for field in df.schema.fields:
        if field.name in (ROW, SUMMARY):
            continue
        kind = physical_kind(field.dataType)
        out[field.name] = ColumnInfo(field.name, kind, roles[kind], kind, None, "iso" if kind == "date" else None)
    return out
