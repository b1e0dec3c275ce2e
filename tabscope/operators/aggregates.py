"""Filters, aggregates and time grains shared by questions and dashboard tiles."""

from __future__ import annotations

import math
import re
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.columns import SUMMARY, ColumnInfo, SpecError, physical_kind
from tabscope.functions import vocabulary as V
from tabscope.functions.values import cell_number, time_bucket

MAX_FILTERS_PER_REQUEST = 12
DAY = re.compile(r"\d{4}-\d{2}-\d{2}\Z")
# Longest span in days for each default grain.
GRAIN_SPANS = (("day", 92), ("month", 3 * 366), ("quarter", 8 * 366))


def physical(df: DataFrame, name: str) -> str:
    return physical_kind(df.schema[name].dataType)


def numeric(df: DataFrame, name: str) -> Column:
    """The column's numbers; anything else is null."""
    return F.col(name) if physical(df, name) == "number" else cell_number(name)


def text_form(df: DataFrame, name: str) -> Column:
    return F.col(name) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name).cast("string")


def as_day(df: DataFrame, name: str) -> Column:
    if physical(df, name) == "date":
        return F.col(name)
    return F.try_to_date(F.substring(F.col(name), 1, 10), "yyyy-MM-dd")


def drop_summary_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(SUMMARY)).drop(SUMMARY) if SUMMARY in df.columns else df


def filter_condition(df: DataFrame, filters: list[dict], columns: dict[str, ColumnInfo], allowed: set[str] | None = None) -> Column | None:
    """One condition for all filters (ANDed), or None when there are none."""
    if not filters:
        return None
    if len(filters) > MAX_FILTERS_PER_REQUEST:
        raise SpecError(f"at most {MAX_FILTERS_PER_REQUEST} filters")
    parts: list[Column] = []
    for item in filters:
        info = columns.get(item.get("column"))
        if info is None or (allowed is not None and info.name not in allowed):
            raise SpecError(f"filter on unknown column {item.get('column')!r}")
        if "values" in item:
            parts.append(_in_values(df, info, item["values"]))
        elif "from" in item or "to" in item:
            parts.extend(_in_dates(df, info, item.get("from"), item.get("to")))
        elif "min" in item or "max" in item:
            parts.extend(_in_range(df, info, item.get("min"), item.get("max")))
        else:
            raise SpecError("a filter needs values, from/to or min/max")
    return reduce(lambda a, b: a & b, parts) if parts else None


def _in_values(df: DataFrame, info: ColumnInfo, values) -> Column:
    if not isinstance(values, (list, tuple)) or not 1 <= len(values) <= V.OPTION_VALUES or not all(isinstance(v, str) for v in values):
        raise SpecError(f"a category filter takes 1 to {V.OPTION_VALUES} texts")
    return text_form(df, info.name).isin(list(values))


def _in_dates(df: DataFrame, info: ColumnInfo, low, high) -> list[Column]:
    if info.role != "time" and info.data_type != "date":
        raise SpecError(f"{info.name} is not a date column")
    for bound in (low, high):
        if bound not in (None, "") and not (isinstance(bound, str) and DAY.match(bound)):
            raise SpecError("dates are written YYYY-MM-DD")
    if info.time_format == "year_month":
        value = F.substring(F.col(info.name), 1, 7)
        return ([value >= low[:7]] if low else []) + ([value <= high[:7]] if high else [])
    # Half-open bounds on the stored value keep the filter inside the Parquet scan.
    value = as_day(df, info.name)
    out = []
    if low:
        out.append(value >= F.lit(date.fromisoformat(low)))
    if high:
        out.append(value < F.lit(date.fromisoformat(high) + timedelta(days=1)))
    return out


def _in_range(df: DataFrame, info: ColumnInfo, low, high) -> list[Column]:
    value, out = numeric(df, info.name), []
    for bound, test in ((low, value.__ge__), (high, value.__le__)):
        if bound is None:
            continue
        if isinstance(bound, bool) or not isinstance(bound, (int, float)) or not math.isfinite(bound):
            raise SpecError("number bounds must be finite numbers")
        out.append(test(F.lit(bound)))
    return out


def apply_filters(df: DataFrame, filters: list[dict], columns: dict[str, ColumnInfo], allowed: set[str] | None = None) -> DataFrame:
    condition = filter_condition(df, filters, columns, allowed)
    return df if condition is None else df.filter(condition)


def aggregate(df: DataFrame, agg: str, name: str | None) -> Column:
    """count(*) when no column is named; numeric aggregates look at numbers only."""
    if name is None:
        return F.count(F.lit(1))
    if agg == "count":
        return F.count(F.col(name))
    if agg == "count_distinct":
        return F.count_distinct(F.col(name))
    value = numeric(df, name).cast("double")
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg](value)


def grain_for_span(days: int | None) -> str:
    if days is None:
        return "month"
    return next((grain for grain, longest in GRAIN_SPANS if days <= longest), "year")


def default_grain(df: DataFrame, info: ColumnInfo) -> str:
    """Grain that suits the span of the (already filtered) dates; reads one row."""
    if info.time_format == "year_month":
        return "month"
    day = as_day(df, info.name).cast("date")
    low, high = df.agg(F.min(day), F.max(day)).first()
    return grain_for_span((high - low).days if low and high else None)


def bucket_label(df: DataFrame, info: ColumnInfo, grain: str) -> Column:
    if info.time_format == "year_month":
        month = F.substring(F.col(info.name), 1, 7)
        if grain == "year":
            return F.substring(month, 1, 4)
        if grain == "quarter":
            return F.concat(F.substring(month, 1, 4), F.lit("-Q"), F.ceil(F.substring(month, 6, 2).cast("int") / 3).cast("string"))
        return month
    return time_bucket(as_day(df, info.name), grain)
