"""Searching, sorting and paging stored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.columns import ROW, ColumnInfo, columns_from_schema, data_columns, physical_kind
from tabscope.functions.ordered import running_sorted
from tabscope.operators.aggregates import apply_filters

MAX_PAGE_SIZE = 100
# A sorted page this far in still fits one task; deeper pages rank in parallel.
SHALLOW_ROWS = 200_000


def search_rows(df: DataFrame, text: str = "", column: str | None = None, filters: list[dict] | None = None,
                columns: dict[str, ColumnInfo] | None = None) -> DataFrame:
    """Rows that hold ``text`` (any case, taken literally) in one or any column."""
    rows = apply_filters(df, filters or [], columns or columns_from_schema(df))
    if not text:
        return rows
    names = [column] if column else data_columns(df)
    needle = F.lower(F.lit(text))
    return rows.filter(reduce(lambda a, b: a | b, [
        F.coalesce(F.contains(F.lower(F.col(f"`{n}`").cast("string")), needle), F.lit(False)) for n in names]))


def sort_key(df: DataFrame, sort: str | None, direction: str = "asc"):
    """Order: text ignoring case, nulls last both ways, original row number on ties."""
    if not sort:
        return [F.col(ROW).asc()]
    key = F.lower(sort) if physical_kind(df.schema[sort].dataType) == "text" else F.col(sort)
    return [key.desc_nulls_last() if direction == "desc" else key.asc_nulls_last(), F.col(ROW).asc()]


def browse(df: DataFrame, text: str = "", column: str | None = None, sort: str | None = None, direction: str = "asc", page: int = 1,
           page_size: int = 25, filters: list[dict] | None = None, columns: dict[str, ColumnInfo] | None = None) -> DataFrame:
    """One page of the matching rows plus ``total_rows``."""
    if not 1 <= page <= 1_000_000 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError("page is 1 to 1,000,000 and page_size 1 to 100")
    if direction not in ("asc", "desc"):
        raise ValueError("direction is asc or desc")
    found = search_rows(df, text, column, filters, columns)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    order, skip = sort_key(df, sort, direction), (page - 1) * page_size
    if skip + page_size <= SHALLOW_ROWS:
        rows = found.orderBy(*order).offset(skip).limit(page_size)
    else:
        ranked = running_sorted(found.withColumn("_one", F.lit(1)), order, "_one", "_rank")
        rows = ranked.filter((F.col("_rank") > skip) & (F.col("_rank") <= skip + page_size)).drop("_one", "_rank")
    return rows.withColumn("total_rows", total)


def shorten_cells(page: DataFrame, max_characters: int | None = None) -> DataFrame:
    """Display copy of a page: long texts cut, with ``truncated_cells`` per row."""
    texts = [n for n in data_columns(page) if physical_kind(page.schema[n].dataType) == "text"]
    limit = max_characters or min(2000, max(20, 1_000_000 // (MAX_PAGE_SIZE * max(1, len(page.columns)) * 4)))
    cut = sum((F.when(F.length(f"`{n}`") > limit, 1).otherwise(0) for n in texts), F.lit(0))
    return page.select(*[F.when(F.length(f"`{n}`") > limit, F.concat(F.substring(F.col(f"`{n}`"), 1, limit - 1), F.lit("…"))).otherwise(F.col(f"`{n}`")).alias(n)
                         if n in texts else F.col(f"`{n}`") for n in page.columns], cut.alias("truncated_cells"))
