"""Writing tables out: safe CSV, report tables, detected tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.columns import ROW, ColumnInfo
from tabscope.operators import patterns, profile

# Fixed value: what makes a spreadsheet read text as a formula.
FORMULA_START = r"^[\s\p{Cc}\p{Cf}]*[=+\-@]"


def csv_safe(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("(?U)" + FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def safe_name(name: str) -> str:
    probe = name.lstrip()
    return "'" + name if probe[:1] in ("=", "+", "-", "@") else name


def write_csv_safe(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with texts and headers a spreadsheet cannot run as formulas."""
    out = df.select(*[(csv_safe(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(safe_name(f.name)) for f in df.schema.fields])
    out.write.mode(mode).option("header", "true").option("escape", '"').option("encoding", "UTF-8").csv(path)


def report_tables(df: DataFrame, columns: dict[str, ColumnInfo], name: str) -> dict[str, DataFrame]:
    """Flat report tables: overview, kpis, insights, quality, columns, charts."""
    facts = profile.table_profile(df, name)
    found = patterns.select_insights(patterns.insights(df, columns, name))
    groups = [c.name for c in columns.values() if c.data_type in ("text", "boolean", "mixed") and 1 < c.unique_count <= patterns.MAX_CATEGORIES]
    charts = [patterns.frequency(df, g).select(F.lit(f"share of {g}").alias("chart"), F.col("label").alias("x"), F.col("count").cast("double").alias("y")) for g in groups[:2]]
    points = charts[0] if charts else df.sparkSession.createDataFrame([], "chart string, x string, y double")
    for part in charts[1:]:
        points = points.unionByName(part)
    return {
        "overview": facts.select("table", "rows_count", "columns_count"),
        "kpis": patterns.overview_kpis(df, columns, name),
        "insights": found.select("id", "importance", "kind", "title", "evidence.metric", "evidence.value", "evidence.method", "evidence.columns"),
        "quality": facts.select("table", "rows_count", "duplicate_rows", "missing_count", "missing_percentage"),
        "columns": profile.profile_columns(df).drop("position", "fractional", "clock"),
        "charts": points,
    }


def save_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table under its own folder, with its original row numbers; columns keep their types."""
    for table_id, df in tables.items():
        if ROW not in df.columns:
            raise ValueError(f"{table_id} has no {ROW} column")
        df.write.mode("overwrite").parquet(f"{path}/table_id={table_id}")


def load_table(spark, path: str, table_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table_id={table_id}")
