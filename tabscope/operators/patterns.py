"""Patterns in one table: frequencies, category means, trends, correlations, insights."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.columns import ROW, ColumnInfo
from tabscope.functions.ordered import every_nth, rows_at_ranks
from tabscope.operators.aggregates import as_day, drop_summary_rows, numeric
from tabscope.operators.profile import duplicate_rows, profile_columns, shorten, table_profile

# Limits of the pattern rules.
MAX_CATEGORIES = 30
DONUT_GROUPS = 6
CORRELATED_MEASURES = 6
CLASSIC_MEASURES = 5
SAMPLE_POINTS = 200
MAX_INSIGHTS, MAX_CHARTS, MAX_KPIS = 24, 12, 6
DAY_SPAN, MONTH_SPAN, YEAR_BLOCKS = 60, 365 * 5, 60


def frequency(df: DataFrame, column: str) -> DataFrame:
    """``label, count, share, chart`` for a column of up to 30 categories (none beyond)."""
    groups = (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("count")))
    whole = groups.agg(F.struct(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("n")).alias("w")).scalar()
    return (groups.withColumn("_w", whole).filter(F.col("_w.n") <= MAX_CATEGORIES)
            .select(shorten(F.col("label")).alias("label"), "count", (F.col("count") / F.col("_w.rows") * 100).alias("share"),
                    F.when(F.col("_w.n") <= DONUT_GROUPS, "donut").otherwise("bar").alias("chart")))


def category_mean(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """``label, mean, count`` over complete pairs, largest mean first."""
    value = numeric(df, measure).cast("double")
    return (df.filter(F.col(dimension).isNotNull() & value.isNotNull()).groupBy(F.col(dimension).cast("string").alias("label"))
            .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("count")).orderBy(F.col("mean").desc(), "label"))


def best_and_worst(means: DataFrame) -> DataFrame:
    """``best, best_mean, worst, worst_mean, groups`` of a ``category_mean`` table."""
    return means.agg(F.max_by("label", F.struct("mean", "label")).alias("best"), F.max("mean").alias("best_mean"),
                     F.min_by("label", F.struct("mean", "label")).alias("worst"), F.min("mean").alias("worst_mean"), F.count(F.lit(1)).alias("groups"))


def trend_unit(first, last) -> tuple[str, int]:
    """(unit, years per block) for the span of two dates."""
    days = (last - first).days
    unit = "day" if days <= DAY_SPAN else "month" if days <= MONTH_SPAN else "year"
    return unit, max(1, math.ceil((last.year - first.year + 1) / YEAR_BLOCKS))


def trend(df: DataFrame, time: str, measure: str) -> DataFrame:
    """``period, mean, count, unit``: mean by day, month or N-year block; gaps stay gaps."""
    day, value = as_day(df, time), numeric(df, measure).cast("double")
    first, last = df.agg(F.min(day), F.max(day)).first()
    if first is None:
        return df.sparkSession.createDataFrame([], "period string, mean double, count bigint, unit string")
    unit, step = trend_unit(first, last)
    if unit == "year":
        start = F.floor((F.year(day) - 1) / step) * step + 1
        label = F.lpad(start.cast("string"), 4, "0") if step == 1 else F.format_string("%04d–%04d", start, start + (step - 1))
    else:
        label = F.date_format(day, "yyyy-MM-dd" if unit == "day" else "yyyy-MM")
    return (df.filter(day.isNotNull() & value.isNotNull()).groupBy(label.alias("period")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("count"))
            .withColumn("unit", F.lit(unit)).orderBy("period"))


def monthly_trend(df: DataFrame, time: str, measure: str) -> DataFrame:
    """``period, mean, count, missing_months``: monthly means and how many months lie empty between the ends."""
    day, value = as_day(df, time), numeric(df, measure).cast("double")
    months = (df.filter(day.isNotNull() & value.isNotNull()).groupBy((F.year(day) * 12 + F.month(day)).alias("m"), F.date_format(day, "yyyy-MM").alias("period"))
              .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("count")))
    missing = months.agg((F.max("m") - F.min("m") + 1 - F.count(F.lit(1))).alias("x")).scalar()
    return months.drop("m").withColumn("missing_months", missing).orderBy("period")


def trend_change(points: DataFrame) -> DataFrame:
    """``first_period, last_period, metric, value`` from a trend: relative to the size of
    the first mean, or absolute when that is zero.  No row below two periods."""
    ends = points.agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.min_by("mean", "period").alias("a"),
                      F.max_by("mean", "period").alias("b"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return ends.select("first_period", "last_period",
                       F.when(F.col("a") != 0, "first_to_last_mean_change_pct").otherwise("last_minus_first_mean").alias("metric"),
                       F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.abs("a") * 100).otherwise(F.col("b") - F.col("a")).alias("value"))


def correlations(df: DataFrame, measures: list[str], rule: str = "overview") -> DataFrame:
    """``x, y, r, n`` of every pair, complete rows only, strongest first; one scan.

    overview: first 6 columns that vary, n >= 3.  classic: first 5, n >= 10 and both sides vary."""
    spark = df.sparkSession
    values = df.select(*[numeric(df, m).cast("double").alias(m) for m in measures])
    if rule == "overview":
        ends = values.agg(*[F.struct(F.min(f"`{m}`").alias("a"), F.max(f"`{m}`").alias("b")).alias(m) for m in measures]).first()
        kept = [m for m in measures if ends[m]["a"] is not None and ends[m]["b"] > ends[m]["a"]][:CORRELATED_MEASURES]
        least = 3
    else:
        kept, least = measures[:CLASSIC_MEASURES], 10
    pairs = list(combinations(kept, 2))
    if not pairs:
        return spark.createDataFrame([], "x string, y string, r double, n bigint")
    columns = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
        x, y = F.when(both, F.col(f"`{a}`")), F.when(both, F.col(f"`{b}`"))
        # corr() itself divides by zero under ANSI rules when a side does not vary.
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        columns.append(F.struct(F.lit(i).alias("i"), F.lit(a).alias("x"), F.lit(b).alias("y"), F.count_if(both).alias("n"), r.alias("r")).alias(f"p{i}"))
    wide = values.agg(*columns)
    return (wide.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")
            .filter((F.col("n") >= least) & F.col("r").isNotNull())
            .select("x", "y", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r")).alias("r"), "n").orderBy(F.abs("r").desc(), "x", "y"))


def systematic_sample(df: DataFrame, x: str, y: str, points: int = SAMPLE_POINTS) -> DataFrame:
    """Every ceil(rows/200)-th row by position, kept when both values are numbers."""
    rows = df.select(ROW, numeric(df, x).cast("double").alias("x"), numeric(df, y).cast("double").alias("y"))
    return rows_at_ranks(rows, ROW, lambda n: every_nth(n, points), points).filter("x is not null and y is not null").drop("_rank")


def round_robin(df: DataFrame, group: str, order: list, limit: int, group_order=None) -> DataFrame:
    """First of every group, then second of every group, … up to ``limit`` rows, with ``turn``."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    # No group can contribute more than `limit`, so the rank is pruned before the shuffle.
    ranked = df.withColumn("turn", turn).filter(F.col("turn") <= limit)
    return ranked.orderBy("turn", group_order if group_order is not None else F.col(group)).limit(limit)


def _insight(kind, title, metric, value, columns, method, importance="medium"):
    lit = lambda x: F.lit(x) if not hasattr(x, "alias") else x
    return [lit(kind).alias("kind"), lit(title).alias("title"), lit(importance).alias("importance"), F.struct(
        lit(metric).alias("metric"), lit(value).cast("double").alias("value"), lit(method).alias("method"), lit(columns).alias("columns")).alias("evidence")]


def insights(df: DataFrame, columns: dict[str, ColumnInfo], table: str = "table") -> DataFrame:
    """``seq, kind, title, importance, evidence``: findings of one table in rule order."""
    df = drop_summary_rows(df)
    measures = [c.name for c in columns.values() if c.role == "measure"]
    dimensions = [c.name for c in columns.values() if c.data_type in ("text", "boolean", "mixed") and 1 < c.unique_count <= MAX_CATEGORIES and c.role != "measure"]
    times = [c.name for c in columns.values() if c.role == "time" and c.time_format == "iso"]
    parts: list[DataFrame] = []
    for name in reversed(measures[:2]):
        for t in times[:1]:
            change = trend_change(trend(df, t, name))
            parts.append(change.select(*_insight("trend", f"{name} over time", F.col("metric"), F.col("value"), f"{t}, {name}", "mean per period, last against first", "high")))
    quality = table_profile(df, table)
    parts.append(quality.filter("missing_count > 0 or duplicate_rows > 0").select(*_insight(
        "quality", f"data quality of {table}", "missing_percentage", F.col("missing_percentage"), ", ".join(columns), "missing cells over all cells",
        F.when(F.col("missing_percentage") >= 10, "high").otherwise("medium"))))
    if measures:
        profile = profile_columns(df.select(*measures))
        for name in measures:
            row = profile.filter(F.col("column") == name)
            parts.append(row.filter("outliers > 0").select(*_insight("anomaly", f"unusual values in {name}", "iqr_outlier_count", F.col("outliers"), name, "outside 1.5 IQR", "high")))
            parts.append(row.filter("count >= 2").select(*_insight("distribution", f"distribution of {name}", "median", F.col("median"), name, "all numbers of the column", "low")))
    for name in dimensions[:2]:
        top = frequency(df, name).orderBy(F.col("count").desc(), "label").limit(1)
        parts.append(top.select(*_insight("segment", F.concat(F.lit(f"largest group of {name}: "), "label"), "top_category_count", F.col("count"), name, "rows per group")))
    for name in measures[:2]:
        for d in dimensions[:1]:
            best = best_and_worst(category_mean(df, d, name)).filter("groups >= 2")
            parts.append(best.select(*_insight("segment", F.concat(F.lit(f"highest mean {name} by {d}: "), "best"), "highest_category_mean", F.col("best_mean"), f"{d}, {name}", "mean of complete pairs")))
    if len(measures) > 1:
        strongest = correlations(df, measures).limit(2)
        parts.append(strongest.select(*_insight("relationship", F.concat("x", F.lit(" and "), "y"), "pearson_r", F.col("r"), F.concat_ws(", ", "x", "y"), "Pearson, complete pairs")))
    numbered = [p.select((F.lit(i * 10) + F.monotonically_increasing_id() * 0).alias("seq"), "*") for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def select_insights(found: DataFrame, limit: int = MAX_INSIGHTS) -> DataFrame:
    """Numbered ``EV-001…``: one of every kind before a second of any kind."""
    firsts = found.groupBy("kind").agg(F.min("seq").alias("first_seq"))
    ranked = round_robin(found.join(F.broadcast(firsts), "kind"), "kind", [F.col("seq"), F.abs(F.col("evidence.value")).desc()], limit, F.col("first_seq"))  # at most six kinds
    position = F.row_number().over(Window.orderBy("turn", "first_seq"))  # at most `limit` rows
    return ranked.select(F.format_string("EV-%03d", position).alias("id"), "kind", "title", "importance", "evidence")


def overview_kpis(df: DataFrame, columns: dict[str, ColumnInfo], table: str = "table") -> DataFrame:
    """``seq, name, value``: rows, completeness, and the mean of two measures or a group count."""
    df = drop_summary_rows(df)
    measures = [c.name for c in columns.values() if c.role == "measure"][:2]
    dimensions = [c.name for c in columns.values() if c.data_type in ("text", "boolean", "mixed") and 1 < c.unique_count <= MAX_CATEGORIES]
    base = table_profile(df, table).select(
        F.col("rows_count").cast("double").alias("rows"), (100 - F.col("missing_percentage")).alias("complete"))
    items = [F.struct(F.lit(1).alias("seq"), F.lit("rows").alias("name"), F.col("rows").alias("value")),
             F.struct(F.lit(2).alias("seq"), F.lit("completeness").alias("name"), F.round("complete", 4).alias("value"))]
    out = base.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    if measures:
        means = df.agg(*[F.avg(numeric(df, m).cast("double")).alias(m) for m in measures])
        out = out.unionByName(means.select(F.explode(F.array(*[
            F.struct(F.lit(3 + i).alias("seq"), F.lit(f"mean {m}").alias("name"), F.col(f"`{m}`").alias("value")) for i, m in enumerate(measures)])).alias("x")).select("x.*"))
    elif dimensions:
        groups = df.agg(F.count_distinct(F.col(dimensions[0])).cast("double").alias("value"))
        out = out.unionByName(groups.select(F.lit(3).alias("seq"), F.lit(f"groups of {dimensions[0]}").alias("name"), "value"))
    return out


__all__ = ["frequency", "category_mean", "best_and_worst", "trend", "monthly_trend", "trend_change", "correlations", "systematic_sample",
           "round_robin", "insights", "select_insights", "overview_kpis", "duplicate_rows"]
