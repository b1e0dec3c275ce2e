"""Dashboard tiles: figures, time series, ranked categories, histograms, scatter, options."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.columns import ROW, SUMMARY, ColumnInfo
from tabscope.functions import vocabulary as V
from tabscope.functions.ordered import every_nth, rows_at_ranks
from tabscope.functions.quantiles import exact_quantiles
from tabscope.functions.values import number_text
from tabscope.operators.aggregates import (aggregate, as_day, bucket_label, default_grain, drop_summary_rows, filter_condition, numeric, text_form)


def kpis(df: DataFrame, items: list[dict], columns: dict[str, ColumnInfo]) -> DataFrame:
    """All figures of a dashboard: ``id, agg, column, value``.  One scan computes every
    aggregate; medians share one quantile pass."""
    plain = [i for i in items if i["agg"] != "median"]
    medians = [i for i in items if i["agg"] == "median"]
    parts = []
    if plain:
        wide = df.agg(*[aggregate(df, i["agg"], i.get("column")).cast("double").alias(i["id"]) for i in plain])
        parts.append(wide.select(F.explode(F.array(*[F.struct(
            F.lit(i["id"]).alias("id"), F.lit(i["agg"]).alias("agg"), F.lit(i.get("column")).cast("string").alias("column"),
            F.col(i["id"]).alias("value")) for i in plain])).alias("x")).select("x.*"))
    if medians:
        numbers = df.select(*[numeric(df, i["column"]).cast("double").alias(i["id"]) for i in medians])
        names = df.sparkSession.createDataFrame([(i["id"], i["column"]) for i in medians], "id string, column string")
        q = exact_quantiles(numbers, [i["id"] for i in medians], [.5]).select(F.col("column").alias("id"), F.col("q0").alias("value"))
        parts.append(names.join(q, "id").select("id", F.lit("median").alias("agg"), "column", "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def row_counts(df: DataFrame, filters: list[dict], columns: dict[str, ColumnInfo]) -> DataFrame:
    """``rows_total, rows_matched, summary_rows_excluded`` in one pass."""
    summary = F.col(SUMMARY) if SUMMARY in df.columns else F.lit(False)
    condition = filter_condition(df, filters, columns)
    matched = ~summary if condition is None else ~summary & F.coalesce(condition, F.lit(False))
    return df.agg(F.count_if(~summary).alias("rows_total"), F.count_if(matched).alias("rows_matched"),
                  F.count_if(summary).alias("summary_rows_excluded"))


def time_series(df: DataFrame, x: ColumnInfo, y: str | None, agg: str, grain: str | None = None, max_points: int = V.MAX_TIME_POINTS) -> DataFrame:
    """``x, y, grain``: the asked (or default) grain, coarsened until at most 400 points.

    One scan aggregates to the finest grain; coarser grains are rolled up from that,
    so trying several costs nothing more."""
    start = grain or default_grain(df, x)
    month_only = x.time_format == "year_month"
    if month_only and start in ("day", "week"):
        start = "month"
    finest = bucket_label(df, x, "month").alias("_d") if month_only else as_day(df, x.name).cast("date").alias("_d")
    value = F.lit(1) if y is None else F.col(y) if agg == "count" else numeric(df, y).cast("double")
    fine = (df.groupBy(finest).agg(F.count(value).alias("n"), *([] if agg == "count" or y is None else [
        F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi")])).filter(F.col("_d").isNotNull()))
    choices = V.GRAINS[V.GRAINS.index(start):]
    day = ColumnInfo("_d", "text" if month_only else "date", "time", "date", None, x.time_format)
    counted = fine.agg(*[F.count_distinct(bucket_label(fine, day, g)).alias(g) for g in choices]).first()
    chosen = next((g for g in choices if counted[g] <= max_points), choices[-1])
    rolled = {"count": F.sum("n"), "sum": F.sum("s"), "avg": F.sum("s") / F.sum("n"), "min": F.min("lo"), "max": F.max("hi")}
    if y is None:
        agg = "count"
    points = fine.groupBy(bucket_label(fine, day, chosen).alias("x")).agg(
        (F.when(F.sum("n") > 0, rolled[agg]) if agg == "avg" else rolled[agg]).alias("y"))
    return points.filter(F.col("y").isNotNull()).withColumn("grain", F.lit(chosen)).orderBy("x").limit(max_points + 1)


def top_categories(df: DataFrame, x: str, y: str | None, agg: str, n: int = 12, kind: str = "bar", others: bool = True) -> DataFrame:
    """``x, y, groups_total, is_others``: largest groups, then one remainder row for
    sums and counts when groups were cut."""
    n = max(3, min(8 if kind == "donut" else 30, n))
    groups = (df.groupBy(text_form(df, x).alias("x")).agg(aggregate(df, agg, y).cast("double").alias("y")).filter(F.col("x").isNotNull()))
    shown = groups.filter(F.col("y").isNotNull()).orderBy(F.col("y").desc(), F.col("x").asc()).limit(n)
    whole = groups.agg(F.struct(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("total")).alias("w")).scalar()
    result = shown.withColumn("groups_total", whole["groups"]).withColumn("is_others", F.lit(False))
    if not others or agg not in ("sum", "count"):
        return result
    rest = (shown.agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("c")).withColumn("w", whole)
            .filter(F.col("w.groups") > F.col("c"))
            .select(F.concat(F.lit("Others ("), F.format_number(F.col("w.groups") - F.col("c"), 0), F.lit(" groups)")).alias("x"),
                    (F.col("w.total") - F.col("s")).alias("y"), F.col("w.groups").alias("groups_total"), F.lit(True).alias("is_others")))
    return result.unionByName(rest)


def bin_count(rule: str, n: int, constant: bool) -> int:
    """Number of bins.  Fixed rules: dashboard 5–20, overview 3–10 (rounded up), classic 3–10 (rounded down)."""
    root = math.sqrt(n)
    if rule == "dashboard":
        return 1 if constant else max(5, min(20, math.ceil(root)))
    return min(10, max(3, math.ceil(root) if rule == "overview" else int(root)))


def histogram(df: DataFrame, column: str, rule: str = "dashboard") -> DataFrame:
    """``bin, x_from, x_to, label, y`` with empty bins kept; no rows when the rule does not apply.

    overview needs at least 5 values and max > min; classic needs 10 values and 3 distinct."""
    value = numeric(df, column).cast("double")
    few = df.select(value.alias("v")).filter("v is not null")
    n, low, high = few.agg(F.count("v"), F.min("v"), F.max("v")).first()
    eligible = n > 0
    if rule == "overview":
        eligible = n >= 5 and high > low
    elif rule == "classic":
        eligible = n >= 10 and high > low and few.distinct().limit(3).count() >= 3
    bins = bin_count(rule, n, low == high) if eligible else 0
    scale = (max(abs(low), abs(high)) or 1.0) if rule == "overview" and eligible else 1.0
    first = (low / scale) if eligible else 0.0
    width = ((high / scale - first) / bins or 1.0) if eligible else 1.0
    position = F.floor((F.col("v") / F.lit(scale) - F.lit(first)) / F.lit(width))
    counted = few.groupBy(F.greatest(F.lit(0), F.least(F.lit(max(bins - 1, 0)), position)).alias("bin")).agg(F.count(F.lit(1)).alias("y"))
    axis = (df.sparkSession.range(bins).select(F.col("id").alias("bin"))
            .withColumn("x_from", (F.lit(first) + F.col("bin") * F.lit(width)) * F.lit(scale))
            .withColumn("x_to", (F.lit(first) + (F.col("bin") + 1) * F.lit(width)) * F.lit(scale)))
    return (axis.join(F.broadcast(counted.limit(32)), "bin", "left")  # at most 20 bins
            .select("bin", "x_from", "x_to", F.concat(number_text("x_from"), F.lit(" – "), number_text("x_to")).alias("label"),
                    F.coalesce("y", F.lit(0)).alias("y")))


def scatter(df: DataFrame, x: str, y: str, points: int = V.SCATTER_POINTS) -> DataFrame:
    """``x, y, points_total, sampled``: every k-th complete pair in row order, at most 500."""
    pairs = (df.select(F.col(ROW), numeric(df, x).cast("double").alias("x"), numeric(df, y).cast("double").alias("y"))
             .filter("x is not null and y is not null"))
    total = pairs.count()
    picked = rows_at_ranks(pairs, ROW, lambda n: every_nth(n, points), points)
    return picked.select(ROW, "x", "y", F.lit(total).alias("points_total"), F.lit(total > points).alias("sampled"))


def filter_options(df: DataFrame, items: list[dict], columns: dict[str, ColumnInfo]) -> DataFrame:
    """Choices for each filter: ``id, kind, value, count, total, min, max``."""
    def blank(kind):
        return F.lit(None).cast(kind)
    parts = []
    for item in items:
        info = columns[item["column"]]
        head = [F.lit(item["id"]).alias("id"), F.lit(item["kind"]).alias("kind")]
        if item["kind"] == "category":
            groups = df.groupBy(text_form(df, info.name).alias("value")).agg(F.count(F.lit(1)).alias("count")).filter("value is not null")
            parts.append(groups.orderBy(F.col("count").desc(), "value").limit(V.OPTION_VALUES)
                         .withColumn("total", groups.agg(F.count(F.lit(1)).alias("n")).scalar())
                         .select(*head, "value", "count", "total", blank("string").alias("min"), blank("string").alias("max"),
                                 blank("double").alias("low"), blank("double").alias("high")))
        elif item["kind"] == "date":
            label = bucket_label(df, info, "day")
            parts.append(df.agg(F.min(label).alias("min"), F.max(label).alias("max"))
                         .select(*head, blank("string").alias("value"), blank("bigint").alias("count"), blank("bigint").alias("total"),
                                 "min", "max", blank("double").alias("low"), blank("double").alias("high")))
        else:
            value = numeric(df, info.name).cast("double")
            parts.append(df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
                         .select(*head, blank("string").alias("value"), blank("bigint").alias("count"), blank("bigint").alias("total"),
                                 blank("string").alias("min"), blank("string").alias("max"), "low", "high"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_trace(tile: DataFrame, counts: DataFrame, table: str, sheet: str, column: str | None, agg: str | None,
               filtered: bool, group_by: str | None = None, cell_range: str | None = None) -> DataFrame:
    """Provenance columns on every row of a tile; ``counts`` comes from ``row_counts``."""
    used = counts.select(F.struct("rows_matched", "summary_rows_excluded")).scalar()
    return (tile.withColumn("_u", used)
            .select(*tile.columns, F.lit(sheet).alias("trace_sheet"), F.lit(table).alias("trace_table"),
                    F.lit(column).cast("string").alias("trace_column"), F.lit(agg).cast("string").alias("trace_agg"),
                    F.col("_u.rows_matched").alias("trace_rows"), F.col("_u.summary_rows_excluded").alias("trace_excluded"),
                    F.lit(filtered).alias("trace_filtered"), F.lit(group_by).cast("string").alias("trace_group_by"),
                    F.lit(cell_range).cast("string").alias("trace_range")))


def run_tile(df: DataFrame, chart: dict, columns: dict[str, ColumnInfo]) -> DataFrame:
    """The tile of one validated chart spec."""
    if chart["type"] in ("line", "area"):
        return time_series(df, columns[chart["x"]], chart.get("y"), chart["agg"], chart.get("grain"))
    if chart["type"] in V.CATEGORY_CHARTS:
        return top_categories(df, chart["x"], chart.get("y"), chart["agg"], chart["limit"], chart["type"])
    if chart["type"] == "histogram":
        return histogram(df, chart["x"])
    return scatter(df, chart["x"], chart["y"])


def run_dashboard(df: DataFrame, spec: dict, columns: dict[str, ColumnInfo], filters: list[dict] | None = None) -> dict:
    """Every figure and chart of a validated spec; a chart that fails does not sink the rest."""
    from tabscope.operators.aggregates import apply_filters
    from tabscope.plans.dashboard import referenced
    filters = filters or []
    rows = drop_summary_rows(df)
    kept = apply_filters(rows, filters, columns, referenced(spec))
    result = {"counts": row_counts(df, filters, columns), "kpis": kpis(kept, spec["kpis"], columns) if spec["kpis"] else None,
              "charts": {}, "errors": {}, "options": filter_options(rows, spec["filters"], columns) if spec["filters"] else None}
    for chart in spec["charts"]:
        try:
            result["charts"][chart["id"]] = run_tile(kept, chart, columns)
        except (ValueError, ArithmeticError) as error:
            result["errors"][chart["id"]] = str(error)
    return result
