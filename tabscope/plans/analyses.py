"""Which analyses suit a table, and running them so that one failure stays alone."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.values import cell_number
from tabscope.operators import patterns, profile, tiles
from tabscope.operators.aggregates import numeric, physical

# Eligibility thresholds.
OUTLIER_VALUES, HISTOGRAM_VALUES, DISTINCT_NUMBERS = 8, 10, 3
GROUPED_DIMENSIONS, GROUPED_MEASURES, TREND_MEASURES = 4, 2, 3
PAIR_ROWS = 10


@dataclass(frozen=True)
class Analysis:
    id: str
    type: str
    columns: tuple[str, ...]


def eligible_analyses(df: DataFrame) -> list[Analysis]:
    """Plans in rule order.  Only profile rows, one per column, come to the driver."""
    rows = profile.profile_strict(df).orderBy("position").collect()
    measures = [r for r in rows if r["role"] == "measure"]
    groups = [r["column"] for r in rows if r["role"] == "dimension" and 2 <= r["unique"] <= 30]
    times = [r["column"] for r in rows if r["role"] == "time_dimension" and r["unique"] >= 3]
    names = [m["column"] for m in measures]
    numbers = {n: _number(df, n) for n in names}
    distinct = df.agg(*[F.count_distinct(numbers[n]).alias(f"u{i}") for i, n in enumerate(names)]).first() if names else []
    plans: list[tuple[str, tuple[str, ...]]] = [("quality", tuple(r["column"] for r in rows))]
    for i, m in enumerate(measures):
        plans.append(("statistics", (m["column"],)))
        if m["valid_count"] >= OUTLIER_VALUES and distinct[i] >= DISTINCT_NUMBERS:
            plans.append(("outliers", (m["column"],)))
        if m["valid_count"] >= HISTOGRAM_VALUES and distinct[i] >= DISTINCT_NUMBERS:
            plans.append(("distribution", (m["column"],)))
    for g in groups[:GROUPED_DIMENSIONS]:
        plans.append(("frequency", (g,)))
        plans.extend(("category", (g, n)) for n in names[:GROUPED_MEASURES])
    for t in times[:1]:
        plans.extend(("trend", (t, n)) for n in names[:TREND_MEASURES])
    pairs = list(combinations(names[:patterns.CLASSIC_MEASURES], 2))
    if pairs:
        checks = []
        for i, (a, b) in enumerate(pairs):
            both = numbers[a].isNotNull() & numbers[b].isNotNull()
            checks.append(F.struct(F.count_if(both).alias("n"), F.min(F.when(both, numbers[a])).alias("a0"), F.max(F.when(both, numbers[a])).alias("a1"),
                                   F.min(F.when(both, numbers[b])).alias("b0"), F.max(F.when(both, numbers[b])).alias("b1")).alias(f"p{i}"))
        facts = df.agg(*checks).first()
        plans.extend(("correlation", pair) for pair, f in zip(pairs, facts) if f["n"] >= PAIR_ROWS and f["a0"] < f["a1"] and f["b0"] < f["b1"])
    return [Analysis(f"A-{i:02d}", kind, columns) for i, (kind, columns) in enumerate(plans, 1)]


def _number(df: DataFrame, name: str):
    return F.col(name).cast("double") if physical(df, name) == "number" else cell_number(name)


def eligible_table(df: DataFrame) -> DataFrame:
    plans = eligible_analyses(df)
    return df.sparkSession.createDataFrame([(p.id, p.type, ", ".join(p.columns)) for p in plans], "id string, type string, columns string")


def _typed(df: DataFrame, plan: Analysis) -> DataFrame:
    """Text cells of the analysed number columns as numbers."""
    for name in plan.columns:
        if plan.type != "quality" and name in plan.columns[-2:] and physical(df, name) == "text" and (
                plan.type in ("statistics", "outliers", "distribution", "correlation") or (plan.type in ("category", "trend") and name == plan.columns[-1])):
            df = df.withColumn(name, cell_number(name))
    return df


RUNNERS = {
    "quality": lambda df, c: profile.table_profile(df, "table"),
    "statistics": lambda df, c: profile.profile_columns(df.select(*c)),
    "outliers": lambda df, c: profile.iqr_outlier_rows(df, c[0]),
    "distribution": lambda df, c: tiles.histogram(df, c[0], "classic"),
    "frequency": lambda df, c: patterns.frequency(df, c[0]),
    "category": lambda df, c: patterns.category_mean(df, c[0], c[1]),
    "trend": lambda df, c: patterns.monthly_trend(df, c[0], c[1]),
    "correlation": lambda df, c: patterns.correlations(df, list(c), "classic"),
}


def run_analyses(df: DataFrame, plans: list[Analysis], runners: dict | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """({id: result}, [(id, message)]).  A plan that fails is reported and the rest go on."""
    results, errors = {}, []
    for plan in plans:
        try:
            results[plan.id] = (runners or RUNNERS)[plan.type](_typed(df, plan), plan.columns)
        except Exception as error:  # the contract: one failing analysis never costs the others
            errors.append((plan.id, str(error)))
    return results, errors


__all__ = ["Analysis", "eligible_analyses", "eligible_table", "run_analyses", "numeric"]
