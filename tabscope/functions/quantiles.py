"""Exact quantiles (linear interpolation) without gathering a column in one task.

Spark's exact ``percentile`` keeps every distinct value of its columns in one task,
which is fine up to a few million values and not beyond.  Above that size a sketch
brackets every wanted position, one more scan keeps only the values inside the
brackets (a few rows in ten thousand), and those are ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.ordered import running

ONE_BUFFER_VALUES = 4_000_000
ACCURACY = 10_000
SLACK = 10 / ACCURACY
SUB_BUCKETS = 1024


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], one_buffer_values: int = ONE_BUFFER_VALUES) -> DataFrame:
    """One row per column: ``column, n`` and ``q0, q1, …`` in the order of ``probabilities``.

    A column without values has null quantiles.
    """
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    names = [f"q{j}" for j in range(len(probabilities))]
    counts = values.agg(*[F.count(f"v{i}").alias(f"v{i}") for i in range(len(columns))]).first()
    if sum(counts) <= one_buffer_values:
        wide = values.agg(F.array(*[F.struct(
            F.lit(c).alias("column"), F.count(f"v{i}").alias("n"),
            F.percentile(f"v{i}", F.array(*[F.lit(float(p)) for p in probabilities])).alias("q")) for i, c in enumerate(columns)]).alias("a"))
        return (wide.select(F.explode("a").alias("x"))
                .select("x.column", "x.n", *[F.col("x.q")[j].alias(name) for j, name in enumerate(names)]))
    return _bracketed(values, columns, probabilities, list(counts), names)


def _bracketed(values: DataFrame, columns: list[str], probabilities: list[float], counts: list[int], names: list[str]) -> DataFrame:
    marks = [m for p in probabilities for m in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
    sketch = values.agg(*[F.percentile_approx(f"v{i}", marks, ACCURACY).alias(f"v{i}") for i in range(len(columns))]).first()
    wanted = [(i, j, float(sketch[i][2 * j]), float(sketch[i][2 * j + 1]))
              for i in range(len(columns)) if counts[i] for j in range(len(probabilities))]
    below = values.agg(*[F.count(F.when(F.col(f"v{i}") < lo, 1)).alias(f"b{k}") for k, (i, _, lo, _) in enumerate(wanted)]).first()
    inside = (values.select(F.explode(F.filter(F.array(*[
        F.when(F.col(f"v{i}").between(lo, hi), F.struct(F.lit(k).alias("k"), F.col(f"v{i}").alias("v")))
        for k, (i, _, lo, hi) in enumerate(wanted)]), lambda x: x.isNotNull())).alias("x"))
        .select("x.*").groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")))

    def known(items: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in items]), F.col("k") + 1)

    span = known([hi - lo for _, _, lo, hi in wanted], "double")
    part = F.when(span > 0, F.floor((F.col("v") - known([w[2] for w in wanted], "double")) / span * SUB_BUCKETS)).otherwise(F.lit(0))
    ranked = running(inside, ["k"], "v", sums={"upto": F.col("c")}, block=part.cast("bigint"))
    placed = (ranked.withColumn("pos", known([(counts[i] - 1) * probabilities[j] for i, j, _, _ in wanted], "double"))
              .withColumn("last", known(list(below), "bigint") + F.col("upto") - 1)
              .withColumn("first", F.col("last") - F.col("c") + 1))
    lower = F.floor("pos")
    upper = F.least(lower + 1, known([counts[i] - 1 for i, _, _, _ in wanted], "bigint"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("first")) & (rank <= F.col("last")), F.col("v")))

    part_of = F.max(F.col("pos") - lower)
    picked = (placed.groupBy("k").agg(at(lower).alias("a"), at(upper).alias("b"), part_of.alias("f"))
              .withColumn("q", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("quantile bracket missed its position")).cast("double"))
                          .otherwise(F.col("a") * (1 - F.col("f")) + F.col("b") * F.col("f"))))
    column = known([columns[i] for i, _, _, _ in wanted], "string")
    wide = (picked.withColumn("column", column).withColumn("j", known([j for _, j, _, _ in wanted], "int"))
            .groupBy("column").agg(*[F.max(F.when(F.col("j") == j, F.col("q"))).alias(name) for j, name in enumerate(names)]))
    # One row per column: as many as the table is wide.
    base = values.sparkSession.createDataFrame(list(zip(columns, counts)), "column string, n bigint")
    return base.join(F.broadcast(wide), "column", "left")
