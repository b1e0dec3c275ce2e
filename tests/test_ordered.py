"""Block scans against the plain window they replace, with tiny blocks and a hot group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabscope.functions import ordered as O
from tabscope.functions.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data, r = [], 0
    for g, n in (("hot", 300), ("a", 20), ("b", 1)):
        r = 0
        for _ in range(n):
            r += rng.choice([1, 1, 1, 2, 9, 40])
            data.append((g, r, rng.choice([None, rng.randint(-5, 5)]), rng.random() < .1))
    return spark.createDataFrame(data, "g string, r bigint, v bigint, m boolean")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("through", [0, -1])
def test_running_matches_window(rows, through):
    w = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, through)
    got = O.running(rows, ["g"], "r", sums={"s": F.col("v")}, fills={"f": F.col("v")}, size=16, through=through).select("g", "r", F.coalesce("s", F.lit(0)).alias("s"), "f")
    want = rows.select("g", "r", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.last("v", ignorenulls=True).over(w).alias("f"))
    same(got, want)


def test_neighbours_match_window(rows):
    near = O.with_neighbours(rows, ["g"], "r", before=3, after=2, size=8)
    b, w = Window.partitionBy("g", "_blk").orderBy("r"), Window.partitionBy("g").orderBy("r")
    got = near.select("g", "r", F.lag("r", 3).over(b).alias("p"), F.lead("r", 2).over(b).alias("n"), "_halo").filter("not _halo").drop("_halo")
    same(got, rows.select("g", "r", F.lag("r", 3).over(w).alias("p"), F.lead("r", 2).over(w).alias("n")))


def test_latest_mark_matches_window(rows):
    marks = rows.filter("m").select("g", "r", F.col("r").alias("at"))
    w = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    got = O.latest_mark(rows.select("g", "r"), marks, ["g"], "r", ["at"], size=16).select("g", "r", "at")
    same(got, rows.select("g", "r", F.last(F.when(F.col("m"), F.col("r")), ignorenulls=True).over(w).alias("at")))


def test_running_sorted_matches_window(rows):
    data = rows.filter("v is not null")
    order = [F.col("v").desc(), F.col("g"), F.col("r")]
    want = data.select("g", "r", F.sum("v").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("x"))
    same(O.running_sorted(data, order, "v", "x").select("g", "r", "x"), want)


def test_rows_at_ranks(spark):
    df = spark.range(0, 5000).select((F.col("id") * F.col("id")).alias("r"))
    got = [x["r"] for x in O.rows_at_ranks(df, "r", lambda n: [0, 17, 4999, 2500], 4).orderBy("r").collect()]
    assert got == [0, 17 ** 2, 2500 ** 2, 4999 ** 2]
    assert O.rows_at_ranks(df.filter("r < 0"), "r", lambda n: [0], 1).count() == 0


def test_bracketed_quantiles_equal_the_builtin(spark):
    df = spark.range(0, 4321).select((F.pmod(F.col("id") * 7919, F.lit(997)) / 7).alias("x"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id")).alias("hot"), F.lit(None).cast("double").alias("none"))
    small = {r["column"]: r for r in exact_quantiles(df, ["x", "hot", "none"], [.25, .5, .9]).collect()}
    large = {r["column"]: r for r in exact_quantiles(df, ["x", "hot", "none"], [.25, .5, .9], one_buffer_values=0).collect()}
    for c in ("x", "hot"):
        for q in ("q0", "q1", "q2"):
            assert large[c][q] == pytest.approx(small[c][q], rel=1e-12)
    assert large["none"]["q0"] is None and small["none"]["q0"] is None
