"""Cheap cell tests against the patterns they stand for."""

from pyspark.sql import functions as F

from tabscope.functions import values
from tabscope.operators import grid as G

BREAKS = "".join(map(chr, [9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trimming_uses_no_pattern_and_equals_it(spark):
    texts = [None, "", " ", "a b", "\n", "x \n", "\r\nx "] + [c + "x" + c + "y" + c for c in BREAKS] + list(BREAKS)
    df = spark.createDataFrame([(t,) for t in texts], "c string").repartition(2)
    got = df.select(values.tidy("c").alias("t"), values.is_blank("c").alias("b"))
    assert "regexp" not in plan(got)
    pattern = F.regexp_replace("c", r"(?U)^\s+|\s+$", "")
    both = df.select(values.tidy("c").eqNullSafe(pattern).alias("t"), (values.is_blank("c") == (F.col("c").isNull() | (pattern == ""))).alias("b"), "c").collect()
    assert [r["c"] for r in both if not (r["t"] and r["b"])] == []


def test_kinds(spark):
    kinds = {None: "empty", " 　": "empty", "#N/A": "error", " #REF! ": "error", "#x": "text", "True": "boolean", "false ": "boolean", "truth": "text", "2024-02-29": "date", "2023-02-29": "text",
             "2024-01-05T10:20": "date", "2024-01-05T99:20": "text", "1234-5": "text", "1,234.5": "number", "1,23": "text", "12": "number", "012": "text", "-0.5": "number", "1e5": "number", "9007199254740993": "text",
             "1,234,567,890,123,456,789": "text"}
    rows = spark.createDataFrame([("b", "s", i, [c]) for i, c in enumerate(kinds)], "source string, sheet string, row_number bigint, cells array<string>")
    got = {r["row_number"]: r["kinds"][0] for r in G.normalize_cells(rows).withColumn("kinds", F.when(F.col("error_count") > 0, F.array(F.lit("error"))).otherwise(F.col("kinds"))).collect()}
    assert got == dict(enumerate(kinds.values()))


def test_rows_of_clean_tables_are_made_once(make_grid):
    grid = make_grid({"s": [["Title"], ["Item", "Price"], ["a", 1], ["ITEM", "price"], ["Item", "x"], ["b", 2], ["Total", 3], ["Note: end"]]})
    facts, rows, notes = G.clean_tables(grid)
    assert [(r["row_number"], r["cells"]) for r in rows.orderBy("row_number").collect()] == [(3, ["a", "1"]), (5, ["Item", "x"]), (6, ["b", "2"]), (7, ["Total", "3"])]
    assert "Join" not in plan(rows)  # neither the counts nor the data join the facts again
    assert facts.first()["rows_count"] == 4 and [n["row_number"] for n in notes.collect()] == [8]
