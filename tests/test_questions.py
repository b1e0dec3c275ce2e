import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabscope.columns import ROW, ColumnInfo, SpecError, columns_from_schema
from tabscope.operators import tiles as T
from tabscope.operators.ask import Question, ask, ask_many, headline, merge_questions, to_evidence, to_series
from tabscope.operators.browse import browse
from tabscope.operators.profile import duplicate_rows, example_rows, infer_roles, iqr_outlier_rows, iqr_outliers, profile_columns, role_columns, top_values
from tabscope.operators import patterns as A
from tabscope.plans.dashboard import TableFacts, plan_dashboard, validate_spec


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(2, "SO-001", "North", "Cement", 1200, "2026-01-05"), (3, "SO-002", "South", "Sand", 800, "2026-01-09"), (4, "SO-003", "North", "Steel", 4500, "2026-02-02"),
            (5, "SO-004", "East", "Cement", 950, "2026-02-14"), (6, "SO-005", "South", "Steel", 3100, "2026-03-01"), (7, "SO-006", "East", "Sand", 600, "2026-03-20")]
    return spark.createDataFrame(rows, f"{ROW} bigint, Order string, Region string, Product string, Amount bigint, Date string").withColumn("Date", F.to_date("Date"))


@pytest.fixture(scope="module")
def generated(spark):
    rows = [(i, 1000 + i, dt.date(2026, i % 6 + 1, i % 28 + 1), ["North", "South", "East"][i % 3], f"P{i % 4}", 100 + 10 * i, i % 5 + 1, f"Customer {i}") for i in range(60)]
    return spark.createDataFrame(rows, f"{ROW} bigint, order_id bigint, order_date date, region string, product string, revenue bigint, quantity bigint, customer string")


def pairs(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_sum_by_region_with_share(sales):
    a = ask(sales, Question("Amount", "sum", ("Region",)))
    assert a.summary.first()["value"] == 11150
    got = pairs(a.groups, "key1", "value", "share")
    assert [g[:2] for g in got] == [("North", 5700), ("South", 3900), ("East", 1550)]
    assert got[0][2] == pytest.approx(5700 / 11150 * 100)


def test_filter_month_and_limits(sales):
    cement = ask(sales, Question("Amount", "sum", filters=({"column": "Product", "values": ["Cement"]},))).summary.first()
    assert (cement["value"], cement["matched"]) == (2150, 2)
    months = ask(sales, Question("Amount", "sum", ("Date",), grain="month", sort="label")).groups
    assert pairs(months, "key1", "value") == [("2026-01", 2000), ("2026-02", 5450), ("2026-03", 3700)]
    two = ask(sales, Question(None, "count", ("Region", "Product"), limit=3)).groups.collect()
    assert len(two) == 3 and two[0]["groups_total"] == 6 and two[0]["truncated"]


def test_bad_question_fails_alone(sales):
    answers = ask_many(sales, [Question("Amount", "max"), Question("Region", "sum"), Question("Nope", "count"), Question(None, "sum")])
    assert [a.ok for a in answers] == [True, False, False, False]
    assert answers[0].summary.first()["value"] == 4500


def test_null_groups_count_in_the_share_base(spark):
    df = spark.createDataFrame([("a", 10), (None, 30)], "g string, v bigint")
    row = ask(df, Question("v", "sum", ("g",))).groups.first()
    assert (row["value"], row["share"], row["groups_total"]) == (10, 25, 1)


def test_merge_keeps_the_longer_list():
    merged = merge_questions([Question(None, "count", ("a",), limit=1), Question(None, "count", ("a",), limit=9), Question(None, "count", ("b",))])
    assert [(q.group_by, q.limit) for q in merged] == [(("a",), 9), (("b",), 15)]


def test_series_evidence_and_headline(spark, sales):
    s = to_series(ask(sales, Question("Amount", "sum", ("Region", "Product"), sort="label", limit=50))).collect()
    assert {r["key1"]: r["Cement"] for r in s} == {"North": 1200, "South": None, "East": 950}
    text = to_evidence(ask(sales, Question("Amount", "sum", ("Region",), limit=2, purpose="sales"))).first()["text"]
    assert "North = 5,700 (51.12%)" in text and "showing 2 of 3 groups" in text and "total 11,150" in text
    top = headline(spark, ask_many(sales, [Question("Amount", "sum", ("Region",), limit=1, purpose="best"), Question("Amount", "avg", ("Region",), purpose="all")]))
    assert pairs(top, "label", "value", "note") == [("best", 5700, "North")]


def test_generated_roles(generated):
    r = role_columns(infer_roles(generated))
    got = {n: (c.role, c.semantic_type, c.meaning) for n, c in r.items()}
    assert got["order_id"][0] == "identifier" and got["order_date"][:2] == ("time", "date") and got["region"][:2] == ("dimension", "category")
    assert got["revenue"] == ("measure", "integer", "money") and got["quantity"] == ("measure", "integer", "quantity") and got["customer"][0] == "attribute"


def test_tiles_of_generated_sales(generated):
    c = columns_from_schema(generated)
    north = generated.filter("region = 'North'")
    k = {x["id"]: x["value"] for x in T.kpis(north, [{"id": "a", "agg": "count"}, {"id": "b", "agg": "sum", "column": "revenue"}, {"id": "c", "agg": "median", "column": "revenue"}], c).collect()}
    assert k == {"a": 20, "b": 7700, "c": 385}
    top = T.top_categories(generated, "product", "revenue", "sum", 3).collect()
    assert sum(t["y"] for t in top) == 23700 and sum(t["is_others"] for t in top) == 1
    h = T.histogram(generated, "revenue").collect()
    assert len(h) == 8 and sum(b["y"] for b in h) == 60
    points = T.scatter(generated, "revenue", "quantity").collect()
    assert len(points) == 60 and points[0]["points_total"] == 60 and not points[0]["sampled"]
    series = T.time_series(generated, c["order_date"], None, "count", "month").collect()
    assert [(s["x"], s["y"]) for s in series] == [(f"2026-0{m}", 10) for m in range(1, 7)]
    coarse = T.time_series(generated, c["order_date"], None, "count", "day", max_points=10).collect()
    assert coarse[0]["grain"] == "month"


def test_filters_reject_misuse(sales):
    c = columns_from_schema(sales)
    for bad in ({"column": "x", "values": ["a"]}, {"column": "Region", "from": "2026-01-01"}, {"column": "Amount"}, {"column": "Date", "from": "1/1/2026"}, {"column": "Amount", "min": float("nan")}):
        with pytest.raises(SpecError):
            T.row_counts(sales, [bad], c)


def test_statistics_and_correlation(spark):
    rows = [(i, i, "North" if i % 2 else "South", v, 2 * v, dt.date(2026, (i - 1) // 2 + 1, (i - 1) % 2 + 1)) for i, v in enumerate([10, 10, 12, 14, 16, 100], 1)]
    df = spark.createDataFrame(rows, f"{ROW} bigint, ID bigint, Grp string, Value bigint, Other bigint, Date date")
    p = {x["column"]: x for x in profile_columns(df).collect()}
    assert (p["Value"]["sum"], p["Value"]["median"], p["Value"]["outliers"], p["ID"]["unique_count"]) == (162, 13, 1, 6)
    assert role_columns(infer_roles(df))["ID"].role == "identifier"
    c = A.correlations(df, ["Value", "Other"]).first()
    assert c["r"] == pytest.approx(1) and c["n"] == 6
    assert A.trend_change(A.trend(df, "Date", "Value")).first()["metric"] == "first_to_last_mean_change_pct"
    assert iqr_outliers(df, "Value").first()["outliers"] == 1
    kinds = {x["kind"] for x in A.insights(df, role_columns(infer_roles(df))).select("kind").collect()}
    assert {"trend", "anomaly", "distribution", "segment", "relationship"} <= kinds


def test_zero_spread_rules_differ(spark):
    df = spark.createDataFrame([(i, 5.0 if i < 9 else 50.0 + i) for i in range(11)], f"{ROW} bigint, v double")
    assert iqr_outliers(df, "v").first()["outliers"] == 2
    assert iqr_outlier_rows(df, "v").count() == 0


def test_duplicates_and_top_values(spark):
    df = spark.createDataFrame([(1, "North", "Open"), (2, "South", "Closed"), (3, "North", "Open")], f"{ROW} bigint, Team string, State string")
    assert duplicate_rows(df).first()["duplicate_rows"] == 1
    top = top_values(df, ["Team"]).filter("rank = 1").first()
    assert (top["value"], top["count"]) == ("North", 2)


def test_example_rows_name_their_reasons(spark):
    rows = [(i, dt.date(2026, 1 if i < 90 else 12, 1), "A" if i < 90 else "B", 1000 if i == 99 else 10 + i % 10) for i in range(100)]
    picked = {r[ROW]: r["reasons"] for r in example_rows(spark.createDataFrame(rows, f"{ROW} bigint, Date date, Team string, Amount bigint")).collect()}
    assert len(picked) <= 60 and "numeric_extreme:Amount" in picked[99] and "group_or_period:Team" in picked[90] and "spread_across_rows" in picked[0]


def test_rule_plan_and_validation(generated):
    columns = role_columns(infer_roles(generated))
    spec = plan_dashboard([TableFacts("sales", columns, 60, (("revenue", "quantity", .5),))])
    kinds = [c["type"] for c in spec["charts"]]
    assert kinds[0] == "area" and "bar" in kinds and "scatter" in kinds
    assert spec["kpis"][1] == {"id": "k2", "label": "sum revenue", "column": "revenue", "agg": "sum"}
    proposal = {"source": "ai", "kpis": [{"agg": "sum", "column": "region"}, {"agg": "sum", "column": "revenue"}, {"agg": "sum", "column": "revenue"}]}
    assert len(validate_spec(proposal, columns)["kpis"]) == 1
    with pytest.raises(SpecError):
        validate_spec({**proposal, "source": "rules"}, columns)
    with pytest.raises(SpecError):
        validate_spec({"kpis": []}, columns)
    result = T.run_dashboard(generated, spec, columns, [{"column": "region", "values": ["North"]}])
    assert result["counts"].first()["rows_matched"] == 20 and not result["errors"] and set(result["charts"]) == {c["id"] for c in spec["charts"]}


def test_deep_pages_equal_shallow_ones(monkeypatch, generated):
    from tabscope.operators import browse as B
    ask_page = lambda: [r["order_id"] for r in browse(generated, sort="product", direction="desc", page=3, page_size=10).orderBy(F.col("product").desc(), ROW).collect()]
    shallow = ask_page()
    monkeypatch.setattr(B, "SHALLOW_ROWS", 0)
    assert ask_page() == shallow and len(shallow) == 10


def test_year_month_text_column(spark):
    df = spark.createDataFrame([("2026-01", 1), ("2026-02", 2), ("2026-02", 4)], "m string, v bigint")
    assert role_columns(infer_roles(df))["m"].time_format == "year_month"
    info = ColumnInfo("m", "text", "time", "date", None, "year_month")
    assert [(r["x"], r["y"]) for r in T.time_series(df, info, "v", "sum").collect()] == [("2026-01", 1.0), ("2026-02", 6.0)]


def test_a_limit_over_the_largest_is_the_largest(spark):
    df = spark.range(200).selectExpr("concat('g', id) AS name", "CAST(id AS DOUBLE) AS value")
    shown = [ask(df, Question("value", "sum", ("name",), limit=n)).groups.count() for n in (3, 60, 0)]
    assert shown == [3, 50, 15]
