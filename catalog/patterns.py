"""Pattern analysis and rule-based plans."""

from pyspark.sql import functions as F

from catalog.base import query, r, table
from catalog.profiles import raw_orders, _RAW
from tabscope.columns import ROW
from tabscope.operators import patterns as A
from tabscope.operators import profile as P
from tabscope.plans.analyses import eligible_analyses, eligible_table, run_analyses
from tabscope.plans.dashboard import TableFacts, plan_dashboard


@query("frequency", """
WITH g AS (SELECT NULLIF(p_type, 'PROMO') AS label, COUNT(*) AS n FROM part WHERE p_type <> 'PROMO' GROUP BY 1)
SELECT label, n AS "count", ROUND(n * 100.0 / (SELECT SUM(n) FROM g), 4) AS share, CASE WHEN (SELECT COUNT(*) FROM g) <= 6 THEN 'donut' ELSE 'bar' END AS chart FROM g""")
def frequency(spark, sf):
    df = table(spark, sf, "part").withColumn("p_type", F.nullif("p_type", F.lit("PROMO")))
    return A.frequency(df, "p_type").withColumn("share", r("share", 4))


@query("category_mean", """
SELECT l_returnflag AS label, ROUND(AVG(q), 4) AS mean, COUNT(q) AS "count" FROM (SELECT l_returnflag, NULLIF(l_quantity, 7) AS q FROM lineitem) WHERE q IS NOT NULL GROUP BY 1""")
def category_mean(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("q", F.nullif("l_quantity", F.lit(7.0)))
    return A.category_mean(df, "l_returnflag", "q").withColumn("mean", r("mean", 4))


@query("category_best_worst", """
WITH m AS (SELECT c_mktsegment AS l, AVG(c_acctbal) AS v FROM customer GROUP BY 1)
SELECT arg_max(l, v) AS best, ROUND(MAX(v), 4) AS best_mean, arg_min(l, v) AS worst, ROUND(MIN(v), 4) AS worst_mean, COUNT(*) AS groups FROM m""")
def category_best_worst(spark, sf):
    out = A.best_and_worst(A.category_mean(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))
    return out.withColumn("best_mean", r("best_mean", 4)).withColumn("worst_mean", r("worst_mean", 4))


@query("trend", """
WITH s AS (SELECT date_diff('day', MIN(o_orderdate), MAX(o_orderdate)) AS d FROM orders)
SELECT CASE WHEN d <= 60 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN d <= 1825 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS period,
 ROUND(AVG(o_totalprice), 2) AS mean, COUNT(*) AS "count", MAX(CASE WHEN d <= 60 THEN 'day' WHEN d <= 1825 THEN 'month' ELSE 'year' END) AS unit FROM orders, s GROUP BY 1""")
def trend(spark, sf):
    return A.trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice").withColumn("mean", r("mean"))


@query("trend_days", """SELECT strftime(ts, '%Y-%m-%d') AS period, ROUND(AVG(value), 4) AS mean, COUNT(*) AS "count", 'day' AS unit FROM events GROUP BY 1""")
def trend_days(spark, sf):
    return A.trend(table(spark, sf, "events"), "ts", "value").withColumn("mean", r("mean", 4))


@query("monthly_gap", """
WITH o AS (SELECT * FROM orders WHERE month(o_orderdate) NOT IN (3, 4)),
m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, year(o_orderdate) * 12 + month(o_orderdate) AS k, ROUND(AVG(o_totalprice), 2) AS mean, COUNT(*) AS n FROM o GROUP BY 1, 2)
SELECT period, mean, n AS "count", (SELECT MAX(k) - MIN(k) + 1 - COUNT(*) FROM m) AS missing_months FROM m""")
def monthly_gap(spark, sf):
    df = table(spark, sf, "orders").filter(~F.month("o_orderdate").isin(3, 4))
    return A.monthly_trend(df, "o_orderdate", "o_totalprice").withColumn("mean", r("mean"))


@query("trend_change", """
WITH m AS (SELECT strftime(o_orderdate, '%Y') AS p, AVG(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT MIN(p) AS first_period, MAX(p) AS last_period, 'first_to_last_mean_change_pct' AS metric, ROUND((arg_max(v, p) - arg_min(v, p)) / ABS(arg_min(v, p)) * 100, 4) AS value FROM m""")
def trend_change(spark, sf):
    return A.trend_change(A.trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")).withColumn("value", r("value", 4))


_CORR = """src AS (SELECT l_quantity AS q, l_extendedprice AS p, NULLIF(l_discount, 0) AS d, l_extendedprice * (1 - l_discount) AS net, 5.0 AS fixed FROM lineitem)"""


def _corr_frame(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.nullif("l_discount", F.lit(0.0)).alias("d"),
                                               (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.lit(5.0).alias("fixed"))


def _pairs_sql(names):
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, ROUND(corr({a}, {b}), 4) AS r, COUNT(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM src"
                              for i, a in enumerate(names) for b in names[i + 1:])


@query("correlations", f"WITH {_CORR} {_pairs_sql(['q', 'p', 'd', 'net'])}")
def correlations(spark, sf):
    return A.correlations(_corr_frame(spark, sf), ["q", "fixed", "p", "d", "net"]).withColumn("r", r("r", 4))


@query("correlations_classic", f"WITH {_CORR} {_pairs_sql(['q', 'p', 'd', 'net'])}")
def correlations_classic(spark, sf):
    return A.correlations(_corr_frame(spark, sf), ["q", "fixed", "p", "d", "net"], "classic").withColumn("r", r("r", 4))


@query("systematic_sample", """
WITH p AS (SELECT o_orderkey AS _row, CAST(NULLIF(o_custkey % 4, 0) AS DOUBLE) AS x, o_totalprice AS y, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS n, COUNT(*) OVER () AS total FROM orders)
SELECT _row, x, y FROM p WHERE n % GREATEST(1, CAST(CEIL(total / 200.0) AS BIGINT)) = 0 AND x IS NOT NULL""")
def systematic_sample(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("x"), "o_totalprice")
    return A.systematic_sample(df, "x", "o_totalprice")


@query("round_robin", """
WITH k AS (SELECT p_type, p_partkey, ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part)
SELECT p_type, p_partkey, turn FROM k ORDER BY turn, p_type LIMIT 24""")
def round_robin(spark, sf):
    out = A.round_robin(table(spark, sf, "part"), "p_type", [F.col("p_retailprice").desc(), F.col("p_partkey")], 24)
    return out.select("p_type", "p_partkey", "turn")


def order_slice(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), "o_totalprice", "o_orderpriority", "o_orderdate", (F.col("o_custkey") % 50).alias("visits"))


@query("insight_metrics", """
WITH y AS (SELECT strftime(o_orderdate, '%Y') AS p, AVG(o_totalprice) AS a, AVG(o_custkey % 50) AS b FROM orders GROUP BY 1),
g AS (SELECT o_orderpriority AS k, COUNT(*) AS n, AVG(o_totalprice) AS a, AVG(o_custkey % 50) AS b FROM orders GROUP BY 1),
m AS (SELECT 'trend' AS kind, 'first_to_last_mean_change_pct' AS metric, (arg_max(a, p) - arg_min(a, p)) / arg_min(a, p) * 100 AS value, 'high' AS importance FROM y
UNION ALL SELECT 'trend', 'first_to_last_mean_change_pct', (arg_max(b, p) - arg_min(b, p)) / arg_min(b, p) * 100, 'high' FROM y
UNION ALL SELECT 'quality', 'missing_percentage', 0.0, 'medium' WHERE (SELECT COUNT(*) FROM (SELECT DISTINCT o_totalprice, o_orderpriority, o_orderdate, o_custkey % 50 FROM orders)) < (SELECT COUNT(*) FROM orders)
UNION ALL SELECT 'distribution', 'median', MEDIAN(o_totalprice), 'low' FROM orders
UNION ALL SELECT 'distribution', 'median', MEDIAN(o_custkey % 50), 'low' FROM orders
UNION ALL SELECT 'segment', 'top_category_count', MAX(n), 'medium' FROM g
UNION ALL SELECT 'segment', 'highest_category_mean', MAX(a), 'medium' FROM g
UNION ALL SELECT 'segment', 'highest_category_mean', MAX(b), 'medium' FROM g
UNION ALL SELECT 'relationship', 'pearson_r', corr(o_totalprice, o_custkey % 50), 'medium' FROM orders)
SELECT kind, metric, ROUND(value, 3) AS value, importance FROM m""")
def insight_metrics(spark, sf):
    rows = order_slice(spark, sf)
    found = A.select_insights(A.insights(rows, P.role_columns(P.infer_roles(rows)), "orders"))
    return found.select("kind", F.col("evidence.metric").alias("metric"), r(F.col("evidence.value"), 3).alias("value"), "importance")


@query("overview_kpis", """
SELECT 1 AS seq, 'rows' AS name, CAST(COUNT(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 2, 'completeness', 100.0
UNION ALL SELECT 3, 'mean o_totalprice', ROUND(AVG(o_totalprice), 2) FROM orders UNION ALL SELECT 4, 'mean visits', ROUND(AVG(o_custkey % 50), 2) FROM orders""")
def overview_kpis(spark, sf):
    rows = order_slice(spark, sf)
    return A.overview_kpis(rows, P.role_columns(P.infer_roles(rows)), "orders").withColumn("value", r("value"))


@query("eligible", f"""WITH {_RAW}
SELECT 'A-' || lpad(CAST(i AS VARCHAR), 2, '0') AS id, type, c AS columns FROM (VALUES (1, 'quality', 'order_code, price, day, priority, printed, site, bucket'),
 (2, 'statistics', 'price'), (3, 'outliers', 'price'), (4, 'distribution', 'price'), (5, 'statistics', 'bucket'), (6, 'outliers', 'bucket'), (7, 'distribution', 'bucket'),
 (8, 'frequency', 'priority'), (9, 'category', 'priority, price'), (10, 'category', 'priority, bucket'), (11, 'trend', 'day, price'), (12, 'trend', 'day, bucket'),
 (13, 'correlation', 'price, bucket')) t(i, type, c), (SELECT COUNT(*) FILTER (price <> 'n/a') * 1.0 / COUNT(*) AS share, COUNT(DISTINCT bucket) AS u FROM src) WHERE share >= .85 AND u >= 3""")
def eligible(spark, sf):
    return eligible_table(raw_orders(spark, sf))


@query("run_analyses", f"""WITH {_RAW} SELECT priority AS label, ROUND(AVG(TRY_CAST(price AS DOUBLE)), 2) AS mean, COUNT(TRY_CAST(price AS DOUBLE)) AS "count"
FROM src WHERE priority IS NOT NULL GROUP BY 1""")
def run_every_analysis(spark, sf):
    raw = raw_orders(spark, sf).withColumn("priority", F.nullif("priority", F.lit("")))
    plans = eligible_analyses(raw)
    results, errors = run_analyses(raw, [p for p in plans if p.type in ("category", "frequency")])
    assert not errors, errors
    wanted = next(p.id for p in plans if p.type == "category" and p.columns == ("priority", "price"))
    return results[wanted].withColumn("mean", r("mean"))


@query("plan_dashboard")
def plan_orders(spark, sf):
    rows = table(spark, sf, "orders")
    facts = TableFacts("orders", P.role_columns(P.infer_roles(rows)), rows.count())
    spec = plan_dashboard([facts])
    items = [("kpi", k["id"], k["agg"], k["column"], None) for k in spec["kpis"]]
    items += [("chart", c["id"], c["type"], c["x"], c["y"]) for c in spec["charts"]] + [("filter", f["id"], f["kind"], f["column"], None) for f in spec["filters"]]
    return spark.createDataFrame(items, "part string, id string, kind string, x string, y string")
