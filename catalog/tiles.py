"""Dashboard tiles."""

from pyspark.sql import functions as F

from catalog.base import query, r, table
from tabscope.columns import ROW, ColumnInfo, columns_from_schema
from tabscope.functions.values import bucket_range, time_bucket
from tabscope.operators import tiles as T
from tabscope.operators.aggregates import apply_filters


@query("kpis", """
WITH l AS (SELECT * FROM lineitem WHERE l_returnflag = 'A')
SELECT 'k1' AS id, 'count' AS agg, CAST(NULL AS VARCHAR) AS "column", CAST(COUNT(*) AS DOUBLE) AS value FROM l
UNION ALL SELECT 'k2', 'sum', 'l_extendedprice', ROUND(SUM(l_extendedprice), 2) FROM l
UNION ALL SELECT 'k3', 'avg', 'l_discount', ROUND(AVG(l_discount), 4) FROM l
UNION ALL SELECT 'k4', 'min', 'l_extendedprice', MIN(l_extendedprice) FROM l
UNION ALL SELECT 'k5', 'max', 'l_extendedprice', MAX(l_extendedprice) FROM l
UNION ALL SELECT 'k6', 'count_distinct', 'l_linestatus', COUNT(DISTINCT l_linestatus) FROM l
UNION ALL SELECT 'k7', 'median', 'l_extendedprice', ROUND(MEDIAN(l_extendedprice), 4) FROM l
UNION ALL SELECT 'k8', 'median', 'l_quantity', MEDIAN(l_quantity) FROM l""")
def kpis(spark, sf):
    df = table(spark, sf, "lineitem")
    columns = columns_from_schema(df)
    rows = apply_filters(df, [{"column": "l_returnflag", "values": ["A"]}], columns)
    items = [("count", None), ("sum", "l_extendedprice"), ("avg", "l_discount"), ("min", "l_extendedprice"), ("max", "l_extendedprice"),
             ("count_distinct", "l_linestatus"), ("median", "l_extendedprice"), ("median", "l_quantity")]
    out = T.kpis(rows, [{"id": f"k{i}", "agg": a, "column": c} for i, (a, c) in enumerate(items, 1)], columns)
    return out.withColumn("value", F.when(F.col("agg") == "sum", r("value")).otherwise(r("value", 4)))


@query("row_counts", """
SELECT COUNT(*) FILTER (l_linenumber <> 7) AS rows_total, COUNT(*) FILTER (l_linenumber <> 7 AND l_quantity >= 25) AS rows_matched,
       COUNT(*) FILTER (l_linenumber = 7) AS summary_rows_excluded FROM lineitem""")
def row_counts(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("_is_summary", F.col("l_linenumber") == 7)
    return T.row_counts(df, [{"column": "l_quantity", "min": 25}], columns_from_schema(df))


@query("time_series", """
WITH n AS (SELECT COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS d, COUNT(DISTINCT strftime(o_orderdate, '%Y-W%W')) AS w FROM orders),
b AS (SELECT CASE WHEN d <= 400 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN w <= 400 THEN strftime(o_orderdate, '%Y-W%W')
             ELSE strftime(o_orderdate, '%Y-%m') END AS x, CASE WHEN d <= 400 THEN 'day' WHEN w <= 400 THEN 'week' ELSE 'month' END AS grain,
             o_totalprice FROM orders, n)
SELECT x, ROUND(SUM(o_totalprice), 2) AS y, grain FROM b GROUP BY x, grain""")
def time_series(spark, sf):
    df = table(spark, sf, "orders")
    return T.time_series(df, columns_from_schema(df)["o_orderdate"], "o_totalprice", "sum", "day").withColumn("y", r("y"))


@query("time_series_default", """
SELECT strftime(l_shipdate, '%Y') || '-Q' || quarter(l_shipdate) AS x, ROUND(AVG(l_discount), 4) AS y, 'quarter' AS grain
FROM lineitem GROUP BY 1""")
def time_series_default(spark, sf):
    df = table(spark, sf, "lineitem")
    return T.time_series(df, columns_from_schema(df)["l_shipdate"], "l_discount", "avg").withColumn("y", r("y", 4))


@query("time_series_year_month", """
SELECT strftime(o_orderdate, '%Y-%m') AS x, CAST(COUNT(*) AS DOUBLE) AS y, 'month' AS grain FROM orders GROUP BY 1""")
def time_series_year_month(spark, sf):
    df = table(spark, sf, "orders").select(time_bucket("o_orderdate", "month").alias("period"))
    info = ColumnInfo("period", "text", "time", "date", None, "year_month")
    return T.time_series(df, info, None, "count").withColumn("y", F.col("y").cast("double"))


@query("topn_others", """
WITH g AS (SELECT p_brand AS x, SUM(l_extendedprice) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT * FROM g ORDER BY y DESC, x LIMIT 5)
SELECT x, ROUND(y, 2) AS y, (SELECT COUNT(*) FROM g) AS groups_total, FALSE AS is_others FROM s
UNION ALL SELECT 'Others (' || format('{:,}', (SELECT COUNT(*) FROM g) - 5) || ' groups)', ROUND((SELECT SUM(y) FROM g) - (SELECT SUM(y) FROM s), 2),
  (SELECT COUNT(*) FROM g), TRUE""")
def topn_others(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return T.top_categories(df, "p_brand", "l_extendedprice", "sum", 5).withColumn("y", r("y"))


@query("topn_average", """
SELECT c_mktsegment AS x, ROUND(AVG(c_acctbal), 4) AS y, (SELECT COUNT(DISTINCT c_mktsegment) FROM customer) AS groups_total, FALSE AS is_others
FROM customer GROUP BY 1 ORDER BY AVG(c_acctbal) DESC, 1 LIMIT 3""")
def topn_average(spark, sf):
    return T.top_categories(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "avg", 3, "donut").withColumn("y", r("y", 4))


def _histogram_sql(source, column, bins, scaled):
    value = f"CAST({column} AS DOUBLE)"
    scale = "GREATEST(ABS(MIN(v)), ABS(MAX(v)))" if scaled else "1.0"
    return f"""
WITH src AS (SELECT {value} AS v FROM {source}),
s AS (SELECT COUNT(v) AS n, MIN(v) AS lo, MAX(v) AS hi, {scale} AS k FROM src),
b AS (SELECT *, {bins} AS bins FROM s),
w AS (SELECT *, (hi / k - lo / k) / bins AS width, lo / k AS first FROM b),
c AS (SELECT GREATEST(0, LEAST(bins - 1, CAST(FLOOR((v / k - first) / width) AS BIGINT))) AS bin, COUNT(*) AS y FROM src, w GROUP BY 1)
SELECT r.bin AS bin, ROUND((first + r.bin * width) * k, 4) AS x_from, ROUND((first + (r.bin + 1) * width) * k, 4) AS x_to, COALESCE(y, 0) AS y
FROM w, (SELECT UNNEST(range(0, 20)) AS bin) r LEFT JOIN c ON c.bin = r.bin WHERE r.bin < w.bins"""


def _histogram(name, rule, source, column, bins, scaled=False):
    @query(name, _histogram_sql(source, column, bins, scaled))
    def run(spark, sf):
        h = T.histogram(table(spark, sf, source), column, rule)
        return h.select("bin", r("x_from", 4).alias("x_from"), r("x_to", 4).alias("x_to"), "y")


_histogram("hist_dashboard", "dashboard", "events", "value", "GREATEST(5, LEAST(20, CAST(CEIL(SQRT(n)) AS BIGINT)))")
_histogram("hist_overview", "overview", "lineitem", "l_extendedprice", "LEAST(10, GREATEST(3, CAST(CEIL(SQRT(n)) AS BIGINT)))", True)
_histogram("hist_classic", "classic", "customer", "c_acctbal", "LEAST(10, GREATEST(3, CAST(FLOOR(SQRT(n)) AS BIGINT)))")


@query("scatter_sample", """
WITH p AS (SELECT o_orderkey, CAST(NULLIF(o_custkey % 5, 0) AS DOUBLE) AS x, o_totalprice AS y FROM orders),
q AS (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS n, COUNT(*) OVER () AS total FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT o_orderkey AS _row, x, y, total AS points_total, total > 500 AS sampled FROM q
WHERE n % GREATEST(1, CAST(CEIL(total / 500.0) AS BIGINT)) = 0""")
def scatter_sample(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("x"), "o_totalprice")
    return T.scatter(df, "x", "o_totalprice")


@query("filter_options", """
WITH c AS (SELECT p_brand AS v, COUNT(*) AS n FROM part GROUP BY 1)
SELECT 'f1' AS id, 'category' AS kind, v AS value, n AS "count", (SELECT COUNT(*) FROM c) AS total, CAST(NULL AS VARCHAR) AS "min",
       CAST(NULL AS VARCHAR) AS "max", CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM c
UNION ALL SELECT 'f2', 'number', NULL, NULL, NULL, NULL, NULL, MIN(p_retailprice), MAX(p_retailprice) FROM part""")
def filter_options(spark, sf):
    df = table(spark, sf, "part")
    return T.filter_options(df, [{"id": "f1", "column": "p_brand", "kind": "category"}, {"id": "f2", "column": "p_retailprice", "kind": "number"}],
                            columns_from_schema(df))


@query("filter_options_date", """
SELECT 'f1' AS id, 'date' AS kind, strftime(MIN(o_orderdate), '%Y-%m-%d') AS "min", strftime(MAX(o_orderdate), '%Y-%m-%d') AS "max" FROM orders""")
def filter_options_date(spark, sf):
    df = table(spark, sf, "orders")
    return T.filter_options(df, [{"id": "f1", "column": "o_orderdate", "kind": "date"}], columns_from_schema(df)).select("id", "kind", "min", "max")


@query("tile_trace", """
SELECT c_mktsegment AS x, CAST(COUNT(*) AS DOUBLE) AS y, 5 AS groups_total, FALSE AS is_others, 'customer' AS trace_sheet, 'customer' AS trace_table,
       CAST(NULL AS VARCHAR) AS trace_column, 'count' AS trace_agg, (SELECT COUNT(*) FROM customer WHERE c_acctbal >= 0) AS trace_rows,
       CAST(0 AS BIGINT) AS trace_excluded, TRUE AS trace_filtered, 'c_mktsegment' AS trace_group_by, CAST(NULL AS VARCHAR) AS trace_range
FROM customer WHERE c_acctbal >= 0 GROUP BY 1""")
def tile_trace(spark, sf):
    df = table(spark, sf, "customer")
    columns, filters = columns_from_schema(df), [{"column": "c_acctbal", "min": 0}]
    tile = T.top_categories(apply_filters(df, filters, columns), "c_mktsegment", None, "count")
    return T.with_trace(tile, T.row_counts(df, filters, columns), "customer", "customer", None, "count", True, "c_mktsegment")


@query("bucket_range", """
WITH l AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS label FROM orders UNION SELECT DISTINCT strftime(o_orderdate, '%Y') FROM orders
           UNION SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') FROM orders)
SELECT label, CASE length(label) WHEN 10 THEN label WHEN 7 THEN label || '-01' ELSE label || '-01-01' END AS first_day,
  CASE length(label) WHEN 10 THEN label WHEN 7 THEN strftime(last_day(CAST(label || '-01' AS DATE)), '%Y-%m-%d') ELSE label || '-12-31' END AS last_day FROM l""")
def bucket_ranges(spark, sf):
    dates = table(spark, sf, "orders").select(F.explode(F.array(*[time_bucket("o_orderdate", g) for g in ("day", "month", "year")])).alias("label")).distinct()
    span = dates.select("label", bucket_range("label").alias("s"))
    return span.select("label", F.col("s.from").cast("string").alias("first_day"), F.col("s.to").cast("string").alias("last_day"))
