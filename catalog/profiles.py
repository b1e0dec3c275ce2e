"""Profiles, roles and quality."""

from functools import reduce

from pyspark.sql import functions as F

from catalog.base import query, r, table
from tabscope.columns import ROW
from tabscope.operators import profile as P


def sparse_lines(spark, sf):
    """lineitem with nulls: quantity 7, discount 0 and status O are blanked."""
    return table(spark, sf, "lineitem").select(
        F.nullif("l_quantity", F.lit(7.0)).alias("quantity"), "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.nullif("l_linestatus", F.lit("O")).alias("status"), "l_returnflag", "l_shipdate")


SPARSE = """src AS (SELECT NULLIF(l_quantity, 7) AS quantity, l_extendedprice, NULLIF(l_discount, 0) AS discount, NULLIF(l_linestatus, 'O') AS status,
 l_returnflag, l_shipdate FROM lineitem)"""


def _column_sql(name, kind, clock=False):
    if kind == "number":
        stats = f"""COUNT({name}), MIN({name}), MAX({name}), ROUND(AVG({name}), 4), ROUND(quantile_cont({name}, 0.5), 4), ROUND(stddev_samp({name}), 4), ROUND(SUM({name}), 2),
 (SELECT COUNT(*) FROM src, (SELECT quantile_cont({name}, 0.25) AS a, quantile_cont({name}, 0.75) AS b FROM src) q WHERE {name} < a - 1.5 * (b - a) OR {name} > b + 1.5 * (b - a)), NULL, NULL"""
    elif kind == "date":
        stats = f"NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, strftime(MIN({name}), '%Y-%m-%d %H:%M:%S'), strftime(MAX({name}), '%Y-%m-%d %H:%M:%S')"
    else:
        stats = "NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"
    return (f"SELECT '{name}', '{kind}', COUNT(*), COUNT(*) - COUNT({name}), ROUND((COUNT(*) - COUNT({name})) * 100.0 / COUNT(*), 4), COUNT(DISTINCT {name}), {stats} FROM src")


@query("profile_columns", f"""
WITH {SPARSE}, p("column", data_type, rows, missing_count, missing_percentage, unique_count, "count", "min", "max", mean, median, std, "sum", outliers, date_min, date_max) AS (
{" UNION ALL ".join(_column_sql(n, k) for n, k in (("quantity", "number"), ("l_extendedprice", "number"), ("discount", "number"), ("status", "text"), ("l_returnflag", "text"), ("l_shipdate", "date")))})
SELECT * FROM p""")
def profile_columns(spark, sf):
    p = P.profile_columns(sparse_lines(spark, sf))
    return p.select("column", "data_type", "rows", "missing_count", "missing_percentage", "unique_count", "count", "min", "max", r("mean", 4).alias("mean"),
                    r("median", 4).alias("median"), r("std", 4).alias("std"), r("sum").alias("sum"), "outliers", "date_min", "date_max")


@query("duplicates", """
WITH d AS (SELECT l_returnflag, l_linestatus, l_quantity, COUNT(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows FROM d""")
def duplicates(spark, sf):
    return P.duplicate_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query("outliers", """
WITH q AS (SELECT COUNT(value) AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT n, ROUND(a - 1.5 * (b - a), 4) AS lower, ROUND(b + 1.5 * (b - a), 4) AS upper,
  (SELECT COUNT(*) FROM events WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers FROM q""")
def outliers(spark, sf):
    return P.iqr_outliers(table(spark, sf, "events"), "value").withColumn("lower", r("lower", 4)).withColumn("upper", r("upper", 4))


@query("outlier_rows", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id AS _row, value FROM events, q WHERE b > a AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))""")
def outlier_rows(spark, sf):
    return P.iqr_outlier_rows(table(spark, sf, "events").withColumn(ROW, F.col("event_id")), "value")


@query("date_range", """SELECT strftime(MIN(ts), '%Y-%m-%dT%H:%M:%S') AS first, strftime(MAX(ts), '%Y-%m-%dT%H:%M:%S') AS last FROM events""")
def date_range(spark, sf):
    return P.date_range(table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")), "ts")


@query("top_values", """
WITH v AS (SELECT 'p_name' AS c, p_name AS v, COUNT(*) AS n, MIN(p_partkey) AS f FROM part GROUP BY p_name
           UNION ALL SELECT 'p_type', p_type, COUNT(*), MIN(p_partkey) FROM part GROUP BY p_type),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c ORDER BY n DESC, f) AS rank FROM v)
SELECT c AS "column", rank, v AS value, n AS "count" FROM k WHERE rank <= 10""")
def top_values(spark, sf):
    return P.top_values(table(spark, sf, "part").withColumn(ROW, F.col("p_partkey")), ["p_name", "p_type"])


def _table_sql(name, source, columns, uniques):
    missing = " + ".join(f"COUNT(*) - COUNT({c})" for c in columns)
    return (f"SELECT '{name}' AS t, COUNT(*) AS rows_count, {len(columns)} AS columns_count, {missing} AS missing_count, "
            f"COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {uniques} FROM {source})) AS duplicate_rows FROM {source}")


_TABLES = f"""WITH e AS (SELECT event_type, NULLIF(value, 1.0) AS value FROM events), c AS (SELECT c_mktsegment, c_nationkey FROM customer),
t AS ({_table_sql("events", "e", ["event_type", "value"], "event_type, value")} UNION ALL {_table_sql("customer", "c", ["c_mktsegment", "c_nationkey"], "c_mktsegment, c_nationkey")})"""


def _profiles(spark, sf):
    events = table(spark, sf, "events").select("event_type", F.nullif("value", F.lit(1.0)).alias("value"))
    customers = table(spark, sf, "customer").select("c_mktsegment", "c_nationkey")
    return reduce(lambda a, b: a.unionByName(b), [P.table_profile(events, "events"), P.table_profile(customers, "customer")])


@query("table_profile", _TABLES + """
SELECT t AS "table", rows_count, CAST(columns_count AS BIGINT) AS columns_count, missing_count, ROUND(missing_count * 100.0 / (rows_count * columns_count), 4) AS missing_percentage, duplicate_rows FROM t""")
def table_profile(spark, sf):
    return _profiles(spark, sf)


@query("completeness", _TABLES + """
SELECT CAST(SUM(rows_count) AS BIGINT) AS rows_count, CAST(SUM(missing_count) AS BIGINT) AS missing_count, CAST(SUM(duplicate_rows) AS BIGINT) AS duplicate_rows,
 CAST(SUM(rows_count * columns_count) AS BIGINT) AS cells, ROUND((SUM(rows_count * columns_count) - SUM(missing_count)) * 100.0 / SUM(rows_count * columns_count), 4) AS completeness FROM t""")
def completeness(spark, sf):
    return P.workbook_quality(_profiles(spark, sf))


ROLE_TABLES = ("orders", "customer", "part", "supplier", "events", "nation")


def _role_sql(source, name, kind):
    named_id = "TRUE" if name in () else "FALSE"
    v = f"CAST({name} AS DOUBLE)" if kind == "number" else "NULL"
    clock = f"COUNT(*) FILTER (CAST({name} AS DATE) <> {name})" if kind == "date" else "0"
    return (f"SELECT '{source}' AS t, '{name}' AS c, '{kind}' AS kind, COUNT(*) AS n, COUNT({name}) AS present, COUNT(DISTINCT {name}) AS u, "
            f"MIN({v}) AS lo, MAX({v}) AS hi, COUNT(*) FILTER ({v} <> FLOOR({v})) AS frac, {clock} AS clock, {named_id} AS named FROM {source}")


_ROLE_COLUMNS = [("orders", c, k) for c, k in (("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "date"), ("o_orderpriority", "text"))]
_ROLE_COLUMNS += [("customer", c, k) for c, k in (("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text"))]
_ROLE_COLUMNS += [("part", c, k) for c, k in (("p_partkey", "number"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "number"), ("p_retailprice", "number"))]
_ROLE_COLUMNS += [("supplier", c, k) for c, k in (("s_suppkey", "number"), ("s_name", "text"), ("s_nationkey", "number"), ("s_acctbal", "number"))]
_ROLE_COLUMNS += [("events", c, k) for c, k in (("event_id", "number"), ("ts", "date"), ("user_id", "number"), ("event_type", "text"), ("value", "number"), ("props", "text"))]
_ROLE_COLUMNS += [("nation", c, k) for c, k in (("n_nationkey", "number"), ("n_name", "text"), ("n_regionkey", "number"))]


@query("roles", f"""
WITH p AS ({" UNION ALL ".join(_role_sql(*x) for x in _ROLE_COLUMNS)}),
q AS (SELECT *, kind = 'number' AND present >= 5 AND frac = 0 AND u = present AND hi - lo = present - 1 AS sequential FROM p),
x AS (SELECT t, c, n - present AS missing_count, u AS unique_count,
 CASE WHEN kind = 'date' THEN CASE WHEN clock > 0 THEN 'datetime' ELSE 'date' END
      WHEN kind = 'number' THEN CASE WHEN sequential THEN 'identifier' WHEN frac = 0 THEN 'integer' ELSE 'decimal' END
      WHEN u = present AND present > 200 THEN 'identifier' WHEN u <= 1 THEN 'category'
      WHEN u <= 200 AND (u <= 20 OR u <= present * .5) THEN 'category' ELSE 'text' END AS semantic_type,
 CASE WHEN kind = 'date' THEN 'time' WHEN kind = 'number' THEN CASE WHEN sequential THEN 'identifier' ELSE 'measure' END
      WHEN u = present AND present > 200 THEN 'identifier' WHEN u <= 1 THEN 'attribute'
      WHEN u <= 200 AND (u <= 20 OR u <= present * .5) THEN 'dimension' ELSE 'attribute' END AS role, kind, lo FROM q)
SELECT t AS "table", c AS "column", semantic_type, role,
 CASE WHEN role <> 'measure' THEN NULL WHEN c LIKE '%total%' OR c = 'value' THEN 'money' WHEN c LIKE '%price%' THEN 'price'
      WHEN c LIKE '%order%' AND lo >= 0 THEN 'quantity' END AS meaning,
 CASE WHEN kind = 'date' THEN 'iso' END AS time_format, missing_count, unique_count FROM x""")
def roles(spark, sf):
    parts = [P.infer_roles(table(spark, sf, t)).select(F.lit(t).alias("table"), "column", "semantic_type", "role", "meaning", "time_format", "missing_count", "unique_count")
             for t in ROLE_TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("group_head_tail", """
WITH g AS (SELECT p_name AS label, COUNT(*) AS n, MIN(p_partkey) AS f, MAX(p_partkey) AS l FROM part GROUP BY 1),
k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, label) AS a, ROW_NUMBER() OVER (ORDER BY n, label DESC) AS z FROM g),
s AS (SELECT * FROM k WHERE a <= 10 OR z <= 10)
SELECT label, n AS "count", f AS first_row, l AS last_row, (SELECT COUNT(*) FROM g) AS groups_total, (SELECT COUNT(*) FROM g) - (SELECT COUNT(*) FROM s) AS groups_omitted,
 CAST((SELECT SUM(n) FROM g) - (SELECT SUM(n) FROM s) AS BIGINT) AS omitted_rows FROM s""")
def group_head_tail(spark, sf):
    return P.group_head_tail(table(spark, sf, "part").withColumn(ROW, F.col("p_partkey")), "p_name")


@query("group_head_tail_months", """
WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, COUNT(*) AS n FROM orders GROUP BY 1),
s AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY label) AS a, ROW_NUMBER() OVER (ORDER BY label DESC) AS z FROM g) WHERE a <= 10 OR z <= 10)
SELECT label, n AS "count", (SELECT COUNT(*) FROM g) - (SELECT COUNT(*) FROM s) AS groups_omitted FROM s""")
def group_head_tail_months(spark, sf):
    return P.group_head_tail(table(spark, sf, "orders"), "o_orderdate", by_month=True).select("label", "count", "groups_omitted")


def raw_orders(spark, sf):
    """Orders as text cells: every 10th price is not a number, low priorities are blank, dates as ISO text."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(ROW), F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_code"),
        F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice")).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("printed"), F.lit("X").alias("site"), (F.col("o_custkey") % 100).alias("bucket"))


_RAW = """src AS (SELECT o_orderkey AS r, 'ORD-' || o_orderkey AS order_code, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE format('{:.2f}', o_totalprice) END AS price,
 strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority,
 month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) AS printed, 'X' AS site, o_custkey % 100 AS bucket FROM orders)"""


def _strict_sql(i, name, numeric, date, ident):
    num = "COUNT(*)" if name == "bucket" else f"COUNT(*) FILTER ({name} <> 'n/a')" if name == "price" else "0"
    dtype = "datetime" if date else "numeric" if numeric else "text"
    group = f"COUNT(DISTINCT {name}) <= 30"
    semantic = "'identifier'" if ident else "'datetime'" if date else "'numeric_measure'" if numeric else f"CASE WHEN {group} THEN 'category' ELSE 'free_text' END"
    role = "'identifier'" if ident else "'time_dimension'" if date else "'measure'" if numeric else f"CASE WHEN {group} THEN 'dimension' ELSE 'label' END"
    return (f"SELECT '{name}' AS \"column\", '{dtype}' AS type, {semantic} AS semantic_type, {role} AS role, COUNT(DISTINCT {name}) AS \"unique\", COUNT(*) - COUNT({name}) AS missing, "
            f"ROUND((COUNT(*) - COUNT({name})) * 100.0 / COUNT(*), 2) AS null_pct, {num if numeric else f'COUNT({name})'} AS valid_count, {f'COUNT({name}) - {num}' if numeric else '0'} AS invalid_count, "
            f"(SELECT string_agg(CAST(v AS VARCHAR), ' | ' ORDER BY r) FROM (SELECT {name} AS v, r FROM src WHERE {name} IS NOT NULL ORDER BY r LIMIT 3)) AS samples, "
            f"CAST({'0.9' if numeric or date or ident else '0.7'} AS DOUBLE) AS confidence FROM src")


@query("profile_strict", f"""WITH {_RAW} {" UNION ALL ".join(_strict_sql(i, *x) for i, x in enumerate((
    ("order_code", False, False, True), ("price", True, False, False), ("day", False, True, False), ("priority", False, False, False),
    ("printed", False, False, False), ("site", False, False, False), ("bucket", True, False, False))))}""")
def profile_strict(spark, sf):
    return P.profile_strict(raw_orders(spark, sf)).drop("position", "rows")


@query("quality_issues", f"""WITH {_RAW}
SELECT 'missing' AS kind, 'warning' AS severity, CAST(NULL AS VARCHAR) AS "column", COUNT(*) - COUNT(priority) AS "count" FROM src
UNION ALL SELECT 'dates', 'warning', NULL, COUNT(printed) FROM src
UNION ALL SELECT 'summary', 'warning', NULL, 2
UNION ALL SELECT 'mixed', 'warning', 'price', COUNT(*) FILTER (price = 'n/a') FROM src
UNION ALL SELECT 'constant', 'info', 'site', 1
UNION ALL SELECT 'cardinality', 'info', 'printed', COUNT(DISTINCT printed) FROM src""")
def quality_issues(spark, sf):
    raw = raw_orders(spark, sf)
    return P.quality_issues(raw, P.profile_strict(raw), unresolved=2)


@query("slash_dates", f"""WITH {_RAW} SELECT 'printed' AS "column", COUNT(printed) AS "count" FROM src UNION ALL SELECT 'day', CAST(0 AS BIGINT)""")
def slash_dates(spark, sf):
    return P.slash_dates(raw_orders(spark, sf), ["printed", "day"])


@query("limits", "SELECT COUNT(*) AS rows, CAST(9 AS BIGINT) AS columns, COUNT(*) * 9 AS cells FROM (SELECT l_orderkey FROM lineitem)")
def limits(spark, sf):
    return P.check_limits(table(spark, sf, "lineitem").drop("l_partkey", "l_suppkey"), max_rows=1_000_000_000_000)


@query("example_rows")
def example_rows(spark, sf):
    rows = table(spark, sf, "orders").withColumn(ROW, F.col("o_orderkey"))
    return P.example_rows(rows.select(ROW, "o_totalprice", "o_orderpriority", "o_orderdate"))
