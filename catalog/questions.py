"""Grouped questions."""

from pyspark.sql import functions as F

from catalog.base import query, r, table
from tabscope.operators.ask import Question, answers_table, ask, ask_many, headline, to_evidence, to_series


def shown(answer, digits=2):
    keys = [f"key{i}" for i in range(1, len(answer.question.group_by) + 1)]
    return answer.groups.select(*keys, r("value", digits).alias("value"), r("share", 4).alias("share"), "groups_total", "truncated")


@query("ask_group_share", """
WITH t AS (SELECT SUM(o_totalprice) AS total FROM orders),
g AS (SELECT o_orderpriority AS key1, SUM(o_totalprice) AS v FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT key1, ROUND(v, 2) AS value, ROUND(v / total * 100, 4) AS share, (SELECT COUNT(*) FROM g) AS groups_total,
       (SELECT COUNT(*) FROM g) > 15 AS truncated
FROM g, t ORDER BY v DESC, key1 LIMIT 15""")
def ask_group_share(spark, sf):
    return shown(ask(table(spark, sf, "orders"), Question("o_totalprice", "sum", ("o_orderpriority",))))


@query("ask_two_keys", """
WITH src AS (SELECT NULLIF(l_returnflag, 'N') AS f, l_linestatus AS s, l_quantity FROM lineitem),
g AS (SELECT f AS key1, s AS key2, COUNT(l_quantity) AS v FROM src GROUP BY 1, 2),
ok AS (SELECT * FROM g WHERE key1 IS NOT NULL AND key2 IS NOT NULL)
SELECT key1, key2, CAST(v AS DOUBLE) AS value, ROUND(v * 100.0 / (SELECT SUM(v) FROM g), 4) AS share,
       (SELECT COUNT(*) FROM ok) AS groups_total, (SELECT COUNT(*) FROM ok) > 3 AS truncated
FROM ok ORDER BY v DESC, key1, key2 LIMIT 3""")
def ask_two_keys(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    answer = ask(rows, Question("l_quantity", "count", ("l_returnflag", "l_linestatus"), limit=3))
    return shown(answer).withColumn("value", F.col("value").cast("double"))


def _period(name, grain, label):
    @query(name, f"""
    WITH g AS (SELECT {label} AS key1, AVG(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT key1, ROUND(v, 2) AS value, CAST(NULL AS DOUBLE) AS share, (SELECT COUNT(*) FROM g) AS groups_total,
           (SELECT COUNT(*) FROM g) > 50 AS truncated
    FROM g ORDER BY key1 LIMIT 50""")
    def run(spark, sf):
        return shown(ask(table(spark, sf, "orders"), Question("o_totalprice", "avg", ("o_orderdate",), grain=grain, sort="label", limit=50)))


_period("ask_month", "month", "strftime(o_orderdate, '%Y-%m')")
_period("ask_week", "week", "strftime(o_orderdate, '%Y-W%W')")
_period("ask_quarter", "quarter", "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)")


@query("ask_default_grain", """
WITH span AS (SELECT date_diff('day', MIN(CAST(ts AS DATE)), MAX(CAST(ts AS DATE))) AS d FROM events),
g AS (SELECT CASE WHEN d <= 92 THEN strftime(ts, '%Y-%m-%d') WHEN d <= 1098 THEN strftime(ts, '%Y-%m')
                  WHEN d <= 2928 THEN strftime(ts, '%Y') || '-Q' || quarter(ts) ELSE strftime(ts, '%Y') END AS key1,
             MAX(value) AS v FROM events, span GROUP BY 1)
SELECT key1, ROUND(v, 2) AS value, CAST(NULL AS DOUBLE) AS share, (SELECT COUNT(*) FROM g) AS groups_total,
       (SELECT COUNT(*) FROM g) > 15 AS truncated FROM g ORDER BY v ASC, key1 LIMIT 15""")
def ask_default_grain(spark, sf):
    return shown(ask(table(spark, sf, "events"), Question("value", "max", ("ts",), sort="asc")))


@query("ask_filtered", """
WITH m AS (SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'R') AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
           AND l_quantity BETWEEN 10 AND 40)
SELECT ROUND(SUM(l_extendedprice), 2) AS value, COUNT(*) AS matched, CAST(0 AS BIGINT) AS excluded_summary_rows FROM m""")
def ask_filtered(spark, sf):
    answer = ask(table(spark, sf, "lineitem"), Question("l_extendedprice", "sum", filters=(
        {"column": "l_returnflag", "values": ["A", "R"]}, {"column": "l_shipdate", "from": "1996-01-01", "to": "1998-12-31"},
        {"column": "l_quantity", "min": 10, "max": 40})))
    return answer.summary.withColumn("value", r("value"))


@query("ask_batch", """
SELECT 'a' AS id, TRUE AS ok, CAST(NULL AS VARCHAR) AS error, NULL AS key1, NULL AS key2, CAST(COUNT(*) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS share FROM orders
UNION ALL SELECT 'bad', FALSE, 'o_orderstatus is not numeric', NULL, NULL, NULL, NULL
UNION ALL SELECT * FROM (SELECT 'c', TRUE, NULL, o_orderstatus, NULL, CAST(COUNT(*) AS DOUBLE), ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM orders), 4)
  FROM orders GROUP BY o_orderstatus ORDER BY COUNT(*) DESC, o_orderstatus LIMIT 2)
UNION ALL SELECT 'e', TRUE, NULL, NULL, NULL, CAST(COUNT(DISTINCT o_custkey) AS DOUBLE), NULL FROM orders""")
def ask_batch(spark, sf):
    answers = ask_many(table(spark, sf, "orders"), [
        Question(id="a"), Question("o_orderstatus", "sum", id="bad"), Question(None, "count", ("o_orderstatus",), limit=1, id="c"),
        Question(None, "count", ("o_orderstatus",), limit=2, id="d"), Question("o_custkey", "count_distinct", id="e")])
    return answers_table(spark, answers).withColumn("share", r("share", 4))


@query("ask_series", """
SELECT o_orderpriority AS key1, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, SUM(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O,
       SUM(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P FROM orders GROUP BY 1""")
def ask_series(spark, sf):
    wide = to_series(ask(table(spark, sf, "orders"), Question(None, "count", ("o_orderpriority", "o_orderstatus"), sort="label", limit=50)))
    return wide.select("key1", "F", "O", "P")


@query("ask_headline", """
SELECT 'a' AS id, 'orders' AS label, CAST(COUNT(*) AS DOUBLE) AS value, 'rows' AS note FROM orders
UNION ALL SELECT * FROM (SELECT 'b', 'best status', CAST(COUNT(*) AS DOUBLE), o_orderstatus FROM orders GROUP BY o_orderstatus ORDER BY 3 DESC, 4 LIMIT 1)
UNION ALL SELECT 'd', 'largest', MAX(o_totalprice), 'o_totalprice' FROM orders""")
def ask_headline(spark, sf):
    return headline(spark, ask_many(table(spark, sf, "orders"), [
        Question(id="a", purpose="orders"), Question(None, "count", ("o_orderstatus",), limit=1, id="b", purpose="best status"),
        Question(None, "count", ("o_orderpriority",), id="c", purpose="by priority"), Question("o_totalprice", "max", id="d", purpose="largest")]))


@query("ask_evidence", """
WITH g AS (SELECT event_type AS k, COUNT(*) AS n FROM events GROUP BY 1)
SELECT 'Q-001' AS evidence_id, 'events by type: rows from ' || format('{:,}', CAST(SUM(n) AS BIGINT)) || ' rows by event_type: '
  || string_agg(k || ' = ' || format('{:,}', n) || ' (' || rtrim(rtrim(format('{:.2f}', n * 100.0 / (SELECT SUM(n) FROM g)), '0'), '.') || '%)', '; ' ORDER BY n DESC, k)
  || '; total ' || format('{:,}', CAST(SUM(n) AS BIGINT)) AS text FROM g""")
def ask_evidence(spark, sf):
    return to_evidence(ask(table(spark, sf, "events"), Question(None, "count", ("event_type",), purpose="events by type")))
