"""Bid comparison and estimates: bidder = supplier % 8, line = part, value = summed price (whole cents, so rounding never ties)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import query, r, table
from tabscope.columns import ROW
from tabscope.operators import bids as B

PARTIES = [f"B{i}" for i in range(8)]


def bid_lines(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = l.groupBy(F.col("l_partkey").alias("line"), F.col("p_type").alias("category"), (F.col("l_suppkey") % 8).alias("party_order")).agg(
        F.sum("l_extendedprice").alias("total"), F.sum("l_quantity").alias("material"))
    return g.withColumn("party", F.concat(F.lit("B"), F.col("party_order").cast("string"))).withColumn("labour", F.lit(None).cast("double")).withColumn("item", F.col("line").cast("string"))


_BIDS = """b AS (SELECT l_partkey AS line, p_type AS category, l_suppkey % 8 AS party_order, 'B' || (l_suppkey % 8) AS party, SUM(l_extendedprice) AS total, SUM(l_quantity) AS material
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
t AS (SELECT party, party_order, SUM(total) AS total, SUM(material) AS material, COUNT(*) AS priced FROM b GROUP BY 1, 2),
c AS (SELECT line, category, MIN(total) AS low, MAX(total) AS high, arg_min(party, total) AS low_party, arg_max(party, total) AS high_party FROM b GROUP BY 1, 2 HAVING COUNT(*) = (SELECT COUNT(*) FROM t)),
ct AS (SELECT party, SUM(total) AS common_total, COUNT(*) AS common_lines FROM b WHERE line IN (SELECT line FROM c) GROUP BY 1)"""


@query("rank_bids", f"""WITH {_BIDS}
SELECT ROW_NUMBER() OVER (ORDER BY t.total, party_order) AS rank, t.party, ROUND(t.total, 2) AS total, ROUND(t.material, 2) AS material, CAST(NULL AS DOUBLE) AS labour,
 ROUND(t.total - (SELECT MIN(total) FROM t), 2) AS diff, ROUND((t.total - (SELECT MIN(total) FROM t)) / (SELECT MIN(total) FROM t) * 100, 4) AS diff_pct,
 ROUND((t.total - 50000000.0) / 50000000.0 * 100, 4) AS vs_benchmark_pct, priced, (SELECT COUNT(DISTINCT line) FROM b) - priced AS missing, ROUND(common_total, 2) AS common_total
FROM t LEFT JOIN ct ON ct.party = t.party""")
def rank_bids(spark, sf):
    out = B.rank_bids(bid_lines(spark, sf), 50_000_000.0)
    return out.select("rank", "party", r("total").alias("total"), r("material").alias("material"), "labour", r("diff").alias("diff"), r("diff_pct", 4).alias("diff_pct"),
                      r("vs_benchmark_pct", 4).alias("vs_benchmark_pct"), "priced", "missing", r("common_total").alias("common_total"))


@query("party_totals", f"WITH {_BIDS} SELECT party, party_order, ROUND(total, 2) AS total, ROUND(material, 2) AS material, CAST(NULL AS DOUBLE) AS labour, priced FROM t")
def party_totals(spark, sf):
    return B.party_totals(B.drop_empty_parties(bid_lines(spark, sf))).withColumn("total", r("total")).withColumn("material", r("material"))


@query("common_totals", f"WITH {_BIDS} SELECT party, ROUND(common_total, 2) AS common_total, common_lines FROM ct")
def common_totals(spark, sf):
    return B.common_totals(bid_lines(spark, sf)).withColumn("common_total", r("common_total"))


@query("price_spread", f"WITH {_BIDS} SELECT line, category, low_party, ROUND(low, 2) AS low, high_party, ROUND(high, 2) AS high, ROUND((high - low) / low * 100, 2) AS spread_pct FROM c WHERE low > 0 AND high > low ORDER BY high - low DESC, line LIMIT 15")
def price_spread(spark, sf):
    return B.price_spread(bid_lines(spark, sf)).select("line", "category", "low_party", r("low").alias("low"), "high_party", r("high").alias("high"), r("spread_pct").alias("spread_pct"))


@query("wins", f"WITH {_BIDS} SELECT low_party AS party, COUNT(*) AS wins FROM c GROUP BY 1")
def wins(spark, sf):
    return B.wins(bid_lines(spark, sf))


@query("best_of", f"""WITH {_BIDS}, x AS (SELECT common_total FROM ct WHERE party = (SELECT party FROM t ORDER BY total, party_order LIMIT 1))
SELECT ROUND(SUM(low), 2) AS best_of, ROUND(MAX(common_total), 2) AS low_on_common, ROUND(MAX(common_total) - SUM(low), 2) AS negotiable FROM c, x""")
def best_of(spark, sf):
    out = B.best_of(bid_lines(spark, sf))
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("category_matrix", f"WITH {_BIDS} SELECT category, " + ", ".join(f"ROUND(SUM(CASE WHEN party = '{p}' THEN total END), 2) AS {p}" for p in PARTIES) + " FROM b GROUP BY 1")
def category_matrix(spark, sf):
    return B.category_matrix(bid_lines(spark, sf), PARTIES).select("category", *[r(p).alias(p) for p in PARTIES])


@query("stated_total", f"""WITH {_BIDS}
SELECT party, ROUND(CASE WHEN party = 'B3' THEN total * 2 ELSE total END, 2) AS stated, ROUND(total, 2) AS total, party = 'B3' AS differs FROM t""")
def stated_total(spark, sf):
    totals = B.party_totals(bid_lines(spark, sf))
    value = F.when(F.col("party") == "B3", F.col("total") * 2).otherwise(F.col("total"))
    rows = totals.select("party", F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias(ROW), F.lit(label).alias("label"), v.alias("value")) for i, (label, v) in enumerate(
        (("Total zone A", value / 2), ("Grand Total", value - 1), ("Grand total of the project", value), ("Grand total VAT 7%", value * 1.07)))])).alias("x")).select("party", "x.*")
    return B.stated_total(rows, totals.select("party", "total")).withColumn("stated", r("stated")).withColumn("total", r("total"))


def _line_totals(l, *more):
    """Totals of order lines; ``more`` are columns that tell rows of the same key apart."""
    k = F.col("l_linenumber") % 3
    one = lambda m, a, p, v: F.struct(F.lit(m).alias("measure"), F.lit(a).cast("string").alias("axis"), F.lit(p).alias("position"), v.alias("value"))
    none = F.lit(None).cast("double")
    cells = l.select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("n"), *more, F.col("l_quantity").alias("quantity"), F.explode(F.array(
        one("amount", None, 5, F.when(k == 0, F.col("l_extendedprice")).otherwise(none)), one("amount", "material", 2, F.when(k == 1, F.col("l_extendedprice")).otherwise(none)),
        one("amount", "labour", 3, F.when(k == 1, F.col("l_tax") * 100).otherwise(none)), one("unit", None, 1, F.when(k == 2, F.col("l_discount")).otherwise(none)))).alias("x")).select("line", "n", *more, "quantity", "x.*")
    return B.line_total(cells, ["line", "n", *more]).select("line", "n", *more, *[r(c).alias(c) for c in ("total", "material", "labour")])


@query("line_total", """
SELECT l_orderkey AS line, l_linenumber AS n, ROUND(CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice + l_tax * 100 ELSE l_quantity * l_discount END, 2) AS total,
 CASE l_linenumber % 3 WHEN 1 THEN ROUND(l_extendedprice, 2) END AS material, CASE l_linenumber % 3 WHEN 1 THEN ROUND(l_tax * 100, 2) END AS labour FROM (SELECT DISTINCT * FROM lineitem) x
QUALIFY COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1""")
def line_total(spark, sf):
    l = table(spark, sf, "lineitem").distinct()
    once = l.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").drop("c")
    return _line_totals(l.join(once, ["l_orderkey", "l_linenumber"]))


@query("line_total_every_line", """
SELECT l_orderkey AS line, l_linenumber AS n, nth, ROUND(CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice + l_tax * 100 ELSE l_quantity * l_discount END, 2) AS total,
 CASE l_linenumber % 3 WHEN 1 THEN ROUND(l_extendedprice, 2) END AS material, CASE l_linenumber % 3 WHEN 1 THEN ROUND(l_tax * 100, 2) END AS labour
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) AS nth FROM lineitem) x""")
def line_total_every_line(spark, sf):
    """``line_total`` on all rows: rows that repeat a key are numbered over all their columns."""
    l = table(spark, sf, "lineitem")
    l = l.withColumn("nth", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[F.col(c).asc_nulls_first() for c in l.columns])).cast("bigint"))
    return _line_totals(l, "nth")


@query("fill_sections", """
WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN 'Section ' || (o_orderkey // 50) END AS h FROM orders)
SELECT k AS _row, 'Section ' || (k // 50) AS category FROM s WHERE h IS NULL""")
def fill_sections(spark, sf):
    heading = F.col("o_orderkey") % 50 == 0
    rows = table(spark, sf, "orders").select(F.lit("t").alias("table"), F.col("o_orderkey").alias(ROW), F.when(heading, F.concat(F.lit("Section "), F.floor(F.col("o_orderkey") / 50).cast("string"))).otherwise("line").alias("label"),
                                             F.when(~heading, F.col("o_totalprice")).alias("quantity"), (~heading).alias("priced"), F.lit(None).cast("string").alias("category_text"))
    return B.section_category(rows, ["table"]).select(ROW, "category")


_ROLE_COLUMNS = [(1, "Category", "text"), (2, "Description", "text"), (3, "Unit", "text"), (4, "Qty", "number"), (5, "Budget / Total", "number"),
                 (6, "Acme Ltd / Material unit price", "number"), (7, "Acme Ltd / Amount", "number"), (8, "Acme Ltd / Total amount", "number"), (9, "Beta Beta Co / Labour cost", "number"), (10, "Remark", "text")]


@query("read_roles", """
WITH t AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT CAST(k AS VARCHAR) AS "table", position, role, party, is_benchmark, measure, axis FROM t, (VALUES (1, 'category', NULL, FALSE, NULL, NULL), (2, 'item', NULL, FALSE, NULL, NULL), (3, 'unit', NULL, FALSE, NULL, NULL),
 (4, 'quantity', NULL, FALSE, NULL, NULL), (5, 'priced', 'Budget', TRUE, 'amount', NULL), (6, 'priced', 'Acme Ltd', FALSE, 'unit', 'material'), (7, 'priced', 'Acme Ltd', FALSE, 'amount', 'material'),
 (8, 'priced', 'Acme Ltd', FALSE, 'amount', NULL), (9, 'priced', 'Beta Co', FALSE, 'amount', 'labour'), (10, NULL, NULL, FALSE, NULL, NULL)) v(position, role, party, is_benchmark, measure, axis)""")
def read_roles(spark, sf):
    one = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(n).alias("name"), F.lit(t).alias("data_type")) for p, n, t in _ROLE_COLUMNS])
    columns = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("table")).distinct().select("table", F.explode(one).alias("x")).select("table", "x.*")
    return B.read_roles(columns).drop("name")


@query("classify_table", """
WITH b AS (SELECT p_type AS t, COUNT(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
k AS (SELECT t, n, CASE WHEN t IN ('PROMO', 'SMALL') THEN 'comparison' WHEN t = 'LARGE' THEN 'estimate' ELSE 'general' END AS kind FROM b)
SELECT t AS "table", kind, n AS priced_lines, t = (SELECT t FROM k WHERE kind = 'comparison' ORDER BY n DESC LIMIT 1) AS preferred FROM k""")
def classify_table(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    party = F.when(F.col("p_type").isin("PROMO", "SMALL"), F.concat(F.lit("B"), (F.col("l_suppkey") % 3).cast("string")))
    lines = l.groupBy(F.col("p_type").alias("table"), F.col("l_partkey").alias("line"), party.alias("party")).agg(F.sum("l_extendedprice").alias("total")).withColumn("is_benchmark", F.lit(False))
    types = table(spark, sf, "part").select(F.col("p_type").alias("table")).distinct()
    name = F.when(F.col("table").isin("LARGE", "PROMO", "SMALL"), "Description").otherwise("Colour")
    columns = types.select("table", F.explode(F.array(F.struct(F.lit(1).alias("position"), name.alias("name"), F.lit("text").alias("data_type")),
                                                      F.struct(F.lit(2).alias("position"), F.lit("Qty").alias("name"), F.lit("number").alias("data_type")),
                                                      F.struct(F.lit(3).alias("position"), F.lit("Unit price").alias("name"), F.lit("number").alias("data_type")))).alias("x")).select("table", "x.*")
    return B.classify_table(B.read_roles(columns), lines)


def estimate_lines(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = l.groupBy(F.col("l_partkey").alias("line"), F.col("p_type").alias("category")).agg(F.sum("l_extendedprice").alias("m"), F.sum("l_quantity").alias("lab"))
    keep = F.col("line") % 11 != 0
    return g.select("line", "category", F.when(keep, F.col("m") + F.col("lab")).alias("total"), F.when(keep, F.col("m")).alias("material"), F.when(keep, F.col("lab")).alias("labour"))


_EST = """e AS (SELECT l_partkey AS line, p_type AS category, CASE WHEN l_partkey % 11 <> 0 THEN SUM(l_extendedprice) + SUM(l_quantity) END AS total,
 CASE WHEN l_partkey % 11 <> 0 THEN SUM(l_extendedprice) END AS material, CASE WHEN l_partkey % 11 <> 0 THEN SUM(l_quantity) END AS labour FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


@query("estimate_totals", f"""WITH {_EST} SELECT ROUND(SUM(total), 2) AS total, ROUND(SUM(material), 2) AS material, ROUND(SUM(labour), 2) AS labour, ROUND(SUM(material) / SUM(total) * 100, 4) AS material_share,
 ROUND(SUM(labour) / SUM(total) * 100, 4) AS labour_share, COUNT(total) AS priced, COUNT(*) - COUNT(total) AS unpriced FROM e""")
def estimate_totals(spark, sf):
    out = B.estimate_totals(estimate_lines(spark, sf))
    return out.select(*[r(c, 4 if c.endswith("share") else 2).alias(c) if c not in ("priced", "unpriced") else F.col(c) for c in out.columns])


@query("category_share", f"WITH {_EST} SELECT category, ROUND(SUM(total), 2) AS value, COUNT(*) AS items, ROUND(SUM(total) / (SELECT SUM(total) FROM e) * 100, 4) AS share FROM e WHERE total IS NOT NULL GROUP BY 1")
def category_share(spark, sf):
    return B.category_share(estimate_lines(spark, sf)).select("category", r("value").alias("value"), "items", r("share", 4).alias("share"))


@query("pareto", f"""WITH {_EST}, s AS (SELECT total, SUM(total) OVER (ORDER BY total DESC, line ROWS UNBOUNDED PRECEDING) - total AS before, SUM(total) OVER () AS whole FROM e WHERE total IS NOT NULL)
SELECT COUNT(*) FILTER (before < whole * .8) AS lines_needed, COUNT(*) AS priced, ROUND(MAX(whole), 2) AS total FROM s""")
def pareto(spark, sf):
    return B.pareto_count(estimate_lines(spark, sf)).withColumn("total", r("total"))


@query("top_lines", f"""WITH {_EST} SELECT line, category, ROUND(total, 2) AS value, ROUND(total / whole * 100, 4) AS share, ROUND(SUM(total) OVER (ORDER BY total DESC, line ROWS UNBOUNDED PRECEDING) / whole * 100, 4) AS cumulative_share
FROM e, (SELECT SUM(total) AS whole FROM e) WHERE total IS NOT NULL ORDER BY total DESC, line LIMIT 15""")
def top_lines(spark, sf):
    return B.top_lines(estimate_lines(spark, sf)).select("line", "category", r("value").alias("value"), r("share", 4).alias("share"), r("cumulative_share", 4).alias("cumulative_share"))
