"""Benchmark comparison: vendor = supplier % 5, reference price = the part's retail price."""

from pyspark.sql import functions as F

from catalog.base import query, table
from catalog.base import r as rounded
from tabscope.operators import benchmark as Q

VENDORS = [f"V{i}" for i in range(5)]
TOLERANCE = .15


def r(c, digits=3):
    """Values are multiples of a thousandth, so three digits never tie."""
    return rounded(c, digits)


def records(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    none = F.lit(None).cast("double")
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    ref = F.when(F.col("l_linenumber") == 6, none).otherwise(F.col("p_retailprice"))
    r_ = l.select(F.lit("f.xlsx").alias("source"), F.lit("ST_1").alias("sheet"), F.concat(F.lit("V"), (F.col("l_suppkey") % 5).cast("string")).alias("vendor"), F.col("p_type").alias("group"),
                  F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") == 1, "not_quoted")).alias("note"),
                  F.when(F.col("l_linenumber") == 6, none).otherwise(F.lit(25.0)).alias("quantity_benchmark"), F.when(F.col("l_linenumber") == 7, none).otherwise(F.col("l_quantity")).alias("quantity_proposal"), none.alias("quantity_normalized"),
                  ref.alias("material_benchmark"), F.when(F.col("l_linenumber") == 7, none).otherwise(rate).alias("material_proposal"),
                  F.when(F.col("l_linenumber") == 7, none).when(rate > ref * 1.22, ref).otherwise(rate).alias("material_normalized"),
                  F.when(F.col("l_linenumber") == 6, none).otherwise(F.lit(100.0)).alias("labour_benchmark"), F.when(F.col("l_linenumber") == 7, none).otherwise(100 * (1 + F.col("l_tax") * 4)).alias("labour_proposal"), none.alias("labour_normalized"),
                  none.alias("total_benchmark"), F.when((F.col("l_linenumber") == 2) | ((F.col("l_linenumber") == 7) & (F.col("l_linestatus") == "O")), F.col("l_extendedprice") * 1.1).alias("total_proposal"), none.alias("total_normalized"))
    return Q.flag_parents(r_)


_REC = """l AS (SELECT *, l_extendedprice / l_quantity AS rate FROM lineitem JOIN part ON l_partkey = p_partkey),
x AS (SELECT 'V' || (l_suppkey % 5) AS vendor, p_type AS g, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'not_quoted' END AS note,
 CASE WHEN l_linenumber <> 6 THEN 25.0 END::DOUBLE AS qb, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS qp, CASE WHEN l_linenumber <> 6 THEN p_retailprice END AS mb, CASE WHEN l_linenumber <> 7 THEN rate END AS mp,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber <> 6 AND rate > p_retailprice * 1.22 THEN p_retailprice ELSE rate END AS mn,
 CASE WHEN l_linenumber <> 6 THEN 100.0 END::DOUBLE AS lb, CASE WHEN l_linenumber <> 7 THEN 100 * (1 + l_tax * 4) END AS lp,
 CASE WHEN l_linenumber = 2 OR (l_linenumber = 7 AND l_linestatus = 'O') THEN l_extendedprice * 1.1 END AS tp FROM l),
y AS (SELECT *, tp IS NOT NULL AND tp <> 0 AND mp IS NULL AND lp IS NULL AND qp IS NULL AS parent,
 COALESCE(note, CASE WHEN COALESCE(qb > 0 AND qp IS NOT NULL, FALSE) OR COALESCE(mb > 0 AND mp IS NOT NULL, FALSE) OR COALESCE(lb > 0 AND lp IS NOT NULL, FALSE) THEN 'comparable'
  WHEN COALESCE(qb, 0) = 0 AND COALESCE(mb, 0) = 0 AND COALESCE(lb, 0) = 0 THEN 'out_of_scope' ELSE 'not_quoted' END) AS kind FROM x),
z AS (SELECT *, kind = 'comparable' AND (COALESCE(mb > 0 AND mp / mb > 20, FALSE) OR COALESCE(lb > 0 AND lp / lb > 20, FALSE)) AS mismatch FROM y),
c AS (SELECT *, COALESCE(mp, 0) + COALESCE(lp, 0) AS bid, COALESCE(CASE WHEN mb > 0 AND mp > mb * 1.15 THEN mb ELSE mp END, 0) + COALESCE(CASE WHEN lb > 0 AND lp > lb * 1.15 THEN lb ELSE lp END, 0) AS used,
 CASE WHEN qb > 0 AND qp > qb * 1.15 THEN qb ELSE qp END AS qu FROM z),
d AS (SELECT *, CASE WHEN (mp IS NOT NULL OR lp IS NOT NULL) AND qp IS NOT NULL THEN qp * bid END AS calc FROM c),
m AS (SELECT *, CASE WHEN mismatch THEN COALESCE(tp, COALESCE(qp, 0) * bid) ELSE COALESCE(tp, calc, 0) END AS original,
 CASE WHEN mismatch THEN COALESCE(tp, COALESCE(qp, 0) * bid) WHEN COALESCE(calc, 0) = 0 THEN COALESCE(tp, calc, 0) WHEN tp IS NOT NULL THEN tp * (qu * used / calc) ELSE qu * used END AS normalized FROM d),
agg AS (SELECT vendor, g, COUNT(*) FILTER (NOT parent) AS total, COUNT(*) FILTER (NOT parent AND kind = 'comparable') AS comparable, COUNT(*) FILTER (NOT parent AND kind = 'out_of_scope') AS out_of_scope,
 COUNT(*) FILTER (NOT parent AND kind = 'not_quoted') AS not_quoted, COUNT(*) FILTER (parent) AS parent_rows, COUNT(*) FILTER (NOT parent AND mismatch) AS mismatch,
 SUM(original) FILTER (NOT parent) AS original, SUM(normalized) FILTER (NOT parent) AS normalized,
 COUNT(*) FILTER (f AND qb > 0 AND qp > qb * 1.15) AS quantity_over, COUNT(*) FILTER (f AND mb > 0 AND mp > mb * 1.15) AS material_over, COUNT(*) FILTER (f AND lb > 0 AND lp > lb * 1.15) AS labour_over,
 COUNT(*) FILTER (f AND mp < mb) AS material_under, SUM(qb * mb) FILTER (f AND mb > 0 AND mp IS NOT NULL AND qb <> 0) AS mref, SUM(qb * mp) FILTER (f AND mb > 0 AND mp IS NOT NULL AND qb <> 0) AS mbid,
 SUM(qb * lb) FILTER (f AND lb > 0 AND lp IS NOT NULL AND qb <> 0) AS lref, SUM(qb * lp) FILTER (f AND lb > 0 AND lp IS NOT NULL AND qb <> 0) AS lbid
 FROM (SELECT *, NOT parent AND kind = 'comparable' AND NOT mismatch AS f FROM m) GROUP BY 1, 2),
tot AS (SELECT vendor, CAST(NULL AS VARCHAR) AS g, SUM(total) AS total, SUM(comparable) AS comparable, SUM(out_of_scope) AS out_of_scope, SUM(not_quoted) AS not_quoted, SUM(parent_rows) AS parent_rows, SUM(mismatch) AS mismatch,
 SUM(original) AS original, SUM(normalized) AS normalized, SUM(quantity_over) AS quantity_over, SUM(material_over) AS material_over, SUM(labour_over) AS labour_over, SUM(material_under) AS material_under,
 SUM(mref) AS mref, SUM(mbid) AS mbid, SUM(lref) AS lref, SUM(lbid) AS lbid FROM agg GROUP BY 1),
s AS (SELECT *, original - normalized AS savings, (original - normalized) / original * 100 AS savings_pct, comparable + not_quoted AS items, quantity_over * 100.0 / (comparable + not_quoted) AS quantity_over_pct,
 (mbid / mref - 1) * 100 AS material_dev_pct, (lbid / lref - 1) * 100 AS labour_dev_pct FROM (SELECT * FROM agg UNION ALL SELECT * FROM tot))"""


def summary(spark, sf):
    return Q.summarize(Q.aggregate_groups(Q.priced_records(records(spark, sf), TOLERANCE), TOLERANCE))


@query("boq_classify", f"WITH {_REC} SELECT vendor, kind, parent, mismatch, COUNT(*) AS rows FROM z GROUP BY 1, 2, 3, 4")
def boq_classify(spark, sf):
    return Q.flag_mismatch(Q.classify_rows(records(spark, sf))).groupBy("vendor", "kind", "parent", "mismatch").agg(F.count(F.lit(1)).alias("rows"))


@query("boq_money", f"WITH {_REC} SELECT vendor, kind, ROUND(SUM(original), 3) AS original, ROUND(SUM(normalized), 3) AS normalized FROM m GROUP BY 1, 2")
def boq_money(spark, sf):
    money = Q.priced_records(records(spark, sf), TOLERANCE)
    return money.groupBy("vendor", "kind").agg(r(F.sum("original")).alias("original"), r(F.sum("normalized")).alias("normalized"))


@query("boq_rollup", f"""WITH {_REC} SELECT vendor, g AS "group", CAST(total AS BIGINT) AS total, CAST(comparable AS BIGINT) AS comparable, CAST(out_of_scope AS BIGINT) AS out_of_scope, CAST(not_quoted AS BIGINT) AS not_quoted,
 CAST(parent_rows AS BIGINT) AS parent_rows, CAST(mismatch AS BIGINT) AS mismatch, ROUND(original, 3) AS original, ROUND(normalized, 3) AS normalized, ROUND(savings_pct, 4) AS savings_pct, CAST(quantity_over AS BIGINT) AS quantity_over,
 CAST(material_over AS BIGINT) AS material_over, CAST(labour_over AS BIGINT) AS labour_over, CAST(material_under AS BIGINT) AS material_under, ROUND(quantity_over_pct, 4) AS quantity_over_pct, ROUND(material_dev_pct, 4) AS material_dev_pct, ROUND(labour_dev_pct, 4) AS labour_dev_pct FROM s""")
def boq_rollup(spark, sf):
    return summary(spark, sf).select("vendor", "group", "total", "comparable", "out_of_scope", "not_quoted", "parent_rows", "mismatch", r("original").alias("original"), r("normalized").alias("normalized"),
                                     r("savings_pct", 4).alias("savings_pct"), "quantity_over", "material_over", "labour_over", "material_under", r("quantity_over_pct", 4).alias("quantity_over_pct"),
                                     r("material_dev_pct", 4).alias("material_dev_pct"), r("labour_dev_pct", 4).alias("labour_dev_pct"))


@query("boq_matrix", f"WITH {_REC} SELECT g AS \"group\", " + ", ".join(f"ROUND(MAX(CASE WHEN vendor = '{v}' THEN labour_dev_pct END), 4) AS {v}" for v in VENDORS) + " FROM s WHERE g IS NOT NULL GROUP BY 1")
def boq_matrix(spark, sf):
    return Q.comparison_matrix(summary(spark, sf), "labour_dev_pct", VENDORS).select("group", *[r(v, 4).alias(v) for v in VENDORS])


@query("boq_leaders", f"""WITH {_REC}, u AS (SELECT vendor, g, 'quantity_over' AS metric, CAST(quantity_over AS DOUBLE) AS v FROM s WHERE g IS NOT NULL UNION ALL SELECT vendor, g, 'savings', savings FROM s WHERE g IS NOT NULL
 UNION ALL SELECT vendor, g, 'labour_dev_pct', labour_dev_pct FROM s WHERE g IS NOT NULL AND comparable >= 5 UNION ALL SELECT vendor, g, 'material_dev_pct', material_dev_pct FROM s WHERE g IS NOT NULL AND comparable >= 5),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vendor, metric ORDER BY v DESC, g) AS n FROM u WHERE v IS NOT NULL)
SELECT vendor, metric, g AS "group", ROUND(v, 3) AS value FROM k WHERE n = 1""")
def boq_leaders(spark, sf):
    return Q.leaders(summary(spark, sf)).withColumn("value", r("value", 3))


@query("boq_patterns", f"""WITH {_REC}, p AS (SELECT vendor, COALESCE(labour_dev_pct, 0) AS lab, COALESCE(material_dev_pct, 0) AS mat, COALESCE(quantity_over_pct, 0) AS q, MAX(COALESCE(quantity_over_pct, 0)) OVER () AS qm FROM s WHERE g IS NULL),
n AS (SELECT vendor, concat_ws(' + ', CASE WHEN lab > 15 AND lab > mat + 10 THEN 'labour-heavy' WHEN mat > 15 AND mat > lab + 10 THEN 'material-heavy' WHEN lab > 15 AND mat > 15 THEN 'labour and material high' END,
 CASE WHEN q > 5 AND q >= .8 * qm THEN 'quantity padding' END) AS pattern FROM p),
w AS (SELECT vendor, string_agg(g, ', ' ORDER BY k) AS top_groups FROM (SELECT vendor, g, ROW_NUMBER() OVER (PARTITION BY vendor ORDER BY savings DESC, g) AS k FROM s WHERE g IS NOT NULL AND savings > 0) WHERE k <= 2 GROUP BY 1)
SELECT n.vendor, CASE WHEN pattern = '' THEN 'close to benchmark' ELSE pattern END AS pattern, COALESCE(top_groups, '') AS top_groups FROM n LEFT JOIN w ON w.vendor = n.vendor""")
def boq_patterns(spark, sf):
    return Q.pattern_labels(summary(spark, sf))


@query("field_summary", f"""WITH {_REC} SELECT COUNT(*) AS vendors, CAST(SUM(items) AS BIGINT) AS items, arg_min(vendor, savings_pct) AS closest, arg_max(vendor, savings_pct) AS furthest, ROUND(AVG(savings), 3) AS average_savings, ROUND(AVG(savings_pct), 4) AS average_savings_pct FROM s WHERE g IS NULL""")
def field_summary(spark, sf):
    return Q.field_summary(summary(spark, sf)).withColumn("average_savings", r("average_savings")).withColumn("average_savings_pct", r("average_savings_pct", 4))


@query("benchmark_totals", f"""WITH {_REC} SELECT ROUND(SUM(original), 3) AS original, ROUND(SUM(normalized), 3) AS normalized, ROUND(SUM(savings), 3) AS savings, CAST(SUM(quantity_over + material_over + labour_over) AS BIGINT) AS over, CAST(SUM(items) AS BIGINT) AS items FROM s WHERE g IS NULL""")
def benchmark_totals(spark, sf):
    out = Q.benchmark_totals(summary(spark, sf))
    return out.select(r("original").alias("original"), r("normalized").alias("normalized"), r("savings").alias("savings"), "over", "items")


@query("tolerance", f"""WITH {_REC}, f AS (SELECT vendor, mp / mb AS q FROM x WHERE mb > 0 AND mp > mb AND ABS(mn - mp) > 1e-9 AND ABS(mn - mb) <= mb * 1e-6)
SELECT vendor, CASE WHEN COUNT(*) >= 20 THEN GREATEST(0, FLOOR((MIN(q) - 1) * 100 * 2) / 2) / 100 END AS tolerance, COUNT(*) AS sample FROM f GROUP BY 1""")
def tolerance(spark, sf):
    return Q.infer_tolerance(records(spark, sf))


@query("reconcile", f"""WITH {_REC}, t AS (SELECT vendor, SUM(normalized) FILTER (NOT parent) AS n, SUM(COALESCE(mn, 0) * qp) FILTER (NOT parent) AS st FROM m GROUP BY 1)
SELECT vendor, ROUND(n, 3) AS normalized, ROUND(st, 3) AS stated_normalized, ROUND(n - st, 3) AS difference, ROUND((n - st) / st * 100, 4) AS difference_pct FROM t""")
def reconcile(spark, sf):
    rows = records(spark, sf).withColumn("total_normalized", F.coalesce("material_normalized", F.lit(0.0)) * F.col("quantity_proposal"))
    rows = rows.withColumn("total_normalized", F.when(~F.col("parent"), F.col("total_normalized")))
    out = Q.reconcile(Q.summarize(Q.aggregate_groups(Q.priced_records(rows, TOLERANCE), TOLERANCE)))
    return out.select("vendor", *[r(c).alias(c) for c in ("normalized", "stated_normalized", "difference")], r("difference_pct", 4).alias("difference_pct"))


HEADERS = ["No", "Item", "Category", "Unit", "Quantity RBP", "Quantity AAA", "Quantity BBB", "Material RBP", "Material AAA", "Material BBB", "Labour RBP", "Labour AAA", "Labour BBB", "Diff Material AAA", "Total AAA", "Remark"]


def bill_grid(spark, sf):
    """One bill per part type: title, header and a row per part, priced by AAA and BBB."""
    p = table(spark, sf, "part").select((F.concat(F.upper(F.substring("p_type", 1, 2)), F.lit("_"), F.col("p_type"))).alias("sheet"), "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    s = lambda c: c.cast("string")
    q, price = F.col("p_size"), F.col("p_retailprice")
    rows = p.select("sheet", (F.col("p_partkey") + 3).alias("row_number"), F.array(
        s(F.col("p_partkey")), F.col("p_name"), F.col("p_brand"), F.lit("ea"), s(q), s(q), s(q * 1.2), F.format_number(price, 2), F.format_string("%.2f", price * 2), F.format_string("%.2f", price), F.lit("50"), F.lit("50"), F.lit("52.5"),
        F.lit("0"), F.lit(None).cast("string"), F.when(F.col("p_partkey") % 9 == 0, "out of scope").otherwise("")).alias("cells"))
    heads = p.select("sheet").distinct().select("sheet", F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("row_number"), F.array(F.lit("Contractor: Acme Works"), F.lit("Project North Tower")).alias("cells")),
        F.struct(F.lit(2).cast("bigint").alias("row_number"), F.array(*[F.lit(h) for h in HEADERS]).alias("cells")))).alias("x")).select("sheet", "x.*")
    return rows.unionByName(heads).select(F.lit("bill.xlsx").alias("source"), "sheet", "row_number", "cells")


@query("map_headers", """
WITH t AS (SELECT DISTINCT upper(substr(p_type, 1, 2)) || '_' || p_type AS sheet FROM part)
SELECT sheet, position, axis, role, derived, line_total, category, item, label FROM t, (VALUES (0, NULL, 'proposal', FALSE, FALSE, FALSE, FALSE, ''), (1, NULL, 'proposal', FALSE, FALSE, FALSE, TRUE, ''), (2, NULL, 'proposal', FALSE, FALSE, TRUE, FALSE, ''),
 (3, NULL, 'proposal', FALSE, FALSE, FALSE, FALSE, ''), (4, 'quantity', 'benchmark', FALSE, FALSE, FALSE, FALSE, 'RBP'), (5, 'quantity', 'proposal', FALSE, FALSE, FALSE, FALSE, 'AAA'), (6, 'quantity', 'proposal', FALSE, FALSE, FALSE, FALSE, 'BBB'),
 (7, 'material', 'benchmark', FALSE, FALSE, FALSE, FALSE, 'RBP'), (8, 'material', 'proposal', FALSE, FALSE, FALSE, FALSE, 'AAA'), (9, 'material', 'proposal', FALSE, FALSE, FALSE, FALSE, 'BBB'), (10, 'labour', 'benchmark', FALSE, FALSE, FALSE, FALSE, 'RBP'),
 (11, 'labour', 'proposal', FALSE, FALSE, FALSE, FALSE, 'AAA'), (12, 'labour', 'proposal', FALSE, FALSE, FALSE, FALSE, 'BBB'), (13, 'material', 'proposal', TRUE, FALSE, FALSE, FALSE, 'Diff AAA'), (14, NULL, 'proposal', FALSE, TRUE, FALSE, FALSE, ''),
 (15, NULL, 'proposal', FALSE, FALSE, FALSE, FALSE, '')) v(position, axis, role, derived, line_total, category, item, label)""")
def map_headers(spark, sf):
    return Q.header_cells(bill_grid(spark, sf)).drop("source", "row_number", "header")


@query("vendor_map", """
WITH t AS (SELECT DISTINCT upper(substr(p_type, 1, 2)) || '_' || p_type AS sheet FROM part)
SELECT sheet, vendor, field, position FROM t, (VALUES ('AAA', 'quantity_benchmark', 4), ('AAA', 'quantity_proposal', 5), ('AAA', 'material_benchmark', 7), ('AAA', 'material_proposal', 8), ('AAA', 'labour_benchmark', 10), ('AAA', 'labour_proposal', 11), ('AAA', 'total_proposal', 14),
 ('BBB', 'quantity_benchmark', 4), ('BBB', 'quantity_proposal', 6), ('BBB', 'material_benchmark', 7), ('BBB', 'material_proposal', 9), ('BBB', 'labour_benchmark', 10), ('BBB', 'labour_proposal', 12)) v(vendor, field, position)""")
def vendor_map(spark, sf):
    return Q.map_vendors(Q.header_cells(bill_grid(spark, sf))).drop("source")


@query("to_long", """
SELECT upper(substr(p_type, 1, 2)) || '_' || p_type AS sheet, p_partkey + 3 AS row, vendor, upper(substr(p_type, 1, 2)) AS "group", p_brand AS category, p_name AS item, CASE WHEN p_partkey % 9 = 0 THEN 'out_of_scope' END AS note,
 CAST(p_size AS DOUBLE) AS quantity_benchmark, ROUND(CASE vendor WHEN 'AAA' THEN p_size ELSE p_size * 1.2 END::DOUBLE, 3) AS quantity_proposal, ROUND(p_retailprice, 3) AS material_benchmark,
 ROUND(CASE vendor WHEN 'AAA' THEN p_retailprice * 2 ELSE p_retailprice END, 1) AS material_proposal, CASE vendor WHEN 'AAA' THEN 50.0 ELSE 52.5 END::DOUBLE AS labour_proposal, TRUE AS priced, FALSE AS parent FROM part, (VALUES ('AAA'), ('BBB')) v(vendor)""")
def to_long(spark, sf):
    grid, skipped = Q.drop_aggregate_sheets(bill_grid(spark, sf))
    heads = Q.header_cells(grid)
    out = Q.to_long(grid, heads, Q.map_vendors(heads))
    return out.select("sheet", "row", "vendor", "group", "category", "item", "note", "quantity_benchmark", r("quantity_proposal").alias("quantity_proposal"), r("material_benchmark").alias("material_benchmark"),
                      r("material_proposal", 1).alias("material_proposal"), "labour_proposal", "priced", "parent")


@query("scan_labels", """SELECT 'bill.xlsx' AS source, 'Acme Works' AS vendor, 'North Tower' AS project FROM part LIMIT 1""")
def scan_labels(spark, sf):
    return Q.scan_labels(bill_grid(spark, sf))


@query("aggregate_sheets", """SELECT DISTINCT 'Summary ' || p_type AS sheet, 'summary or analysis sheet' AS reason FROM part""")
def aggregate_sheets(spark, sf):
    grid = table(spark, sf, "part").select(F.lit("b").alias("source"), F.explode(F.array(F.col("p_type"), F.concat(F.lit("Summary "), F.col("p_type")))).alias("sheet"),
                                           F.col("p_partkey").alias("row_number"), F.array("p_name").alias("cells"))
    return Q.drop_aggregate_sheets(grid)[1].drop("source")


@query("disambiguate", """
SELECT s_name || ' (' || f || ')' AS vendor, f || '.xlsx' AS source FROM supplier, (VALUES ('a'), ('b')) v(f) WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_name, 'a.xlsx' FROM supplier WHERE s_suppkey % 3 <> 0""")
def disambiguate(spark, sf):
    s = table(spark, sf, "supplier")
    prepared = s.select(F.col("s_name").alias("vendor"), F.explode(F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("a.xlsx"), F.lit("b.xlsx"))).otherwise(F.array(F.lit("a.xlsx")))).alias("source"))
    return Q.disambiguate(prepared, prepared.select("source").distinct())[0].select("vendor", "source")


@query("vendor_sheets", """
SELECT DISTINCT 'bill' || (p_partkey % 4) AS source, 'ST_' || v AS sheet, v AS vendor, p_partkey % 4 <> 3 AS accepted FROM part, (VALUES ('AAA'), ('BBB'), ('CCC')) x(v)""")
def vendor_sheets(spark, sf):
    """Four bills, each on three sheets; in the fourth one sheet prices other lines."""
    p = table(spark, sf, "part").withColumn("b", F.col("p_partkey") % 4)
    lines = p.select(F.concat(F.lit("bill"), F.col("b").cast("string")).alias("source"), "b", F.col("p_partkey").alias("row_number"), F.col("p_name").alias("item"), "p_size", F.col("p_retailprice").alias("material"),
                     F.explode(F.array(F.lit("AAA"), F.lit("BBB"), F.lit("CCC"))).alias("v"))
    changed = ((F.col("v") == "BBB") & (F.col("row_number") % 64 == 0)) | ((F.col("b") == 3) & (F.col("v") == "CCC"))
    q = F.col("p_size").cast("double") + F.when(changed, 1000).otherwise(0)
    return Q.match_vendor_sheets(lines.select("source", F.concat(F.lit("ST_"), "v").alias("sheet"), "row_number", "item", q.alias("quantity"), "material", F.lit(50.0).alias("labour"))).drop("cluster")
