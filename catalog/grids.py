"""Grid clean-up over sheets derived from the orders and events tables.

The order grid has one sheet per priority: a title, a blank row, a header, order rows as
text, after every 100 orders a blank row and a total, and a note at the end.
"""

from pyspark.sql import functions as F

from catalog.base import query, r, table
from tabscope.columns import ROW
from tabscope.functions.ordered import running
from tabscope.operators import grid as G
from tabscope.session import durable

GRID = "source string, sheet string, row_number bigint, cells array<string>"


def _texts(*columns):
    return F.array(*[c.cast("string") for c in columns])


def numbered_orders(spark, sf):
    """Orders with their 1-based position ``p`` inside the priority."""
    orders = table(spark, sf, "orders").withColumn("sheet", F.col("o_orderpriority"))
    return durable(running(orders, ["sheet"], "o_orderkey", sums={"p": F.lit(1)}).withColumn("k", F.floor((F.col("p") - 1) / 100)))


def order_grid(spark, sf):
    rows = numbered_orders(spark, sf)
    none = F.lit(None).cast("string")
    data = rows.select("sheet", (F.lit(3) + F.col("p") + 2 * F.col("k")).alias("row_number"),
                       _texts(F.col("o_orderkey"), F.col("o_custkey"), F.format_string("%.2f", "o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("cells"))
    blocks = rows.groupBy("sheet", "k").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n")).filter("n = 100")
    at = F.lit(103) + 102 * F.col("k")
    totals = blocks.select("sheet", F.explode(F.array(
        F.struct((at + 1).alias("row_number"), F.array().cast("array<string>").alias("cells")),
        F.struct((at + 2).alias("row_number"), F.array(F.lit("Total"), none, F.format_string("%.2f", "s"), none).alias("cells")))).alias("x")).select("sheet", "x.*")
    sheets = rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))
    frame = sheets.select("sheet", F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("row_number"), F.array(F.concat(F.lit("Orders "), F.col("sheet"))).alias("cells")),
        F.struct(F.lit(2).cast("bigint").alias("row_number"), F.array().cast("array<string>").alias("cells")),
        F.struct(F.lit(3).cast("bigint").alias("row_number"), F.array(F.lit("Order"), F.lit("Customer"), F.lit("Price"), F.lit("Date")).alias("cells")),
        F.struct((F.col("n") + 2 * F.floor(F.col("n") / 100) + 4).alias("row_number"), F.array(F.concat(F.lit("Note: end of "), F.col("sheet"))).alias("cells")))).alias("x")).select("sheet", "x.*")
    # Several rules read the grid, so it is written once.
    return durable(data.unionByName(totals).unionByName(frame).select(F.lit("orders").alias("source"), "sheet", "row_number", "cells"))


_NUMBERED = """o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders),
b AS (SELECT o_orderpriority AS sheet, (p - 1) // 100 AS k, SUM(o_totalprice) AS s, COUNT(*) AS n FROM o GROUP BY 1, 2)"""


@query("normalize_kinds", """
WITH c AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN '1,234.50' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '00' || o_orderkey WHEN 3 THEN '#N/A'
  WHEN 4 THEN '  ' WHEN 5 THEN 'TRUE' WHEN 6 THEN format('{:.2f}', o_totalprice) ELSE o_orderpriority END AS v FROM orders)
SELECT k AS row_number, CASE k % 8 WHEN 0 THEN '1234.50' WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 'true' ELSE v END AS cell,
 CASE k % 8 WHEN 0 THEN 'number' WHEN 1 THEN 'date' WHEN 3 THEN 'empty' WHEN 4 THEN 'empty' WHEN 5 THEN 'boolean' WHEN 6 THEN 'number' ELSE 'text' END AS kind,
 CASE WHEN k % 8 = 3 THEN 1 ELSE 0 END AS error_count FROM c""")
def normalize_kinds(spark, sf):
    k = F.col("o_orderkey") % 8
    value = (F.when(k == 0, "1,234.50").when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.concat(F.lit("00"), F.col("o_orderkey").cast("string"))).when(k == 3, "#N/A")
             .when(k == 4, "  ").when(k == 5, "TRUE").when(k == 6, F.format_string("%.2f", "o_totalprice")).otherwise(F.col("o_orderpriority")))
    grid = table(spark, sf, "orders").select(F.lit("o").alias("source"), F.lit("s").alias("sheet"), F.col("o_orderkey").alias("row_number"), F.array(value).alias("cells"))
    return G.normalize_cells(grid).select("row_number", F.col("cells")[0].alias("cell"), F.col("kinds")[0].alias("kind"), "error_count")


@query("header_detect", """SELECT o_orderpriority AS sheet, '3' AS header_rows, 'Order|Customer|Price|Date' AS labels, 4 AS data_start, 1 AS first_col FROM orders GROUP BY 1""")
def header_detect(spark, sf):
    h = G.detect_header(order_grid(spark, sf))
    return h.select("sheet", F.array_join("header_rows", "|").alias("header_rows"), F.array_join(F.flatten("header_cells"), "|").alias("labels"), "data_start", "first_col")


@query("title_lines", """SELECT o_orderpriority AS sheet, 1 AS line, 'Orders ' || o_orderpriority AS text FROM orders GROUP BY 2, 3, 1""")
def title_lines(spark, sf):
    grid = order_grid(spark, sf)
    return G.title_lines(grid, G.detect_header(grid)).select("sheet", "line", "text")


@query("clean_grid", f"""WITH {_NUMBERED}
SELECT o_orderpriority AS sheet, COUNT(*) + COUNT(*) // 100 AS rows_count, COUNT(*) // 100 AS summary_rows, ROUND(SUM(o_totalprice), 2) AS price,
 4 AS first_row, COUNT(*) + 3 + 2 * (COUNT(*) // 100) AS last_row, 'Order|Customer|Price|Date' AS names FROM o GROUP BY 1""")
def clean_grid(spark, sf):
    facts, rows, _ = G.clean_tables(order_grid(spark, sf))
    body = rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("rows_count"), F.count_if("_is_summary").alias("summary_rows"),
                                     r(F.sum(F.when(~F.col("_is_summary"), F.get("cells", F.lit(2)).try_cast("double")))).alias("price"),
                                     F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"))
    return body.join(facts.select("sheet", F.array_join("names", "|").alias("names")), "sheet")


@query("grid_notes", """SELECT o_orderpriority AS sheet, COUNT(*) + 2 * (COUNT(*) // 100) + 4 AS row_number, 'Note: end of ' || o_orderpriority AS note FROM orders GROUP BY 1""")
def grid_notes(spark, sf):
    return G.split_notes(order_grid(spark, sf))[1].drop("source")


@query("summary_rows", f"""WITH {_NUMBERED} SELECT sheet, 105 + 102 * k AS row_number, format('{{:.2f}}', s) AS total FROM b WHERE n = 100""")
def summary_rows(spark, sf):
    return G.flag_summary_rows(order_grid(spark, sf)).filter("_is_summary").select("sheet", "row_number", F.get("cells", F.lit(2)).alias("total"))


def event_grid(spark, sf, same_header):
    """One sheet per event type; every 50 rows a gap and a header, renamed or repeated."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("sheet"), "event_id", "user_id", "value")
    rows = running(events, ["sheet"], "event_id", sums={"p": F.lit(1)}).withColumn("k", F.floor((F.col("p") - 1) / 50))
    data = rows.select("sheet", (F.col("p") + 3 * F.col("k") + 1).alias("row_number"), _texts(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.format_string("%.2f", "value")).alias("cells"))
    name = F.lit("Reading") if same_header else F.concat(F.lit("Reading "), F.col("k").cast("string"))
    heads = rows.groupBy("sheet", "k").agg(F.count(F.lit(1)).alias("n"))
    header = heads.select("sheet", (53 * F.col("k") + 1).alias("row_number"), F.array(F.lit("Person"), name).alias("cells"))
    titles = heads.filter("k > 0").select("sheet", (53 * F.col("k")).alias("row_number"), F.array(F.concat(F.lit("Part "), F.col("k").cast("string"))).alias("cells"))
    grid = data.unionByName(header) if same_header else data.unionByName(header).unionByName(titles)
    return durable(grid.select(F.lit("events").alias("source"), "sheet", "row_number", "cells"))


@query("split_tables", """
WITH e AS (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events)
SELECT event_type AS sheet, (p - 1) // 50 + 1 AS table_no, CASE WHEN p <= 50 THEN '' ELSE 'Part ' || ((p - 1) // 50) END AS title,
 'Person|Reading ' || ((p - 1) // 50) AS header, COUNT(*) AS rows, MIN(p + 3 * ((p - 1) // 50) + 1) AS first_row FROM e GROUP BY 1, 2, 3, 4""")
def split_tables(spark, sf):
    grid = event_grid(spark, sf, same_header=False)
    rows = G.split_tables(grid, G.detect_header(grid)).filter("kind = 'data'")
    return rows.groupBy("sheet", "table_no", "title", F.array_join("header", "|").alias("header")).agg(F.count(F.lit(1)).alias("rows"), F.min("row_number").alias("first_row"))


@query("repeated_headers", """SELECT event_type AS sheet, CAST(1 AS BIGINT) AS table_no, COUNT(*) AS rows FROM events GROUP BY 1""")
def repeated_headers(spark, sf):
    grid = event_grid(spark, sf, same_header=True)
    rows = G.drop_repeated_headers(G.split_tables(grid, G.detect_header(grid)))
    return rows.filter("kind = 'data'").groupBy("sheet", "table_no").agg(F.count(F.lit(1)).alias("rows"))


@query("detect_blocks", """
WITH o AS (SELECT o_orderpriority AS sheet, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT sheet, CAST(1 AS BIGINT) AS band, 1 AS first_col, 4 AS last_col, CAST(3 AS BIGINT) AS header_row, CAST(1.0 AS DOUBLE) AS confidence, CAST(4 AS BIGINT) AS first_row, n + 2 * (n // 100) + 4 AS last_row FROM o""")
def detect_blocks(spark, sf):
    return G.detect_blocks(order_grid(spark, sf)).drop("source")


@query("fill_merged", """
WITH t AS (SELECT o_orderkey // 7 AS b, MIN(o_orderkey) AS f FROM orders GROUP BY 1)
SELECT o.o_orderkey AS row_number, h.o_orderpriority AS section, CAST(o.o_custkey AS VARCHAR) AS customer
FROM orders o JOIN t ON t.b = o.o_orderkey // 7 JOIN orders h ON h.o_orderkey = t.f""")
def fill_merged(spark, sf):
    orders = table(spark, sf, "orders")
    blocks = orders.groupBy(F.floor(F.col("o_orderkey") / 7).alias("b")).agg(F.min("o_orderkey").alias("first_row"), F.max("o_orderkey").alias("last_row"))
    merges = blocks.select(F.lit("o").alias("source"), F.lit("s").alias("sheet"), "first_row", F.lit(1).alias("first_col"), "last_row")
    tops = orders.join(blocks.select(F.col("first_row").alias("o_orderkey"), F.lit(True).alias("top")), "o_orderkey", "left")
    grid = tops.select(F.lit("o").alias("source"), F.lit("s").alias("sheet"), F.col("o_orderkey").alias("row_number"),
                       F.array(F.when(F.col("top"), F.col("o_orderpriority")), F.col("o_custkey").cast("string")).alias("cells"))
    return G.fill_merged(grid, merges).select("row_number", F.col("cells")[0].alias("section"), F.col("cells")[1].alias("customer"))


@query("reconciled_totals", f"""WITH {_NUMBERED}
SELECT o_orderpriority AS sheet, p + p // 100 - CASE WHEN p % 100 = 0 THEN 1 ELSE 0 END AS pos, 'order' AS label, o_totalprice AS value, FALSE AS unresolved FROM o
UNION ALL SELECT sheet, 101 * (k + 1), 'Total', -1.0, TRUE FROM b WHERE n = 100 AND k % 3 = 1""")
def reconciled_totals(spark, sf):
    """Two of three block totals add up; the third is wrong and stays, inside the next segment."""
    rows = numbered_orders(spark, sf)
    data = rows.select("sheet", (F.col("p") + F.col("k")).alias("pos"), F.lit("order").alias("label"), F.col("o_totalprice").alias("value"))
    blocks = rows.groupBy("sheet", "k").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n")).filter("n = 100")
    earlier = blocks.select("sheet", (F.col("k") + 1).alias("k"), F.col("s").alias("before"))
    stated = blocks.join(earlier, ["sheet", "k"], "left")
    total = F.when(F.col("k") % 3 == 1, -1.0).when(F.col("k") % 3 == 2, F.col("s") + F.col("before") - 1).otherwise(F.col("s"))
    totals = stated.select("sheet", (101 * (F.col("k") + 1)).alias("pos"), F.lit("Total").alias("label"), total.alias("value"))
    return G.drop_reconciled_totals(data.unionByName(totals), ["sheet"], "pos", "label", ["value"]).withColumnRenamed("_unresolved", "unresolved")


@query("column_types", """
SELECT o_orderpriority AS sheet, i AS position, CASE i WHEN 0 THEN 'number' WHEN 1 THEN 'number' WHEN 2 THEN 'number' ELSE 'date' END AS data_type,
 COUNT(*) + CASE WHEN i IN (0, 2) THEN COUNT(*) // 100 ELSE 0 END AS filled FROM orders, (VALUES (0), (1), (2), (3)) v(i) GROUP BY 1, 2""")
def column_types(spark, sf):
    _, rows, _ = G.clean_tables(order_grid(spark, sf))
    return G.infer_column_types(rows, G.SHEET).drop("source")


@query("fit_width", """
SELECT o_orderkey AS row_number, CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus END AS c, 3 AS width, 'A|B|คอลัมน์ C' AS names FROM orders""")
def fit_width(spark, sf):
    cells = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.col("o_orderkey").cast("string"), F.lit("x"), F.col("o_orderstatus"))).otherwise(F.array(F.col("o_orderkey").cast("string"), F.lit("x")))
    rows = table(spark, sf, "orders").select(F.lit("o").alias("source"), F.lit("s").alias("sheet"), F.col("o_orderkey").alias("row_number"), cells.alias("cells"))
    names = spark.createDataFrame([("o", "s", ["A", "B"])], "source string, sheet string, names array<string>")
    fitted, named = G.fit_width(rows, names)
    out = fitted.select("row_number", F.get("cells", F.lit(0)).alias("a"), F.get("cells", F.lit(2)).alias("c"), F.size("cells").alias("width"))
    return out.withColumn("names", named.select(F.array_join("names", "|")).scalar())


@query("apply_layout", """
SELECT 1 AS table_no, o_orderkey AS row_number, CASE WHEN o_orderkey = 5 THEN 'header' ELSE 'data' END AS kind, CAST(o_custkey AS VARCHAR) AS first_cell, 2 AS width FROM orders WHERE o_orderkey BETWEEN 5 AND 99
UNION ALL SELECT 2, o_orderkey, CASE WHEN o_orderkey = 100 THEN 'header' ELSE 'data' END, CAST(o_custkey AS VARCHAR), 2 FROM orders WHERE o_orderkey >= 100""")
def apply_layout(spark, sf):
    grid = table(spark, sf, "orders").select(F.lit("o").alias("source"), F.lit("s").alias("sheet"), F.col("o_orderkey").alias("row_number"),
                                             _texts(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("cells"))
    layout = G.layout_table(spark, {("o", "s"): [{"header_rows": [5], "data_start": 6, "first_col": 2}, {"header_rows": [100], "data_start": 101, "first_col": 2}]})
    return G.apply_layout(grid, layout).select("table_no", "row_number", "kind", F.col("cells")[0].alias("first_cell"), F.size("cells").alias("width"))


@query("header_groups", """
WITH s AS (SELECT DISTINCT o_custkey AS c FROM orders), g AS (SELECT c % 3 AS g, MIN(CAST(c AS VARCHAR)) AS representative, COUNT(*) AS members FROM s GROUP BY 1)
SELECT CAST(c AS VARCHAR) AS sheet, representative, members FROM s JOIN g ON g.g = c % 3""")
def header_groups(spark, sf):
    sheets = table(spark, sf, "orders").select("o_custkey").distinct()
    headers = sheets.select(F.lit("o").alias("source"), F.col("o_custkey").cast("string").alias("sheet"),
                            F.array(F.array(F.lit("Item"), F.concat(F.lit("Price "), (F.col("o_custkey") % 3).cast("string")))).alias("header_cells"))
    return G.header_groups(headers).drop("source")


@query("column_names", """
WITH s AS (SELECT DISTINCT o_custkey AS c FROM orders)
SELECT CAST(c AS VARCHAR) AS sheet, CASE c % 2 WHEN 0 THEN 'Price / RBP|Price / ' || c || '|คอลัมน์ D|Total|total (2)' ELSE 'Name|Value' END AS names FROM s""")
def column_names(spark, sf):
    s = lambda *xs: F.array(*[F.lit(x).cast("string") if not hasattr(x, "alias") else x for x in xs])
    sheets = table(spark, sf, "orders").select("o_custkey").distinct()
    even = F.array(s("Price", None, None, "Total", "total"), s("RBP", F.col("o_custkey").cast("string"), None, None, None))
    odd = F.array(s("Report", None), s("Name", "Value"))
    shift = F.col("o_custkey") % 2 == 0
    pad = lambda rows: F.transform(rows, lambda row: F.concat(F.array(F.lit(None).cast("string")), row))
    headers = sheets.select(F.lit("o").alias("source"), F.col("o_custkey").cast("string").alias("sheet"), F.when(shift, pad(even)).otherwise(odd).alias("header_cells"),
                            F.when(shift, 2).otherwise(1).alias("first_col"))
    return G.column_names(headers).select("sheet", F.array_join("names", "|").alias("names"))


@query("stack_group", """
SELECT o_orderkey, o_totalprice, 'N_' || o_orderstatus AS _sheet, 'N' AS _sheet_group FROM orders WHERE o_orderstatus IN ('F', 'O') UNION ALL
SELECT o_orderkey, o_totalprice, 'S_P', 'S' FROM orders WHERE o_orderstatus = 'P'""")
def stack_group(spark, sf):
    orders = table(spark, sf, "orders")
    tables = {f"{p}_{s}": orders.filter(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("O_ORDERKEY" if s == "O" else "o_orderkey"), "o_totalprice") for p, s in (("N", "F"), ("N", "O"), ("S", "P"))}
    tables["Summary"] = orders.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total"))
    return G.stack_same_header(tables)


@query("continued_pages", """
WITH p AS (SELECT o_orderstatus AS doc, o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i FROM orders),
n AS (SELECT *, i // 50 AS page FROM p)
SELECT doc, page // 4 + 1 AS table_no, page, COUNT(*) + CASE WHEN page % 4 = 2 THEN 1 ELSE 0 END AS rows FROM n GROUP BY 1, 2, 3""")
def continued_pages(spark, sf):
    """Fifty orders a page; every fourth page changes the width; one header in four is data."""
    orders = table(spark, sf, "orders").withColumn("doc", F.col("o_orderstatus"))
    rows = running(orders.select("doc", "o_orderkey", "o_custkey"), ["doc"], "o_orderkey", sums={"i": F.lit(1)}).withColumn("page", F.floor((F.col("i") - 1) / 50))
    pages = rows.groupBy("doc", "page").agg(F.collect_list(F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))).alias("rows"))  # fifty rows
    wide = F.floor(F.col("page") / 4) % 2 == 1
    header = F.when(F.col("page") % 4 == 2, F.array(F.lit("17"), F.lit("4"))).otherwise(F.array(F.lit("Order"), F.lit("Customer")))
    header = F.when(wide, F.concat(header, F.array(F.when(F.col("page") % 4 == 2, "9").otherwise("Extra")))).otherwise(header)
    out = G.join_continued_pages(pages.withColumn("header", header))
    return out.groupBy("doc", "table_no", "page").agg(F.count(F.lit(1)).alias("rows"))


@query("typed_rows", """
SELECT o_orderkey AS _row, CAST(o_orderkey AS DOUBLE) AS id, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN TRUE ELSE FALSE END AS flag, o_orderpriority AS name FROM orders""")
def typed_rows(spark, sf):
    rows = table(spark, sf, "orders").select(F.lit("o").alias("source"), F.lit("s").alias("sheet"), F.col("o_orderkey").alias("row_number"), F.array(
        F.col("o_orderkey").cast("string"), F.format_string("%.2f", "o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.when(F.col("o_orderkey") % 2 == 0, "TRUE").otherwise("False"), F.col("o_orderpriority")).alias("cells"))
    typed = G.typed_table(G.normalize_cells(rows), ["id", "price", "day", "flag", "name"], ["number", "number", "date", "boolean", "text"])
    return typed.select(ROW, "id", "price", F.date_format("day", "yyyy-MM-dd").alias("day"), "flag", "name")
