"""Sources and sinks: written from the tables to a scratch folder, read back, compared with the table."""

import uuid

from pyspark.sql import functions as F

from catalog.base import query, r, table
from tabscope.columns import ROW
from tabscope.functions.values import typed_number
from tabscope.operators import grid as G
from tabscope.operators import profile as P
from tabscope.sources import json_documents as J
from tabscope.sources import readers as R
from tabscope.sources import sinks as S


def scratch(spark, name):
    """A fresh folder beside the checkpoints, which every executor can reach."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        from tabscope.session import durable
        durable(spark.range(1))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", """
SELECT CAST(o_orderkey AS DOUBLE) AS id, 'note, "' || o_orderpriority || CASE WHEN o_orderkey % 100 = 0 THEN '"' || chr(10) || 'more' ELSE '"' END AS note, o_totalprice AS price FROM orders""")
def csv_round_trip(spark, sf):
    path = scratch(spark, "csv")
    note = F.concat(F.lit('note, "'), "o_orderpriority", F.when(F.col("o_orderkey") % 100 == 0, '"\nmore').otherwise('"'))
    rows = table(spark, sf, "orders").select("o_orderkey", note.alias("note"), "o_totalprice")
    rows.write.option("escape", '"').option("sep", ";").option("quoteAll", "false").csv(path)
    grid = R.read_grid_csv(spark, path)
    typed = G.typed_table(G.normalize_cells(grid), ["id", "note", "price"], ["number", "text", "number"])
    return typed.drop(ROW)


@query("csv_row_numbers", """SELECT COUNT(*) AS rows, COUNT(*) AS last_row, COUNT(*) AS row_numbers, 1 AS first_row FROM part""")
def csv_row_numbers(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "part").coalesce(1).write.csv(path)
    grid = R.read_grid_csv(spark, path)
    return grid.agg(F.count(F.lit(1)).alias("rows"), F.max("row_number").alias("last_row"), F.count_distinct("row_number").alias("row_numbers"), F.min("row_number").alias("first_row"))


@query("read_many", """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS part, COUNT(*) AS rows, CAST(SUM(p_partkey) AS BIGINT) AS keys FROM part GROUP BY 1""")
def read_many(spark, sf):
    base, paths = scratch(spark, "many"), []
    for name, rest, sep in (("even", 0, ","), ("odd", 1, "|")):
        paths.append(f"{base}/{name}")
        table(spark, sf, "part").filter(F.col("p_partkey") % 2 == rest).select("p_partkey", "p_name", "p_brand").write.option("sep", sep).csv(paths[-1])
    grid = R.read_many(spark, paths)
    return grid.groupBy(F.regexp_extract("source", "/(even|odd)/", 1).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("cells")[0].cast("bigint")).alias("keys"))


@query("thai_round_trip", """SELECT p_partkey AS id, 'ราคา ' || p_name AS name FROM part""")
def thai_round_trip(spark, sf):
    """Thai text written in the Windows code page is recognised and decoded."""
    path = scratch(spark, "thai")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    table(spark, sf, "part").select("p_partkey", F.concat(F.lit("ราคา "), "p_name").alias("name")).write.option("encoding", "x-windows-874").csv(path)
    return R.read_grid_csv(spark, path).select(F.col("cells")[0].cast("bigint").alias("id"), F.col("cells")[1].alias("name"))


@query("csv_mixed_encodings", """SELECT p_partkey AS id, 'ราคา ' || p_name AS name FROM part""")
def csv_mixed_encodings(spark, sf):
    """One folder of UTF-8 and Windows code page files."""
    path = scratch(spark, "mixed")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    named = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("ราคา "), "p_name").alias("name"))
    named.filter("p_partkey % 2 = 0").write.csv(path)
    named.filter("p_partkey % 2 = 1").write.mode("append").option("encoding", "x-windows-874").csv(path)
    return R.read_grid_csv(spark, path).select(F.col("cells")[0].cast("bigint").alias("id"), F.col("cells")[1].alias("name"))


@query("csv_strict", """SELECT c_custkey AS id, c_name || ', "' || c_mktsegment || '"' AS name, c_nationkey AS nation FROM customer""")
def csv_strict(spark, sf):
    """Strict quoting: well-formed quoted cells, with doubled quotes and delimiters inside, come back unchanged."""
    path = scratch(spark, "strict")
    name = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    table(spark, sf, "customer").select("c_custkey", name.alias("name"), "c_nationkey").write.option("escape", '"').option("quoteAll", "true").csv(path)
    grid = R.read_grid_csv(spark, path, sep=",", strict=True)
    return grid.select(grid.cells[0].cast("bigint").alias("id"), grid.cells[1].alias("name"), grid.cells[2].cast("int").alias("nation"))


@query("json_flatten", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k", event_type AS "who.type", '[' || user_id || ',1]' AS "who.list" FROM events""")
def json_flatten(spark, sf):
    path = scratch(spark, "json")
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("props"), F.struct(F.col("event_type").alias("type"), F.array("user_id", F.lit(1)).alias("list")).alias("who"))
    e.write.json(path)
    return R.read_records_json(spark, path).select("event_id", "`props.k`", "`who.type`", "`who.list`")


@query("json_flatten_long", """SELECT event_id, replace(CAST(range(event_id, event_id + 1200) AS VARCHAR), ', ', ',') AS "who.list" FROM events WHERE event_id % 100 = 0""")
def json_flatten_long(spark, sf):
    """Lists of more than 2,000 characters."""
    path = scratch(spark, "json")
    e = table(spark, sf, "events").filter("event_id % 100 = 0")
    e.select("event_id", F.struct(F.expr("sequence(event_id, event_id + 1199)").alias("list")).alias("who")).write.json(path)
    return R.read_records_json(spark, path).select("event_id", "`who.list`")


@query("json_shapes", """
SELECT 'grid' AS shape, CAST(p_partkey AS BIGINT) AS id, 'a "b", [' || p_name AS name FROM part
UNION ALL SELECT 'records', CAST(p_partkey AS BIGINT), p_name || '},{' FROM part""")
def json_shapes(spark, sf):
    """One JSON object with a list of lists, a list of records and an object beside them, read by many tasks."""
    path = scratch(spark, "json")
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit('a "b", ['), "p_name").alias("cell"), F.concat("p_name", F.lit("},{")).alias("field"))
    line = "place int, value string"
    frame = spark.createDataFrame([(0, '{"note": {"a": [1, {"b": 2}]}, "grid": [["id", "name"]'), (2, '], "records": [{"id": -1}'), (4, "]}")], line)
    grid = p.select(F.lit(1).alias("place"), F.concat(F.lit(',["'), "p_partkey", F.lit('",'), F.substring(F.to_json(F.array("cell")), 2, 1 << 30)).alias("value"))
    records = p.select(F.lit(3).alias("place"), F.concat(F.lit(","), F.to_json(F.struct(F.col("p_partkey").alias("id"), F.struct(F.col("field").alias("name")).alias("x")))).alias("value"))
    frame.unionByName(grid).unionByName(records).repartition(1).sortWithinPartitions("place").select("value").write.text(path)
    tables = J.json_document(spark, path)
    rows = tables["grid"].filter("cells[0] <> 'id'").select(F.lit("grid").alias("shape"), F.expr("cells[0]").cast("bigint").alias("id"), F.expr("cells[1]").alias("name"))
    return rows.unionByName(tables["records"].filter("id <> -1").select(F.lit("records").alias("shape"), F.col("id").cast("bigint").alias("id"), F.col("`x.name`").alias("name")))


@query("xml_round_trip", """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier""")
def xml_round_trip(spark, sf):
    path = scratch(spark, "xml")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    s.coalesce(1).write.format("xml").option("rowTag", "row").option("rootTag", "rows").option("attributePrefix", "_").save(path)
    return R.read_records_xml(spark, path).select("id", "name", "balance")


@query("html_tables", """
SELECT CAST(p_partkey AS VARCHAR) AS source, 'table 1' AS sheet, CAST(1 AS BIGINT) AS row_number, 'Name|~|Brand' AS cells FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'table 1', 2, p_name || ' & co|' || p_size || '|' || p_brand FROM part""")
def html_tables(spark, sf):
    p = table(spark, sf, "part")
    html = F.concat(F.lit("<p>x</p><table><tr><td>alone</td></tr></table><table><tr><th colspan=2>Name</th><th>Brand</th></tr><tr><td>"), "p_name", F.lit(" &amp; co</td><td> "), F.col("p_size").cast("string"),
                    F.lit("</td><td>"), "p_brand", F.lit("</td></tr></table>"))
    grid = R.html_tables(p.select("p_partkey", html.alias("html")), "p_partkey", "html")
    return grid.select("source", "sheet", "row_number", F.array_join("cells", "|", "~").alias("cells"))


@query("page_tables", """SELECT COUNT(*) AS rows FROM pages WHERE FALSE""")
def page_tables(spark, sf):
    """The stored pages hold no tables."""
    return R.html_tables(table(spark, sf, "pages"), "page_id", "html").agg(F.count(F.lit(1)).alias("rows"))


@query("typed_number", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey * 1000.0 + 0.5 WHEN 1 THEN -(o_orderkey * 1.0) WHEN 2 THEN NULL WHEN 3 THEN 0.5 WHEN 4 THEN NULL ELSE o_orderkey * 1.0 END::DOUBLE AS value FROM orders""")
def typed_numbers(spark, sf):
    k = F.col("o_orderkey")
    text = (F.when(k % 6 == 0, F.format_number(k * 1000 + 0.5, 2)).when(k % 6 == 1, F.concat(F.lit("("), k.cast("string"), F.lit(")"))).when(k % 6 == 2, F.concat(F.lit("00"), k.cast("string")))
            .when(k % 6 == 3, "0.5").when(k % 6 == 4, F.concat(k.cast("string"), F.lit(" pcs"))).otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(" "))))
    return table(spark, sf, "orders").select("o_orderkey", typed_number(text).alias("value"))


@query("csv_safe", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '''=' || p_name WHEN 1 THEN '''  -' || p_name WHEN 2 THEN p_name || '=1' ELSE '''@' || p_name END AS text FROM part""")
def csv_safe(spark, sf):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("="), "p_name")).when(k == 1, F.concat(F.lit("  -"), "p_name")).when(k == 2, F.concat("p_name", F.lit("=1"))).otherwise(F.concat(F.lit("@"), "p_name"))
    return table(spark, sf, "part").select("p_partkey", S.csv_safe(text).alias("text"))


@query("csv_safe_file", """SELECT COUNT(*) AS rows, COUNT(*) AS guarded FROM part""")
def csv_safe_file(spark, sf):
    path = scratch(spark, "safe")
    S.write_csv_safe(table(spark, sf, "part").select(F.concat(F.lit("=cmd "), "p_name").alias("=name"), "p_partkey"), path)
    back = spark.read.option("header", "true").csv(path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("`'=name`").startswith("'=cmd ")).alias("guarded"))


@query("store_tables", """SELECT o_orderkey AS _row, o_totalprice, o_orderstatus FROM orders""")
def store_tables(spark, sf):
    path = scratch(spark, "tables")
    S.save_tables({"s0": table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), "o_totalprice", "o_orderstatus")}, path)
    return S.load_table(spark, path, "s0")


@query("report_tables", """
SELECT "column", data_type, rows, missing_count, unique_count, mean FROM (SELECT 'o_totalprice' AS "column", 'number' AS data_type, COUNT(*) AS rows, CAST(0 AS BIGINT) AS missing_count, COUNT(DISTINCT o_totalprice) AS unique_count, ROUND(AVG(o_totalprice), 2) AS mean FROM orders
UNION ALL SELECT 'o_orderpriority', 'text', COUNT(*), 0, COUNT(DISTINCT o_orderpriority), NULL FROM orders)""")
def report_tables(spark, sf):
    rows = table(spark, sf, "orders").select("o_totalprice", "o_orderpriority")
    tables = S.report_tables(rows, P.role_columns(P.infer_roles(rows)), "orders")
    path = scratch(spark, "report")
    S.save_report(tables, path)
    return spark.read.parquet(f"{path}/columns").select("column", "data_type", "rows", "missing_count", "unique_count", r("mean").alias("mean"))
