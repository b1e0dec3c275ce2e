"""Search, sort and pages."""

from pyspark.sql import functions as F

from catalog.base import query, table
from tabscope.columns import ROW
from tabscope.operators.browse import browse, search_rows, shorten_cells


@query("browse_search", """SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR CAST(p_partkey AS VARCHAR) LIKE '%ring%'""")
def browse_search(spark, sf):
    return search_rows(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "RING")


@query("browse_search_text", """SELECT doc_id FROM documents WHERE contains(lower(text), 'tion in')""")
def browse_search_text(spark, sf):
    return search_rows(table(spark, sf, "documents").select("doc_id", "text"), "Tion In", "text").select("doc_id")


@query("browse_page", """
WITH m AS (SELECT o_orderkey AS _row, NULLIF(o_orderpriority, '1-URGENT') AS p, o_totalprice FROM orders WHERE o_totalprice >= 100000)
SELECT _row, p, o_totalprice, (SELECT COUNT(*) FROM m) AS total_rows FROM m ORDER BY lower(p) DESC NULLS LAST, _row LIMIT 50 OFFSET 100""")
def browse_page(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"), "o_totalprice")
    return browse(rows, sort="p", direction="desc", page=3, page_size=50, filters=[{"column": "o_totalprice", "min": 100000}])


@query("browse_shorten", """
SELECT doc_id AS _row, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS text, CASE WHEN length(text) > 40 THEN 1 ELSE 0 END AS truncated_cells FROM documents""")
def browse_shorten(spark, sf):
    return shorten_cells(table(spark, sf, "documents").select(F.col("doc_id").alias(ROW), "text"), 40)
