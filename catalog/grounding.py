"""Evidence checks: one statement per customer group, citing computed order facts."""

from pyspark.sql import functions as F

from catalog.base import query, table
from tabscope.operators import evidence as E


def facts(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("o_totalprice")).cast("bigint").alias("s"))
    return o.select(F.format_string("EV-%d", "o_custkey").alias("evidence_id"), "o_custkey", "n", "s",
                    F.concat(F.lit("customer has "), F.col("n").cast("string"), F.lit(" orders worth "), F.format_number("s", 0), F.lit(" and change -"), F.col("n").cast("string"), F.lit(".26 in 2020-2021")).alias("text"))


def statements(spark, sf):
    """By customer modulo 6: right, rounded right, sign reversed, invented, uncited, Thai digits."""
    f = facts(spark, sf).withColumn("k", F.col("o_custkey") % 6)
    n = F.col("n").cast("string")
    text = (F.when(F.col("k") == 0, F.concat(F.lit("They placed "), n, F.lit(" orders ("), F.col("evidence_id"), F.lit(")")))
            .when(F.col("k") == 1, F.concat(F.lit("The change was -"), n, F.lit(".3"))).when(F.col("k") == 2, F.concat(F.lit("The change was "), n, F.lit(".3")))
            .when(F.col("k") == 3, F.concat(F.lit("They placed "), (F.col("n") + 100).cast("string"), F.lit(" orders")))
            .when(F.col("k") == 4, F.concat(F.lit("They placed "), n, F.lit(" orders"))).otherwise(F.lit("They placed ๙ orders")))
    ids = F.when(F.col("k") == 4, F.array(F.lit("EV-none"))).otherwise(F.array("evidence_id"))
    return f.select(F.col("o_custkey").cast("string").alias("statement_id"), text.alias("text"), ids.alias("evidence_ids"))


@query("figures", r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS token FROM (SELECT doc_id, text FROM documents))
SELECT doc_id, COUNT(*) AS figures, MAX(length(token)) AS longest FROM m GROUP BY 1""")
def figures(spark, sf):
    """Whole numbers only, so both regular-expression dialects agree: signs, commas and points are blanked first."""
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^0-9]+", " ").alias("text"))
    return E.extract_figures(docs, "text", ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("figures"), F.max(F.length("token")).alias("longest"))


@query("figures_signed", """
WITH f AS (SELECT o_custkey, COUNT(*) AS n, CAST(FLOOR(SUM(o_totalprice)) AS BIGINT) AS s FROM orders GROUP BY 1)
SELECT 'EV-' || o_custkey AS evidence_id, position, value FROM (SELECT o_custkey, 0 AS position, CAST(n AS DOUBLE) AS value FROM f UNION ALL SELECT o_custkey, 1, s FROM f
 UNION ALL SELECT o_custkey, 2, -(n + 0.26) FROM f UNION ALL SELECT o_custkey, 3, 2020 FROM f UNION ALL SELECT o_custkey, 4, 2021 FROM f)""")
def figures_signed(spark, sf):
    return E.extract_figures(facts(spark, sf), "text", ["evidence_id"]).select("evidence_id", "position", "value")


_SAID = """k AS (SELECT DISTINCT o_custkey AS c FROM orders)"""


@query("grounding", f"WITH {_SAID} SELECT CAST(c AS VARCHAR) AS statement_id, c % 6 IN (0, 1) AS grounded FROM k")
def grounding(spark, sf):
    return E.check_grounding(statements(spark, sf), facts(spark, sf).select("evidence_id", "text")).select("statement_id", "grounded")


@query("grounding_unsigned", f"WITH {_SAID} SELECT CAST(c AS VARCHAR) AS statement_id, c % 6 IN (0, 1, 2) AS grounded FROM k")
def grounding_unsigned(spark, sf):
    return E.check_grounding(statements(spark, sf), facts(spark, sf).select("evidence_id", "text"), "unsigned").select("statement_id", "grounded")


@query("strip_citations", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Sales rose.' WHEN 1 THEN 'See then stop' ELSE 'Plain ' || o_orderkey END AS text FROM orders""")
def strip_citations(spark, sf):
    k = F.col("o_orderkey") % 3
    cite = F.format_string("EV-%03d", "o_orderkey")
    text = (F.when(k == 0, F.concat(F.lit("Sales rose ("), cite, F.lit(", Q-002)."))).when(k == 1, F.concat(F.lit("See "), cite, F.lit(", then stop"))).otherwise(F.concat(F.lit("Plain "), F.col("o_orderkey").cast("string"))))
    return table(spark, sf, "orders").select("o_orderkey", E.strip_citations(text).alias("text"))


@query("filter_statements", f"WITH {_SAID} SELECT COUNT(*) FILTER (c % 6 IN (0, 1)) AS kept, COUNT(*) FILTER (c % 6 NOT IN (0, 1)) AS dropped FROM k")
def filter_statements(spark, sf):
    return E.filter_statements(statements(spark, sf), facts(spark, sf).select("evidence_id", "text"))[1]


@query("filter_paragraphs", """
WITH f AS (SELECT o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT CAST(c AS VARCHAR) AS report_id, section, 'T' || section AS title, CASE section WHEN 0 THEN 'Orders: ' || n ELSE 'No figures here' END AS text, 1 AS kept, section = 0 AS cited, c % 2 = 0 AS usable
FROM f, (VALUES (0), (1)) s(section) WHERE section = 0 OR c % 2 = 0""")
def filter_paragraphs(spark, sf):
    f = facts(spark, sf)
    n = F.col("n").cast("string")
    second = F.when(F.col("o_custkey") % 2 == 0, "No figures here").otherwise("About 123456789 more")
    sections = f.select(F.col("o_custkey").cast("string").alias("report_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("section"), F.lit("T0").alias("title"), F.array(F.concat(F.lit("Orders: "), n), F.concat(F.lit("Orders: "), n, F.lit("7"))).alias("paragraphs"), F.array(F.col("evidence_id"), F.lit("EV-none")).alias("evidence_ids")),
        F.struct(F.lit(1).alias("section"), F.lit("T1").alias("title"), F.array(second).alias("paragraphs"), F.array(F.lit("EV-none")).alias("evidence_ids")))).alias("x")).select("report_id", "x.*")
    out = E.filter_paragraphs(sections, f.select("evidence_id", "text"))
    return out.select("report_id", "section", "title", F.array_join("paragraphs", "|").alias("text"), F.size("paragraphs").alias("kept"), (F.size("evidence_ids") > 0).alias("cited"), "usable")


@query("evidence_rows", """
WITH t AS (SELECT p_brand, COUNT(*) AS n FROM part GROUP BY 1), x AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p_brand) AS i FROM t)
SELECT 'BOQ-' || lpad(CAST(i AS VARCHAR), 3, '0') AS id, 'Parts by brand' AS title, 'Parts by brand — ' || p_brand || ' / parts: ' || format('{:,}', n) AS statement FROM x""")
def evidence_rows(spark, sf):
    t = table(spark, sf, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("value"))
    return E.evidence_rows(t.select(F.lit(1).alias("tile"), F.lit("Parts by brand").alias("title"), "label", F.lit("parts").alias("series"), "value"))


@query("merge_sections", """
WITH d AS (SELECT DISTINCT c_nationkey AS n, c_custkey AS k FROM customer), s AS (SELECT n, COUNT(*) AS c FROM d GROUP BY 1)
SELECT CAST(n AS VARCHAR) AS report_id, CAST(c AS BIGINT) AS sections, CAST(c AS BIGINT) AS ids FROM s WHERE c <= 12
UNION ALL SELECT CAST(d.n AS VARCHAR), COUNT(DISTINCT k % 3), COUNT(DISTINCT k) FROM d JOIN s ON s.n = d.n WHERE c > 12 GROUP BY d.n""")
def merge_sections(spark, sf):
    """One section per customer of a nation, each twice; analyses are of three kinds."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("report_id"), "c_custkey", F.col("c_custkey").cast("string").alias("id"))
    sections = c.select("report_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"), "c_custkey", "id").select(
        "report_id", (F.col("c_custkey") * 2 + F.col("d")).alias("seq"), F.concat(F.lit("Topic "), "id").alias("title"), F.lit("overview").alias("question"), F.array("id").alias("analysis_ids"))
    kinds = F.element_at(F.array(F.lit("statistics"), F.lit("trend"), F.lit("outliers")), (F.col("c_custkey") % 3 + 1).cast("int"))
    out = E.merge_sections(sections, c.select("report_id", F.col("id").alias("evidence_id"), kinds.alias("type")))
    return out.groupBy("report_id").agg(F.count_distinct("seq").alias("sections"), F.count(F.lit(1)).alias("ids"))


@query("pick_display", """
WITH i AS (SELECT c_mktsegment AS section, c_custkey AS seq, c_nationkey % 2 AS t FROM customer), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY section, t ORDER BY seq) AS nth FROM i),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY section ORDER BY CASE WHEN nth > 1 THEN 1 ELSE 0 END, seq) AS pick FROM n)
SELECT section, seq, pick FROM p WHERE pick <= 3""")
def pick_display(spark, sf):
    items = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("section"), F.col("c_custkey").alias("seq"), (F.col("c_nationkey") % 2).alias("table_id"))
    return E.pick_display(items, ["section"]).select("section", "seq", "pick")
