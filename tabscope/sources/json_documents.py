"""JSON documents of any size: one file's lists as tables, read by many tasks.

A document is read in pieces that end at a comma, wherever file blocks are cut.  What is open before
a piece follows from sums over the pieces before it: an odd number of quotes means inside a string,
and the brackets outside strings add up to the depth.  So the commas that part a list's elements are
known without one task reading the whole file.  Every element becomes a line of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.ordered import block_of, running
from tabscope.session import durable
from tabscope.sources.readers import _numbered, flatten_records, read_records_json

_STRING = r'"(?:[^"\\]|\\.)*+"'
#: Lines whose rows meet the facts of their member or file in one place.
BLOCK = 1 << 16
#: What stands before a member's value, and before the elements of a list.
_NAME = rf"^\s*(?:\{{\s*)?({_STRING})\s*:\s*"


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, line, text``: the pieces between commas, numbered from 1 in each file."""
    rows = spark.read.option("lineSep", ",").text(path)
    return _numbered(rows.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"),
                                 F.col("_metadata.file_block_length").alias("length"), F.monotonically_increasing_id().alias("id"),
                                 F.regexp_replace(F.validate_utf8("value"), "^\ufeff", "").alias("text")))


def _brackets(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    def count(marks: str) -> Column:
        return F.length(text) - F.length(F.translate(text, marks, ""))
    return count("[{") - count("]}")


def _with_facts(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the one row of ``facts`` of their ``keys``.  The facts are repeated for every block
    of lines (``from``) of their rows, so a member with most of a file's elements is not one task's work."""
    block = block_of("from", BLOCK)
    reach = rows.groupBy(*keys).agg(F.min(block).alias("_lo"), F.max(block).alias("_hi"))
    spread = facts.join(reach, keys).withColumn("_b", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return rows.withColumn("_b", block).join(spread, [*keys, "_b"]).drop("_b")


def json_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, member, name, kind, element, text``: every element of the lists of JSON documents.

    A document that is a list has one member, named null.  In a document that is an object each
    member counts: lists (kind ``[``) give a row per element, anything else (``{`` or ``-``) a single row.
    ``text`` is the element's JSON on one line.  Blank files give no rows; brackets that don't close
    raise an error.  What one element needs at a time is that element.
    """
    plain = F.regexp_replace("text", r"\\.", "")
    bare = F.regexp_replace(plain, '"[^"]*+(?:"|$)', "")
    tail = F.regexp_replace(F.regexp_replace(plain, '^[^"]*+(?:"|$)', ""), '"[^"]*+(?:"|$)', "")
    quotes = (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))).cast("bigint")
    top = F.when(F.regexp_extract("text", r"^\s*(\S)", 1) != "", F.regexp_extract("text", r"^\s*(\S)", 1))
    scanned = _pieces(spark, path).select("source", "line", "text", quotes.alias("quotes"), _brackets(bare).cast("bigint").alias("outside"), _brackets(tail).cast("bigint").alias("within"))
    stringed = running(scanned, ["source"], "line", sums={"seen": F.col("quotes")}, fills={"top": F.when(F.col("line") == 1, top)})
    before_odd = (F.col("seen") - F.col("quotes")) % 2 == 1
    change = F.when(before_odd, F.col("within")).otherwise(F.col("outside"))
    # A list is read as the only member of an object: one level deeper than it stands.
    deep = running(stringed.select("source", "line", "text", "top", (F.col("seen") % 2 == 1).alias("in_string"), change.alias("change")), ["source"], "line",
                   sums={"depth": F.col("change") + F.when((F.col("line") == 1) & (F.col("top") == "["), 1).otherwise(0)})
    ends = ~F.col("in_string")
    marked = deep.withColumn("ends_member", (ends & (F.col("depth") == 1)).cast("bigint")).withColumn("ends_element", (ends & F.col("depth").isin(1, 2)).cast("bigint"))
    numbered = running(marked, ["source"], "line", sums={"member": F.col("ends_member"), "element": F.col("ends_element")})
    numbered = numbered.withColumn("member", F.col("member") - F.col("ends_member")).withColumn("element", F.col("element") - F.col("ends_element"))
    def joined(order: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda p: p["text"]), ",").alias("text")

    # A name may hold commas, so a member's head is the text up to its first end of an element.
    fine = (numbered.groupBy("source", "member", "element").agg(joined("line"), F.first("top").alias("top"), F.min("line").alias("from"), F.max("line").alias("to"),
                                                                 F.max_by("depth", "line").alias("depth"), F.max_by("in_string", "line").alias("in_string")))
    fine = durable(fine)  # read for the heads and the rows
    heads = (fine.groupBy("source", "member").agg(F.min_by("text", "element").alias("head"), F.first("top").alias("top"))
             .withColumn("value", F.when(F.col("top") == "[", F.col("head")).otherwise(F.regexp_replace("head", _NAME, "")))
             .withColumn("kind", F.regexp_extract("value", r"^\s*(\S?)", 1)).withColumn("kind", F.when(F.col("kind").isin("[", "{"), F.col("kind")).otherwise("-"))
             .select("source", "member", "kind", F.when(F.col("top") != "[", F.get(F.from_json(F.concat(F.lit("["), F.regexp_extract("head", _NAME, 1), F.lit("]")), "array<string>"), F.lit(0))).alias("name")))
    whole = (_with_facts(fine, heads, ["source", "member"]).withColumn("place", F.when(F.col("kind") == "[", F.col("element")))
             .groupBy("source", "member", "name", "kind", "place", "top")
             .agg(joined("element"), F.min("from").alias("from"), F.max("to").alias("to"), F.max_by("depth", "element").alias("depth"), F.max_by("in_string", "element").alias("in_string"))
             .withColumnRenamed("place", "element"))
    whole = durable(whole)
    starts = whole.groupBy("source", "member").agg(F.min("from").alias("start"))
    ends_at = whole.groupBy("source").agg(F.max("to").alias("end"))
    whole = _with_facts(_with_facts(whole, starts, ["source", "member"]), ends_at, ["source"])
    closed = F.when(F.col("top") == "[", 1).otherwise(0)
    whole = whole.withColumn("text", F.when((F.col("to") == F.col("end")) & F.col("top").isin("[", "{") & ((F.col("depth") != closed) | F.col("in_string")),
                                            F.raise_error(F.concat(F.lit("brackets or quotes of the JSON document don't close: "), "source")).cast("string")).otherwise(F.col("text")))
    text = F.when(F.col("from") == F.col("start"), F.when(F.col("top") == "[", F.col("text")).otherwise(F.regexp_replace("text", _NAME, ""))).otherwise(F.col("text"))
    # The document's own closing brace, then the list's brackets.
    text = F.when((F.col("top") == "{") & (F.col("depth") == 0), F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    text = F.when((F.col("kind") == "[") & (F.col("from") == F.col("start")), F.regexp_replace(text, r"^\s*\[", "")).otherwise(text)
    text = F.when((F.col("kind") == "[") & (F.col("depth") <= 1), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    # Strings hold no raw line ends, so an element fits on one line.
    return whole.select("source", "member", "name", "kind", "element", F.btrim(F.translate(text, "\r\n\t", "   ")).alias("text")).filter("text <> ''")


def json_document(spark: SparkSession, path: str) -> dict[str | None, DataFrame]:
    """The tables of one JSON document, by name (null for a document that is a list).

    A list of lists is a grid (``source, sheet, row_number, cells``), any other list a table of flat
    records, what is no object in it as ``value``.  In an object every list of objects or lists is a
    table of its own; an object without one is a single record if it holds plain values only, else a
    table of ``key`` and ``value`` (JSON text).  An empty document has no tables.
    """
    elements = durable(json_elements(spark, path))
    begins = F.substring("text", 1, 1)
    members = (elements.groupBy("member", "name", "kind").agg(F.bool_and(begins == "[").alias("grid"), F.bool_and(begins.isin("[", "{")).alias("nested"))
               .orderBy("member").collect())  # a row per table
    listed = [m for m in members if m["kind"] == "[" and (m["nested"] or m["name"] is None)]
    if not members:
        return {}
    if not listed:
        if all(m["kind"] == "-" for m in members):
            return {None: read_records_json(spark, path, True)}
        value = F.when(F.col("kind") == "[", F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("element", "text"))), lambda e: e["text"]), ","), F.lit("]"))).otherwise(F.min("text"))
        rows = elements.groupBy("source", "member", "name", "kind").agg(value.alias("value"))
        unquoted = F.when(F.col("value").startswith('"'), F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"), F.lit(0))).otherwise(F.col("value"))
        return {None: rows.select(F.col("name").alias("key"), unquoted.alias("value"))}
    return {m["name"]: _table(elements.filter(F.col("member") == m["member"]), m["name"], m["grid"]) for m in listed}


def _table(elements: DataFrame, name: str | None, grid: bool) -> DataFrame:
    if grid:
        number = running(elements.withColumn("place", F.col("element") + 1), ["source"], "place", sums={"row_number": F.lit(1).cast("bigint")})
        return number.select("source", F.coalesce(F.lit(name), F.lit("")).alias("sheet"), "row_number", F.from_json("text", "array<string>", {"mode": "FAILFAST"}).alias("cells"))
    record = F.when(F.substring("text", 1, 1) == "{", F.col("text")).otherwise(F.concat(F.lit('{"value":'), "text", F.lit("}")))
    spark = elements.sparkSession
    folder = f"{spark.sparkContext.getCheckpointDir()}/json-{uuid.uuid4().hex}"
    elements.select(record.alias("value")).write.text(folder)
    return flatten_records(spark.read.option("mode", "FAILFAST").json(folder))
