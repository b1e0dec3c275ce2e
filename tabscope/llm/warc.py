"""Web archives: write, read and resolve repeated payloads into revisit records.

Archives are WARC/1.0 text files written and read by Spark's own text source, so any file system
will do and one record is one row.  A record's first field names the archive
(``WARC-Warcinfo-ID``), drawn at random for each archive: the version line with it is where
records part when an archive is read, which no payload can hold by chance.  ``Content-Length`` is
checked for every record.

Resolution shuffles headers only: originals are the largest page id of each payload digest, found
by partial maxima, and the few digests that repeat are joined to the records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import common as C

BREAK = "\r\n"
RECORDS_PER_FILE = 20_000
HEADER = ("record_id", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "refers_to_record")


def _begin(archive: str) -> str:
    return f"WARC/1.0{BREAK}WARC-Warcinfo-ID: <urn:uuid:{archive}>{BREAK}"


def _line(name: str, value: Column) -> Column:
    """A header field, or nothing if there is no value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def write_archive(records: DataFrame, path: str) -> str:
    """Write records (the columns of ``HEADER`` and ``payload``) and return the archive's name.
    A revisit is written without its payload."""
    archive = str(uuid.uuid4())
    payload = F.when(F.col("record_type") == "revisit", "").otherwise(F.coalesce("payload", F.lit("")))
    url = F.regexp_replace("url", "[\\x00-\\x20]", "")  # a header field is one line
    text = F.concat(
        F.lit(_begin(archive)), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record_id", F.lit(">"))),
        _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), "refers_to_record", F.lit(">"))),
        _line("X-Page-ID", F.col("page_id").cast("string")), _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")), F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit(BREAK + BREAK), payload)
    (records.select(text.alias("value")).write.option("lineSep", BREAK + BREAK).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))
    return archive


def read_archive(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Records of an archive: the columns of ``HEADER`` and ``payload``; a damaged record fails the read."""
    rows = spark.read.option("lineSep", _begin(archive)).text(path).filter(F.octet_length("value") > 0)
    head = F.substring_index("value", BREAK + BREAK, 1)
    body = F.expr(f"substr(value, length(head) + {len(BREAK * 2) + 1})")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(F.concat(F.lit(BREAK), "head"), rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))

    def named(name: str) -> Column:
        return F.regexp_extract(field(name), "<urn:uuid:([^>]*)>", 1)

    parsed = rows.withColumn("head", head).withColumn("body", body)
    payload = F.expr(f"substr(body, 1, length(body) - {len(BREAK * 2)})")
    length = F.octet_length("payload").cast("string")
    return (parsed.withColumn("payload", payload)
            .withColumn("payload", F.when(field("Content-Length") == length, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "head"))))
            .select(named("WARC-Record-ID").alias("record_id"), field("X-Page-ID").cast("bigint").alias("page_id"), field("WARC-Target-URI").alias("url"),
                    field("WARC-Type").alias("record_type"), F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
                    field("X-Payload-Length").cast("bigint").alias("payload_bytes"), field("X-Refers-To-Page-ID").cast("bigint").alias("refers_to"),
                    named("WARC-Refers-To").alias("refers_to_record"), "payload"))


def as_responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as response records; a null html is an empty payload."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    base = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    return base.select(F.uuid().alias("record_id"), "page_id", "url", F.lit("response").alias("record_type"), F.sha1(F.encode("payload", "UTF-8")).alias("payload_digest"),
                       F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.lit(None).cast("bigint").alias("refers_to"),
                       F.lit(None).cast("string").alias("refers_to_record"), "payload")


def resolve(records: DataFrame, room: str, least: int = 1000) -> DataFrame:
    """Responses of equal payloads of at least ``least`` bytes become revisits of the one with the
    largest page id; of records that repeat id and payload, the largest record id is the response."""
    long_ones = F.col("payload_bytes") >= least
    rank = F.struct(F.col("page_id"), F.col("record_id"))  # a null page id is the smallest
    originals = (records.filter(long_ones).groupBy("payload_digest").agg(F.max(rank).alias("original"), F.count(F.lit(1)).alias("n"))
                 .filter("n > 1").select("payload_digest", "original"))
    # Written first, so that its size is known when the join is planned: repeats only are joined.
    originals = C.stored(originals, f"{room}/originals")
    joined = records.join(originals, "payload_digest", "left")
    again = F.coalesce(long_ones & F.col("original").isNotNull() & (F.col("record_id") != F.col("original.record_id")), F.lit(False))
    return joined.select("record_id", "page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), "payload_digest", "payload_bytes",
                         F.when(again, F.col("original.page_id")).alias("refers_to"), F.when(again, F.col("original.record_id")).alias("refers_to_record"), "payload")


def deduplicate(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """Archive pages, resolve repeats, write the deduplicated archive and read it back.

    Returns the columns of ``HEADER`` and ``payload`` (empty for revisits), one row per page.
    Null html and null url are empty and absent; a page without id is kept, and is an original only
    among such pages; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    room = C.workroom(spark, "warc")
    first = write_archive(as_responses(pages, page_id, url, html), f"{room}/first")
    resolved = resolve(read_archive(spark, f"{room}/first", first), room, least)
    final = write_archive(resolved, f"{room}/final")
    C.discard(spark, f"{room}/first")
    return read_archive(spark, f"{room}/final", final)
