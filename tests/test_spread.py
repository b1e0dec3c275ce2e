"""Rows of a small file are worked on by many tasks."""

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_long_records_of_one_file_come_from_every_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        rows = entry.queries()["to_long"](spark, "/root/testdata/sf0.001")
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
