"""Cases that once gave wrong rows without an error."""

import pytest
from pyspark.errors import PySparkException

from tabscope.operators.ask import Question, ask_many
from tabscope.operators.benchmark import match_vendor_sheets
from tabscope.operators.bids import clean_party, section_category
from tabscope.operators.patterns import best_and_worst
from tabscope.sources.readers import read_grid_csv, read_records_json


def _grid(spark, path, **options):
    return [r["cells"] for r in read_grid_csv(spark, str(path), sep=",", **options).orderBy("row_number").collect()]


def test_marks_inside_plain_cells_open_nothing(spark, tmp_path):
    file = tmp_path / "inch.csv"
    file.write_text('a,b,c\n1,5" pipe,3\n2,bolt,8\n3,6" pipe,4\n')
    assert _grid(spark, file) == [["a", "b", "c"], ["1", '5" pipe', "3"], ["2", "bolt", "8"], ["3", '6" pipe', "4"]]


def test_quoted_breaks_beside_plain_marks(spark, tmp_path):
    file = tmp_path / "both.csv"
    file.write_text('a,b\n1,"x\n5"" y, z\nend"\n2,5" p\n"q\n\nr",3\n')
    assert _grid(spark, file) == [["a", "b"], ["1", 'x\n5" y, z\nend'], ["2", '5" p'], ["q\n\nr", "3"]]


def test_a_quote_left_open_fails(spark, tmp_path):
    file = tmp_path / "open.csv"
    file.write_text('a,b\n1,"open\n2,x\n')
    with pytest.raises(PySparkException, match="malformed quotes"):
        _grid(spark, file)


def test_bytes_that_are_not_utf8_fail_wherever_they_stand(spark, tmp_path):
    file = tmp_path / "late.csv"
    file.write_bytes(b"a,b\n" + b"1,x\n" * 300_000 + b"2,\xa1\xa2\n")
    with pytest.raises(PySparkException):
        _grid(spark, file)


def test_broken_json_lines_fail(spark, tmp_path):
    file = tmp_path / "rows.json"
    file.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):  # schema inference raises through the gateway
        read_records_json(spark, str(file), multi_line=False).collect()


def test_prices_on_other_axes_are_other_bills(spark):
    rows = [("b", f"BOQ {n}", i, f"item {i}", 1.0, 7.0 if n == "A" else None, None if n == "A" else 7.0) for n in "AB" for i in range(1, 12)]
    lines = spark.createDataFrame(rows, "source string, sheet string, row_number bigint, item string, quantity double, material double, labour double")
    assert not any(r["accepted"] for r in match_vendor_sheets(lines).collect())


def test_long_names_stay_apart(spark):
    head = "x" * 90
    rows = [("s", 1, head + " one", None, False, None), ("s", 2, "a", 1.0, True, None), ("s", 3, head + " two", None, False, None), ("s", 4, "b", 1.0, True, None)]
    frame = spark.createDataFrame(rows, "sheet string, row_number bigint, label string, quantity double, priced boolean, category_text string")
    assert section_category(frame, ["sheet"], "row_number").select("category").distinct().count() == 2
    names = spark.createDataFrame([(head + " one",), (head + " two",)], "n string")
    assert names.select(clean_party(names["n"])).distinct().count() == 2


def test_ties_are_settled_by_label(spark):
    means = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1)], "label string, mean double, count bigint")
    row = best_and_worst(means).first()
    assert (row["best"], row["worst"]) == ("b", "a")


def test_questions_after_the_twelfth_are_refused_not_lost(spark):
    frame = spark.createDataFrame([(1, "x")], "n bigint, g string")
    answers = ask_many(frame, [Question("n", "sum", ("g",))] * 14)
    assert sum(a.error is not None and "more than" in a.error for a in answers) == 2
