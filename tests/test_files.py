import json

import pytest
from pyspark.sql import functions as F

from tabscope.functions.values import bucket_range, time_bucket, typed_number
from tabscope.plans.analyses import Analysis, eligible_analyses, run_analyses
from tabscope.sources import readers as R
from tabscope.sources.sinks import csv_safe, write_csv_safe


def grid_rows(df):
    return [(r["row_number"], r["cells"]) for r in df.orderBy("source", "row_number").collect()]


@pytest.mark.parametrize("sep,encoding,bom", [(",", "utf-8", b""), (";", "utf-8", b"\xef\xbb\xbf"), ("\t", "cp874", b""), ("|", "utf-16-le", b"\xff\xfe")])
def test_csv_dialects(spark, tmp_path, sep, encoding, bom):
    lines = [sep.join(["รหัส", "ชื่อ", "ยอด"]), sep.join(["001", "ปูน", "5"]), "", sep.join(["002", '"a ""b"" c"', ""])]
    (tmp_path / "x.csv").write_bytes(bom + "\r\n".join(lines).encode(encoding) + "\r\n".encode(encoding))
    got = [r for r in grid_rows(R.read_grid_csv(spark, str(tmp_path / "x.csv"))) if r[1]]
    assert got == [(1, ["รหัส", "ชื่อ", "ยอด"]), (2, ["001", "ปูน", "5"]), (4, ["002", 'a "b" c'])]


def test_quoted_line_breaks_and_many_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n3,4\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("x;y\n5;6\n", encoding="utf-8")
    assert grid_rows(R.read_grid_csv(spark, str(tmp_path / "a.csv"))) == [(1, ["x", "y"]), (2, ["1", "two\nlines"]), (4, ["3", "4"])]
    many = R.read_many(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert {r["s"]: r["n"] for r in many.groupBy(F.regexp_extract("source", r"(\w)\.csv", 1).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 3, "b": 2}


def test_delimiter_is_judged_on_all_lines_outside_quotes(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a, b and c, d\n" + '1;"x, y, z"\n2;"p, q, r"\n3;s\n', encoding="utf-8")
    (tmp_path / "one.csv").write_text("only\nvalues\n", encoding="utf-8")
    (tmp_path / "none.csv").write_text("", encoding="utf-8")
    assert [R.find_delimiter(spark, [str(tmp_path / n)], {"UTF-8": []}) for n in ("d.csv", "one.csv", "none.csv")] == [";", ",", ","]


def test_each_file_of_a_folder_has_its_own_encoding(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    names = {"utf8": "utf-8", "thai": "cp874", "marked": "utf-16-le"}
    for name, encoding in names.items():
        mark = b"\xff\xfe" if name == "marked" else b""
        (folder / f"{name} file.csv").write_bytes(mark + f"{name};ราคา\n\n{name};ปูน\n".encode(encoding))
    found = R.find_encodings(spark, [str(folder)])
    assert {e: len(f) for e, f in found.items()} == {"UTF-8": 1, R.THAI_CODE_PAGE: 1, "UTF-16LE": 1}
    rows = {(r["row_number"], *r["cells"]) for r in R.read_grid_csv(spark, str(folder)).collect()}
    assert rows == {(n, *c) for name in names for n, c in ((1, (name, "ราคา")), (2, ()), (3, (name, "ปูน")))}


def test_encoding_shows_only_at_the_end_of_a_file(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes(b"id;name\n" * 200_000 + "1;ปูน\n".encode("cp874"))
    last = R.read_grid_csv(spark, str(tmp_path / "late.csv")).orderBy(F.desc("row_number")).first()
    assert (last["row_number"], last["cells"]) == (200_001, ["1", "ปูน"])
    (tmp_path / "broken.csv").write_bytes(b"id;name\n1;\xff\xfd\xdb\n")
    with pytest.raises(Exception, match="MALFORMED_CHARACTER_CODING"):
        R.read_grid_csv(spark, str(tmp_path / "broken.csv")).collect()


@pytest.mark.parametrize("sent", [0, 1000])
def test_lines_are_numbered_across_file_blocks(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(R, "BLOCKS_SENT", sent)
    for name, n in (("x", 9000), ("y", 40)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name},{i}\n" + "\n" * (i % 3 == 0) for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = [(r["cells"][0], r["row_number"], int(r["cells"][1])) for r in R.read_grid_csv(spark, str(tmp_path)).collect() if r["cells"]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(name, i + 1 + -(-i // 3), i) for name, n in (("x", 9000), ("y", 40)) for i in range(n)]
    assert sorted(rows) == sorted(want)


def test_malformed_quotes_and_wide_rows_fail(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('x,y\n"a"b,c\n', encoding="utf-8")
    with pytest.raises(Exception, match="malformed quotes"):
        R.read_grid_csv(spark, str(tmp_path / "bad.csv"), sep=",").collect()
    (tmp_path / "wide.csv").write_text("1,2,3,4\n", encoding="utf-8")
    with pytest.raises(Exception, match="more than 3 columns"):
        R.read_grid_csv(spark, str(tmp_path / "wide.csv"), sep=",", max_columns=3).collect()


def test_json_shapes(spark, tmp_path):
    records = [{"Region": "North", "a": {"b": 1, "c": [1, 2]}}, {"Region": "South", "a": {"b": 2, "c": []}}]
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    (tmp_path / "object.json").write_text(json.dumps({"sales": records, "meta": {"v": 1}}))
    for df in (R.read_records_json(spark, str(tmp_path / "array.json")), R.read_records_json(spark, str(tmp_path / "lines.jsonl")), R.json_tables(spark, str(tmp_path / "object.json"))["sales"]):
        assert {(r["Region"], r["a.b"], r["a.c"]) for r in df.collect()} == {("North", 1, "[1,2]"), ("South", 2, "[]")}


def test_record_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<root><meta>1</meta><items><item id="1"><name>a</name></item><item id="2"><name>b</name></item></items></root>')
    assert {(r["id"], r["name"]) for r in R.read_records_xml(spark, str(tmp_path / "r.xml")).collect()} == {(1, "a"), (2, "b")}


def test_html_tables(spark):
    html = "<table><tr><th colspan='2'>A<br>B</th><th>C</th></tr><tr><td>x &amp; y<td></td><td>1</td></tr></table><table><tr><td>one row</td></tr></table>"
    got = grid_rows(R.html_tables(spark.createDataFrame([(7, html), (8, None)], "id int, html string"), "id", "html"))
    assert got[0] == (1, ["A\nB", None, "C"]) and len(got) == 2


def test_numbers_and_formula_guard(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in ["1,234.50", "(300)", "0123", "0.5", "12 ชิ้น", "", " 7 "]], "t string")
    assert [r[0] for r in df.select(typed_number("t")).collect()] == [1234.5, -300, None, .5, None, None, 7]
    texts = ["=1", " +2", "​@x", "a=1", "\t-3"]
    guarded = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(csv_safe("t")).collect()]
    assert guarded == ["'=1", "' +2", "'​@x", "a=1", "'\t-3"]
    write_csv_safe(spark.createDataFrame([("=1", -2)], "`=h` string, n int").coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.splitlines() == ["'=h,n", "'=1,-2"]


def test_buckets(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-01-01",), ("2023-01-02",)], "d string").withColumn("d", F.to_date("d"))
    assert [r[0] for r in df.select(time_bucket("d", "week")).collect()] == ["2024-W09", "2023-W00", "2023-W01"]
    ranges = spark.createDataFrame([("2024-02",), ("2024",), ("2024-Q1",)], "l string").select(bucket_range("l").alias("r")).collect()
    assert [r["r"] and (str(r["r"]["from"]), str(r["r"]["to"])) for r in ranges] == [("2024-02-01", "2024-02-29"), ("2024-01-01", "2024-12-31"), None]


def test_one_failing_analysis_leaves_the_rest(spark):
    df = spark.createDataFrame([("A", 10), ("B", 20), ("A", 30), ("B", 40)], "Team string, Amount bigint")
    plans = eligible_analyses(df)
    assert [p.type for p in plans] == ["quality", "statistics", "frequency", "category"]
    results, errors = run_analyses(df, [*plans, Analysis("A-99", "trend", ("Nope", "Amount"))])
    assert set(results) == {p.id for p in plans} and [e[0] for e in errors] == ["A-99"]
