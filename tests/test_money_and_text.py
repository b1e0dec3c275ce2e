import pytest
from pyspark.sql import functions as F

from tabscope.columns import ROW
from tabscope.operators import benchmark as Q
from tabscope.operators import bids as B
from tabscope.operators import evidence as E

BIDS = [("dig", "earthwork", 5000, 6000, 4500, 5500), ("fill", "earthwork", 4000, 3500, 4500, 3750), ("pour", "concrete", 40000, 42000, 46000, 41000), ("rebar", "concrete", 25000, 24000, None, 26000)]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(line, cat, p, o, None if v is None else float(v)) for line, cat, *values in BIDS for o, (p, v) in enumerate(zip("ABC", values[:3]))]
    rows += [(line, cat, "บริษัท ______ จำกัด", 3, None) for line, cat, *_ in BIDS]
    df = spark.createDataFrame(rows, "line string, category string, party string, party_order int, total double")
    return df.withColumn("material", F.lit(None).cast("double")).withColumn("labour", F.lit(None).cast("double"))


def test_bid_ranking(lines):
    bids = B.drop_empty_parties(lines)
    got = [(r["rank"], r["party"], r["total"], r["missing"], r["common_total"]) for r in B.rank_bids(bids, 76250.0).orderBy("rank").collect()]
    assert got == [(1, "C", 55000, 1, 55000), (2, "A", 74000, 0, 49000), (3, "B", 75500, 0, 51500)]
    assert B.rank_bids(bids, 76250.0).filter("rank = 1").first()["vs_benchmark_pct"] == pytest.approx((55000 - 76250) / 76250 * 100)
    best = B.best_of(bids).first()
    assert (best["best_of"], best["negotiable"]) == (48000, 7000)
    matrix = {r["category"]: r["A"] for r in B.category_matrix(bids, ["A", "B", "C"]).collect()}
    assert matrix == {"concrete": 65000, "earthwork": 9000}
    assert {r["party"]: r["wins"] for r in B.wins(bids).collect()} == {"A": 1, "B": 1, "C": 1}


@pytest.mark.parametrize("values", [[12000, 5500, 25000, 14000], [5.0] * 10, [3.0, 3.0, 3.0, 1.0, -2.0], [0.0, 0.0]])
def test_estimate_and_pareto(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(99, None)], "line int, total double").withColumn("category", F.lit("x"))
    total, running, needed = sum(values), 0.0, 0
    for v in sorted(values, reverse=True):
        if not total or running >= total * .8:
            break
        running, needed = running + v, needed + 1
    assert B.pareto_count(df).first()["lines_needed"] == needed


def test_line_value_rules(spark):
    cells = [(1, 10.0, "amount", "material", 1, 30.0), (1, 10.0, "amount", "labour", 2, 5.0), (1, 10.0, "amount", None, 3, 99.0), (2, 10.0, "unit", "material", 1, 3.0), (2, 10.0, "unit", "labour", 2, None),
             (3, 10.0, "unit", None, 1, 4.0), (4, None, "unit", None, 1, 4.0)]
    df = spark.createDataFrame(cells, "line int, quantity double, measure string, axis string, position int, value double")
    got = {r["line"]: (r["total"], r["material"], r["labour"]) for r in B.line_total(df, ["line"]).collect()}
    assert got == {1: (99.0, 30.0, 5.0), 2: (30.0, 30.0, None), 3: (40.0, None, None), 4: (None, None, None)}


ITEMS = [(f"Item {i}", "หมวด " + ("A" if i < 6 else "B"), 10.0 * (i + 1), 100.0, 50.0) for i in range(12)]
SIDE = ["No", "รายการ", "หมวดงาน", "หน่วย", "ปริมาณ RBP", "ปริมาณ AAA เสนอ", "ปริมาณ BBB เสนอ", "ราคาของ RBP", "ราคาของ AAA เสนอ", "ราคาของ BBB เสนอ", "ราคาแรง RBP", "ราคาแรง AAA เสนอ", "ราคาแรง BBB เสนอ", "ส่วนต่าง AAA", "Flag ปริมาณ"]


def side_by_side():
    rows = [[i, item, cat, "ea", q, q, q * 1.2, m, m * (2 if i == 1 else 1), m, l, l, l * 1.05, 0, None] for i, (item, cat, q, m, l) in enumerate(ITEMS, 1)]
    return {s: [SIDE, *rows] for s in ("ST_A", "AR_A")}


def test_side_by_side_vendors(make_grid):
    grid, _ = Q.drop_aggregate_sheets(make_grid({**side_by_side(), "Summary": [["Total", "1"]]}))
    heads = Q.header_cells(grid)
    records = Q.to_long(grid, heads, Q.map_vendors(heads))
    tol, source = Q.choose_tolerance(Q.infer_tolerance(records))
    assert (tol, source) == (.15, "default")
    s = Q.summarize(Q.aggregate_groups(Q.priced_records(records, tol), tol))
    t = {r["vendor"]: r for r in s.filter("group is null").collect()}
    assert sorted(t) == ["AAA", "BBB"] and {r["group"] for r in s.filter("group is not null").collect()} == {"AR", "ST"}
    assert (t["AAA"]["material_over"], t["AAA"]["labour_over"], t["AAA"]["quantity_over"]) == (2, 0, 0)
    assert (t["BBB"]["quantity_over"], t["BBB"]["labour_over"]) == (24, 0)
    assert t["BBB"]["labour_dev_pct"] == pytest.approx(5) and t["BBB"]["material_dev_pct"] == pytest.approx(0)
    assert t["AAA"]["savings"] == pytest.approx(2000) and t["BBB"]["savings"] > 0
    declared = Q.summarize(Q.aggregate_groups(Q.priced_records(records, .01), .01))
    assert declared.filter("group is null and vendor = 'BBB'").first()["labour_over"] == 24
    assert Q.comparison_matrix(s, "quantity_over", ["AAA", "BBB"]).count() == 2


VENDOR_HEAD = ["No", "รายการ", "หมวดงาน", "หน่วย", "ปริมาณ (ราคากลาง)", "ปริมาณ", "ราคาวัสดุ/หน่วย (ราคากลาง)", "ราคาวัสดุ/หน่วย", "ราคาแรง/หน่วย (ราคากลาง)", "ราคาแรง/หน่วย"]


def test_one_sheet_per_vendor(make_grid):
    sheets = {v: [VENDOR_HEAD, *[[i, item, cat, "ea", q, q * qf, m, m * mf, l, l * lf] for i, (item, cat, q, m, l) in enumerate(ITEMS, 1)]] for v, qf, mf, lf in (("AAA", 1.0, 1.5, 1.0), ("BBB", 1.3, 1.0, 1.0))}
    grid = make_grid(sheets)
    heads = Q.header_cells(grid)
    records = Q.to_long(grid, heads, Q.map_vendors(heads))
    lines = records.select("source", "sheet", F.col("row").alias("row_number"), "item", F.col("quantity_benchmark").alias("quantity"), F.col("material_benchmark").alias("material"), F.col("labour_benchmark").alias("labour"))
    vendors = Q.match_vendor_sheets(lines)
    assert {(r["sheet"], r["vendor"], r["accepted"]) for r in vendors.collect()} == {("AAA", "AAA", True), ("BBB", "BBB", True)}
    named = records.drop("vendor").join(vendors.filter("accepted").select("source", "sheet", "vendor"), ["source", "sheet"])
    t = {r["vendor"]: r for r in Q.summarize(Q.aggregate_groups(Q.priced_records(named, .15), .15)).filter("group is null").collect()}
    assert t["AAA"]["material_over"] == 12 and t["BBB"]["quantity_over"] == 12


def test_labels_and_quoted_zero(spark, make_grid):
    found = Q.scan_labels(make_grid({"ST_A": [["ผู้รับเหมา: วิศวพัฒน์ จำกัด"], [], ["โครงการ", "บ้านตัวอย่าง"]]})).first()
    assert (found["vendor"], found["project"]) == ("วิศวพัฒน์ จำกัด", "บ้านตัวอย่าง")
    base = {f: None for f in Q.FIELDS}
    rows = [{**base, "material_proposal": 0.0, "total_proposal": 5.0}, {**base, "total_proposal": 5.0}, {**base, "total_benchmark": 5.0}]
    df = spark.createDataFrame([tuple(r[f] for f in Q.FIELDS) for r in rows], ", ".join(f"{f} double" for f in Q.FIELDS))
    assert [r["parent"] for r in Q.flag_parents(df).collect()] == [False, True, False]


def test_grounding(spark):
    evidence = spark.createDataFrame([("EV-001", "ผลต่าง -12.34"), ("EV-002", "rows 1,204 from 2020-2021, share 0.5e3")], "evidence_id string, text string")
    cases = {"a": ("ผลต่าง -12.3", ["EV-001"], True), "b": ("ผลต่าง 12.3", ["EV-001"], False), "c": ("EV-001 says nothing", ["EV-001"], True), "d": ("rows 1204", ["EV-001"], False), "e": ("1,204 rows", ["EV-002"], True),
             "f": ("in 2021", ["EV-002"], True), "g": ("about 1.2e3 rows", ["EV-002"], True), "h": ("500 exactly", ["EV-002"], True), "i": ("จำนวน ๙", ["EV-002"], False), "j": ("no figures", [], True), "k": ("-12.35", ["EV-001"], False)}
    df = spark.createDataFrame([(k, t, ids) for k, (t, ids, _) in cases.items()], "statement_id string, text string, evidence_ids array<string>")
    assert {r["statement_id"]: r["grounded"] for r in E.check_grounding(df, evidence).collect()} == {k: v for k, (_, _, v) in cases.items()}
    assert {r["statement_id"]: r["grounded"] for r in E.check_grounding(df, evidence, "unsigned").collect()}["b"]


def test_shown_text_has_no_ids(spark):
    texts = ["ยอดขาย 5 (EV-001, Q-002).", "ดู EV-003, แล้ว [BOQ-001]", "Q2-001 และ x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.strip_citations("t")).collect()]
    assert got == ["ยอดขาย 5.", "ดู แล้ว", "และ x"]


def test_outlines_keep_every_id(spark):
    kinds = ["statistics", "category", "outliers", "trend", "correlation", "frequency", "distribution"]
    sections = [("r", i, f"T{i}", "q", [f"E{i}"]) for i in range(372)] + [("s", 0, "own", "q", ["A", "B"]), ("s", 1, "again", "q", ["B", "A"])]
    df = spark.createDataFrame(sections, "report_id string, seq bigint, title string, question string, analysis_ids array<string>")
    types = spark.createDataFrame([("r", f"E{i}", kinds[i % 7]) for i in range(372)], "report_id string, evidence_id string, type string")
    out = E.merge_sections(df, types).collect()
    big = [r for r in out if r["report_id"] == "r"]
    assert len({r["seq"] for r in big}) == 7 and len(big) == len({r["analysis_id"] for r in big}) == 372
    assert {(r["title"], r["analysis_id"]) for r in out if r["report_id"] == "s"} == {("own", "A"), ("own", "B")}


def test_stated_total_ignores_vat(spark):
    rows = spark.createDataFrame([("A", 5, "Total zone 1", 1.0), ("A", 9, "Grand total", 100.0), ("A", 10, "Grand total VAT", 107.0), ("B", 9, "TOTAL", 5.0)], f"party string, {ROW} bigint, label string, value double")
    got = {r["party"]: (r["stated"], r["differs"]) for r in B.stated_total(rows, spark.createDataFrame([("A", 99.0), ("B", 5.0)], "party string, total double")).collect()}
    assert got == {"A": (100.0, True), "B": (None, False)}
