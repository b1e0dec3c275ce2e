"""Registered queries that must not leave rows out."""

import duckdb

from catalog import base, bidding  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_line_total_runs_on_every_line(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = con.execute(base.ORACLE["line_total_every_line"]).fetchall()
    got = [tuple(r) for r in base.QUERIES["line_total_every_line"](spark, SF).collect()]
    assert len(got) == base.table(spark, SF, "lineitem").count() == len(set((r[0], r[1], r[2]) for r in got))
    key = lambda r: r[:3]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and all((x is None) == (y is None) and (x is None or abs(x - y) < 0.011) for x, y in zip(a[3:], b[3:]))
