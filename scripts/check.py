"""Compare every registered query with its oracle on one scale factor.

usage: python scripts/check.py [sf dir] [name prefix ...]
"""

import importlib
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        return repr(float(value))
    return str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(canon(rec[i]) for i in order) for rec in records], key=lambda t: tuple("" if x is None else x for x in t))


def kinds(names, records):
    """Python types seen in each column: a strict comparer tells 1 from 1.0."""
    return {n: {type(rec[i]).__name__ for rec in records if rec[i] is not None} for i, n in enumerate(names)}


def main():
    from tabscope.session import local_session
    entry = importlib.import_module("__spark_entry__")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = fn(spark, sf)
            got = df.collect()
            took = time.time() - began
            if name not in oracle:
                print(f"ROWS  {name:24s} {len(got):6d} rows {took:5.1f}s  {df.columns}")
                continue
            cur = con.execute(oracle[name])
            names = [d[0] for d in cur.description]
            fetched = cur.fetchall()
            want = rows(names, fetched)
            have = rows(df.columns, got)
            a, b = kinds(df.columns, got), kinds(names, fetched)
            apart = {n: (a[n], b[n]) for n in a if n in b and a[n] and b[n] and a[n] != b[n]}
            if apart:
                print(f"TYPES {name}: {apart}")
            if sorted(names) != sorted(df.columns):
                print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(names)}")
                bad += 1
            elif have == want:
                print(f"ok    {name:24s} {len(got):6d} rows {took:5.1f}s")
            else:
                bad += 1
                a, b = [x for x in have if x not in set(want)], [x for x in want if x not in set(have)]
                print(f"DIFF  {name}: {len(have)} vs {len(want)} rows; only spark {a[:3]}; only duckdb {b[:3]}")
        except Exception as error:  # keep going: this is a report
            bad += 1
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:700]}")
    print("bad:", bad)


main()
