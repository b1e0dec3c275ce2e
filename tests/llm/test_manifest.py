"""The manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabscope.llm import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, g int, pos string, node string, leaf int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tampered(row):
    hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
    return leaf((*row[:4], lower(row[4]))) if hit else leaf(row)


def climb(digests, place):
    """The end of a tree, and the siblings of ``place`` as (left, right) per level."""
    sides = []
    while len(digests) > 1:
        run = digests[place // 16 * 16:place // 16 * 16 + 16]
        sides.append(("".join(run[:place % 16]), "".join(run[place % 16 + 1:])))
        digests, place = [h(*digests[i:i + 16]) for i in range(0, len(digests), 16)], place // 16
    return digests[0], sides


def brute(rows):
    groups = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in groups}
    subroots = [climb([leaf(r) for r in own[s]], 0)[0] for s in groups]
    out = []
    for g, s in enumerate(groups):
        for at, row in enumerate(own[s]):
            subroot, sides = climb([leaf(r) for r in own[s]], at)
            root, more = climb(subroots, g)
            folded = tampered(row)
            for left, right in sides + more:
                folded = h(left, folded, right)
            out.append((row[0], leaf(row), subroot, root, "".join(a + b for a, b in sides + more), folded, folded == root))
    return sorted(out, key=str)


def run(spark, rows, parts=2):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame([(*r, 1, "a", "b", 2) for r in rows], SCHEMA)
        hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
        return sorted((tuple(r) for r in manifest.audit(docs, tampered=hit).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)


@pytest.mark.parametrize("parts", [1, 9])
def test_equals_a_plain_tree(spark, parts):
    rng = random.Random(parts)
    names = [None, "", "a", "é", "z", "B", "lone"]
    sizes = [40, 16, 17, 300, 1, 256, 1]
    rows = [(i, s, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Text É", "plain", "A" * 5000])) for i, s in enumerate(s for s, n in zip(names, sizes) for _ in range(n))]
    rows += [(7, "a", "en", 1, "twice"), (7, "a", "en", 1, "twice"), (7, "a", "en", 2, "TWICE"), (None, "z", None, None, None), (None, None, None, None, None)]
    rng.shuffle(rows)
    got = run(spark, rows, parts)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_many_small_groups(spark):
    rows = [(i, f"s{i % 700}", "en", 3, f"Text {i}") for i in range(900)]
    assert run(spark, rows, 5) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 17])
def test_few_rows(spark, n):
    rows = [(i, "one", "en", 3, f"Text {i}") for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_equal_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", 4)
    rows = [(None, None, None, None, None)] * 400 + [(i, "x", None, 1, "T") for i in range(300)]
    assert run(spark, rows, 4) == brute(rows)
