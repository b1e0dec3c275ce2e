"""Sketches against plain set differences, and the whole table against neighbours in sorted order."""

import hashlib
import random

import numpy as np
import pytest

from tabscope.llm import sketches
from tabscope.llm.sketches import Sketch, Version


def prose(rng, n):
    return " ".join(f"w{rng.randrange(300)}" + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))


def plain(a, b):
    a, b = set(sketches.digests(a).tolist()), set(sketches.digests(b).tolist())
    return a - b, b - a, len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("n", [0, 1, 3, 10, 200, 3000])
def test_peeling_recovers_the_difference(n):
    rng = random.Random(n)
    for turn in range(5):
        base = [f"{rng.random()}." for _ in range(300)]
        a, b = list(base), list(base)
        for side in (a, b):
            for _ in range(rng.randint(0, n)):
                side.insert(rng.randrange(len(side) + 1), f"{rng.random()}.")
        a, b = "".join(a), "".join(b)
        gone, new, cells = sketches.difference(Version(a), Version(b))
        assert (set(gone.tolist()), set(new.tolist())) == plain(a, b)[:2]
        assert cells == sketches.CELLS or len(gone) + len(new) > sketches.CELLS // 6


def test_a_sketch_too_small_is_noticed():
    keys = np.arange(1, 500, dtype=np.uint64)
    assert (Sketch.of(keys) - Sketch.of(keys[:10])).peel() is None
    gone, new = (Sketch.of(keys, 1200) - Sketch.of(keys[:10], 1200)).peel()
    assert sorted(gone.tolist()) == keys[10:].tolist() and not len(new)


def test_repeated_paragraphs_count():
    a, b = Version("same.\n" * 5), Version("same.\n" * 3)
    assert sketches.likeness(a, b)[:3] == (3 / 5, 2, 0)


def test_paragraphs_cover_the_text():
    rng = random.Random(1)
    for text in ["", "\n", "...", "a" * 1000, prose(rng, 400), "é. ü!\n\n漢字。" * 30]:
        assert "".join(sketches.paragraphs(text)) == text


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for at, (name, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        want.append((name, len(text), hashlib.sha256(new.encode()).hexdigest(), Version(text).sketch().text(), Version(new).sketch().text(), plain(text, new)[2], plain(text, after)[2]))
    mine = [tuple(r)[:7] for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_every_document_meets_the_next_one(spark, make_docs, partitions):
    rng = random.Random(2)
    rows = [(3 * i - 40, prose(rng, rng.randint(0, 150))) for i in range(60)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "x"), (505, prose(rng, 20000)), (None, "no id. é")]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sketches.fingerprints(make_docs(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    check(rows, got)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (500, 501, -31)}
    assert len(same) == 1


def test_few_rows_and_repeated_rows(spark, make_docs):
    assert sketches.fingerprints(make_docs([])).count() == 0
    check([(1, "only. one")], sketches.fingerprints(make_docs([(1, "only. one")])).collect())
    rows = [(1, "same. text")] * 4 + [(2, "other. text")]
    check(rows, sketches.fingerprints(make_docs(rows)).collect())
