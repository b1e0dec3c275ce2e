"""Lines recur only across documents that really differ, however often these are copied."""

import random

import pytest

from tabscope.llm import common, line_templates


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))


def dropped(docs):
    return {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs).collect()}


def test_a_much_copied_page_saves_no_boilerplate(make_docs):
    rng = random.Random(1)
    notice = "subscribe to our weekly letter today"
    page = words(rng, 25)
    rows = [(d, f"{words(rng, 25)}\n{notice}") for d in range(200)] + [(1000 + d, f"{page}\n{notice}") for d in range(400)]
    got = dropped(make_docs(rows))
    assert len(got) == 600 and not any(notice in t for t in got.values())
    assert all(got[d] == t.split("\n")[0] for d, t in rows)


def test_documents_that_share_their_longest_line(make_docs):
    rng = random.Random(2)
    notice = "all content of this site may be used under the terms that are named in the legal notice"
    rows = [(d, f"{words(rng, 12)}\nhome news contact\n{notice}") for d in range(100)]
    got = dropped(make_docs(rows))
    assert all(got[d] == t.split("\n")[0] for d, t in rows)


def test_near_copies_keep_their_lines(make_docs):
    rng = random.Random(3)
    lines = [words(rng, 8), words(rng, 9), words(rng, 10)]
    rows = []
    for d in range(20):
        # A word among the leading ones differs, so that the longest lines fall into different leaves.
        longest = words(random.Random(4), 20).split()
        longest[d % 3] = f"{words(rng, 1)}x"
        rows.append((d, "\n".join([*lines, " ".join(longest)])))
    assert dropped(make_docs(rows)) == dict(rows)


def test_two_families_are_too_few(make_docs):
    rng = random.Random(5)
    notice = "press the bell to get our news first"
    pages = [words(rng, 30) for _ in range(3)]
    rows = [(d, f"{pages[d % 2]}\n{notice}") for d in range(40)]
    assert all(notice in t for t in dropped(make_docs(rows)).values())
    rows.append((99, f"{pages[2]}\n{notice}"))
    assert not any(notice in t for t in dropped(make_docs(rows)).values())


def test_families_equal_exact_shares_of_small_texts(spark):
    """Texts of under ``SKETCH`` triples in all are compared exactly."""
    rng = random.Random(6)
    base = words(rng, 25).split()
    texts = []
    for edits in (0, 1, 2, 3, 6, 25):
        for _ in range(4):
            own = list(base)
            for at in rng.sample(range(25), edits):
                own[at] = words(rng, 1)
            texts.append(" ".join(own))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    room = common.workroom(spark, "families")
    names = {r["h"]: r["text"] for r in docs.selectExpr("xxhash64(text) AS h", "text").collect()}
    roots = {names[r["whole"]]: r["root"] for r in line_templates.families(docs, room).collect()}

    def triples(text):
        w = [*text.split(), None, None]
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}

    for t in set(texts):
        # Linked with the unedited text exactly if alike; the fully edited ones are alone.
        a, b = triples(t), triples(texts[0])
        if len(a & b) >= 0.6 * len(a | b):
            assert roots[t] == roots[texts[0]]
        if not a & b:
            assert t not in roots


@pytest.mark.parametrize("name", ["lines_before", "lines_dropped", "whole"])
def test_clashing_column_stays(spark, name):
    docs = spark.createDataFrame([(1, "a b", "mine")], f"doc_id bigint, text string, {name} string")
    row = line_templates.drop_recurring_lines(docs).first()
    assert row[name] == "mine" and len(row) == 5


def test_very_long_text(make_docs):
    long = "\n".join(f"{i} " + words(random.Random(i), 9) for i in range(6000))
    rows = [(1, long), (2, "short one\nsay hello to us"), (3, "another thing here\nsay hello to us"), (4, long + "\nsay hello to us")]
    got = dropped(make_docs(rows))
    assert got[1] == long and got[4] == long and got[2] == "short one"
