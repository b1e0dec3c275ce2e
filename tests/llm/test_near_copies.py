"""Near copies against brute-force Jaccard over whole shingle sets."""

import random

import corpus_pipeline
from tabscope.llm import near_copies


def grams(text):
    words = (text or "").lower().split()
    size = min(5, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def close(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def brute(rows):
    """The smallest id of each component; rows are (id, text)."""
    sets = [grams(t) for _, t in rows]
    least = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if close(sets[i], sets[j])] for i in range(len(rows))]
    while True:
        new = [min((least[j] for j in near[i]), key=lambda j: rows[j][0]) for i in range(len(rows))]
        if new == least:
            return {rows[j][0] for j in least}
        least = new


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_stage_keeps_one_of_near_copies(spark):
    rng = random.Random(5)
    rows = []
    for family in range(40):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
        rows += [(len(rows) + i, t) for i, t in enumerate([base, *(edited(rng, base, rng.choice([1, 2, 2, 3, 6])) for _ in range(4))])]
    rows += [(1000, ""), (1001, " "), (1002, "two words"), (1003, "Two Words"), (1004, "two words more")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == brute(rows)


def test_a_chain_and_a_large_family(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    # Neighbours of the chain are close, its ends are not.
    chain = [(i, " ".join(base[3 * i:3 * i + 60])) for i in range(12)]
    core = " ".join(f"v{rng.randrange(5000)}" for _ in range(150))
    family = [(100 + i, edited(rng, core, 3)) for i in range(150)]
    rows = chain + family
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in got} == brute(rows)


def test_rows_without_ids(make_docs):
    text = " ".join(f"w{i}" for i in range(50))
    got = near_copies.keep_one(make_docs([(3, text), (None, text), (None, text + " end"), (4, "a b c"), (4, "d e f"), (4, "d e f"), (None, None), (7, "")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, text), (4, "a b c"), (4, "d e f"), (7, "")]
    assert all((r["_row"], r["row"]) == ("y", 1) for r in got)


def test_fingerprints_alone_link_close_copies(spark, monkeypatch):
    """Without any band, op1's Golay keys find the close copies."""
    rng = random.Random(7)
    rows = []
    for family in range(10):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
        rows += [(3 * family, base), (3 * family + 1, base + " one more"), (3 * family + 2, base + " " + base.split()[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_copies, "_led", lambda keys, turn, least: spark.createDataFrame([], "a bigint, b bigint"))
    monkeypatch.setattr(near_copies, "_crossed", lambda keys, sets, least: spark.createDataFrame([], "a bigint, b bigint"))
    assert {r["doc_id"] for r in near_copies.keep_one(docs).collect()} == {3 * f for f in range(10)} == brute(rows)


def test_a_member_meets_one_leader_a_turn(spark):
    keys = spark.createDataFrame([(k, p, 50, p) for k in range(25) for p in range(k, k + 40)], "key bigint, print bigint, n bigint, root bigint")
    led = near_copies._led(keys, 0, 0.8).collect()
    assert len(led) == len({r["b"] for r in led}) <= 64


def test_blocks_of_a_bucket_link_as_the_whole(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(near_copies, "PART", 300)
    core = [f"v{rng.randrange(5000)}" for _ in range(60)]
    rows = [(i, edited(rng, " ".join(core), rng.choice([1, 2, 4, 9]))) for i in range(60)]
    monkeypatch.setattr(near_copies, "_led", lambda keys, turn, least: spark.createDataFrame([], "a bigint, b bigint"))
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in got} == brute(rows)
