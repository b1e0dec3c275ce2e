"""Importance resampling against plain counts: weights, keys and the drawn rows."""

import math
import random
import re
import struct
from collections import Counter

import xxhash

from tabscope.llm import quality

M = (1 << 64) - 1


def mix(x):
    x = ((x ^ x >> 33) * 0xFF51AFD7ED558CCD) & M
    x = ((x ^ x >> 33) * 0xC4CEB9FE1A85EC53) & M
    return x ^ x >> 33


def spark_hash(number, doc_id, text=None):
    h = xxhash.xxh64_intdigest(struct.pack("<i", number), seed=42)
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=h)
    return xxhash.xxh64_intdigest(text.encode(), seed=h) if text is not None else h


def buckets(text):
    own = [xxhash.xxh64_intdigest(u) | 1 for u in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
    return [x % quality.BUCKETS for x in own + [mix((a * 0x9E3779B97F4A7C15 + b) & M) for a, b in zip(own, own[1:])]]


def plain(rows, labels, k=None):
    """``(id, text, weight, key)`` of the drawn rows."""
    raw, wanted = Counter(), Counter()
    for doc_id, text in rows:
        raw.update(buckets(text))
        if labels.get(doc_id) == 1 and not spark_hash(7, doc_id) & 1:
            wanted.update(buckets(text))
    n, m = sum(wanted.values()), sum(raw.values())

    def ratio(b):
        return math.log((wanted[b] + 1) / (n + quality.BUCKETS)) - math.log((raw[b] + 1) / (m + quality.BUCKETS)) if n else 0.0

    weights = [math.fsum(map(ratio, buckets(t))) / len(buckets(t)) if buckets(t) else 0.0 for _, t in rows]
    good = [w for (d, _), w in zip(rows, weights) if labels.get(d) == 1 and spark_hash(7, d) & 1]
    bad = [w for (d, _), w in zip(rows, weights) if labels.get(d) == 0]
    if k is None:
        k = len(rows)
        if good and bad:
            cut = max(sorted({*good, *bad}), key=lambda c: round(sum(w >= c for w in good) / len(good) - sum(w >= c for w in bad) / len(bad), 12))
            k = sum(w >= cut for w in weights)
    keys = [w / quality.TEMPERATURE - math.log(-math.log(((spark_hash(9, d, t) >> 11) + 0.5) / 2 ** 53)) for (d, t), w in zip(rows, weights)]
    least = sorted(keys, reverse=True)[k - 1] if k <= len(rows) else -math.inf
    return sorted(((d, t, round(w, 9), round(x, 5)) for (d, t), w, x in zip(rows, weights, keys) if x >= least), key=str)


def text(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", ".", "!!"]) for _ in range(n))


def test_weights_keys_and_draw(spark, make_docs):
    rng = random.Random(3)
    fine, poor = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(25)] + [f"good{i}" for i in range(15)]
    rows = [(i, text(rng, fine if i % 3 else poor, rng.randint(1, 40))) for i in range(240)]
    rows += [(300, None), (301, ""), (302, "good1"), (302, "good1"), (None, "good2 good3"), (303, text(rng, fine, 5000))]
    labels = {i: int(bool(i % 3)) for i in range(0, 240, 2)}
    table = spark.createDataFrame([*labels.items(), (2, 1), (None, 1), (999, 0), (1, None)], "doc_id bigint, quality int")
    docs = make_docs(rows)
    for k in (None, 11):
        want = plain(rows, labels, k)
        for got in (quality.resample(docs, table, k=k), quality.resample(docs, table, k=k, columns=("doc_id", "text"))):
            assert sorted(((r["doc_id"], r["text"], round(r["weight"], 9), round(r["weight_key"], 5)) for r in got.collect()), key=str) == want


def test_own_columns_of_that_name_stay(spark, make_docs):
    docs = make_docs([(1, "a b", 5.0), (2, "c", 6.0)], "doc_id bigint, text string, weight double")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.resample(docs, none).collect()
    assert {(r["doc_id"], r["weight"], r["weight_"]) for r in got} == {(1, 5.0, 0.0), (2, 6.0, 0.0)}


def test_labels_beyond_the_bound_are_left_out(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, text(rng, [f"w{i}" for i in range(30)], 20)) for i in range(60)]
    labels = {i: i % 2 for i in range(60)}
    used = sorted(labels, key=lambda i: (lambda h: h - (1 << 64) if h >> 63 else h)(spark_hash(8, i)))[:25]
    got = quality.resample(make_docs(rows), spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int"), labelled=25).collect()
    assert sorted(((r["doc_id"], r["text"], round(r["weight"], 9), round(r["weight_key"], 5)) for r in got), key=str) == plain(rows, {i: labels[i] for i in used})
