"""Every operator against brute force, an exact round trip or held-out accuracy, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabscope.llm import bpe, common, contamination, language_model, licenses, line_templates, neighbours, quality, simhash, substrings, warc
from tabscope.llm.components import components

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocab=300):
    return " ".join(f"w{int(min(vocab, rng.paretovariate(0.7)))}" for _ in range(n))


def letters(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 120)) for _ in range(60)]
    for i in range(20):  # copies, near copies and shared passages
        words = texts[i].split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        texts += [texts[i], " ".join(words), prose(rng, 20) + " " + " ".join(words[:30]) + "\n" + prose(rng, 9)]
    texts += [None, "", "  \n\t ", "ONE", "one", "É é", prose(rng, 5000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_simhash_equals_brute_force(spark, make_docs, corpus):
    rows = sorted(corpus)
    def mark(text):
        w = WORD.findall(lower(text))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    prints = np.array([mark(t) for _, t in rows], dtype=np.uint64)
    root = roots(len(rows), zip(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints) <= 4)))
    want = {(d, f"{int(p):016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, root)}
    got = simhash.near_duplicates(make_docs(corpus)).select("doc_id", "fingerprint", "component_id").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    kept = simhash.keep_one(make_docs(corpus)).collect()
    assert {r["doc_id"] for r in kept} == {r for _, _, r in want}


@pytest.mark.parametrize("block", [1024, 16])
def test_simhash_links_find_every_pair_within_four_bits(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = [base]
    for flips in (1, 2, 3, 4, 5):
        f = base.copy()
        for _ in range(flips):
            f ^= np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64)
        near.append(f)
    prints = np.unique(np.concatenate([*near, base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print bigint")
    found = [tuple(r) for r in simhash.links(simhash.meeting_keys(frame), 4, common.workroom(spark, "test")).collect()]
    place = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    assert roots(len(prints), [(place[a], place[b]) for a, b in found]) == roots(len(prints), zip(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints) <= 4)))


def test_golay_code_is_perfect():
    golay = simhash.Golay()
    assert np.bincount(golay.index(np.arange(1 << 23)), minlength=4096).tolist() == [2048] * 4096


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(frame, common.workroom(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_archives_round_trip_and_resolve(spark, make_docs):
    long = "<p>é\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n" + "x" * 1200
    rows = [(1, "http://a\r\nb", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (2, "u", long), (7, "u", "y" * 999 + "é")]
    got = warc.deduplicate(make_docs(rows, "page_id bigint, url string, html string"))
    got = sorted(got.collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["record_type"]))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [
        (1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None),
        (7, "response", None), (None, "revisit", 2)]
    payload = {r["page_id"]: r for r in got if r["record_type"] == "response"}
    assert payload[2]["payload"] == long and payload[5]["payload"] == "" and payload[7]["payload_bytes"] == 1001
    assert all(r["payload_digest"] == hashlib.sha1((dict((a, c) for a, _, c in rows)[r["page_id"]] or "").encode()).hexdigest() for r in got)


def test_licenses_equal_all_windows(spark, make_docs):
    rng = random.Random(4)
    names = list(licenses.TEMPLATES)
    rows = [(i, prose(rng, 30) + "\n" + licenses.TEMPLATES[n] + "\n" + prose(rng, 10)) for i, n in enumerate(names)]
    rows.append((50, prose(rng, 8) + " this work IS licensed under the GNU Lesser Public License, version 3 " + prose(rng, 5)))
    rows += [(51, prose(rng, 200)), (52, None), (53, ""), (None, "Released under the MIT license")]
    got = licenses.scan_licenses(make_docs(rows)).collect()
    by_doc = {r["doc_id"]: r for r in got}
    assert len(got) == len(names) + 2 and all(by_doc[i]["license"] == n and by_doc[i]["edits"] == 0 for i, n in enumerate(names))
    # "Lesser" makes it another license, whatever else is missing.
    assert by_doc[50]["license"] == "LGPL-3.0 notice" and by_doc[50]["changes"] == ["- general"] and by_doc[50]["first_word"] == 8
    # Every window of every length: a document has a notice exactly if some window is near some template.
    for d, text in rows:
        words = licenses.words_of(text or "")[0]
        near = any(licenses.wording(t, words)[0] <= int(licenses.RATE * len(t)) for t in (licenses.words_of(v)[0] for v in licenses.TEMPLATES.values()))
        assert near == (d in by_doc)


@pytest.mark.parametrize("text, license", [
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0 notice"),
    ("this work is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0 notice"),
    ("this work is licensed under the GNU General Public License, version 1", "GPL-2.0 notice (unknown variant)"),
    ("this work is licensed under the GNU Lesser General Public License, version 2.1", "LGPL-3.0 notice (unknown variant)"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.", "CC-BY-SA-4.0 (unknown variant)"),
    ("This work is licenced under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0")])
def test_words_that_tell_licenses_apart(text, license):
    found = licenses.Templates(licenses.TEMPLATES, licenses.RATE, 3).scan("some words before. " + text + " and some words after it")
    assert [r["license"] for r in found] == [license]


def test_wording_counts_edits():
    def edits(a, b):  # plain table, any part of b
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)
    rng = random.Random(5)
    for _ in range(200):
        a, b = [rng.choice("abc") for _ in range(rng.randint(1, 8))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        cost, first, end, changes = licenses.wording(a, b)
        assert cost == edits(a, b) == len(changes) and 0 <= first <= end <= len(b)
        assert contamination.myers("".join(a), "".join(b))[0] == cost


def test_quality_parts_held_out_labels(spark, make_docs):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(20, 200)) if i % 5 else " ".join(f"W{rng.randint(1, 999)}!!" for _ in range(80))) for i in range(600)]
    rows += [(None, None), (900, ""), (901, prose(rng, 3000))]
    labels = spark.createDataFrame([(i, int(bool(i % 5)), 0) for i in range(0, 600, 2)] + [(None, 1, 0), (5000, 0, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.resample(make_docs(rows), labels).collect()}
    held_out = range(1, 600, 2)
    assert sum(i in kept for i in held_out if i % 5) >= 235 and sum(i in kept for i in held_out if not i % 5) <= 2
    assert kept == {r["doc_id"] for r in quality.resample(make_docs(rows), labels, columns=("doc_id",)).collect()}
    assert quality.resample(make_docs(rows), labels.limit(0)).count() == len(rows)
    assert quality.resample(make_docs(rows), labels, k=17).count() == 17


def test_kth_largest(spark):
    values = [random.Random(8).gauss(0, 1) for _ in range(9000)] + [0.5] * 6000
    frame = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 4000, 8000, 14999):
        assert quality.kth_largest(frame, k) == sorted(values, reverse=True)[k - 1]


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 24))
    data = [(int(i), (centres[i % 12] + 0.8 * rng.standard_normal(24)).tolist()) for i in range(3000)]
    data += [(3000 + i, data[7][1]) for i in range(400)]  # one very common vector
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0, None] * 12), (5200, [1.0]), (None, data[0][1])]
    frame = spark.createDataFrame([(*r, 1) for r in data + odd], "vec_id bigint, embedding array<double>, q int")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([v for _, v in data])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    ids = np.array([i for i, _ in data])
    hits = total = 0
    for q in range(0, 3400, 50):
        score = np.round((x * x[q]).sum(axis=1), 12)
        score[q] = -2
        best = ids[np.lexsort((ids, -score))[:5]]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(s - score[v]) < 1e-9 for _, v, s in mine)
        hits, total = hits + len(set(best) & {v for _, v, _ in mine}), total + 5
    assert hits / total >= 0.97 and set(got) == set(range(0, 3400, 50))
    few = neighbours.nearest(frame.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert {r["vec_id"] for r in few} == {1, 2}
    assert neighbours.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_passages_equal_brute_force(spark, make_docs):
    rng = random.Random(10)
    items = [(i, prose(rng, 30) if i < 8 else [None, "", "Ab"][i - 8]) for i in range(11)]
    rows = []
    for d in range(40):
        text = list(items[d % 8][1])
        for _ in range(d // 8 * 2):
            at = rng.randrange(len(text))
            text[at:at + 1] = rng.choice(["", "q", text[at] + "z"])
        rows.append((d, prose(rng, 20) + " \n" + "".join(text).upper() + "-- " + prose(rng, 20)))
    rows += [(50, None), (51, ""), (52, prose(rng, 3000)), (None, items[0][1])]
    frame = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")

    def edits(a, b):
        row = np.zeros(len(b) + 1, dtype=int)
        codes = np.array([ord(c) for c in b])
        for i, x in enumerate(a, 1):
            new = np.concatenate(([i], np.minimum(row[:-1] + (codes != ord(x)), row[1:] + 1)))
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        return int(row.min())
    want = set()
    for d, text in rows:
        for i, item in items:
            a, b = contamination.plain(item or ""), contamination.plain(text or "")
            if a and b and (e := edits(a, b)) <= int(contamination.RATE * len(a)):
                want.add((d, i, e))
    got = contamination.find_passages(make_docs(rows), frame).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == want and len(got) == len(want)
    clean = contamination.without_passages(make_docs(rows), frame).collect()
    assert {r["doc_id"] for r in clean} == {d for d, _ in rows} - {d for d, _, _ in want}


@pytest.mark.parametrize("small", [False, True])
def test_language_model_equals_plain_counts(spark, make_docs, corpus, monkeypatch, small):
    if small:  # many packs and shards
        monkeypatch.setattr(common, "PACK_TOKENS", 300)
        monkeypatch.setattr(common, "SHARD_KEYS", 500)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in corpus}
    words = {d: WORD.findall(lower(t)) for d, t in corpus}
    one, two, ends = Counter(), Counter(), 0
    for d, w in words.items():
        if not held[d]:
            one.update(w)
            ends += 1
            two.update(zip(["<s>", *w], [*w, "</s>"]))
    n, v, k = sum(one.values()) + ends, len(one) + 1, language_model.STRENGTH

    def count(w):
        return ends if w in ("<s>", "</s>") else one[w]
    got = language_model.train_and_score(make_docs(corpus), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()
    assert len(got) == len(corpus)
    for r in got:
        w = words[r["doc_id"]]
        base = [(count(x) + 1) / (n + v + 1) for x in [*w, "</s>"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w) + 1, sum(one[x] > 0 for x in w) + 1, n)
        assert math.isclose(r["base_score"], sum(map(math.log10, base)), rel_tol=1e-9)
        exact = sum(math.log10((two[u, x] + k * p) / (count(u) + k)) for u, x, p in zip(["<s>", *w], [*w, "</s>"], base))
        assert abs(r["score"] - exact) <= 0.02 * (len(w) + 1)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_without_training(spark, make_docs):
    got = language_model.train_and_score(make_docs([(1, "a b"), (None, None)]), F.lit(False)).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(3, 0, 0), (1, 0, 0)}


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, dtype=int), np.array([0]), np.array([5, 5, 5]), np.sort(rng.integers(0, 1 << 40, 1000)), np.arange(100)):
        assert language_model.ef_open(language_model.ef_pack(values)).tolist() == values.tolist()


@pytest.mark.parametrize("small", [False, True])
def test_passage_dedup_equals_brute_force(spark, make_docs, corpus, monkeypatch, small):
    if small:
        monkeypatch.setattr(common, "PACK_TOKENS", 200)
        monkeypatch.setattr(common, "SHARD_KEYS", 300)
    words = {d: WORD.findall(t or "") for d, t in corpus}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i:i + 13]), d)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(make_docs(corpus)).collect()}
    assert len(got) == len(corpus) and sum(r["n_removed"] for r in got.values()) > 0
    for d, w in words.items():
        gone = {p for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < d for p in range(i, i + 13)}
        assert got[d]["n_words"] == len(w) and got[d]["n_removed"] == len(gone)
        assert got[d]["kept"] == " ".join(x for p, x in enumerate(w) if p not in gone)
        assert {p for s in got[d]["spans"] for p in range(s["first"], s["last"] + 1)} == gone


def test_passage_dedup_of_rows_without_id(spark, make_docs):
    text = " ".join(f"t{i}" for i in range(20))
    got = substrings.remove_repeats(make_docs([(None, text), (None, text), (3, text), (3, text), (5, text)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, 0), (3, 0), (3, 0), (5, 20)]


def test_line_templates(spark, make_docs):
    rng = random.Random(11)
    rows = []
    for d in range(12):
        rows.append((d, "\n".join([letters(rng, 12) + f" unique{d}", f"Page {d} of 12 at example", "Share this with friends now", "", letters(rng, 6) + f" end{d}", f"{d} {d + 1} {d + 2}"])))
    copy = "\n".join(letters(rng, 15) for _ in range(3))
    rows += [(20 + i, copy) for i in range(6)] + [(40, None), (41, ""), (42, " \n "), (None, "Share this with friends now\nalone")]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[d]["lines_dropped"] == 2 and "Page" not in got[d]["text"] and "Share" not in got[d]["text"] and f"unique{d}" in got[d]["text"] and f"{d} {d + 1} {d + 2}" in got[d]["text"] for d in range(12))
    assert all((r["_row"], r["row"]) == ("y", 1) for r in got.values())
    assert all(got[20 + i]["text"] == copy for i in range(6))
    assert got[40]["text"] is None and got[41]["text"] == "" and got[42]["text"] == " \n " and got[None]["text"] == "alone"
    assert (got[40]["lines_before"], got[41]["lines_before"]) == (0, 1)


def test_bpe_equals_the_library(spark, make_docs):
    whole = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(12)
    pool = ["it's", "don't", "we'LL", "İstanbul", "ΣΑΣ", "é", "<|endoftext|>", "a<|startoftext|>b", "\x85", "\x1c", "\xa0", "中文字", "ﬁ", "😀😀", "١٢", "½", "Straße", "_x_", "K", "</w>", "¡µº", "\n"]
    texts = ["".join(rng.choice([*pool, " ", "".join(rng.choices("abcdefghÄéñ'.-9", k=rng.randint(1, 9)))]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [*enumerate(texts), (500, None), (501, ""), (None, " \t"), (7, texts[7]), (502, "word " * 30000)]
    got = bpe.encode_documents(make_docs(rows), VOCABULARY).collect()
    want = []
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want.append((d, np.array(ids, dtype="<u4").tobytes(), whole.decode(ids, skip_special_tokens=False)))
    key = repr
    assert sorted(((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got), key=key) == sorted(want, key=key)


def test_bpe_cuts_long_texts_at_spaces(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 7)
    encoder = bpe.Encoder(bpe.Vocabulary(open(VOCABULARY, encoding="utf-8").read()))
    text = "some long words, anticonstitutionally split"
    assert encoder.encode_long(text) == b"".join(encoder.encode([text]))


def test_empty_tables(spark, make_docs):
    none = make_docs([])
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert warc.deduplicate(make_docs([], "page_id bigint, url string, html string")).count() == 0
    assert licenses.scan_licenses(none).count() == 0 and quality.resample(none, labels).count() == 0
    assert contamination.find_passages(none, items).count() == 0 and contamination.without_passages(make_docs([(1, "a")]), items).count() == 1
    assert language_model.train_and_score(none, F.lit(True)).count() == 0 and substrings.remove_repeats(none).count() == 0
    assert line_templates.drop_recurring_lines(none).count() == 0 and bpe.encode_documents(none, VOCABULARY).count() == 0
