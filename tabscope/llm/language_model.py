"""A bigram language model in Elias-Fano tries, trained on and scoring whole corpora.

*Model.*  ``p(w | u) = (c(u, w) + strength * p1(w)) / (c(u) + strength)``: counts of the training
text smoothed towards ``p1(w) = (c(w) + 1) / (N + V + 1)``, which leaves room for unknown words.
Every text begins after a start mark and closes with an end token.

*Trie.*  Seen contexts and, under each, its successors are two levels of growing word numbers.
Contexts, the pointers to their successor ranges and the successors (lifted by where the range
before ended, so that they grow along the whole level) are Elias-Fano sequences; each successor
has its smoothed probability in one byte.  Levels are plain buffers, unpacked whole for a lookup.  A lookup
finds the context, then searches the successor relative to the context's own range.

*Scale.*  The trie is cut into shards by context and a slice of the successor, so a frequent
context is spread too.  Neither counts nor tries are collected or broadcast: packs of documents
send their distinct words, then their distinct pairs, to the shards and get one answer for each
(see ``common``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common as C

START, END, FIRST = 0, 1, 2
STRENGTH = 200.0
#: Parts into which a context's successors are dealt.
PARTS = 16


# --- Elias-Fano -----------------------------------------------------------------------------------------

def ef_pack(values: np.ndarray) -> bytes:
    """Growing numbers: low bits side by side, high parts as gaps in unary."""
    values = np.asarray(values, dtype=np.int64)
    n, last = len(values), int(values[-1]) if len(values) else 0
    width = max(0, (last // n).bit_length() - 1) if n else 0
    low = np.packbits((values[:, None] >> np.arange(width) & 1).astype(np.uint8).ravel())
    high = np.zeros((last >> width) + n + 1, dtype=np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return np.array([n, width], dtype="<i8").tobytes() + low.tobytes() + np.packbits(high).tobytes()


def ef_open(raw: bytes) -> np.ndarray:
    """All numbers of a sequence, from its buffer."""
    n, width = np.frombuffer(raw, "<i8", 2).tolist()
    size = (n * width + 7) // 8
    low = np.unpackbits(np.frombuffer(raw, np.uint8, size, 16), count=n * width).reshape(n, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 + size)))[:n]
    return (ones - np.arange(n) << width) + low


def build_trie(context: np.ndarray, word: np.ndarray, log_p: np.ndarray) -> dict:
    """Levels of sorted distinct (context, word) pairs."""
    first, run = C.runs(context)
    ends = np.append(first[1:], len(word))
    lift = np.concatenate(([0], np.cumsum(word[ends - 1] + 1)[:-1]))
    low, high = (float(log_p.min()), float(log_p.max())) if len(log_p) else (0.0, 0.0)
    step = (high - low) / 254 or 1.0
    return {"contexts": ef_pack(context[first]), "pointers": ef_pack(np.append(first, len(word))), "successors": ef_pack(word + lift[run]),
            "codes": (np.rint((log_p - low) / step) + 1).astype(np.uint8).tobytes(), "low": low, "step": step}


def search_trie(trie: dict, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Code of each asked pair, 0 if it was never seen."""
    contexts, pointers, successors = (ef_open(trie[k]) for k in ("contexts", "pointers", "successors"))
    codes = np.frombuffer(trie["codes"], np.uint8)
    at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
    begin, end = pointers[at], pointers[at + 1]
    lift = np.where(begin > 0, successors[begin - 1] + 1, 0)
    found = np.searchsorted(successors, word + lift)
    hit = (contexts[at] == context) & (found >= begin) & (found < end)
    found = np.minimum(found, len(successors) - 1)
    return np.where(hit & (successors[found] == word + lift), codes[found], 0)


# --- words ----------------------------------------------------------------------------------------------

def word_probes(packs: DataFrame, shards: int) -> DataFrame:
    """Every pack's distinct words with their training counts."""
    def probe(batches):
        for pack, _ in C.read_packs(batches):
            if pack.vocab:
                keys = pack.hashes()
                counts = np.bincount(pack.tokens[np.repeat(pack.flags, pack.sizes)], minlength=len(keys))
                order = np.argsort(keys)
                yield pa.RecordBatch.from_pydict(C.key_slices(pack, keys[order], counts[order], shards), schema=C.PROBE_SCHEMA)

    return packs.mapInArrow(probe, C.PROBES)


def number_words(probes: DataFrame) -> DataFrame:
    """For each pack and shard: the words' numbers within the shard (0: not in training) and counts."""
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        keys, _, counts = C.gather_keys(rows)
        order = np.argsort(keys, kind="stable")
        first, run = C.runs(keys[order])
        total = np.add.reduceat(counts[order], first)
        number = np.cumsum(total > 0) * (total > 0)
        numbers, totals = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
        numbers[order], totals[order] = number[run], total[run]
        cuts = np.concatenate(([0], np.cumsum(rows["n"].to_numpy())))
        spans = list(zip(cuts[:-1], cuts[1:]))
        return pd.DataFrame({"pack": rows["pack"].astype(object), "shard": rows["shard"], "n": rows["n"],
                             "numbers": [C.squeeze(numbers[a:b]) for a, b in spans], "counts": [C.squeeze(totals[a:b]) for a, b in spans],
                             "shard_words": int(number.max()), "shard_total": int(total.sum())})

    return probes.groupBy("shard").applyInPandas(settle, "pack string, shard int, n int, numbers binary, counts binary, shard_words bigint, shard_total bigint")


class Numbered:
    """A pack with the corpus-wide number and count of its words; number -1: not in training."""

    def __init__(self, pack: C.Pack, answers: list[dict] | None, facts: dict):
        number, count = np.full(len(pack.vocab), -1, dtype=np.int64), np.zeros(len(pack.vocab), dtype=np.int64)
        at = 0
        order = np.argsort(pack.hashes()) if pack.vocab else []
        for part in answers or []:
            place = order[at:at + part["n"]]
            own = C.unsqueeze(part["numbers"], part["n"]).astype(np.int64)
            number[place] = np.where(own > 0, part["shard"] * facts["span"] + own - 1 + FIRST, -1)
            count[place] = C.unsqueeze(part["counts"], part["n"])
            at += part["n"]
        n_docs = len(pack.sizes)
        tokens, ends = number[pack.tokens], facts["train_docs"]
        self.owner = np.repeat(np.arange(n_docs), pack.sizes + 1)
        #: What is seen before each token, each token, and their counts; the end token closes a text.
        self.context = np.insert(tokens, pack.starts, START)
        self.word = np.insert(tokens, pack.ends, END if ends else -1)
        self.context_count = np.insert(count[pack.tokens], pack.starts, ends)
        self.word_count = np.insert(count[pack.tokens], pack.ends, ends)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Place of one token for each distinct pair of known words, sorted, and each token's pair (-1: none)."""
        known = np.flatnonzero((self.context >= 0) & (self.word >= 0))
        if len(known) and max(self.context.max(), self.word.max()) >> 32:
            raise ValueError("more than 2^32 words")
        keys = self.context[known] << 32 | self.word[known]
        order = np.argsort(keys, kind="stable")
        first, run = C.runs(keys[order])
        of = np.full(len(self.word), -1, dtype=np.int64)
        of[known[order]] = run
        return known[order][first] if len(first) else first, of

    def dealt(self, place: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by shard (pairs stay sorted), the shards that get some, and their cuts."""
        spread = C.mix((self.context[place] * PARTS + self.word[place] % PARTS).astype(np.uint64))
        shard = (spread >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        return order, np.flatnonzero(np.diff(cuts)), cuts


# --- pairs ----------------------------------------------------------------------------------------------

def pair_probes(packs: DataFrame, shards: int, facts: dict, training: bool) -> DataFrame:
    """Distinct pairs of each pack by shard: those of training texts with counts, or all to be looked up."""
    names = ("contexts", "words") + (("times", "context_counts", "word_counts") if training else ())
    schema = pa.schema([("shard", pa.int32()), ("pack", pa.string()), ("n", pa.int32()), *[(c, pa.binary()) for c in names]])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, row in C.read_packs(batches):
            text = Numbered(pack, row["answers"], facts)
            place, of = text.pairs()
            if not len(place):
                continue
            if training:
                times = np.bincount(of[(of >= 0) & np.repeat(pack.flags, pack.sizes + 1)], minlength=len(place))
                place, times = place[times > 0], times[times > 0]
            order, full, cuts = text.dealt(place, shards)
            place = place[order]
            columns = [text.context[place], text.word[place]] + ([times[order], text.context_count[place], text.word_count[place]] if training else [])
            packed = [[(C.squeeze_sorted if c == 0 else C.squeeze)(v[cuts[s]:cuts[s + 1]]) for s in full] for c, v in enumerate(columns)]
            yield pa.RecordBatch.from_pydict({"shard": full.tolist(), "pack": [pack.name] * len(full), "n": np.diff(cuts)[full].tolist(), **dict(zip(names, packed))}, schema=schema)

    return packs.mapInArrow(probe, "shard int, pack string, n int, " + ", ".join(f"{c} binary" for c in names))


def _column(rows: pd.DataFrame, name: str) -> np.ndarray:
    open_one = C.unsqueeze_sorted if name == "contexts" else C.unsqueeze
    return np.concatenate([open_one(v, n) for v, n in zip(rows[name], rows["n"])]).astype(np.int64)


TRIE = "shard int, n_pairs bigint, contexts binary, pointers binary, successors binary, codes binary, low double, step double"


def build_tries(probes: DataFrame, facts: dict, strength: float) -> DataFrame:
    """One trie row per shard."""
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        context, word = _column(rows, "contexts"), _column(rows, "words")
        order = np.lexsort((word, context))
        first, _ = C.runs(context[order] << 32 | word[order])
        one = order[first]
        times = np.add.reduceat(_column(rows, "times")[order], first)
        base = (_column(rows, "word_counts")[one] + 1) / facts["room"]
        log_p = np.log10((times + strength * base) / (_column(rows, "context_counts")[one] + strength))
        return pd.DataFrame([{"shard": rows["shard"].iat[0], "n_pairs": len(one), **build_trie(context[one], word[one], log_p)}])

    return probes.groupBy("shard").applyInPandas(build, TRIE)


def look_up(probes: DataFrame, tries: DataFrame) -> DataFrame:
    """Codes of every pack's pairs, from the shard's trie."""
    def answer(asked: pd.DataFrame, trie: pd.DataFrame) -> pd.DataFrame:
        if not len(trie) or not len(asked):
            return pd.DataFrame({"pack": pd.Series([], dtype=object), "shard": [], "n": [], "codes": pd.Series([], dtype=object), "low": [], "step": []})
        codes = search_trie(trie.iloc[0].to_dict(), _column(asked, "contexts"), _column(asked, "words")).astype(np.uint8)
        cuts = np.concatenate(([0], np.cumsum(asked["n"].to_numpy())))
        return pd.DataFrame({"pack": asked["pack"].astype(object), "shard": asked["shard"], "n": asked["n"],
                             "codes": [codes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], "low": trie["low"].iat[0], "step": trie["step"].iat[0]})

    return probes.groupBy("shard").cogroup(tries.groupBy("shard")).applyInPandas(answer, "pack string, shard int, n int, codes binary, low double, step double")


# --- scores ---------------------------------------------------------------------------------------------

_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scores(packs: DataFrame, shards: int, facts: dict, strength: float) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, row in C.read_packs(batches):
            text = Numbered(pack, row["answers"], facts)
            base = np.log10((text.word_count + 1) / facts["room"])
            log_p = np.log10(strength / (text.context_count + strength)) + base
            place, of = text.pairs()
            order, full, cuts = text.dealt(place, shards)
            seen = np.full(len(place), np.nan)
            for part in row["codes"] or []:
                codes = np.frombuffer(part["codes"], np.uint8).astype(float)
                own = order[cuts[part["shard"]]:cuts[part["shard"] + 1]]
                seen[own] = np.where(codes > 0, part["low"] + (codes - 1) * part["step"], np.nan)
            known = of >= 0
            hit = np.where(known, seen[of] if len(seen) else np.nan, np.nan)
            log_p = np.where(np.isnan(hit), log_p, hit)
            docs = len(pack.sizes)

            def total(values):
                return np.bincount(text.owner, weights=values, minlength=docs)

            yield pa.RecordBatch.from_arrays([
                pa.array(pack.doc_ids, pa.int64()), pa.array(~pack.flags), pa.array(pack.sizes + 1), pa.array(total(text.word_count > 0).astype(np.int64)),
                pa.array(np.full(docs, facts["train_tokens"], dtype=np.int64)), pa.array(total(base)), pa.array(total(log_p))], schema=_SCORES)

    return packs.mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def train_and_score(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", strength: float = STRENGTH) -> DataFrame:
    """Learn from the rows for which ``training`` holds (null: not) and score every row.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per
    input row; logarithms are decimal.  Null, empty and white-space texts are one end token.
    Repeated rows and null ids count and score as they stand.  Without training rows every token is
    unknown.  An empty table gives no rows; other columns are not read.
    """
    room = C.workroom(docs.sparkSession, "language-model")
    packs = C.stored(C.make_packs(docs, doc_id, text, training, lower=True), f"{room}/packs")
    words = C.stored(number_words(word_probes(packs, C.shard_count(packs, 0.5))), f"{room}/words")
    by_shard = words.groupBy("shard").agg(F.first("shard_words").alias("w"), F.first("shard_total").alias("t"))
    known, span, total = by_shard.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.max("w"), F.lit(1)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ends = packs.agg(F.sum(F.expr("aggregate(flags, 0L, (n, f) -> n + int(f))"))).first()[0] or 0
    facts = {"span": max(int(span), 1), "train_docs": int(ends), "train_tokens": int(total) + int(ends), "room": int(total) + int(ends) + int(known) + bool(ends) + 1}
    named = C.stored(C.with_answers(packs, words.drop("shard_words", "shard_total").select("pack", "shard", "n", "numbers", "counts"), "answers"), f"{room}/named")
    shards = C.shard_count(packs, 1.5)
    C.discard(docs.sparkSession, f"{room}/packs", f"{room}/words")
    tries = C.stored(build_tries(pair_probes(named, shards, facts, True), facts, strength), f"{room}/tries")
    codes = C.stored(look_up(pair_probes(named, shards, facts, False), tries), f"{room}/codes")
    return scores(C.with_answers(named, codes.drop("n"), "codes"), shards, facts, strength)
