"""Exact repeated passages: fixed-block anchors, rolling probes, extension to maximal repeats.

A window is ``window`` consecutive words.  Any window of a document holds one whole block of that
document's grid of non-overlapping blocks of ``(window + 1) // 2`` words.  So:

1. *Index and probe.*  Every grid block is indexed and every rolling gram of block length probes
   the index.  A gram is an anchor if it is a grid block somewhere and occurs in two documents.
2. *Extend.*  Windows that hold an anchor are compared whole (64-bit hashes of all their words);
   windows whose words start earlier in a document with a smaller id are repeats, and runs of
   them are the maximal repeated spans.
3. *Cut.*  Spans are taken out of the text; what is left is joined by single spaces.

Grams travel as sorted key arrays per pack of documents (see ``common``), so a passage that a
third of all documents share still is one key per pack.  Anchor keys keep 44 bits: a chance match
only adds a window to step 2, which compares windows by 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common as C

LOW_BITS = np.uint64(20)
NO_ID = np.iinfo(np.int64).max


def _doc_order(pack: C.Pack) -> np.ndarray:
    """Ids to compare; a null id sorts last."""
    return np.array([NO_ID if d is None else d for d in pack.doc_ids], dtype=np.int64)


def anchor_probes(packs: DataFrame, block: int, shards: int) -> DataFrame:
    """Every pack's distinct rolling grams; mark 1: a grid block, mark 2: in two documents of the pack."""
    def probe(batches):
        for pack, _ in C.read_packs(batches):
            at = C.whole_grams(pack, block)
            keys = C.gram_hashes(pack.hashes()[pack.tokens], block)[at] >> LOW_BITS << LOW_BITS
            owner = pack.owners()[at]
            grid = (at - pack.starts[owner]) % block == 0
            order = np.argsort(keys, kind="stable")  # stable: owners rise within a key
            keys, owner, grid = keys[order], owner[order], grid[order]
            first, _ = C.runs(keys)
            if not len(first):
                continue
            last = np.append(first[1:], len(keys)) - 1
            marks = np.maximum.reduceat(grid, first) + 2 * (owner[first] != owner[last])
            yield pa.RecordBatch.from_pydict(C.key_slices(pack, keys[first], marks, shards), schema=C.PROBE_SCHEMA)

    return packs.mapInArrow(probe, C.PROBES)


def _answer(rows: pd.DataFrame, keys, source, chosen) -> pd.DataFrame:
    """The chosen keys of each pack."""
    order = np.lexsort((keys[chosen], source[chosen]))
    keys, source = keys[chosen][order], source[chosen][order]
    at = np.searchsorted(source, np.arange(len(rows) + 1))
    own = [i for i in range(len(rows)) if at[i + 1] > at[i]]
    return pd.DataFrame({"pack": pd.Series([rows["pack"].iat[i] for i in own], dtype=object), "shard": rows["shard"].iloc[own].to_list(),
                         "n": [int(at[i + 1] - at[i]) for i in own], "keys": [C.squeeze_sorted(keys[at[i]:at[i + 1]]) for i in own]})


ANSWERS = "pack string, shard int, n int, keys binary"


def anchors(probes: DataFrame) -> DataFrame:
    """For each pack, those of its grams that are a grid block somewhere and occur in two documents."""
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        keys, source, marks = C.gather_keys(rows)
        order = np.argsort(keys, kind="stable")
        first, run = C.runs(keys[order])
        seen = np.bitwise_or.reduceat(marks[order], first)
        many = np.diff(np.append(first, len(keys))) > 1
        good = (seen & 1).astype(bool) & (many | (seen >= 2))
        chosen = np.zeros(len(keys), dtype=bool)
        chosen[order] = good[run]
        return _answer(rows, keys, source, chosen)

    return probes.groupBy("shard").applyInPandas(settle, ANSWERS)


def _keys_of(answers) -> np.ndarray:
    if not answers:
        return np.zeros(0, dtype=np.uint64)
    return np.concatenate([C.unsqueeze_sorted(a["keys"], a["n"]) for a in answers])  # shards hold rising ranges


def _held(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


def window_probes(packs: DataFrame, block: int, window: int, shards: int) -> DataFrame:
    """Distinct windows that hold an anchor, each with its smallest document of the pack as mark."""
    def probe(batches):
        for pack, row in C.read_packs(batches):
            wanted = _keys_of(row["answers"])
            if not len(wanted):
                continue
            words = pack.hashes()[pack.tokens]
            hit = _held(C.gram_hashes(words, block) >> LOW_BITS << LOW_BITS, wanted)
            near = np.concatenate(([0], np.cumsum(hit)))
            at = C.whole_grams(pack, window)
            at = at[near[at + window - block + 1] > near[at]]
            if not len(at):
                continue
            keys, ids = C.gram_hashes(words, window)[at], _doc_order(pack)[pack.owners()[at]]
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            first, _ = C.runs(keys)
            least = np.minimum.reduceat(ids, first)
            shifted = (least.astype(np.uint64) ^ np.uint64(1 << 63))  # signed order as unsigned order
            base = shifted.min()
            rows = C.key_slices(pack, keys[first], shifted - base, shards)
            rows["base"] = [int(base) - (1 << 63)] * len(rows["shard"])
            yield pa.RecordBatch.from_pydict(rows, schema=C.PROBE_SCHEMA.append(pa.field("base", pa.int64())))

    return packs.mapInArrow(probe, C.PROBES + ", base bigint")


def repeats(probes: DataFrame) -> DataFrame:
    """For each pack, its windows that also start in a smaller document of another pack."""
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        keys, source, marks = C.gather_keys(rows)
        ids = marks + rows["base"].to_numpy().astype(np.uint64)[source]  # wraps around
        ids = ids.view(np.int64)
        order = np.argsort(keys, kind="stable")
        first, run = C.runs(keys[order])
        least = np.minimum.reduceat(ids[order], first)
        chosen = np.zeros(len(keys), dtype=bool)
        chosen[order] = least[run] < ids[order]
        return _answer(rows, keys, source, chosen)

    return probes.groupBy("shard").applyInPandas(settle, ANSWERS)


def cut_repeats(packs: DataFrame, window: int) -> DataFrame:
    """Per document: words, words removed, removed spans of word places, and the text kept."""
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                     ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.binary())])

    def cut(batches):
        for pack, row in C.read_packs(batches):
            keys = C.gram_hashes(pack.hashes()[pack.tokens], window)
            at, owner, ids = C.whole_grams(pack, window), pack.owners(), _doc_order(pack)
            gone = _held(keys[at], _keys_of(row["answers"])) & (ids[owner[at]] != NO_ID)
            order = np.argsort(keys[at], kind="stable")
            if len(order):  # repeats between documents of this pack
                first, run = C.runs(keys[at][order])
                least = np.minimum.reduceat(ids[owner[at]][order], first)
                gone[order] |= (least[run] < ids[owner[at]][order]) & (ids[owner[at]][order] != NO_ID)
            edge = np.zeros(len(pack.tokens) + 1, dtype=np.int64)
            np.add.at(edge, at[gone], 1)
            np.add.at(edge, at[gone] + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
            flat = np.concatenate(([0], np.cumsum(covered)))
            rows, held = [], 0
            for i, (lo, hi) in enumerate(zip(pack.starts, pack.ends)):
                mask = covered[lo:hi]
                turn = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                left = b" ".join([pack.vocab[t] for t in pack.tokens[lo:hi][~mask].tolist()])
                rows.append({"doc_id": pack.doc_ids[i], "n_words": int(hi - lo), "n_removed": int(flat[hi] - flat[lo]),
                             "spans": [{"first": int(a), "last": int(b) - 1} for a, b in zip(turn[::2], turn[1::2])], "kept": left})
                held += len(left)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    cut_rows = packs.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<first:bigint,last:bigint>>, kept binary")
    return cut_rows.withColumn("kept", F.col("kept").cast("string"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller id.

    Returns ``doc_id, n_words, n_removed, spans, kept``: one row per input row.  Null and empty
    texts have no words.  Rows of one id never remove each other's words; a row without an id
    loses nothing and takes nothing from others with an id.  An empty table gives no rows.  Other
    columns are not read.
    """
    spark, block = docs.sparkSession, (window + 1) // 2
    room = C.workroom(spark, "substrings")
    packs = C.stored(C.make_packs(docs, doc_id, text), f"{room}/packs")
    shards = C.shard_count(packs)
    hits = C.stored(anchors(anchor_probes(packs, block, shards)), f"{room}/anchors")
    again = window_probes(C.with_answers(packs, hits, "answers"), block, window, shards)
    later = C.stored(repeats(again), f"{room}/repeats")
    C.discard(spark, f"{room}/anchors")
    return cut_repeats(C.with_answers(packs, later, "answers"), window)
