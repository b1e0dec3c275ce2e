"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits in three segments of 22, 21 and 21, each padded to a word of the perfect
binary Golay code [23, 12].  Every 23-bit word lies within 3 bits of exactly one of 4,096
codewords.  A segment's *own* key is that codeword's index; its *near* keys are the codewords of
all words within one bit: one key if the word lies within 2 bits of its codeword, six otherwise.
If two segments differ in one bit at most, the own key of either is among the near keys of the other.

Four differing bits over three segments leave, by pigeonhole, either a segment without difference
or two segments with one each.  So fingerprints meet under three exact keys (a whole segment), or
under two codeword indices: near keys of the first segment with the own key of the second on the
one side, own with near on the other.  Everything that meets is verified with the whole distance.

Distinct fingerprints are compared, never copies.  Buckets larger than ``BLOCK`` are cut into
blocks, and pairs of blocks become tasks of their own.  A bucket reports links that span its
groups, not all pairs in them; connected components over links then give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common as C
from tabscope.llm.components import components

SEED = 42
#: Shingles hashed at a time.
SLICE = 1 << 16
#: Fingerprints of a bucket compared in one task.
BLOCK = 1024
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011


# --- fingerprints -------------------------------------------------------------------------------------

def fingerprint(raw: bytes, size: int) -> int:
    """SimHash of a text's shingles of ``size`` words; 0 without words.  A-Z count as lower case."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(starts), SLICE):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[lo:lo + SLICE].tolist(), ends[lo:lo + SLICE].tolist())], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """``doc_id, print``: the fingerprint as a signed long, one row per document, without a shuffle."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or b"", size) for t in batch["text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints.view(np.int64))], schema=schema)

    return rows.mapInArrow(mark, "doc_id bigint, print bigint")


# --- keys -----------------------------------------------------------------------------------------------

def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator: zero for codewords."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << bit - 11), left)
    return left


class Golay:
    """Codeword index of every 23-bit word, by a table from remainders to error patterns."""

    def __init__(self):
        one = 1 << np.arange(23, dtype=np.int64)
        two = (one[:, None] | one)[np.triu_indices(23, 1)]
        three = np.unique(two[:, None] | one)
        patterns = np.concatenate(([0], one, two, three[np.bitwise_count(three) == 3]))
        self.errors = np.zeros(2048, dtype=np.int64)
        self.errors[_remainders(patterns)] = patterns
        self.low = _remainders(np.arange(1 << 12))
        self.high = _remainders(np.arange(1 << 11) << 12)

    def index(self, words: np.ndarray) -> np.ndarray:
        """Upper 12 bits of the nearest codeword."""
        return (words ^ self.errors[self.low[words & 0xFFF] ^ self.high[words >> 12]]) >> 11

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word, index) for the distinct codewords of all words within one bit."""
        around = words[:, None] ^ np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
        found = np.sort(self.index(around), axis=1)
        keep = np.ones(found.shape, dtype=bool)
        keep[:, 1:] = found[:, 1:] != found[:, :-1]
        place, column = np.nonzero(keep)
        return place, found[place, column]


def _keys(prints: np.ndarray, golay: Golay) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(keys, places in ``prints``, side): side 0 meets side 1 of the same key; side 2 meets itself.
    The top bits of a key say which segments it is of."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [golay.index(p) for p in parts]
    near = [golay.near(p) for p in parts]
    everyone = np.arange(len(prints))
    for i, part in enumerate(parts):
        yield part | i << 32, everyone, 2
    for t, (i, j) in enumerate(PAIRS):
        (place, key), (other, last) = near[i], near[j]
        yield key << 12 | own[j][place] | (3 + t) << 32, place, 0
        yield own[i][other] << 12 | last | (3 + t) << 32, other, 1


def meeting_keys(prints: DataFrame) -> DataFrame:
    """``key, side, print``: all keys of distinct fingerprints."""
    schema = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("print", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            values = batch["print"].to_numpy(zero_copy_only=False)
            for keys, places, side in _keys(values.view(np.uint64), golay):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), side, dtype=np.int32)), pa.array(values[places])], schema=schema)

    return prints.select("print").mapInArrow(spread, "key bigint, side int, print bigint")


# --- links ----------------------------------------------------------------------------------------------

def _spanning(left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links within ``most`` bits between two lists, fewest that connect what they connect."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for lo in range(0, len(left), 256):
        a, b = np.nonzero(np.bitwise_count(left[lo:lo + 256, None] ^ right) <= most)
        for x, y in zip(left[lo + a].tolist(), right[b].tolist()):
            if x != y and (p := find(x)) != (q := find(y)):
                root[p] = q
                out.append((x, y))
    return out


def links(keys: DataFrame, most: int, room: str) -> DataFrame:
    """``a, b``: links that connect all fingerprints within ``most`` bits of each other."""
    keys = C.stored(keys, f"{room}/keys")
    hot = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    dealt = keys.join(hot, "key", "left").withColumn("cuts", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    # A fingerprint of block i goes to the block pairs (0..i, i) and (i, i..): every two blocks meet once.
    mine = F.pmod(F.xxhash64("print"), F.col("cuts")).cast("int")
    dealt = (dealt.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
             .select("key", F.least("mine", "with").alias("p"), F.greatest("mine", "with").alias("q"), (F.col("mine") <= F.col("with")).alias("first"), "side", "print"))
    parts = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(pd.DataFrame({c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}))
            rows = pd.concat(held, ignore_index=True)
            same = rows["key"].to_numpy(), rows["p"].to_numpy(), rows["q"].to_numpy()
            new = np.flatnonzero(np.logical_or.reduce([s[1:] != s[:-1] for s in same])) + 1
            cut = int(new[-1]) if len(new) else 0  # the last bucket may go on
            yield _compare(rows.iloc[:cut], np.concatenate(([0], new))) if cut else pa.RecordBatch.from_pylist([], schema=schema)
            held = [rows.iloc[cut:]]
        if held and len(held[0]):
            yield _compare(held[0], np.array([0, len(held[0])]))

    def _compare(rows: pd.DataFrame, cuts: np.ndarray) -> pa.RecordBatch:
        prints = rows["print"].to_numpy().view(np.uint64)
        side, first = rows["side"].to_numpy(), rows["first"].to_numpy().astype(bool)
        edge = rows["p"].to_numpy() == rows["q"].to_numpy()
        out = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi - lo < 2:
                continue
            values, s, f = prints[lo:hi], side[lo:hi], first[lo:hi]
            if s[0] == 2:  # a whole segment
                out += _spanning(values, values, most) if edge[lo] else _spanning(values[f], values[~f], most)
            elif edge[lo]:
                out += _spanning(values[s == 0], values[s == 1], most)
            else:  # two blocks: near keys of either meet own keys of the other
                out += _spanning(values[(s == 0) & f], values[(s == 1) & ~f], most) + _spanning(values[(s == 1) & f], values[(s == 0) & ~f], most)
        ends = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], schema=schema)

    return parts.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, most: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id, print``: one row per input row.

    Documents are linked at ``most`` (0 to 4) or fewer differing bits; ``component_id`` is the
    smallest id reachable.  Null, empty and white-space texts have fingerprint zero and are linked
    like any other.  A row without an id is in its class but never names it; a class of such rows
    only has a null id.  Repeated rows stay.  An empty table gives no rows; other columns are not read.
    """
    if not 0 <= most <= 4:
        raise ValueError("keys are laid out for at most 4 differing bits")
    room = C.workroom(docs.sparkSession, "simhash")
    marked = C.stored(fingerprints(docs, doc_id, text, size), f"{room}/prints")
    classes = C.stored(marked.groupBy("print").agg(F.min("doc_id").alias("least")), f"{room}/classes")
    found = C.stored(links(meeting_keys(classes), most, room).distinct(), f"{room}/links")
    C.discard(docs.sparkSession, f"{room}/keys")
    roots = components(found, room).select(F.col("node").alias("print"), "root")
    rooted = classes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = C.stored(rooted.join(lowest, "root").select("print", "component_id"), f"{room}/named")
    return marked.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "print")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, most: int = 4) -> DataFrame:
    """The documents of ``docs`` whose id names their class.  Of rows repeating that id all stay
    but exact repeats of the text; rows without an id stay only in classes without one."""
    kept = C.fresh(docs, "_kept")
    found = near_duplicates(docs, doc_id, text, size, most).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(found, F.col(doc_id).cast("bigint").eqNullSafe(F.col(kept)), "left_semi").dropDuplicates([doc_id, text])
