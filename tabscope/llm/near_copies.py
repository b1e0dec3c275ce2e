"""Near copies by exact Jaccard similarity of word shingles.

Candidates come from two sources.  SimHash fingerprints meet under op1's Golay keys (``simhash``): texts
whose fingerprints differ in at most 4 bits, mostly close copies.  At a similarity of 0.8 two
fingerprints of 64 bits differ in about ten, so MinHash bands propose what they miss: 25 bands of 4
values miss a pair of 0.8 with a probability of 2e-6, and closer pairs less often.  Every pair is
verified on its whole shingle sets (64-bit hashes of five words).

Texts with equal shingle sets are one *class* from the start, so copies are never compared.  A class
is first verified against its fingerprint's links and one leader of its buckets, then against another
leader: a few pairs per class, however large its family.  Members of a bucket that are then still in different
components are compared inside tasks, block by block, and only links that connect components come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common as C
from tabscope.llm import simhash
from tabscope.llm.components import components

BANDS, ROWS = 25, 4
#: Shingles whose MinHash values are computed at a time.
SLICE = 1 << 13
#: Parts of the rows of one bucket, so that a large family is not one task's work.
SALTS = 16
#: Pairs of one leader in one part.
FAN = 64
#: Differing bits at which fingerprints propose a pair.
BITS = 4
#: Shingles of one side of a block of a bucket: 16 MB.
PART = 1 << 21
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_BAND = C.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


class _Hashes(dict):
    """Hash of each word met, computed once."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(raw: bytes, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words each; a shorter text is one shingle.  A-Z count as lower case."""
    words = raw.lower().split()
    numbers = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    return np.unique(C.gram_hashes(numbers, size)[:len(words) - size + 1]) if size else numbers


def band_keys(values: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(values), SLICE):
        least = np.minimum(least, ((values[lo:lo + SLICE] ^ _MASKS) * _TIMES).min(axis=1))
    keys = _BAND.copy()
    for row in C.mix(least).reshape(BANDS, ROWS).T:
        keys = C.mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("content"), F.col(text).cast("binary").alias("text"))


def _sketches(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``doc_id, content, print, n, bands, bits`` of every row: ``print`` is the hash of the shingle set, ``bits`` the SimHash."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.int64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            if len(hashes) > 1 << 20:
                hashes = _Hashes()
            sets = [shingles(t.as_py() or b"", size, hashes) for t in batch["text"]]
            prints = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64))
            bands = pa.array([band_keys(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            bits = pa.array(np.array([simhash.fingerprint(t.as_py() or b"", size) for t in batch["text"]], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["content"], prints, pa.array([len(s) for s in sets], pa.int64()), bands, bits], schema=schema)

    return _named(docs, doc_id, text).mapInArrow(mark, "doc_id bigint, content bigint, print bigint, n bigint, bands array<bigint>, bits bigint")


def _sets(docs: DataFrame, doc_id: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """``print, n, held``: shingle sets of the classes in ``wanted``, from the row that stands for each."""
    schema = pa.schema([("print", pa.int64()), ("n", pa.int64()), ("held", pa.binary())])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            if len(hashes) > 1 << 20:
                hashes = _Hashes()
            sets = [shingles(t.as_py() or b"", size, hashes) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["print"], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    rows = _named(docs, doc_id, text).withColumnRenamed("doc_id", "_id").withColumnRenamed("content", "_content")
    rows = rows.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_content") == F.col("content"))).select("print", "text")
    return rows.mapInArrow(hold, "print bigint, n bigint, held binary").dropDuplicates(["print"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose sets have a Jaccard similarity of ``least`` or more."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("parts"))
    left = sets.select(F.col("print").alias("a"), F.col("held").alias("of_a")).join(many, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    whole = dealt.join(sets.select(F.col("print").alias("b"), F.col("held").alias("of_b")), "b").join(left.hint("merge"), ["a", "part"]).select("a", "b", "of_a", "of_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["of_a"], batch["of_b"]):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], schema=schema).filter(pa.array(keep, pa.bool_()))

    return whole.mapInArrow(judge, "a bigint, b bigint")


def _alike(least: float):
    """Sizes that allow the similarity: the smaller set may be the other's subset at best."""
    return F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - 1e-9


def _fingerprinted(marked: DataFrame, room: str) -> DataFrame:
    """``a, b``: classes whose fingerprints op1's Golay keys link, each fingerprint standing for its classes
    by the least of them."""
    stand = C.stored(marked.filter("n > 0").groupBy("bits").agg(F.min("print").alias("print")), f"{room}/stand")
    linked = C.stored(simhash.links(simhash.meeting_keys(stand.select(F.col("bits").alias("print"))), BITS, room).distinct(), f"{room}/links")
    C.discard(marked.sparkSession, f"{room}/keys")
    ends = [stand.select(F.col("bits").alias(f"{c}_bits"), F.col("print").alias(c)) for c in ("a", "b")]
    between = linked.select(F.col("a").alias("a_bits"), F.col("b").alias("b_bits")).join(ends[0], "a_bits").join(ends[1], "b_bits").select("a", "b")
    same = marked.filter("n > 0").select("bits", F.col("print").alias("b")).join(stand, "bits").select(F.col("print").alias("a"), "b").filter("a <> b")
    return C.stored(between.unionByName(same), f"{room}/pairs")


def _led(keys: DataFrame, turn: int, least: float) -> DataFrame:
    """``a, b``: each member with one leader of its buckets, of those whose roots differ from its own.

    The rank doesn't depend on the bucket: the buckets of a family mostly choose the same leader."""
    rank = F.struct(F.xxhash64("print", F.lit(turn)).alias("r"), F.col("print").alias("a"), F.col("n").alias("m"), F.col("root").alias("over"))
    leaders = keys.groupBy("key").agg(F.min(rank).alias("x"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", "x.r", "x.a", "x.m", "x.over")
    spread = leaders.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    met = keys.withColumn("_salt", F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int")).join(spread, ["key", "_salt"])
    return met.filter(F.col("root") != F.col("over")).filter(_alike(least)).groupBy(F.col("print").alias("b")).agg(F.min_by("a", "r").alias("a")).select("a", "b")


def _crossed(keys: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``a, b``: links between all members of a bucket whose roots differ, as many as connect the roots.

    A bucket of much text is cut into blocks; every two blocks meet in a task of their own, so a task
    holds two blocks' sets whatever the bucket's size.  The comparisons of a bucket grow with the
    square of its components."""
    mixed = keys.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.sum("n") / PART).cast("int").alias("cuts")).filter("lo <> hi").select("key", "cuts")
    mine = F.pmod(F.xxhash64("print"), F.col("cuts")).cast("int")
    dealt = (keys.join(mixed, "key").withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
             .select("key", F.least("mine", "with").alias("p"), F.greatest("mine", "with").alias("q"), (F.col("mine") <= F.col("with")).alias("first"), "print", "root"))
    whole = dealt.join(sets.select("print", "held"), "print").select("key", "p", "q", "first", "print", "root", "held")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for *key, first, name, root, raw in zip(*(batch[c].to_pylist() for c in batch.schema.names)):
                if key != now and held:
                    yield _linked(held, now[1] == now[2], least, schema)
                    held = []
                now = key
                held.append((first, name, root, np.frombuffer(raw, np.uint64)))
        if held:
            yield _linked(held, now[1] == now[2], least, schema)

    return whole.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(compare, "a bigint, b bigint").distinct()


def _linked(rows: list[tuple], whole: bool, least: float, schema: pa.Schema) -> pa.RecordBatch:
    """Links within one block (``whole``) or between two that connect all roots they can."""
    up: dict[int, int] = {}

    def find(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    roots, sizes = np.array([r[2] for r in rows]), np.array([len(r[3]) for r in rows])
    side = np.array([r[0] for r in rows])
    left, right = (np.arange(len(rows)),) * 2 if whole else (np.flatnonzero(side), np.flatnonzero(~side))
    out = []
    for lo in range(0, len(left), 256):
        x = left[lo:lo + 256, None]
        fit = (roots[x] != roots[right]) & (np.minimum(sizes[x], sizes[right]) >= least * np.maximum(sizes[x], sizes[right]) - 1e-9)
        if whole:
            fit &= x < right
        for i, j in zip(*(at.tolist() for at in np.nonzero(fit))):
            (_, a, p, mine), (_, b, q, other) = rows[left[lo + i]], rows[right[j]]
            if (p := find(p)) != (q := find(q)):
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if both >= least * (len(mine) + len(other) - both) - 1e-9:
                    up[p] = q
                    out.append((a, b))
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], schema=schema)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one text of each component of near copies: the one with the smallest id.

    Texts are linked at a Jaccard similarity of ``least`` (0.8 or more) or above over shingles of
    ``size`` words; texts without words are copies of each other.  Rows without an id come last in
    their component.  Repeated rows of the same id and text stay once; rows repeating an id with
    another text are judged by their own text.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("the bands are laid out for a similarity of at least 0.8")
    spark, room = docs.sparkSession, C.workroom(docs.sparkSession, "copies")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    marked = C.stored(_sketches(docs, doc_id, text, size).groupBy("print").agg(F.min(first).alias("first"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("bits").alias("bits")), f"{room}/classes")
    close = _fingerprinted(marked, f"{room}/golay")
    keys = marked.select(F.explode("bands").alias("key"), "print", "n")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")).hint("merge")
    keys = C.stored(keys.withColumn("_salt", F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int")).join(shared, ["key", "_salt"]).drop("_salt"), f"{room}/keys")
    wanted = marked.select("print", "first.doc_id", "first.content").join(keys.select("print").unionByName(close.select(F.explode(F.array("a", "b")).alias("print"))).distinct(), "print")
    sets = C.stored(_sets(docs, doc_id, text, size, wanted), f"{room}/sets")
    found = spark.createDataFrame([], "a bigint, b bigint")
    rooted = keys.withColumn("root", F.col("print"))
    for turn in range(3):
        if turn < 2:
            pairs = _led(rooted, turn, least)
            pairs = C.stored(pairs if turn else pairs.unionByName(close).distinct(), f"{room}/pairs{turn}")
            if turn and pairs.isEmpty():
                continue
        new = C.stored(_verified(pairs, sets, least) if turn < 2 else _crossed(rooted, sets, least), f"{room}/links{turn}")
        if turn and new.isEmpty():
            continue
        found = found.unionByName(new)
        roots = C.stored(components(found, f"{room}/turn{turn}").select(F.col("node").alias("print"), "root"), f"{room}/roots{turn}")
        rooted = keys.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    C.discard(spark, f"{room}/sets", f"{room}/keys")
    kept = marked.select("print", "first").join(roots, "print", "left").groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("first").alias("x"))
    own, content = C.fresh(docs, "_kept"), C.fresh(docs, "_content")
    kept = C.stored(kept.select(F.col("x.doc_id").alias(own), F.col("x.content").alias(content)), f"{room}/kept")
    return docs.join(kept, F.col(doc_id).cast("bigint").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text)) == F.col(content)), "left_semi").dropDuplicates([doc_id, text])
