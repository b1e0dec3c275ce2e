"""Helpers that several operators share: stored tables, packs of tokens, and a key exchange.

*Stored tables* are Parquet folders below ``spark.checkpoint.dir``: every executor reaches them,
so a lost executor never loses a finished step.  Shuffle files of a step go when it is written.

A *pack* is one row holding whole documents of about ``PACK_TOKENS`` words: numbered words, the
pack's own word list and the documents' sizes.  Packs are made without a shuffle and stored once,
so later steps number and sort their words alike without reading the texts again.

The *exchange* sends each pack's distinct sorted keys to shards of the key range.  A key comes at
most once per pack, so however often a word or passage repeats, no shard grows with it.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACK_TOKENS = 1 << 20
SHARD_KEYS = 1 << 21
PACKS = ("pack string, n_tokens bigint, doc_ids array<bigint>, flags array<boolean>, "
         "sizes binary, tokens binary, vocab binary")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workroom(spark: SparkSession, name: str) -> str:
    """A new folder for one run's tables in the shared folder the session names."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a step's rows and read them back; its shuffle files are removed once it is written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no later step reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def mix(keys: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys evenly (the finaliser of MurmurHash3)."""
    keys = keys ^ (keys >> np.uint64(33))
    keys = keys * np.uint64(0xFF51AFD7ED558CCD)
    keys = keys ^ (keys >> np.uint64(33))
    keys = keys * np.uint64(0xC4CEB9FE1A85EC53)
    return keys ^ (keys >> np.uint64(33))


# --- compact arrays -------------------------------------------------------------------------------

def squeeze(values: np.ndarray) -> bytes:
    """Unsigned values as byte planes of the least width; the first byte says how many."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unsqueeze(raw: bytes, count: int) -> np.ndarray:
    out = np.zeros((count, 8), dtype=np.uint8)
    if width := raw[0]:
        out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, count).T
    return out.reshape(-1).view(np.uint64)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned values by their gaps."""
    values = np.asarray(values, dtype=np.uint64)
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unsqueeze_sorted(raw: bytes, count: int) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, count), dtype=np.uint64)


# --- packs ------------------------------------------------------------------------------------------

class Pack:
    """One pack row unfolded: documents, their word numbers and the word list."""

    def __init__(self, row: dict):
        self.name, self.doc_ids, self.flags = row["pack"], row["doc_ids"], np.array(row["flags"], dtype=bool)
        self.sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        self.tokens = unsqueeze(row["tokens"], row["n_tokens"]).astype(np.int64)
        self.vocab = row["vocab"].split(b" ") if row["vocab"] else []
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def hashes(self) -> np.ndarray:
        """The 64-bit hash of each word of the list."""
        return np.fromiter(map(xxhash.xxh64_intdigest, self.vocab), np.uint64, len(self.vocab))

    def owners(self) -> np.ndarray:
        """The document's place in the pack, for each token."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def make_packs(docs: DataFrame, doc_id: str, text: str, flag: Column | None = None, lower: bool = False) -> DataFrame:
    """Documents as packs, without a shuffle.  Words are runs of anything but ASCII white space;
    a null text has none.  ``lower`` lower-cases A-Z only.  ``flag`` is kept per document."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"),
                       F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)).alias("flag"))

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, flags, parts, held = [], [], [], 0
        number = defaultdict(itertools.count().__next__)

        def close():
            row = {"pack": uuid.uuid4().hex, "n_tokens": held, "doc_ids": names, "flags": flags,
                   "sizes": np.array([len(p) for p in parts], dtype=np.int32).tobytes(),
                   "tokens": squeeze(np.concatenate(parts)), "vocab": b" ".join(number)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("pack", pa.string()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())),
                ("sizes", pa.binary()), ("tokens", pa.binary()), ("vocab", pa.binary())]))

        for batch in batches:
            for name, raw, kept in zip(batch["doc_id"].to_pylist(), batch["text"], batch["flag"].to_pylist()):
                raw = raw.as_py() or b""
                words = (raw.lower() if lower else raw).split()
                names.append(name)
                flags.append(kept)
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                held += len(words)
                if held >= PACK_TOKENS:
                    yield close()
                    names, flags, parts, held = [], [], [], 0
                    number = defaultdict(itertools.count().__next__)
        if names:
            yield close()

    return rows.mapInArrow(fold, PACKS)


def read_packs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Pack, dict]]:
    """Each pack of Arrow batches, with its raw row for columns joined to it."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield Pack(row), row


def shard_count(packs: DataFrame, per_token: float = 1.0) -> int:
    total = packs.agg(F.sum("n_tokens")).first()[0] or 0
    return max(1, -(-int(total * per_token) // SHARD_KEYS))


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's slice of sorted 64-bit keys begins, and the end."""
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)])).astype(np.int64)


PROBES = "shard int, pack string, n int, keys binary, marks binary"
PROBE_SCHEMA = pa.schema([("shard", pa.int32()), ("pack", pa.string()), ("n", pa.int32()), ("keys", pa.binary()), ("marks", pa.binary())])


def key_slices(pack: Pack, keys: np.ndarray, marks: np.ndarray, shards: int) -> dict:
    """Sorted distinct keys and a number for each, as one row per shard."""
    cuts = shard_cuts(keys, shards)
    full = np.flatnonzero(np.diff(cuts))
    return {"shard": full.tolist(), "pack": [pack.name] * len(full), "n": [int(cuts[s + 1] - cuts[s]) for s in full],
            "keys": [squeeze_sorted(keys[cuts[s]:cuts[s + 1]]) for s in full],
            "marks": [squeeze(marks[cuts[s]:cuts[s + 1]]) for s in full]}


def gather_keys(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's keys with the place of the row each is from and its mark."""
    keys = [unsqueeze_sorted(k, n) for k, n in zip(rows["keys"], rows["n"])]
    marks = [unsqueeze(m, n) for m, n in zip(rows["marks"], rows["n"])]
    return np.concatenate(keys), np.repeat(np.arange(len(rows)), rows["n"]), np.concatenate(marks)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of each run of equal sorted keys, and each key's run."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def with_answers(packs: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Each pack with its answers as one array ``name``: as many entries as it has shards."""
    fields = [c for c in answers.columns if c != "pack"]
    gathered = answers.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return packs.join(gathered, "pack", "left")


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position; the last ``size - 1`` positions are zero."""
    out = np.zeros(len(words), dtype=np.uint64)
    if len(words) >= size:
        part = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for k in range(size):
            part = part * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(part)]
        out[:len(part)] = mix(part)
    return out


def whole_grams(pack: Pack, size: int) -> np.ndarray:
    """Positions from which ``size`` words follow in the same document."""
    at = np.arange(len(pack.tokens))
    return np.flatnonzero(at + size <= np.repeat(pack.ends, pack.sizes))
