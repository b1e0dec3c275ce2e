"""Quality by importance resampling: hashed n-gram models of wanted and raw text.

Words and runs of marks, and their pairs, are hashed into ``BUCKETS`` counts: once over the wanted
texts, once over all texts.  The ratio of the two generative models weighs a document; its mean
logarithm per n-gram makes texts of any length comparable.  Documents are drawn without
replacement in proportion to ``exp(mean / temperature)`` by adding Gumbel noise (from a hash of the
id, so it can be repeated) and taking the ``k`` largest.

``k`` comes from the data: how many documents reach the weight that parts good from bad labelled
ones best.  Half of the labelled good documents make the wanted model, the other half and the bad
ones choose that weight, out of at most
``LABELLED`` labelled ids (those of the smallest hashes).  Toxicity is not a matter of quality here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common as C

BUCKETS = 1 << 18
CHUNK = 1 << 12
SMOOTHING = 1.0
TEMPERATURE = 0.002
#: Most labelled documents used to fit the wanted model and to choose the parting weight.
LABELLED = 20_000
BINS = 4096
_UNIT = re.compile(r"\w+|[^\w\s]+")
#: Distinct units whose hash a task keeps.
KNOWN = 1 << 20
#: Characters handled at a time, cut at white space.
SLICE = 1 << 22


class Grams:
    """Buckets of a text's units and pairs of units."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _hashes(self, units: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        out = [known.get(u) or known.setdefault(u, xxhash.xxh64_intdigest(u) | 1) for u in units]
        return np.array(out, dtype=np.uint64)

    def of(self, text: str) -> Iterator[np.ndarray]:
        """Buckets, slice by slice."""
        before, at = np.zeros(0, dtype=np.uint64), 0
        while at < len(text):
            stop = at + SLICE
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            own = self._hashes(_UNIT.findall(text[at:stop].lower()))
            both = np.concatenate((before, own))
            pairs = C.mix(both[:-1] * np.uint64(0x9E3779B97F4A7C15) + both[1:])
            yield (np.concatenate((own, pairs)) % np.uint64(BUCKETS)).astype(np.int64)
            before, at = both[-1:], stop


_COUNTS = pa.schema([("part", pa.int32()), ("wanted", pa.binary()), ("raw", pa.binary())])
COUNTS = "part int, wanted binary, raw binary"


def _rows(counts: np.ndarray) -> pa.RecordBatch:
    cut = counts.reshape(2, -1, CHUNK)
    full = np.flatnonzero(cut[1].any(axis=1))
    return pa.RecordBatch.from_pydict({"part": full.tolist(), "wanted": [cut[0, i].tobytes() for i in full], "raw": [cut[1, i].tobytes() for i in full]}, schema=_COUNTS)


def bucket_counts(docs: DataFrame, text: str, wanted: Column) -> np.ndarray:
    """Counts over the wanted and over all rows.  Each task adds up its documents; the sums, whose
    size is fixed by ``BUCKETS``, are added in tasks that take one row at a time."""
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(wanted, F.lit(False)).alias("wanted"))

    def count(batches):
        grams, counts = Grams(), np.zeros((2, BUCKETS), dtype=np.int64)
        held, size = ([], []), 0

        def settle():
            for side in (0, 1):
                if held[side]:
                    counts[side] += np.bincount(np.concatenate(held[side]), minlength=BUCKETS)
                    held[side].clear()

        for batch in batches:
            for t, w in zip(batch["text"], batch["wanted"].to_pylist()):
                for found in grams.of(t.as_py()):
                    held[1].append(found)
                    if w:
                        held[0].append(found)
                    size += len(found)
                    if size > 1 << 20:
                        settle()
                        size = 0
        settle()
        yield _rows(counts)

    def add(batches):
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                place = slice(row["part"] * CHUNK, (row["part"] + 1) * CHUNK)
                counts[0, place] += np.frombuffer(row["wanted"], np.int64)
                counts[1, place] += np.frombuffer(row["raw"], np.int64)
        yield _rows(counts)

    partial = rows.mapInArrow(count, COUNTS)
    sums = partial.repartition(16, "part", F.xxhash64("raw") % 4).mapInArrow(add, COUNTS)
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    for row in sums.toLocalIterator():  # at most 16 x BUCKETS / CHUNK rows
        place = slice(row["part"] * CHUNK, (row["part"] + 1) * CHUNK)
        total[0, place] += np.frombuffer(row["wanted"], np.int64)
        total[1, place] += np.frombuffer(row["raw"], np.int64)
    return total


def log_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    p = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * BUCKETS)
    return np.log(p[0]) - np.log(p[1])


def weigher(docs: DataFrame, ratios: np.ndarray):
    """A column function from text to ``(mean log ratio, n-grams)``; the table sent has a fixed size."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("mean double, n bigint")
    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for texts in parts:
            out = []
            for t in texts:
                total, n = 0.0, 0
                for found in grams.of(t or ""):
                    total += float(table.value[found].sum())
                    n += len(found)
                out.append((total / n if n else 0.0, n))
            yield pd.DataFrame(out, columns=["mean", "n"])

    return weigh


def parting_weight(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that keeps the most good for the fewest bad; without both kinds everything passes."""
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate((good, bad)))
    kept_good = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    kept_bad = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[np.argmax(kept_good - kept_bad)])


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of column ``key``: counted in bins that close in on it."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    above = 0
    while True:
        width = (high - low) / BINS
        inside = keys.filter(F.col("key").between(low, high))
        if width <= 0 or low + width == low:
            return high
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        bins = inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("b")).collect()
        for b in bins:
            if above + b["n"] >= k:
                break
            above += b["n"]
        low, high = b["lo"], b["hi"]
        if low == high:
            return low
        if b["n"] <= BINS:
            own = sorted((r[0] for r in keys.filter(F.col("key").between(low, high)).collect()), reverse=True)
            return own[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", quality: str = "quality",
             temperature: float = TEMPERATURE, k: int | None = None, seed: int = 7, columns: tuple[str, ...] | None = None, labelled: int = LABELLED) -> DataFrame:
    """The drawn rows of ``docs``, and ``weight`` (mean log ratio) and ``weight_key``; where ``docs`` has
    such columns, underscores are added to the new names.

    With ``columns`` only those are returned, from the stored weights; otherwise all columns are,
    and the texts are weighed again where they are read.

    ``k`` sets the size of the draw; without it the labels do.  Rows of equal key (repeated ids and
    texts) stay or go together.  A text without n-grams (null, empty, white space) weighs 0.  Labels
    that are null or of unknown ids count for nothing; without labels of both kinds all rows stay.
    An empty table gives no rows.  Texts of any length are weighed whole, in slices.  At most
    ``labelled`` labels are used, so no text is shuffled to meet its label.
    """
    out = C.fresh(docs, "weight"), C.fresh(docs, "weight_key")
    known = (labels.select(F.col(label_id).cast("bigint").alias("_label_id"), F.col(quality).cast("int").alias("_quality"))
             .filter("_label_id is not null and _quality in (0, 1)").groupBy("_label_id").agg(F.min("_quality").alias("_quality"))
             .orderBy(F.xxhash64(F.lit(seed + 1), "_label_id"), "_label_id").limit(labelled))
    # Two numbers for each of at most ``labelled`` ids: read once, then sent with the tasks.
    known = F.broadcast(docs.sparkSession.createDataFrame(known.toPandas(), "_label_id bigint, _quality int"))
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("_doc_id"), F.col(text).alias("_text"))
    found = narrow.join(known, F.col("_doc_id") == F.col("_label_id"), "left")
    fitting = F.pmod(F.xxhash64(F.lit(seed), F.col("_doc_id")), F.lit(2)) == 0
    counts = bucket_counts(found, "_text", (F.col("_quality") == 1) & fitting)
    ratios = log_ratios(counts) if counts[0].any() else np.zeros(BUCKETS)
    weigh = weigher(docs, ratios)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), F.col(doc_id).cast("bigint"), F.col(text)), 11).cast("double") + 0.5) / float(1 << 53)
    # Every text is weighed once; what is kept of it is a few numbers.
    own, (weight, key) = list(columns or ()), out
    kept = docs.select(*[F.col(c).alias(f"own_{c}") for c in own], F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("content"),
                       weigh(F.col(text))["mean"].alias("weight"), uniform.alias("uniform"))
    keys = C.stored(kept.withColumn("key", F.col("weight") / temperature - F.log(-F.log("uniform"))).drop("uniform"), C.workroom(docs.sparkSession, "weights"))
    if k is None:
        judged = keys.join(known, F.col("id") == F.col("_label_id")).filter((F.col("_quality") == 0) | (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(2)) != 0))
        seen = judged.orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "content").limit(labelled).select("_quality", "weight").toPandas()
        cut = parting_weight(seen.loc[seen["_quality"] == 1, "weight"].to_numpy(), seen.loc[seen["_quality"] == 0, "weight"].to_numpy())
        k = keys.filter(F.col("weight") >= float(cut)).count()
    least = kth_largest(keys.select("key"), k)
    if columns is not None:
        return keys.filter(F.col("key") >= least).select(*[F.col(f"own_{c}").alias(c) for c in own], F.col("weight").alias(weight), F.col("key").alias(key))
    keyed = docs.withColumn(weight, weigh(F.col(text))["mean"]).withColumn(key, F.col(weight) / temperature - F.log(-F.log(uniform)))
    return keyed.filter(F.col(key) >= least)
