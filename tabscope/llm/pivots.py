"""k-means in whole numbers with a table of pivot distances (LAESA).

The first centroids serve as *pivots* for all rounds: every vector's distances to them are computed
and stored once.  In a round only the centroids' distances to the pivots are new; by the triangle
inequality the difference of two pivot distances bounds a vector's distance to a centroid from
below.  A vector takes the exact distance to the centroid of the least bound, then to those whose
bound doesn't exceed the best found so far.  Bounds are lowered by more than their rounding, so
equal distances are never missed; distances that decide are exact integers.

Vectors are rows of one stored table read once a round; a task returns sums per centroid, so what
is shuffled and what reaches the driver has a size fixed by the number of centroids and components.
Values too large for 64-bit distances (a component of ``WIDE`` or more after scaling) are kept as
decimal text and compared exactly in Python's integers with every centroid, without bounds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common as C

#: Below it, a sum of 64 squared differences fits 64 bits; more components need less.
WIDE = 1 << 27
LONG = (1 << 63) - 1
TABLE = "vec_id bigint, v binary, d binary, wide string"
TABLE_SCHEMA = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("d", pa.binary()), ("wide", pa.string())])
SUMS = "cluster int, place int, limb int, value bigint"
RESULT = "vec_id bigint, cluster int, distance bigint"


def usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.coalesce((F.size(vector) == dims) & ~odd, F.lit(False))


def floor_scaled(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    over, under = x.as_integer_ratio()
    return scale * over // under


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0]:at[-1]].view(kind)
    return flat.reshape(len(column), len(flat) // len(column))


def _binaries(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in rows]


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots; those of very large whole numbers stop at a value above every bound."""
    if squares.dtype == object:
        squares = np.array([float(min(x, 1 << 200)) for x in squares])
    return np.sqrt(squares.astype(np.float64))


class Centroids:
    """Centroids and pivots as lists of whole numbers; large ones take part without bounds."""

    def __init__(self, centres: list[list[int]], pivots: list[list[int]]):
        self.centres = centres
        self.small = [all(abs(x) < WIDE for x in c) for c in centres]
        self.array = [np.array(c, dtype=np.int64) if s else None for c, s in zip(centres, self.small)]
        # Distance of each pivot to each centroid: unknown (nan) for large ones.
        self.reach = np.array([[math.sqrt(sum((a - b) ** 2 for a, b in zip(p, c))) if s else math.nan for c, s in zip(centres, self.small)] for p in pivots]).reshape(len(pivots), len(centres))

    def exact(self, rows: np.ndarray, c: int) -> np.ndarray:
        """Squared distances of whole-number rows to centroid ``c``, exactly."""
        if self.small[c]:
            apart = rows - self.array[c]
            return np.einsum("ij,ij->i", apart, apart)
        return ((rows.astype(object) - np.array(self.centres[c], dtype=object)) ** 2).sum(axis=1)

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of vectors (by their squared pivot distances) to the centroids."""
        low = np.zeros((len(to_pivots), len(self.centres)))
        for p, own in enumerate(np.sqrt(to_pivots.astype(np.float64)).T):
            reach = self.reach[p]
            # Each root is off by less than 2e-16 of itself.
            gap = np.abs(own[:, None] - reach) - 1e-15 * (own[:, None] + reach)
            np.fmax(low, gap, out=low)
        return low

    def nearest(self, rows: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row the nearest centroid (ties: the smaller number), the squared distance, and how many distances were computed in all."""
        low = self.bounds(to_pivots)
        label = low.argmin(axis=1)
        best = np.zeros(len(rows), dtype=np.int64 if all(self.small) else object)
        computed = len(rows)
        for c in range(len(self.centres)):
            at = np.flatnonzero(label == c)
            if len(at):
                best[at] = self.exact(rows[at], c)
        first = label.copy()
        for c in range(len(self.centres)):
            # A root of the best is rounded too: hence the factor.
            at = np.flatnonzero((first != c) & (low[:, c] <= _root(best) * (1 + 1e-15)))
            if len(at):
                d = self.exact(rows[at], c)
                closer = (d < best[at]) | ((d == best[at]) & (c < label[at]))
                best[at[closer]], label[at[closer]] = d[closer], c
                computed += len(at)
        return label, best, computed

    def nearest_wide(self, row: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(row, c)), i) for i, c in enumerate(self.centres))[::-1]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as parts below 2^32, the last one signed; parts of sums add up in 64 bits."""
    limb = 0
    while not -(1 << 31) <= value < 1 << 31:
        yield limb, value & 0xFFFFFFFF
        value >>= 32
        limb += 1
    yield limb, value


def pivot_table(vectors: DataFrame, vec_id: str, vector: str, pivots: list[list[int]], scale: int) -> DataFrame:
    """``vec_id``, scaled components ``v``, squared distances ``d`` to the pivots; or ``wide`` in place of both."""
    known = [np.array(p, dtype=np.int64) for p in pivots]

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            with np.errstate(over="ignore"):
                values = np.floor(raw * float(scale))
            narrow = (np.abs(values) < WIDE).all(axis=1)
            rows = np.where(narrow[:, None], values, 0).astype(np.int64)
            d = np.stack([np.einsum("ij,ij->i", rows - p, rows - p) for p in known], axis=1) if len(known) else np.zeros((len(rows), 0), np.int64)
            wide = [None if n else ",".join(str(floor_scaled(x, scale)) for x in r) for n, r in zip(narrow, raw.tolist())]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([v if n else None for n, v in zip(narrow, _binaries(rows.astype(np.int32)))], pa.binary()),
                                              pa.array([v if n else None for n, v in zip(narrow, _binaries(d))], pa.binary()), pa.array(wide, pa.string())], schema=TABLE_SCHEMA)

    return vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(scaled, TABLE)


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, list[int]]]]:
    """Places, components and pivot distances of the narrow rows, and the wide ones."""
    wide = [(i, list(map(int, t.split(",")))) for i, t in enumerate(batch["wide"].to_pylist()) if t is not None]
    at = np.flatnonzero(batch["v"].is_valid().to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64), wide
    small = batch.take(pa.array(at)) if wide else batch
    return at, _matrix(small["v"], np.int32).astype(np.int64), _matrix(small["d"], np.int64), wide


def _sums(table: DataFrame, now: Centroids) -> dict[tuple[int, int], int]:
    """Per centroid the sum of each component, and the count at place -1."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}

        def put(c: int, n: int, values: list[int]):
            for place, v in enumerate([n, *values], -1):
                totals[c, place] = totals.get((c, place), 0) + v

        for batch in batches:
            _, rows, d, wide = _parts(batch)
            if len(rows):
                label, _, _ = now.nearest(rows, d)
                for c in np.unique(label):
                    own = rows[label == c]
                    put(int(c), len(own), own.sum(axis=0).tolist())
            for _, row in wide:
                put(now.nearest_wide(row)[0], 1, row)
        flat = [(c, place, limb, v) for (c, place), total in totals.items() for limb, v in _limbs(total)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "place", "limb", "value"])

    out: dict[tuple[int, int], int] = {}
    for r in table.mapInArrow(add, SUMS).groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect():  # centroids x components rows, a few limbs each
        key = r["cluster"], r["place"]
        out[key] = out.get(key, 0) + (r["value"] << 32 * r["limb"])
    return out


def _labelled(table: DataFrame, now: Centroids) -> DataFrame:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, d, wide = _parts(batch)
            found: list[tuple[int, int]] = [(0, 0)] * batch.num_rows
            if len(rows):
                near, best, _ = now.nearest(rows, d)
                for i, c, x in zip(at.tolist(), near.tolist(), best.tolist()):
                    found[i] = (c, x)
            for i, row in wide:
                found[i] = now.nearest_wide(row)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([c for c, _ in found], pa.int32()), pa.array([x if x <= LONG else None for _, x in found], pa.int64())],
                                             names=["vec_id", "cluster", "distance"])
    return table.mapInArrow(label, RESULT)


def first_centroids(vectors: DataFrame, vec_id: str, vector: str, k: int, seed: int, scale: int) -> list[list[int]]:
    """The ``k`` vectors of the smallest hash of their id; equal ids stand by their components, absent ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("bigint").cast("string")).cast("binary"), 256)
    taken = vectors.select(key.alias("key"), F.col(vector).cast("array<double>").alias("vector")).orderBy(F.asc_nulls_last("key"), "vector").limit(k)
    return [[floor_scaled(x, scale) for x in r["vector"]] for r in taken.collect()]


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Clusters of the vectors with ``dims`` finite components, scaled to whole numbers.

    One row per such vector: ``vec_id, cluster, distance`` (squared, to the final centroid),
    ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all) and
    ``centroid_sha256`` (of the final centroid's components, joined by commas).

    Other vectors (null, of another length, with null or non-finite components) give no row.  With
    fewer than ``k`` vectors there are as many centroids.  Rows that repeat an id are vectors of their
    own; a row without id gets a result too.  A distance or sum over 64 bits is null; clusters are
    exact all the same.  An empty table gives no rows.  Other columns are not read.
    """
    if dims > 64:
        raise ValueError("64-bit distances are laid out for at most 64 components")
    spark, room = vectors.sparkSession, C.workroom(vectors.sparkSession, "pivots")
    fit = vectors.filter(usable(F.col(vector), dims)).select(vec_id, vector)
    centres = first_centroids(fit, vec_id, vector, k, seed, scale)
    pivots = [c for c in centres if all(abs(x) < WIDE for x in c)]
    table = C.stored(pivot_table(fit, vec_id, vector, pivots, scale), f"{room}/table")
    for _ in range(rounds if centres else 0):
        sums = _sums(table, Centroids(centres, pivots))
        centres = [[sums[c, i] // n for i in range(dims)] if (n := sums.get((c, -1), 0)) else old for c, old in enumerate(centres)]
    labelled = C.stored(_labelled(table, Centroids(centres, pivots)), f"{room}/labelled")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sizes = labelled.groupBy("cluster").agg(F.when(F.count(F.when(F.col("distance").isNull(), 1)) == 0, whole).alias("inertia")).collect()  # one row per centroid
    inertia = {r["cluster"]: None if r["inertia"] is None else int(r["inertia"]) for r in sizes}
    total = None if None in inertia.values() else sum(inertia.values())
    fits = lambda x: x if x is not None and x <= LONG else None
    facts = [(c, fits(inertia[c]), fits(total), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c in inertia]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return labelled.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
