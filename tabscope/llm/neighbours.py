"""Nearest vectors by cosine: stable projections, a kd-tree over them, and a chi-square stop.

Vectors are brought to length one, where the largest cosine is the least distance.  Each is
projected on ``DIMENSIONS`` directions with normal (2-stable) weights: the squared projected
distance of two vectors at distance d is d^2 times a chi-square variable.  A kd-tree, fitted on at
most ``FIT_ROWS`` projected vectors, cuts the projected space into cells; every row is indexed.

A query meets projected neighbours cell by cell and, within a cell, nearest first.  Each is
verified by its true cosine.  With d the distance of the k-th best so far, the search stops at the
projected distance beyond which a vector within d would lie with a chance of ``1 - CONFIDENCE``
only.  The query's own cell comes first, which bounds d; then only cells that reach within the
stopping distance are visited.  No cell, candidate or partner is capped.

Equal vectors are indexed once, with their smallest ids (as many as a query can ask for).  Cells
that hold many rows, and cells that many queries visit, are split over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm import common as C

DIMENSIONS = 12
CONFIDENCE = 0.999
FIT_ROWS = 20_000
#: Rows a cell should hold, and rows and queries handled in one task at most.
CELL_ROWS = 1024
PART_ROWS = 8192
PART_QUERIES = 512
SEED = 5


def chi_square_bound(dimensions: int, confidence: float) -> float:
    """x with P(chi-square <= x) = confidence, for an even number of dimensions."""
    def above(x):
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > 1 - confidence else (low, middle)
    return high


class Tree:
    """Cuts at medians of the widest dimension; leaves are numbered boxes."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []
        self.low, self.high = [], []
        d = points.shape[1]
        self._grow(points, leaves, np.full(d, -np.inf), np.full(d, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points, leaves, low, high) -> int:
        at = len(self.nodes)
        spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(len(low))
        axis = int(np.argmax(spread))
        cut = float(np.median(points[:, axis])) if spread[axis] > 0 else None
        if leaves < 2 or cut is None or not (points[:, axis] > cut).any():
            self.nodes.append((-1, float(len(self.low)), 0, 0))
            self.low.append(low)
            self.high.append(high)
            return at
        self.nodes.append(())
        right = points[:, axis] > cut
        upper, lower = high.copy(), low.copy()
        upper[axis] = lower[axis] = cut
        a = self._grow(points[~right], leaves - leaves // 2, low, upper)
        b = self._grow(points[right], leaves // 2, lower, high)
        self.nodes[at] = (axis, cut, a, b)
        return at

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            axis, cut, a, b = self.nodes[node]
            if axis < 0:
                out[rows] = int(cut)
                continue
            right = points[rows, axis] > cut
            todo += [(a, rows[~right]), (b, rows[right])]
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to each leaf's box."""
        off = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (off * off).sum(axis=1)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_list(), dtype=np.float64)


def _search(queries: np.ndarray, shadows: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, points: np.ndarray, k: int, stop: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the (place, cosine) of its verified best among the vectors of a cell."""
    for q in range(len(queries)):
        off = points - shadows[q]
        gap = np.einsum("ij,ij->i", off, off)
        order = np.argsort(gap, kind="stable")
        best_place, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        bound, lo, step = bounds[q], 0, 64
        while lo < len(order) and gap[order[lo]] <= stop * bound:
            some = order[lo:lo + step]
            some = some[gap[some] <= stop * bound]
            cosine = (vectors[some] * queries[q]).sum(axis=1)
            best_place, best = np.concatenate((best_place, some)), np.concatenate((best, cosine))
            if len(best) > k:
                keep = np.argsort(-best, kind="stable")
                last = best[keep[k - 1]]
                keep = keep[best[keep] >= last]  # ties stay for the ids to settle
                best_place, best = best_place[keep], best[keep]
            if len(best) >= k:
                bound = min(bound, max(0.0, 2 - 2 * np.sort(best)[-k]) + 1e-12)
            lo, step = lo + step, step * 2
        yield q, best_place, best


def nearest(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``is_query`` holds its ``k`` nearest others.

    Nearest first, ties to the smaller id; all candidates if there are fewer.  Vectors that are
    null, empty, zero or hold a null or non-finite component, and those without an id, take no part;
    so do vectors whose length is not that of most rows (of equally many, the longer).  Rows that
    repeat an id are candidates each, but never for a query of that id.  An empty table gives no
    rows; other columns are not read.
    """
    spark = vectors.sparkSession
    room = C.workroom(spark, "neighbours")
    raw = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    raw = raw.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).filter("length > 0")
    sizes = raw.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    d = sizes["d"]
    clean = C.stored(raw.filter(F.size("v") == d).withColumn("same", F.xxhash64(F.col("v"))), f"{room}/clean")
    # One row per distinct vector, with the ids a query can need: k and its own.
    ranked = clean.select("same", "v", "length", "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    distinct = ranked.groupBy("same").agg(F.first("v").alias("v"), F.first("length").alias("length"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    weights = np.random.default_rng(SEED).standard_normal((d, DIMENSIONS))
    distinct = C.stored(distinct, f"{room}/distinct")
    total = distinct.count()
    fit = np.array([r[0] for r in distinct.orderBy(F.xxhash64(F.lit(SEED), "same")).limit(FIT_ROWS).select("v").collect()])
    fit = fit / np.sqrt((fit * fit).sum(axis=1, keepdims=True))
    tree = Tree(fit @ weights, max(1, min(total // CELL_ROWS, len(fit) // 8)))
    shared = spark.sparkContext.broadcast((weights, tree))

    def project(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, tree = shared.value
        for rows in parts:
            if len(rows):
                v = _matrix(rows["v"])
                points = (v / rows["length"].to_numpy()[:, None]) @ weights
                yield pd.DataFrame({"same": rows["same"], "v": rows["v"], "length": rows["length"], "ids": rows["ids"], "point": list(points), "cell": tree.place(points)})

    index = C.stored(distinct.mapInPandas(project, "same bigint, v array<double>, length double, ids array<bigint>, point array<double>, cell bigint"), f"{room}/index")
    asking = clean.filter("asks").select("vec_id", "same")
    queries = index.join(asking.select("same").distinct(), "same", "left_semi").select(F.col("same").alias("q"), F.col("v").alias("qv"), F.col("length").alias("ql"), F.col("point").alias("qp"), F.col("cell").alias("home"))
    # A cell's rows are dealt over parts of bounded size; every query of a cell visits each part.
    parts = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    dealt = index.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("same"), F.col("parts")).cast("int")).drop("parts")
    stop = chi_square_bound(DIMENSIONS, confidence)

    def visit(visits: DataFrame, wanted: int) -> DataFrame:
        """``q, ids, score`` of what each visit (query, cell, bound) finds."""
        spread = visits.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        crowd = spread.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("crowds"))
        asked = spread.join(crowd, ["cell", "part"]).withColumn("crowd", F.pmod(F.xxhash64("q"), F.col("crowds")).cast("int")).drop("crowds")
        met = dealt.join(crowd, ["cell", "part"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds")

        def find(rows: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(those):
                return pd.DataFrame({"q": [], "ids": [], "score": []})
            units = _matrix(rows["v"]) / rows["length"].to_numpy()[:, None]
            asks = _matrix(those["qv"]) / those["ql"].to_numpy()[:, None]
            names, ids = those["q"].to_numpy(), rows["ids"].to_list()
            out = [(names[q], ids[p], s) for q, place, score in _search(asks, _matrix(those["qp"]), those["bound"].to_numpy(), units, _matrix(rows["point"]), wanted, stop) for p, s in zip(place, score)]
            return pd.DataFrame(out, columns=["q", "ids", "score"])

        keys = ["cell", "part", "crowd"]
        return met.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(find, "q bigint, ids array<bigint>, score double")

    def best(found: DataFrame, wanted: int) -> DataFrame:
        """The ``wanted`` best ids of each query."""
        flat = found.select("q", "score", F.explode("ids").alias("vec_id"))
        return flat.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= wanted).drop("r")

    far = 4.0 + 1e-9  # no two unit vectors are further apart
    home = C.stored(best(visit(queries.select("q", "qv", "ql", "qp", F.col("home").alias("cell"), F.lit(far).alias("bound")), k + 1), k + 1), f"{room}/home")
    # The query's own row counts among those found, so k + 1 of them bound the k-th other.
    bounds = home.groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") > k, F.greatest(2 - 2 * F.col("least"), F.lit(0.0)) + 1e-12).otherwise(far)
    bounded = queries.join(bounds, "q", "left").withColumn("bound", F.coalesce(bound, F.lit(far))).drop("least", "n")

    def reach(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, tree = shared.value
        for rows in parts:
            cells = [[int(c) for c in np.flatnonzero(tree.gaps(np.asarray(p)) <= stop * b) if c != h] for p, b, h in zip(rows["qp"], rows["bound"], rows["home"])]
            yield rows.drop(columns="home").assign(cells=cells)

    onward = bounded.mapInPandas(reach, "q bigint, qv array<double>, ql double, qp array<double>, bound double, cells array<bigint>")
    more = C.stored(visit(onward.withColumn("cell", F.explode("cells")).drop("cells"), k + 1), f"{room}/more")
    found = best(home.select("q", F.array("vec_id").alias("ids"), "score").unionByName(more), k + 1)
    answers = asking.join(found, asking["same"] == found["q"]).select(asking["vec_id"].alias("query_id"), found["vec_id"].alias("vec_id"), "score").filter("query_id <> vec_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
