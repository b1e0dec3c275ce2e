"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A text is cut into paragraphs, long ones at sentence ends; each is a 64-bit digest, repeats
numbered so that every digest of a text is distinct.  A sketch puts each digest into three of its
cells, which hold a count, the exclusive or of the digests and of their check values.

Two sketches of one size are compared by subtraction: what both texts hold cancels out.  Peeling
takes digests from cells that hold a single one, which frees others, until nothing is left: then
both differences are known exactly.  If cells remain, the sketches were too small for the
difference, and both texts are sketched ``GROWTH`` times as large, as often as it takes.

A text is compared with its successor in the order of ids without gathering the order anywhere:
texts are range-partitioned by id once, which is the only shuffle of texts, and streamed in order;
the first and the last text of each partition are joined to the adjoining partition's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common as C

#: Cells of a fingerprint; three groups of equal size.
CELLS = 18
GROWTH = 16
#: Longest paragraph in code points.
LONGEST = 200
#: Bytes of text of a range partition.
PART_BYTES = 1 << 26
_PIECE = re.compile(rf"[^\n.!?]{{1,{LONGEST}}}[\n.!?]*|[\n.!?]+")
_CELL = np.dtype([("count", "<i2"), ("key", "<u8"), ("check", "<u4")])


def paragraphs(text: str) -> list[str]:
    """Runs up to a line feed or the end of a sentence; none is longer than ``LONGEST`` and its marks."""
    return _PIECE.findall(text)


def digests(text: str) -> np.ndarray:
    """One distinct 64-bit digest per paragraph: of its text and of how often it came before."""
    seen: dict[str, int] = {}
    out = []
    for piece in paragraphs(text):
        n = seen[piece] = seen.get(piece, -1) + 1
        out.append(xxhash.xxh64_intdigest(piece, n))
    return np.unique(np.array(out, dtype=np.uint64))  # a digest met twice would never be peeled


def _checks(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


#: The cell inside each third comes from 21 bits of one hash.
_SHIFTS = np.array([[1], [22], [43]], dtype=np.uint64)
_BITS = np.uint64((1 << 21) - 1)


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """Three cells of each key, one in each third; another size has other places."""
    third = cells // 3
    if third <= 1 << 16:
        slots = ((C.mix(keys + np.uint64(cells)) >> _SHIFTS & _BITS) * np.uint64(third)) >> np.uint64(21)
    else:  # 21 bits would leave cells unevenly filled
        slots = np.stack([C.mix(keys + np.uint64(cells + i)) % np.uint64(third) for i in range(3)])
    return slots.astype(np.int64) + np.array([[0], [third], [2 * third]])


@dataclass
class Sketch:
    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, cells: int = CELLS) -> Sketch:
        new = cls(np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint32))
        new.put(keys, _checks(keys), 1)
        return new

    def put(self, keys: np.ndarray, checks: np.ndarray, times: int | np.ndarray):
        # Flat arrays of one length: ``ufunc.at`` reads past the end of values it would have to broadcast.
        at = _places(keys, len(self.count)).ravel()
        np.add.at(self.count, at, times if np.ndim(times) == 0 else np.tile(times, 3))
        np.bitwise_xor.at(self.key, at, np.tile(keys, 3))
        np.bitwise_xor.at(self.check, at, np.tile(checks, 3))

    def __sub__(self, other: Sketch) -> Sketch:
        return Sketch(self.count - other.count, self.key ^ other.key, self.check ^ other.check)

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The keys only the left side held and those only the right side held; None if cells remain."""
        sides: tuple[list, list] = ([], [])
        for _ in range(len(self.count) + 1):
            single = np.flatnonzero(np.abs(self.count) == 1)
            keys = self.key[single]
            checks = _checks(keys)
            pure = np.flatnonzero(checks == self.check[single])
            if not len(pure):
                break
            # A key may be alone in more than one of its cells.
            pure = pure[np.argsort(keys[pure])]
            pure = pure[np.append(True, keys[pure[1:]] != keys[pure[:-1]])]
            keys, signs = keys[pure], self.count[single[pure]]
            sides[0].append(keys[signs > 0])
            sides[1].append(keys[signs < 0])
            self.put(keys, checks[pure], -signs)
        if self.count.any() or self.key.any() or self.check.any():
            return None
        return tuple(np.concatenate(s) if s else np.zeros(0, np.uint64) for s in sides)

    def text(self) -> str:
        """The cells as lowercase hex digits; counts are kept to 16 bits."""
        cells = np.zeros(len(self.count), _CELL)
        cells["count"], cells["key"], cells["check"] = self.count & 0x7FFF, self.key, self.check
        return cells.tobytes().hex()


class Version:
    """A text's digests, and its sketches as they are asked for."""

    def __init__(self, text: str):
        self.text = text
        self.keys = digests(text)
        self.sketches: dict[int, Sketch] = {}

    def sketch(self, cells: int = CELLS) -> Sketch:
        if cells not in self.sketches:
            self.sketches[cells] = Sketch.of(self.keys, cells)
        return self.sketches[cells]


def difference(a: Version, b: Version, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, int]:
    """The digests only ``a`` has, those only ``b`` has, and the cells it took to recover them."""
    while (found := (a.sketch(cells) - b.sketch(cells)).peel()) is None:
        cells *= GROWTH
    return *found, cells


def likeness(a: Version, b: Version) -> tuple[float, int, int, int]:
    """Shared digests over all digests of both texts (1 if both have none), how many only ``a`` and
    only ``b`` has, and the cells it took."""
    gone, new, cells = difference(a, b)
    both = len(a.keys) - len(gone)
    return (both / (both + len(gone) + len(new)) if both + len(gone) + len(new) else 1.0), len(gone), len(new), cells


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first code points of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


FOUND = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
         "removed bigint, added bigint, cells bigint")
_FOUND = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
          ("near_edited", pa.float64()), ("near_next", pa.float64()), ("removed", pa.int64()), ("added", pa.int64()), ("cells", pa.int64())]
#: Rows of a result batch; they hold two fingerprints each.
BATCH = 1000


def compare(doc_id: int | None, own: Version, after: Version) -> tuple:
    """A row of ``FOUND``: a text against its edited version and against the following text."""
    new = Version(edited(own.text, after.text))
    near, removed, added, cells = likeness(own, new)
    return (doc_id, len(own.text), hashlib.sha256(new.text.encode()).hexdigest(), own.sketch().text(), new.sketch().text(), near, likeness(own, after)[0], removed, added, cells)


def _table(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=pa.schema(fields))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``FOUND`` per row of ``docs``: fingerprints of its text and of the version whose last
    half is replaced by the beginning of the next document, and their likeness.

    ``near_edited`` and ``near_next`` compare with the edited version and with the next document;
    ``removed`` and ``added`` count the paragraphs the edit took and brought, recovered with a sketch
    of ``cells`` cells.  The next document is that of the next larger id; the last one is followed
    by the first, a single one by itself.  Rows without id come first; rows that repeat an id follow
    each other by the hash of their text.  A null text is an empty one.  Texts are held one pair at a
    time, whole, however long.  An empty table gives no rows.  Other columns are not read.
    """
    spark, room = docs.sparkSession, C.workroom(docs.sparkSession, "sketches")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    # A row with an edge ("first" or "last") carries a whole text instead of a result.
    fields = [*_FOUND, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())]
    blank = (None,) * (len(_FOUND) - 1)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part, out = None, None, []
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"]
            for i, name in enumerate(ids):
                now = Version(texts[i].as_py())
                if before is None:
                    part = batch["part"][0].as_py()
                    out.append((name, *blank, part, "first", now.text))
                else:
                    out.append((*compare(*before, now), part, None, None))
                before = name, now
                if len(out) >= BATCH:
                    yield _table(out, fields)
                    out = []
        if before is not None:
            out.append((before[0], *blank, part, "last", before[1].text))
        yield _table(out, fields)

    streamed = C.stored(placed.mapInArrow(stream, f"{FOUND}, part int, edge string, text string"), f"{room}/streamed")
    edges = streamed.filter("edge is not null")
    # Two rows per partition: each last text meets the first of the next partition that has one.
    filled = sorted(r["part"] for r in edges.filter("edge = 'last'").select("part").collect())
    following = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1])), "part int, after int")
    last = edges.filter("edge = 'last'").select("part", "doc_id", "text").join(F.broadcast(following), "part")
    first = edges.filter("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([compare(d, Version(t.as_py()), Version(f.as_py())) for d, t, f in zip(batch["doc_id"].to_pylist(), batch["text"], batch["following"])], _FOUND)

    closed = last.join(first.hint("merge"), "after").select("doc_id", "text", "following").mapInArrow(close, FOUND)
    return streamed.filter("edge is null").select(*closed.columns).unionByName(closed)
