"""Benchmark passages in documents: pigeonhole pieces and Myers' bit-parallel distance.

Texts are compared in lower case with runs of anything but letters and digits as one space.  An
item of m characters may differ by ``rate * m`` edits.  Cut into one piece more than that, at least
one piece must stand in the document unchanged wherever the item does.  One automaton finds all
pieces of all items in a single pass; the stretch around each hit is then verified by the
bit-parallel distance of the whole item to any part of it.

Items are handled in slices of at most ``SLICE`` characters, each sent to the tasks on its own, so
what is collected and sent has a bound however many items there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common as C

SLICE = 4_000_000
RATE = 0.05
_GAP = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    cuts = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(item: str, text: str, places: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edits from the item to any part of the text, and where the first such part ends."""
    m = len(item)
    if places is None:
        places = bit_places(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text, 1):
        eq = places.get(c, 0)
        vertical = eq | minus
        cross = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(cross | plus))
        down = plus & cross
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full  # the part may begin anywhere
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, i
    return best, end


def bit_places(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Items:
    """A slice of items ready to search."""

    def __init__(self, rows: list[tuple[int, str]], rate: float):
        self.ids, self.texts, self.budgets, self.places = [], [], [], []
        found: dict[str, list[tuple[int, int]]] = {}
        for name, text in rows:
            item = plain(text or "")
            if not item:
                continue
            budget = int(rate * len(item))
            for offset, piece in pieces(item, budget):
                found.setdefault(piece, []).append((len(self.ids), offset))
            self.ids.append(name)
            self.texts.append(item)
            self.budgets.append(budget)
            self.places.append(bit_places(item))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, least edits, budget, end of the best part) for every item within its budget."""
        if not self.ids:
            return []
        text = plain(text)
        begins: dict[int, list[int]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for item, offset in owners:
                begins.setdefault(item, []).append(end + 1 - size - offset)
        out = []
        for item, starts in begins.items():
            budget, want = self.budgets[item], self.texts[item]
            best = None
            lo = hi = None
            for start in [*sorted(starts), None]:  # overlapping stretches are searched together
                if lo is not None and (start is None or start - budget > hi):
                    edits, end = myers(want, text[lo:hi], self.places[item])
                    if edits <= budget and (best is None or edits < best[0]):
                        best = (edits, lo + end)
                    lo = None
                if start is not None:
                    lo = max(0, start - budget) if lo is None else lo
                    hi = start + len(want) + budget
            if best:
                out.append((self.ids[item], best[0], budget, best[1]))
        return out


def find_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, edits, budget, last_char``: each document and item it holds.

    ``last_char`` is where the best part ends in the compared form.  Null and empty texts hold
    nothing and null or empty items are nowhere.  Repeated documents and items are each reported;
    null ids are reported as null.  Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    total = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-int(total) // SLICE) or 1
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("budget", pa.int32()), ("last_char", pa.int64())])

    def one(part: int) -> DataFrame:
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == part).collect()])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = Items(held.value, rate)
            for batch in batches:
                out = [(d, *hit) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"]) for hit in ready.search(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

        return rows.mapInArrow(search, "doc_id bigint, item_id bigint, edits int, budget int, last_char bigint")

    return reduce(DataFrame.unionByName, map(one, range(slices)))


def without_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item.  Rows of one id go together; rows without an id are
    kept only if none of them holds one."""
    name = C.fresh(docs, "_found")
    found = find_passages(docs, items, doc_id, text, item_id, item_text, rate).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col(doc_id).cast("bigint").eqNullSafe(F.col(name)), "left_anti")
