"""License notices by conditional compression.

Words are compared in lower case without marks at their edges.  A notice of n words may differ in
``rate * n`` words, so one of that many pieces plus one stands unchanged: one automaton over all
templates' pieces finds every place a notice can be, and the words around it are a candidate block.

Each candidate is compressed on its own and once with each template as raw zstandard dictionary;
templates are ranked by how much that shrinks it.  The best is confirmed by the exact wording
differences between template and block (word alignment), which are reported.  A difference in a word
that tells licenses apart (``TELLING``: "lesser", "noncommercial", a version) rejects the template; if
no other is confirmed, the best rejected one is reported as an unknown variant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.contamination import pieces

RATE = 0.15
#: Wordings of common notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: A winner whose wording differs in one of these words is another license of its family.
TELLING = re.compile(r"\b(lesser|library|affero|non-?commercial|no-?deriv\w*|share-?alike|nc|nd|sa|v?[0-9]{1,2}(\.[0-9]+)*)\b")
VARIANT = " (unknown variant)"
_WORD = re.compile(r"\S+")
_EDGES = re.compile(r"^\W+|\W+$")


def words_of(text: str) -> tuple[list[str], list[int]]:
    """Words to compare and the place of each among the text's words."""
    words, places = [], []
    for i, w in enumerate(_WORD.findall(text.lower())):
        if w := _EDGES.sub("", w):
            words.append(w)
            places.append(i)
    return words, places


def wording(template: list[str], block: list[str]) -> tuple[int, int, int, list[str]]:
    """Fewest word edits from the template to any part of the block: (edits, first, end, differences).
    Of equal parts the one that ends first, and of its alignments the one with most kept words early."""
    n, m = len(template), len(block)
    cost = np.zeros((n + 1, m + 1), dtype=np.int32)
    cost[:, 0] = np.arange(n + 1)
    other = np.array(block, dtype=object)
    for i, word in enumerate(template, 1):
        row = np.minimum(cost[i - 1, :-1] + (other != word), cost[i - 1, 1:] + 1)
        cost[i, 1:] = row
        step = np.concatenate(([cost[i, 0]], row)) - np.arange(m + 1)  # insertions: a running minimum
        cost[i] = np.minimum.accumulate(step) + np.arange(m + 1)
    end = int(np.argmin(cost[n]))
    i, j, out = n, end, []
    while i:
        if j and cost[i, j] == cost[i - 1, j - 1] + (template[i - 1] != block[j - 1]):
            if template[i - 1] != block[j - 1]:
                out.append(f"{template[i - 1]} -> {block[j - 1]}")
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            out.append(f"- {template[i - 1]}")
            i -= 1
        else:
            out.append(f"+ {block[j - 1]}")
            j -= 1
    return int(cost[n, end]), j, end, out[::-1]


class Templates:
    def __init__(self, texts: dict[str, str], rate: float, level: int):
        self.names = list(texts)
        self.words = [words_of(t)[0] for t in texts.values()]
        self.budgets = [int(rate * len(w)) for w in self.words]
        self.alone = zstandard.ZstdCompressor(level=level)
        self.given = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]
        found: dict[str, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for offset, piece in pieces(words, self.budgets[t]):
                found.setdefault(f" {' '.join(piece)} ", []).append((t, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def rank(self, block: list[str]) -> list[tuple[float, int]]:
        """(share of the compressed size saved, template), most saved first."""
        raw = " ".join(block).encode()
        size = len(self.alone.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / size, t) for t, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def scan(self, text: str) -> list[dict]:
        if not len(self.automaton):
            return []
        words, places = words_of(text)
        joined = f" {' '.join(words)} "
        hits = [(t, end, size, offset) for end, (size, owners) in self.automaton.iter(joined) for t, offset in owners]
        if not hits:
            return []
        starts = np.cumsum([1, *[len(w) + 1 for w in words]])
        blocks = set()
        for t, end, size, offset in hits:
            first = int(np.searchsorted(starts, end + 2 - size)) - offset
            slack = self.budgets[t]
            blocks.add((max(0, first - slack), min(len(words), first + len(self.words[t]) + slack)))
        found: dict[tuple[int, int, int], dict] = {}
        for lo, hi in sorted(blocks):
            rejected = None
            for saved, t in self.rank(words[lo:hi]):
                edits, first, end, changes = wording(self.words[t], words[lo:hi])
                if edits > self.budgets[t]:
                    continue
                row = {"license": self.names[t], "first_word": places[lo + first], "last_word": places[lo + end - 1], "saved": saved, "edits": edits, "changes": changes}
                if not any(TELLING.search(c) for c in changes):
                    found.setdefault((t, lo + first, lo + end), row)
                    break
                rejected = rejected or ((t, lo + first, lo + end), {**row, "license": self.names[t] + VARIANT})
            else:
                if rejected:
                    found.setdefault(*rejected)
        # Of notices that overlap a confirmed one stands, then the longest, then the one with fewest changes.
        out, taken = [], np.zeros(len(words), dtype=bool)
        for (t, a, b), row in sorted(found.items(), key=lambda x: (x[1]["license"].endswith(VARIANT), x[0][1] - x[0][2], x[1]["edits"], x[0])):
            if not taken[a:b].any():
                taken[a:b] = True
                out.append(row)
        return sorted(out, key=lambda r: r["first_word"])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, rate: float = RATE, level: int = 3) -> DataFrame:
    """``doc_id, license, first_word, last_word, saved, edits, changes``: one row per notice found.

    Word places count from 0 in the text's words.  Null and empty texts hold no notice; repeated
    rows repeat theirs, null ids are reported as null, an empty table gives no rows and other
    columns are not read.  Templates (a short list, sent with the tasks) without words are nowhere.
    """
    wanted = {k: v for k, v in (templates or TEMPLATES).items() if words_of(v)[0]}
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()),
                        ("saved", pa.float64()), ("edits", pa.int32()), ("changes", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Templates(wanted, rate, level)
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"doc_id": d, **hit} for d, t in zip(batch["doc_id"].to_pylist(), batch["text"]) for hit in ready.scan(t.as_py())], schema=schema)

    return rows.mapInArrow(scan, "doc_id bigint, license string, first_word int, last_word int, saved double, edits int, changes array<string>")
