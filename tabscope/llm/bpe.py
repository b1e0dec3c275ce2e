"""Byte-pair encoding and decoding with word ends, sharing the work of common word beginnings.

Each batch's distinct words go into a trie (kept as sorted order: a word shares the states of its
longest common beginning with the word before).  Going down one symbol finds the *last token* of
the encoding so far: the token that ends there and may follow the encoding of what is before it.
Two tokens may stand side by side if merging their symbols alone gives those two tokens again, so
the last token of every prefix fixes its whole encoding and a shared prefix is encoded once.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Words kept between batches of one task; the store is emptied when full.
KNOWN = 400_000
#: Pairs of tokens kept as checked.
KNOWN_PAIRS = 500_000
#: Characters handled at a time.
SLICE = 1 << 22
END = "</w>"
#: Stretches of ASCII and of the letters À to ÿ: normal form, case and splitting are plain there.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Vocabulary:
    """Tokens and merges of a tokenizer file, with the last-token step of the trie."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec["decoder"] is not None:
            raise ValueError("a BPE file with word ends and no decoder is wanted")
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match exactly")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        whole = Tokenizer.from_str(source)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.text = {i: t for t, i in (self.ids | self.special).items()}
        size = max(self.text) + 1
        self.shift = size.bit_length()
        #: How each token is made: its merge's rank (-1 for a symbol) and the two tokens it joins.
        self.made, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right, whole_id = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault(left << self.shift | right, rank)
            if self.made[whole_id] < 0:
                self.made[whole_id], self.left[whole_id], self.right[whole_id] = rank, left, right
        # Only tokens that their own symbols merge to can come out of an encoding.
        sound = {i: True for i in self.ids.values() if self.made[i] < 0}
        for i in sorted(self.ids.values(), key=self.made.__getitem__):
            if i not in sound:
                sound[i] = sound[self.left[i]] and sound[self.right[i]] and self._apart(self.left[i], self.right[i], self.made[i])
        self.inner = {t: i for t, i in self.ids.items() if sound[i] and not t.endswith(END)}
        self.final = {t.removesuffix(END): i for t, i in self.ids.items() if sound[i] and t.endswith(END)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        # Bytes as the splitter writes them: printable Latin-1 stands for itself, the rest follows from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = itertools.count(256)
        self.bytes = {b: chr(b if b in shown else next(spare)) for b in range(256)}
        self._pairs: dict[int, bool] = {}

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge below rank ``limit`` crosses the border of two tokens: the tokens' last
        merges at the border are undone, latest first, and the pair met there must not come earlier."""
        none = len(self.rank) + 1
        while True:
            if self.rank.get(left << self.shift | right, none) < limit:
                return False
            a, b = self.made[left], self.made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left, limit = self.right[left], a
            else:  # of equal merges the one further left comes first, so a crossing one would win
                right, limit = self.left[right], b + 1

    def beside(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side."""
        key = left << self.shift | right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= KNOWN_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(left, right, len(self.rank) + 1)
        return known

    def last_token(self, word: str, end: int, usable: dict[str, int], states: list[tuple[int, int]]) -> tuple[int, int]:
        """The last token of ``word[:end]`` and where it begins; ``states`` holds those of shorter prefixes."""
        for begin in range(max(0, end - self.longest), end):
            token = usable.get(word[begin:end])
            if token is not None and (not begin or self.beside(states[begin][0], token)):
                return token, begin
        raise ValueError(f"no encoding for {word[:end]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words: one depth-first walk over their trie."""
        out, before, states = {}, "", [(-1, 0)]
        for word in sorted(words):
            most = min(len(before), len(word)) - 1  # a word's last symbol is no inner node
            shared = 0
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(word)):
                states.append(self.last_token(word, end, self.inner, states))
            token, at = self.last_token(word, len(word), self.final, states)
            ids = [token]
            while at:
                token, at = states[at]
                ids.append(token)
            out[word] = tuple(ids[::-1])
            before = word
        return out

    def split(self, chunk: str) -> list[str | int]:
        """Words of a stretch without ASCII white space; an added token stands as its id."""
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            low = chunk.lower()
            if low.isascii():
                return [low] if low.isalpha() else _PARTS.findall(low)
            return [w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes) for w in _PARTS.findall(low)]
        out: list[str | int] = []
        for piece in self.cut.split(chunk) if self.cut else [chunk]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece)) if w]
        return out


class Encoder:
    """Encodes stretches of text, remembering those in use: two generations, the older goes when full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known, self.older = vocabulary, {}, {}

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        known, older, fresh = self.known, self.older, []
        for chunk in chunks:
            if chunk not in known:
                if (ids := older.get(chunk)) is None:
                    fresh.append(chunk)
                else:
                    known[chunk] = ids
        split = [self.vocabulary.split(c) for c in fresh]
        words = self.vocabulary.encode_words({w for parts in split for w in parts if type(w) is str})
        for chunk, parts in zip(fresh, split):
            ids = words[parts[0]] if len(parts) == 1 and type(parts[0]) is str else [i for p in parts for i in (words[p] if type(p) is str else (p,))]
            known[chunk] = pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts whose words are learnt at once."""
        parts = [_SPACE.split(t) for t in texts]
        self.learn({c for p in parts for c in p if c})
        self.known[""] = b""
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]

    def encode_long(self, text: str) -> bytes:
        """One very long text, a slice at a time; slices end at white space."""
        out, at = [], 0
        while at < len(text):
            found = _SPACE.search(text, at + SLICE)
            stop = found.end() if found else len(text)
            out += self.encode([text[at:stop]])
            at = stop
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.vocabulary.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def encode_documents(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids again: ``doc_id, ids, decoded``.

    ``ids`` are little-endian unsigned 32-bit numbers.  A null text counts as empty: no ids and an
    empty text.  Rows are independent, so repeated rows and null ids just repeat; an empty table
    gives no rows; other columns are not read.  The vocabulary file, whose size is fixed, is read
    by the driver and goes with the tasks.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(source.value))
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = [batch["text"][lo].as_py()]
                size = len(part[0])
                while lo + len(part) < batch.num_rows and size < SLICE:
                    part.append(batch["text"][lo + len(part)].as_py())
                    size += len(part[-1])
                ids = [encoder.encode_long(part[0])] if len(part) == 1 else encoder.encode(part)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:lo + len(part)], pa.array(ids, pa.binary()),
                                                  pa.array(map(encoder.decode, ids), pa.string())], schema=_OUT)
                lo += len(part)

    return rows.mapInArrow(encode, "doc_id bigint, ids binary, decoded string")
