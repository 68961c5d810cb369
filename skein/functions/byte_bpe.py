"""Byte-level pair encoding of captions to a fixed length (F14), with any list of merges.

A word's neighbouring pairs wait in a queue by rank and place; the best pair merges, its neighbours get new pairs, pairs that
are no more are passed over. So a word of n bytes takes n log n steps, however long it is. Short words do without the queue.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import cleaned

# The pattern of words, the end of a word, and the two special tokens.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
SPECIAL = ["<start_of_text>", "<end_of_text>"]
#: Bytes of a word whose pairs are listed instead of queued.
SHORT = 64
#: Words that a task remembers.
REMEMBERED = 1 << 16


def byte_letters() -> dict[int, str]:
    """A letter for every byte: printable Latin-1 ones stand for themselves, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    """``merges`` are pairs in order of rank; ids: letters in the order of ``byte_letters``, those with the word's end,
    merged pairs by rank, then the special tokens."""

    def __init__(self, merges: Iterable[tuple[str, str]], special: list[str] | None = None):
        self.letters = byte_letters()
        merges, self.special = list(merges), [*SPECIAL, *(special or [])]
        vocabulary = [*self.letters.values(), *(x + END for x in self.letters.values()), *(a + b for a, b in merges), *self.special]
        self.ids = {x: k for k, x in enumerate(vocabulary)}
        self.tokens = vocabulary
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.bytes = {v: k for k, v in self.letters.items()}
        self.pattern = regex.compile("|".join(map(regex.escape, self.special)) + "|" + WORD, regex.IGNORECASE)
        self.written = [bytes(self.bytes[c] for c in x) if self.bytes.keys() >= set(x) else x.encode() for x in self.tokens]
        self.word = lru_cache(REMEMBERED)(self._word)
        self.stretch = lru_cache(REMEMBERED)(self._stretch)
        self.apart = not any(" " in x for x in self.special)
        self.marked = not any(x.isalpha() for x in self.special)
        self.start, self.end = self.ids[SPECIAL[0]], self.ids[SPECIAL[1]]

    def _word(self, word: str) -> tuple[int, ...]:
        parts: list[str | None] = [self.letters[b] for b in word.encode()]
        parts[-1] += END
        return self._short(parts) if len(parts) <= SHORT else self._long(parts)

    def _short(self, parts: list[str]) -> tuple[int, ...]:
        """The ranks of all neighbouring pairs in a list, the first of the lowest merges: least work for few of them."""
        get, none = self.rank.get, len(self.rank)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return tuple(self.ids[p] for p in parts)

    def _long(self, parts: list[str | None]) -> tuple[int, ...]:
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (rank := self.rank.get((parts[i], parts[j]))) is not None:
                heapq.heappush(queue, (rank, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one of the two has merged since
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return tuple(self.ids[p] for p in parts if p is not None)

    def _stretch(self, text: str) -> tuple[int, ...]:
        if self.marked and text.isascii() and text.isalpha():
            return self.word(text)  # one word, without a search
        out: list[int] = []
        for word in self.pattern.findall(text):
            if word in self.special:
                out.append(self.ids[word])
            else:
                out.extend(self.word(word))
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """No word has a space in it, so what stands between spaces is looked up as a whole."""
        text = cleaned(text)
        if not self.apart:
            return list(self._stretch(text))
        return list(chain.from_iterable(self.stretch(x) if len(x) < 64 else self._stretch(x) for x in text.split(" ")))

    def decode(self, ids: Iterable[int]) -> str:
        """Words with a space behind each; special tokens as they are written."""
        return b"".join([self.written[i] for i in ids]).decode("utf-8", errors="replace").replace(END, " ")

    def padded(self, ids: list[int], length: int = 77) -> list[int]:
        """With start and end, cut to ``length`` with the end forced, then zeros."""
        whole = [self.start, *ids, self.end]
        if len(whole) > length:
            whole = [*whole[: length - 1], self.end]
        return whole + [0] * (length - len(whole))


def merges_of(path: str) -> list[tuple[str, str]]:
    """The merges of a tokenizers file (JSON), or of a text with one pair to a line below a line of its own."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.load(f)["model"]["merges"]]
        return [tuple(line.split()) for line in f.read().split("\n")[1:] if len(line.split()) == 2]


_built: dict = {}


def encoded(df: DataFrame, key: str, text: str, merges: str, length: int = 77) -> DataFrame:
    """per row its key (a long), n (ids without start and end), ids (start, ids, end, to ``length``) and decoded (all
    ids back to text). ``merges`` is a file that every executor can read. Null text is empty. Rows are taken a few at a
    time, so long texts do not pile up."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if merges not in _built:
            _built[merges] = ByteBpe(merges_of(merges))
        bpe = _built[merges]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for k, x in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    ids = bpe.encode(x or "")
                    rows.append((k, len(ids), bpe.padded(ids, length), bpe.decode(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out = df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "key bigint, n bigint, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)
