"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token the last token of that prefix's encoding is unique. An automaton over the vocabulary
(a trie with suffix links) lists, at each position, the tokens that are suffixes of the prefix; of those, exactly one can
stand after the stored last token of the shorter prefix, as a pair test tells. Following the stored tokens back from the
end gives the ids that repeated merging would give.

Nulls count as empty text. Empty text has no ids. An empty table gives no rows. Whole texts are encoded, a row at a time: a
very long text needs memory for itself and its ids, and the memories of words that a worker keeps are bounded in bytes (long
words are not kept). There are no ties: the ids are unique. Repeated rows give repeated results; other columns pass by.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, hold, id_text, map_rows, vocabulary

#: Stands for the end-of-word suffix inside the automaton; a private character that byte-level text never holds.
END = ""
#: The split pattern and the white space it means (as its regular expression library defines \s).
SPACE = "\t-\r\x20\x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


def unassigned() -> np.ndarray:
    """For each code point whether ``unicodedata`` does not know it yet."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder and decoder for one vocabulary of the ``tokenizers`` format with word ends; ``most`` and ``most_bytes`` bound each memory of words."""

    def __init__(self, path: str, most: int = 500_000, most_bytes: int = 96 << 20):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = {self._inner(t): i for t, i in model["vocab"].items()}
        self.strings = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: t for t, i in self.special.items()}
        self.special_split = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        n = 1 + max(self.strings)
        if n > 1 << 16:
            raise ValueError("pairs of ids are packed into 32 bits")
        self.size = [len(self._inner(self.strings.get(i, ""))) for i in range(n)]
        self.parts: dict[int, tuple[int, int, int]] = {}  # of each merged token: left, right, rank
        self.rank: dict[int, int] = {}  # by left * 2**16 + right
        for rank, merge in enumerate(model["merges"]):
            left, right = (self._inner(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            x, y, z = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank.setdefault(x << 16 | y, rank)
            self.parts.setdefault(z, (x, y, rank))
        #: The highest rank among a token's merges: merging reaches the token when it has come so far. -1 for single letters.
        self.level = [-1] * n
        for z, (x, y, rank) in sorted(self.parts.items(), key=lambda kv: self.size[kv[0]]):
            self.level[z] = max(rank, self.level[x], self.level[y])
        self.left_edge = [self._edge(i, 0) for i in range(n)]
        self.right_edge = [self._edge(i, 1) for i in range(n)]
        self.automaton = ahocorasick.Automaton()
        whole: dict[int, bool] = {}
        for token, i in sorted(self.ids.items(), key=lambda kv: len(kv[0])):
            x, y, _ = self.parts.get(i, (-1, -1, 0))
            whole[i] = x < 0 or (whole[x] and whole[y] and self._crossing(x << 16 | y) == (x, y))
            if whole[i]:  # others never end a merging, so no encoding holds them
                self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.letter = byte_letters()
        self.words = regex.compile(WORDS)
        #: Of code points that are newer than this interpreter, the library alone knows case, class and normal form.
        self.unknown = unassigned()
        self.path, self._library = path, None
        self.fits = Memo(lambda pair: self._crossing(pair) is None, 500_000)
        self.word = Memo(self._word, most, most_bytes)
        self.chunk = Memo(self._chunk, most, most_bytes)

    def _inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else token

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that lie at one edge of a token while it is being merged, first letter first, each with the level and
        rank of the merge that takes it in (beyond all others for the token itself)."""
        out = [(token, 1 << 40, 1 << 40)]
        while token in self.parts:
            taken = (self.level[token], self.parts[token][2])
            token = self.parts[token][side]
            out.append((token, *taken))
        return out[::-1]

    def _crossing(self, pair: int) -> tuple[int, int] | None:
        """The first two tokens that would merge across the border of a pair when its letters are merged; None: the pair
        stands. Merging goes by rank once both sides exist, the left one of equals first."""
        a, b = self.right_edge[pair >> 16], self.left_edge[pair & 0xFFFF]
        i = j = 0
        while True:
            x, x_level, x_rank = a[i]
            y, y_level, y_rank = b[j]
            r = self.rank.get(x << 16 | y)
            if r is not None:
                at = max(r, self.level[x], self.level[y])
                if (at, r) < (x_level, x_rank) and (at, r) <= (y_level, y_rank):
                    return x, y
            if i + 1 == len(a) and j + 1 == len(b):
                return None
            if (x_level, x_rank) <= (y_level, y_rank):
                i += 1
            else:
                j += 1

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token (already in byte letters, with END after it if the vocabulary marks word ends)."""
        n, fits, size = len(word), self.fits, self.size
        last = [-1] * (n + 1)
        if word[-1] == END:
            last[n - 1] = -2  # the letter before END is only ever a token together with it
        for at, token in self.automaton.iter(word):
            at += 1
            if last[at] == -1:
                begin = at - size[token]
                if not begin or ((before := last[begin]) >= 0 and fits[before << 16 | token]):
                    last[at] = token
        out = []
        while n:
            token = last[n]
            out.append(token)
            n -= size[token]
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[str, str, int]:
        return self._letters(word if word.isascii() and word.isalpha() else "".join([self.letter[b] for b in word.encode()]))

    def _letters(self, plain: str) -> tuple[str, str, int]:
        ids = self.encode_word(plain + END if self.suffix else plain)
        return " ".join(map(str, ids)), " ".join([self.strings[i] for i in ids]), len(ids)

    def _chunk(self, chunk: str) -> tuple[str, str, int]:
        """Of a run without white space: ids as text, tokens as text, number of ids."""
        if chunk.isascii() and chunk.isalpha():
            return self._word(chunk)
        words = [self.word[w] for w in self.words.findall(chunk)]
        return " ".join([w[0] for w in words]), " ".join([w[1] for w in words]), sum([w[2] for w in words])

    def _runs(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # sigma: by character, whatever follows
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
        return [r for r in re.split(f"[{SPACE}]+", text) if r]

    def _parts(self, text: str) -> list[tuple[str, str, int]]:
        """Of a text without special tokens."""
        if text.isascii() or not self.unknown[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            chunk = self.chunk
            return [chunk[r] for r in self._runs(text)]
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [self._letters(word) for word, _ in split]

    def pieces(self, text: str) -> list[tuple[str, str, int]]:
        out, at = [], 0
        for m in self.special_split.finditer(text) if self.special_split else ():
            out += self._parts(text[at : m.start()])
            out.append((str(self.special[m[0]]), m[0], 1))
            at = m.end()
        out += self._parts(text[at:] if at else text)
        return [x for x in out if x[2]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text or "") for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The format names no decoder for this vocabulary: tokens are joined by one space."""
        return " ".join(self.strings[i] for i in ids)


def encoder(path: str) -> PrefixEncoder:
    return hold(("prefixes", path), lambda: PrefixEncoder(path))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (text) for every row."""
    path = path or vocabulary("word_bpe_49k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def start():
        e = encoder(path)

        def each(doc_id, text):
            ids = e.encode(text)
            yield doc_id, ids, e.decode(ids)

        return each

    return map_rows(id_text(df, id_col, text_col), start, schema, "doc_id long, ids array<int>, decoded string", 64)


def digest_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, without moving ids between processes."""
    path = path or vocabulary("word_bpe_49k.json")

    def start():
        e, sha = encoder(path), hashlib.sha256

        def each(doc_id, text):
            p = e.pieces(text or "")
            yield doc_id, sum(x[2] for x in p), sha(" ".join([x[0] for x in p]).encode()).hexdigest(), sha(" ".join([x[1] for x in p]).encode()).hexdigest()

        return each

    return map_rows(id_text(df, id_col, text_col), start, SCHEMA, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
