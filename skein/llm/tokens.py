"""Byte-level token ids by a public vocabulary, fast enough for whole corpora.

A text is split into the vocabulary's pieces and merged by a compiled library. Texts of more than ``CHUNK`` letters go in
parts, cut before a single space between two runs of letters, which no piece crosses. Nothing is remembered between texts.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .bpe import byte_letters
from .common import hold

#: Fixed value: the split pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 16
#: Before a space (no other white space) that stands alone between others.
BORDER = re.compile(r"(?<=\S)(?= \S)")
ODD = re.compile("[\x1c-\x1f]")


class ByteTokenizer:
    """Ids of a ``tokenizers`` file of byte-level type; equal to that library's (held by tests over whole tables)."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.library = tiktoken.Encoding("skein", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str | None, special: bool = True) -> np.ndarray:
        """Unsigned 32-bit ids; with ``special`` the strings of special tokens become their ids, as the library does."""
        if not text:
            return np.empty(0, "<u4")
        if ODD.search(text) or any(t in text for t in self.special):
            return self.library.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
        if len(text) <= CHUNK:
            return self.library.encode_to_numpy(text, disallowed_special=())
        parts, at = [], 0
        while at < len(text):
            m = BORDER.search(text, at + CHUNK)
            end = m.start() if m else len(text)
            parts.append(self.library.encode_to_numpy(text[at:end], disallowed_special=()))
            at = end
        return np.concatenate(parts)


def byte_tokenizer(path: str) -> ByteTokenizer:
    return hold(("bytes", path), lambda: ByteTokenizer(path))
