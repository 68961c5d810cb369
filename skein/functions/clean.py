"""Cleaning of scraped text (F13): wrongly decoded text is repaired, character references decoded twice, white space made one.

Runs in Arrow batches: the character references are those of the HTML standard, which the Python library holds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the Windows code page where they differ from Latin-1, by the byte; bytes that it leaves open stay as they are.
WINDOWS = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: A run that can be bytes of UTF-8 read in a one-byte code page: a lead byte and as many following ones.
FOLLOW = "[\x80-\xbf" + "".join(re.escape(c) for c in WINDOWS) + "]"
RUN = re.compile(f"(?:[\xc2-\xdf]{FOLLOW}|[\xe0-\xef]{FOLLOW}{{2}}|[\xf0-\xf4]{FOLLOW}{{3}})+")


def as_bytes(run: str) -> bytes:
    """The transducer back: each letter as the byte it was read from."""
    return bytes(WINDOWS.get(c, ord(c) & 0xFF) for c in run)


def repaired(text: str) -> str:
    """Text whose UTF-8 was read as Windows-1252 or Latin-1, as often as it was. A run is only repaired if its bytes are
    valid UTF-8, and the rest of the text stays as it is; so does text that is not encoded wrongly, unless it contains such
    a run on purpose."""

    if text.isascii():
        return text

    def back(match: re.Match) -> str:
        try:
            return as_bytes(match[0]).decode("utf-8")
        except UnicodeDecodeError:
            return match[0]

    while True:
        out = RUN.sub(back, text)
        if out == text:
            return out
        text = out


def basic_clean(text: str) -> str:
    return html.unescape(html.unescape(repaired(text))).strip()


def cleaned(text: str) -> str:
    """Repaired, decoded twice, white space of any kind made one space, in lower case."""
    return " ".join(basic_clean(text).split()).lower()


#: Texts that a task holds as Python's beside the batch they come in.
HELD = 64


def mapped(function, text: Column) -> Column:
    """A function of one text over Arrow batches, some ``HELD`` texts at a time; null stays null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, max(1, len(batch)), HELD):
                yield pa.array([None if x is None else function(x) for x in batch.slice(at, HELD).to_pylist()], pa.string())

    return run(text)


def repair_encoding(text: Column) -> Column:
    """the first step alone."""
    return mapped(repaired, text)


def lowered(text: str) -> str:
    """Lower case of every letter by itself, as SQL's lower() has it: Python's knows a sigma at a word's end and makes two of İ."""
    return text.replace("İ", "i").replace("Σ", "σ").lower()


def clean_text(text: Column, references: dict[str, str] | None = None) -> Column:
    """all steps. Null stays null, an empty text is empty. With ``references`` as far as SQL can follow: these alone
    are decoded, as they are spelled, nothing is repaired, and letters are lowered one by one."""
    if references is None:
        return mapped(cleaned, text)
    spelled = re.compile("|".join(re.escape(x) for x in sorted(references, key=len, reverse=True)))

    def once(x: str) -> str:
        return spelled.sub(lambda match: references[match[0]], x)

    return mapped(lambda x: lowered(" ".join(once(once(x)).split())), text)
