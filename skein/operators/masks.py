"""Which tokens of a conversation are predicted: turn-wise masks by template (Q14). Spans behind a marker are in sequences.

Labels are the ids with ``IGNORE`` where nothing is predicted. All is expressions over arrays in a row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conversation import Template
from .sequences import IGNORE, bound, within


@dataclass(frozen=True)
class PatternTokenizer:
    """A stand-in tokenizer that other engines can follow: matches of a pattern, ids from the first 28 bits of their MD5.
    ``begin`` is a token that is put in front of every text, as some tokenizers do; ``dropped`` is read as a space."""

    pattern: str
    begin: int | None = None
    dropped: str | None = None

    def tokens(self, text: Column) -> Column:
        return F.regexp_extract_all(F.replace(text, F.lit(self.dropped), F.lit(" ")) if self.dropped else text, F.lit(self.pattern), F.lit(0))

    def ids(self, text: Column) -> Column:
        own = F.transform(self.tokens(text), lambda w: F.conv(F.substr(F.md5(w.cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("int"))
        return own if self.begin is None else F.concat(F.array(F.lit(self.begin)), own)

    def length(self, text: Column) -> Column:
        return F.size(self.tokens(text)) + int(self.begin is not None)


def literal_split(text: Column, sep: str) -> Column:
    return F.split(text, rf"\Q{sep}\E", -1)


def rounds_of(prompt: Column, t: Template) -> tuple[Column, str, int, int]:
    """Rounds of a rendered prompt, what stands between instruction and answer, how many of the instruction's last tokens
    are predicted after all, and how many tokens stand before the first round."""
    if t.style == "two":
        return literal_split(prompt, t.sep2), f"{t.sep}{t.assistant}: ", 2, 1
    if t.style == "mpt":
        parts, later = literal_split(prompt, t.sep), F.array().cast("array<string>")
        pairs = F.when(F.size(parts) > 3, F.transform(F.sequence(F.lit(3), F.size(parts) - 1, F.lit(2)), lambda i: F.array_join(F.slice(parts, i + 1, F.lit(2)), t.sep))).otherwise(later)
        return F.concat(F.array(F.array_join(F.slice(parts, 1, 3), t.sep)), pairs), t.sep + t.assistant, 1, 0
    raise ValueError(f"no turn-wise masks for {t.style}")


def turn_spans(prompt: Column, total: Column, t: Template, length: Callable[[Column], Column], most: int, after_first: int = 0) -> Column:
    """Q14: array of (from, to) that are predicted, from the walk over rounds.

    A round adds as many tokens as it has on its own; its instruction is not predicted. The walk ends at an empty round and
    at one that does not have exactly one answer. If the lengths do not add up to the sequence's, and the sequence was not
    cut at ``most``, nothing is predicted. ``after_first`` is added to both lengths from the second round on, for tokenizers
    that count a text's beginning differently."""
    rounds, sep, back, start = rounds_of(prompt, t)
    indexed = F.transform(rounds, lambda r, i: F.struct(r.alias("r"), literal_split(r, sep).alias("parts"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        parts = x["parts"]
        more = F.when(x["i"] > 0, after_first).otherwise(0)
        goes_on = acc["open"] & (x["r"] != "") & (F.size(parts) == 2)
        n, own = length(x["r"]) + more, length(F.concat(F.get(parts, F.lit(0)), F.lit(sep))) - back + more
        span = F.struct((acc["at"] + F.greatest(own, F.lit(0))).alias("a"), (acc["at"] + n).alias("b"))
        return F.when(goes_on, F.struct((acc["at"] + n).alias("at"), F.lit(True).alias("open"), F.concat(acc["spans"], F.array(span)).alias("spans"))).otherwise(F.struct(acc["at"].alias("at"), F.lit(False).alias("open"), acc["spans"].alias("spans")))

    none = F.array().cast("array<struct<a:int,b:int>>")
    walked = F.aggregate(indexed, F.struct(F.lit(start).alias("at"), F.lit(True).alias("open"), none.alias("spans")), step)
    return bound(walked, lambda w: F.when((w["at"] < most) & (w["at"] != total), none).otherwise(w["spans"]))


def turn_labels(prompt: Column, t: Template, tokenizer: PatternTokenizer, most: int, after_first: int = 0) -> Column:
    """Q14: labels of a rendered prompt, cut at ``most`` tokens."""
    return bound(F.slice(tokenizer.ids(prompt), 1, most), lambda ids: within(ids, turn_spans(prompt, F.size(ids), t, tokenizer.length, most, after_first)))


def signal_labels(ids: Column, header: Column, lengths: Column, speakers: Column) -> Column:
    """Q14 for prompts with a signal before each speaker: the header is not predicted, nor is what a human says, but for
    the two tokens of the signal. ``lengths`` are of the turns behind the header."""
    turns = F.arrays_zip(lengths.alias("n"), speakers.alias("who"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["n"]
        hidden = F.when(x["who"] == "human", F.array(F.struct((acc["at"] + 2).alias("a"), end.alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
        return F.struct(end.alias("at"), F.concat(acc["hidden"], hidden).alias("hidden"))

    first = F.array(F.struct(F.lit(0).alias("a"), header.cast("int").alias("b")))
    walked = F.aggregate(turns, F.struct(header.cast("int").alias("at"), first.alias("hidden")), step)["hidden"]
    return bound(walked, lambda hidden: F.transform(ids, lambda x, i: F.when(F.exists(hidden, lambda s: (i >= s["a"]) & (i < s["b"])), IGNORE).otherwise(x)))
