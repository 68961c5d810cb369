"""Document fingerprints by winnowing.

All k-grams of code points are hashed by a rolling polynomial (built by doubling over arrays); of every window of w hashes
the smallest is kept, the rightmost of equals, with its position. Two texts that share k + w - 1 code points in a row share
a kept hash, w being the larger of their windows. Unless w is given it is a sixteenth of the text's length, 1 at least and W
at most, so a text of 2 k code points or more shares a hash with every text that keeps its first or last half and is not
longer than it; below 2 k a half holds no whole gram. The grams are those of all lengths, so prints of any two texts compare. A text shorter than k is one gram; a text with fewer grams than a window is one window; an empty (or null)
text has no hashes. Likeness is the Jaccard similarity of the sets of hashes (1 for two empty ones).

The fingerprint as text is base64 of pairs of little-endian unsigned 32-bit numbers (hash, position).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows

K, W = 8, 48
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram (of the whole text if it is shorter)."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    power, size, block = BASE, 1, mix(codes.astype(np.uint64) + np.uint64(0x51ED27)) | np.uint64(1)
    out, done = None, 0  # out: hashes of the first ``done`` letters of each gram
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                out, done = (block[: n - size + 1], size) if out is None else (out[: n - done - size + 1] * power + block[done : n - size + 1], done + size)
            if size * 2 > k:
                break
            block = block[: n - 2 * size + 1] * power + block[size : n - size + 1]
            power, size = power * power, size * 2
        return mix(out[: n - k + 1])


def window(length: int) -> int:
    return min(W, max(1, length // 16))


def winnow(text: str | None, k: int = K, w: int | None = None) -> np.ndarray:
    """Array of kept (hash, position), by position; dtype uint32 pairs."""
    h = (rolling(np.frombuffer((text or "").encode("utf-32-le"), "<u4"), k) >> np.uint64(32)).astype(np.uint64)
    n = len(h)
    if n == 0:
        return np.empty((0, 2), "<u4")
    w = min(window(len(text)) if w is None else w, n)
    key = h << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))  # rightmost of equals: smallest key
    size = 1
    low = key
    while size * 2 <= w:
        low, size = np.minimum(low[: len(low) - size], low[size:]), size * 2
    low = np.minimum(low[: n - w + 1], low[w - size : w - size + n - w + 1])
    keep = low[np.concatenate(([True], low[1:] != low[:-1]))]
    out = np.empty((len(keep), 2), "<u4")
    out[:, 0] = keep >> np.uint64(32)
    out[:, 1] = np.uint64(0xFFFFFFFF) - (keep & np.uint64(0xFFFFFFFF))
    return out


def as_text(prints: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(prints).tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(a) + len(b) - same)


def fingerprints(df: DataFrame, k: int = K, w: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hashes and positions of every row's text, without any shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])

    def start():
        def each(doc_id, text):
            p = winnow(text, k, w)
            yield doc_id, p[:, 0].astype(np.int64), p[:, 1].astype(np.int64)

        return each

    return map_rows(id_text(df, id_col, text_col), start, schema, "doc_id long, hashes array<long>, positions array<long>", 64)


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Chain:
    """Takes the rows of slices in order and compares each with the one after it."""

    def __init__(self, k: int, w: int | None):
        self.k, self.w, self.before = k, w, None

    def __call__(self, slice_no, guest, doc_id, text):
        if self.before is None and guest:
            return  # further rows of the guest's id
        prints = winnow(text, self.k, self.w)
        hashes = np.unique(prints[:, 0])
        if self.before is not None:
            own_id, own, own_prints, own_hashes = self.before
            new = edited(own, text)
            new_prints = winnow(new, self.k, self.w)
            yield own_id, len(own), hashlib.sha256(new.encode()).hexdigest(), as_text(own_prints), as_text(new_prints), likeness(own_hashes, np.unique(new_prints[:, 0])), likeness(own_hashes, hashes)
        self.before = None if guest else (doc_id, text, prints, hashes)


def compare_with_next(df: DataFrame, k: int = K, w: int | None = None, slices: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half gives way to the head of the next document's.

    The next document is that of the next smaller doc_id; after the last the first again; rows of one doc_id follow by
    text; rows without doc_id have no place and go. Ids are cut into ``slices`` ranges at quantiles (four to each shuffle
    partition, so what the driver sees is bounded by that setting). Each range is sorted on its own and takes the first
    row of the range after it as a guest: no row needs a global order, and texts are shuffled once.
    """
    docs = id_text(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).where("doc_id is not null")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = slices or 4 * partitions
    ids = docs.select("doc_id")
    shares = [i / slices for i in range(1, slices)]
    marks = np.array(sorted({int(m) for m in ids.approxQuantile("doc_id", shares, 0.2 / slices)}) if shares else [], np.int64)

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(len(marks) - np.searchsorted(marks, values.to_numpy(), side="right")).astype("int32")

    heads = sorted((r[0], r[1]) for r in ids.withColumn("slice", place("doc_id")).groupBy("slice").agg(F.max("doc_id")).collect())
    hosts = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]  # the first one's host is the last slice
    guests = F.broadcast(df.sparkSession.createDataFrame(hosts or [(0, 0)], "doc_id long, host int"))
    spots = F.filter(F.array(F.struct(F.col("slice"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("slice"), F.lit(True).alias("guest"))), lambda x: x["slice"].isNotNull())
    dealt = docs.withColumn("slice", place("doc_id")).join(guests, "doc_id", "left").select(F.inline(spots), "doc_id", "text")
    ordered = dealt.repartition(partitions, "slice").sortWithinPartitions("slice", "guest", F.desc("doc_id"), "text")
    return map_rows(ordered.select("slice", "guest", "doc_id", "text"), lambda: Chain(k, w), OUT, DDL, 64)
