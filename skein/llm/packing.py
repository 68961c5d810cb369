"""Cost-balanced packing of documents into training sequences.

A piece of n tokens is taken to cost ``linear * n + quadratic * n**2`` (feed-forward and attention). Documents are cut
freely: whole sequences first; the rests of a pool of documents are then dealt out in descending length, each to the
sequence of lowest cost that has room for it. What fits nowhere is cut over the roomiest sequences.

A pool (``pool`` sequences) is packed as a task meets its documents, and only into full sequences: its shortest rests, and a
part of one, wait for the next pool. What still waits at the end of a task is less than a pool; all tasks' waiting rests are
dealt out over as few tasks as they fill pools, and packed there in the same way. Only at the end of these do the tokens
that do not fill a sequence go to sequences of power-of-two lengths, which are never padded, so nothing is. So there are at
most 11 short sequences for every ``pool`` sequences of what waited, however many partitions the input comes in.

Sequence ids are the task's number and a count within it. Null text counts as empty; an empty document is its end token
alone; a very long text fills many sequences; repeated rows are packed like any others; rests of equal length are taken in
the order in which they came; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows, shared_folder, vocabulary
from .tokens import byte_tokenizer

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def deal(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Deal rests (each shorter than ``size``) into sequences: lists of (index, from, length), and their lengths.

    All but the last sequences are full; the last few have power-of-two lengths.
    """
    total = int(lengths.sum())
    full, left = divmod(total, size)
    caps = [size] * full + [1 << k for k in range(size.bit_length() - 1, -1, -1) if left >> k & 1]
    room, cost = np.array(caps, np.int64), np.zeros(len(caps))
    out: list[list[tuple[int, int, int]]] = [[] for _ in caps]

    def put(item: int, at: int, n: int, where: int) -> None:
        out[where].append((item, at, n))
        room[where] -= n
        cost[where] += linear * n + quadratic * n * n

    late = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(item, 0, n, int(fits[np.argmin(cost[fits])]))
        else:
            late.append((item, n))
    for item, n in late:
        at = 0
        while at < n:
            where = int(np.argmax(room))
            take = min(n - at, int(room[where]))
            put(item, at, take, where)
            at += take
    return out, caps


class Packer:
    """Packs one task's documents; ``finish`` gives what is still pooled: with ``last`` in sequences, else as it is."""

    def __init__(self, ids_of, size: int, end_id: int, pool: int, linear: float, quadratic: float, first: int, last: bool = True):
        self.ids_of, self.size, self.end, self.pool, self.linear, self.quadratic, self.next, self.last = ids_of, size, end_id, pool, linear, quadratic, first, last
        self.rests: list[tuple[int, int, int, np.ndarray]] = []  # doc_id, start, tokens of the document, ids
        self.held = 0

    def __call__(self, doc_id, text):
        ids = np.append(self.ids_of(text), np.uint32(self.end)).astype("<u4")
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            yield doc_id, at, self.size, zlib.crc32(ids[at : at + self.size].tobytes()), len(ids), self.next, 0, None
            self.next += 1
        if whole < len(ids):
            yield from self.hold(doc_id, whole, len(ids), ids[whole:].copy())

    def hold(self, doc_id, start: int, tokens: int, ids: np.ndarray):
        self.rests.append((doc_id, start, tokens, ids))
        self.held += len(ids)
        if self.held >= self.pool * self.size:
            waiting = self.set_aside(self.held % self.size)
            yield from self.packed()
            self.rests, self.held = waiting, sum(len(r[3]) for r in waiting)

    def set_aside(self, n: int) -> list[tuple[int, int, int, np.ndarray]]:
        """Takes ``n`` tokens out of the pool: its shortest rests, and the last ids of the next one."""
        order, out = sorted(range(len(self.rests)), key=lambda i: -len(self.rests[i][3])), []
        while n:
            at = order.pop()
            doc_id, start, tokens, ids = self.rests[at]
            if len(ids) <= n:
                out.append(self.rests[at])
                self.rests[at] = None
                n -= len(ids)
            else:
                keep = len(ids) - n
                out.append((doc_id, start + keep, tokens, ids[keep:].copy()))
                self.rests[at] = (doc_id, start, tokens, ids[:keep])
                n = 0
        self.rests = [r for r in self.rests if r is not None]
        return out

    def packed(self):
        sequences, _ = deal(np.array([len(r[3]) for r in self.rests], np.int64), self.size, self.linear, self.quadratic)
        for pieces in sequences:
            offset = 0
            for item, at, n in pieces:
                doc_id, start, tokens, ids = self.rests[item]
                yield doc_id, start + at, n, zlib.crc32(ids[at : at + n].tobytes()), tokens, self.next, offset, None
                offset += n
            self.next += 1

    def finish(self):
        if self.rests and self.last:
            yield from self.packed()
        elif self.rests:
            for doc_id, start, tokens, ids in self.rests:
                yield doc_id, start, len(ids), None, tokens, None, None, ids.tobytes()
        self.rests, self.held = [], 0


def task() -> int:
    return TaskContext.get().partitionId() if TaskContext.get() else 0


def pack(df: DataFrame, size: int = 2048, path: str | None = None, end_id: int = 1, pool: int = 512, linear: float = 1.0, quadratic: float = 1 / 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document, with its sequence and its place there. Two tables in the shared folder hold
    what is packed and what waited; texts are tokenized once."""
    spark, path = df.sparkSession, path or vocabulary("byte_bpe_50k.json")
    kept, wide = shared_folder(spark, "packed"), f"{DDL}, ids binary"
    schema = pa.schema([*SCHEMA, ("ids", pa.binary())])

    def start():
        t = byte_tokenizer(path)
        return Packer(t.ids, size, end_id, pool, linear, quadratic, task() << 40, last=False)

    def again():
        packer = Packer(None, size, end_id, pool, linear, quadratic, (1 << 62) + (task() << 40))

        class Late:
            def __call__(self, doc_id, begin, tokens, ids):
                return packer.hold(doc_id, begin, tokens, np.frombuffer(ids, "<u4"))

            def finish(self):
                return packer.finish()

        return Late()

    map_rows(id_text(df, id_col, text_col), start, schema, wide, 4096).write.parquet(kept)
    found = spark.read.schema(wide).parquet(kept)
    waiting = found.where("ids is not null")
    tasks = -(-(waiting.agg(F.sum("length")).first()[0] or 0) // (pool * size))
    out = found.where("ids is null").drop("ids")
    if not tasks:
        return out
    late = map_rows(waiting.select("doc_id", "start", "doc_tokens", "ids").repartition(tasks), again, schema, wide, 4096)
    return out.unionByName(late.drop("ids"))
