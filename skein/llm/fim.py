"""Fill-in-middle transformation: texts cut at two of their units and put in another order.

Units (lines, words) are what a small automaton begins while it reads code points. Nothing is read one after the other: every
stretch of a text emits the function from the state it is entered in to the state it is left in, and for each entry state how
many units begin in it. Such functions compose associatively, so entry states and counts follow from a scan over stretches,
and a cut is found in the one stretch where the count passes it.

Stretches are lanes of 256 code points, all lanes of many texts being read at once, and above them pieces of 65,536: a text
of one piece is done in place; longer ones are dealt out by the piece, the pieces' functions compose by document, and the
document is told in which piece, in which state and after how many more units each cut lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

LANE, PIECE = 256, 65_536
#: Code points and texts of one numpy call.
MOST_POINTS, MOST_TEXTS = 1 << 20, 512


@dataclass(frozen=True)
class Automaton:
    """``classes`` maps code points to classes 0, 1, ...; ``step[c][q]`` is the state after class c in state q and
    ``begins[c][q]`` whether a unit begins there. State 0 is the first."""

    classes: Callable[[np.ndarray], np.ndarray]
    step: tuple
    begins: tuple

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """With one more class that changes nothing: what fills up a lane."""
        states = len(self.step[0])
        return np.array([*self.step, range(states)], np.int64), np.array([*self.begins, [0] * states], np.int64)


#: Units ``[^\n]*\n|[^\n]+``: state 1 is inside a line.
LINES = Automaton(lambda points: points == 10, ((1, 1), (0, 0)), ((1, 0), (1, 0)))
#: Units are words with the white space behind them, the first one with what is before it too: state 1 is inside a word, 2 in
#: white space that opens the text, 3 in white space behind a word.
WORDS = Automaton(lambda points: np.isin(points, (9, 10, 11, 12, 13, 32)), ((1, 1, 1, 1), (2, 3, 2, 3)), ((1, 0, 0, 1), (1, 0, 0, 0)))


class Scan:
    """Texts read at once: their units (``totals``) and places where units begin."""

    def __init__(self, texts: list[str], automaton: Automaton):
        step, begins = self.step, self.begins = automaton.tables()
        states = self.states = step.shape[1]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        lanes = -(-self.lengths // LANE)
        self.lanes, self.first = lanes, np.concatenate([[0], np.cumsum(lanes)])
        cells = np.full(int(self.first[-1]) * LANE, len(step) - 1, np.uint8)
        for text, at in zip(texts, self.first, strict=False):
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            cells[at * LANE : at * LANE + len(points)] = automaton.classes(points)
        self.cells = cells.reshape(-1, LANE)
        to = np.tile(np.arange(states), (len(self.cells), 1))
        count = np.zeros_like(to)
        for column in np.ascontiguousarray(self.cells.T):
            at = column[:, None]
            count += begins[at, to]
            to = step[at, to]
        # Inclusive scan within each text: the lanes before, doubled in every round, then this one.
        start, index, reach = np.repeat(self.first[:-1], lanes), np.arange(len(to)), 1
        while reach < int(lanes.max(initial=0)):
            on = np.flatnonzero(index - reach >= start)
            before = to[on - reach]
            new_to, new_count = np.take_along_axis(to[on], before, 1), count[on - reach] + np.take_along_axis(count[on], before, 1)
            to[on], count[on] = new_to, new_count
            reach *= 2
        self.to, self.count, self.start = to, count, start

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """By text and entry state: the state it is left in, and how many units begin."""
        last = self.first[1:] - 1
        some = (self.lanes > 0)[:, None]
        return np.where(some, self.to[last], np.arange(self.states)) if len(self.to) else np.tile(np.arange(self.states), (len(self.lanes), 1)), np.where(some, self.count[last], 0) if len(self.to) else np.zeros((len(self.lanes), self.states), np.int64)

    def find(self, text: np.ndarray, entry: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Where the unit begins that follows ``skip`` others, in texts entered in the given states; a text's length if there
        is none. One more reading of the lanes concerned."""
        place = self.lengths[text].copy()
        if not len(self.to):
            return place
        total = self.functions()[1][text, entry]
        for q in range(self.states):
            on = np.flatnonzero((entry == q) & (skip < total))
            if not len(on):
                continue
            sums = self.count[:, q]
            base = np.concatenate([[0], np.cumsum(np.where(self.lanes > 0, sums[self.first[1:] - 1], 0))])
            upto = sums + np.repeat(base[:-1], self.lanes)
            lane = np.searchsorted(upto, base[text[on]] + skip[on], side="right")
            inner = lane > self.first[text[on]]
            state = np.where(inner, self.to[lane - 1, q], q)
            left = skip[on] - np.where(inner, sums[lane - 1], 0)
            found = np.full(len(on), -1)
            for j, column in enumerate(np.ascontiguousarray(self.cells[lane].T)):
                begin = self.begins[column, state]
                found = np.where((found < 0) & (begin == 1) & (left == 0), j, found)
                left, state = left - begin, self.step[column, state]
            place[on] = (lane - self.first[text[on]]) * LANE + found
        return place


def cut_places(texts: list[str], draws: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and the two places where it is cut: draws are two numbers each, taken modulo units and one."""
    scan = Scan(texts, automaton)
    n = scan.functions()[1][:, 0]
    after = np.sort(draws % (n + 1)[:, None], axis=1)
    who, zero = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    return n, np.stack([scan.find(who, zero, after[:, 0]), scan.find(who, zero, after[:, 1])], axis=1)


def arranged(text: str, form: str, a: int, b: int, markers: tuple[str, str, str]) -> str:
    p, s, m = markers
    if form == "psm":
        return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"
    return f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}" if form == "spm" else text


def restored(form: Column, output: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text behind an output. It had none of the markers, so they part the output."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    return F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))).when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))).otherwise(output)


OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
DDL = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", automaton: Automaton = LINES, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"), piece: int = PIECE) -> DataFrame:
    """Per row doc_id, n (units), form, prefix_chars, middle_chars and output.

    Draws are the first four 8-digit groups of the SHA-256 of ``seed:doc_id``: the prefix ends after the smaller of two draws
    modulo n + 1, the middle after the larger; the third says whether a text is left plain, the fourth whether it is spm or
    psm. Null text is empty; empty texts, texts with a marker and rows without doc_id stay plain (null lengths). Every row is
    on its own: repeated rows come back each, extra columns of any name are ignored, no rows give no rows. A text of more
    than ``piece`` code points is scanned by the piece on many tasks; the result does not depend on it."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    draw = [F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.length("text") == 0) | marked | F.coalesce(draw[2] % 100 >= fim_percent, F.lit(True))
    rows = rows.withColumns({"form": F.when(plain, "plain").when(draw[3] % 100 < spm_percent, "spm").otherwise("psm"), "h1": F.coalesce(draw[0], F.lit(0)), "h2": F.coalesce(draw[1], F.lit(0))})
    long = F.length("text") > piece
    return in_place(rows.where(~long), automaton, markers).unionByName(by_pieces(rows.where(long), automaton, markers, piece))


def output_batch(got: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), OUT, strict=True)], schema=OUT)


def finished(doc_id, text: str, form: str, n: int, a: int, b: int, markers) -> tuple:
    lengths = (None, None) if form == "plain" else (int(a), int(b - a))
    return doc_id, int(n), form, *lengths, arranged(text, form, int(a), int(b), markers)


def in_place(rows: DataFrame, automaton: Automaton, markers) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple]) -> pa.RecordBatch:
            n, places = cut_places([r[1] for r in held], np.array([r[3:] for r in held], np.int64), automaton)
            return output_batch([finished(r[0], r[1], r[2], k, *ab, markers) for r, k, ab in zip(held, n, places, strict=True)])

        held, points = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    held.append(row)
                    points += len(row[1]) + LANE
                    if points >= MOST_POINTS or len(held) >= MOST_TEXTS:
                        yield flush(held)
                        held, points = [], 0
        if held:
            yield flush(held)

    return rows.select("doc_id", "text", "form", "h1", "h2").mapInArrow(run, DDL)


def by_pieces(rows: DataFrame, automaton: Automaton, markers, piece: int) -> DataFrame:
    keyed = rows.withColumn("key", F.sha2("text", 256))

    def deal():
        return lambda doc_id, key, text: ((doc_id, key, k, text[at : at + piece]) for k, at in enumerate(range(0, len(text), piece)))

    def read():
        def each(doc_id, key, k, text):
            to, count = Scan([text], automaton).functions()
            yield doc_id, key, k, len(text), to[0].tolist(), count[0].tolist()

        return each

    named = [("doc_id", pa.int64()), ("key", pa.string()), ("piece", pa.int32())]
    pieces = map_rows(keyed.select("doc_id", "key", "text"), deal, pa.schema([*named, ("text", pa.string())]), "doc_id bigint, key string, piece int, text string", rows_per_batch=16)
    pieces = pieces.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # whatever text they are of
    schema = pa.schema([*named, ("chars", pa.int64()), ("to", pa.list_(pa.int64())), ("count", pa.list_(pa.int64()))])
    told = map_rows(pieces, read, schema, "doc_id bigint, key string, piece int, chars bigint, to array<bigint>, count array<bigint>")
    # Composition: as many functions as a text has pieces, equal rows' being equal.
    once = told.dropDuplicates(["doc_id", "key", "piece"]).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("piece", "chars", "to", "count"))).alias("f"))
    zero = F.lit(0).cast("long")

    def walk(acc: Column, x: Column) -> Column:
        return F.struct(F.get(x["to"], acc["state"].cast("int")).alias("state"), (acc["units"] + F.get(x["count"], acc["state"].cast("int"))).alias("units"))

    total = F.aggregate("f", F.struct(zero.alias("state"), zero.alias("units")), walk)["units"]

    def seek(skip: Column) -> Column:
        nowhere = F.lit(None).cast("struct<at:bigint,state:bigint,skip:bigint>")

        def next_piece(acc: Column, x: Column) -> Column:
            units = F.get(x["count"], acc["state"].cast("int"))
            here = acc["hit"].isNull() & (acc["units"] + units > skip)
            hit = F.when(here, F.struct(acc["at"].alias("at"), acc["state"].alias("state"), (skip - acc["units"]).alias("skip"))).otherwise(acc["hit"])
            return F.struct(F.get(x["to"], acc["state"].cast("int")).alias("state"), (acc["units"] + units).alias("units"), (acc["at"] + x["chars"]).alias("at"), hit.alias("hit"))

        return F.aggregate("f", F.struct(zero.alias("state"), zero.alias("units"), zero.alias("at"), nowhere.alias("hit")), next_piece)["hit"]

    whole = keyed.join(once.withColumnRenamed("doc_id", "_doc").withColumnRenamed("key", "_key"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).withColumn("n", total)
    first, second = F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)), F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1))
    aimed = whole.select("doc_id", "text", "form", "n", seek(first).alias("a"), seek(second).alias("b"))

    def start():
        def place(text: str, hit) -> int:
            if hit is None:
                return len(text)
            part = text[hit["at"] : hit["at"] + piece]
            return hit["at"] + int(Scan([part], automaton).find(*(np.array([x]) for x in (0, hit["state"], hit["skip"])))[0])

        def each(doc_id, text, form, n, a, b):
            yield finished(doc_id, text, form, n, place(text, a), place(text, b), markers)

        return each

    return map_rows(aimed, start, OUT, DDL, rows_per_batch=1)
