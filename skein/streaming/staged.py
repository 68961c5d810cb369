"""A staged training stream (ST2): shard list, expansion, selection, decoding, mapping, shuffle, batches.

Each stage is a function from one streaming DataFrame to the next; ``staged`` puts them in a row. All but the shuffle are
stateless. The shuffle keeps a bounded buffer for each slot in the query's state, so a restart from the checkpoint goes on
with what was held, and no row is lost or repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Stage = Callable[[DataFrame], DataFrame]


def staged(stream: DataFrame, *stages: Stage) -> DataFrame:
    for stage in stages:
        stream = stage(stream)
    return stream


def chosen(names: Column, epoch: int, share: float = 1.0) -> Stage:
    """Split: shards whose hash with the epoch falls into the share."""
    return lambda df: df.where(F.pmod(F.xxhash64(names, F.lit(epoch)), F.lit(1_000_000)) < int(share * 1_000_000))


def expanded(function, *arguments: Column) -> Stage:
    """One row to many by a table function, such as the members of a tar."""
    return lambda df: df.lateralJoin(function(*arguments))


def selected(condition: Column) -> Stage:
    return lambda df: df.where(condition)


def mapped(**columns: Column) -> Stage:
    """Decode and map: columns by name, those not named stay."""
    return lambda df: df.withColumns(columns)


def draw(seed: int, slot: int, count: int, below: int) -> int:
    """A number that follows from what came before in the slot alone, so that a repeated micro-batch gives the same."""
    return zlib.crc32(f"{seed}:{slot}:{count}".encode()) % below


def shuffled(order: str, slots: int = 8, size: int = 1000, seed: int = 0, batch: int = 32, slot: str = "slot") -> Stage:
    """Shuffle and batch. A row goes to the slot of its ``order`` column's hash. There it waits in a buffer of ``size`` rows:
    once that is full, each further row takes the place of one at a drawn place, which leaves. Rows that leave are numbered,
    ``batch`` of them making a batch. Within a micro-batch rows come in the order of ``order``, so results do not depend on
    how Spark deals them out.

    A row whose ``order`` is null ends the slots' epoch: ``closing`` makes such rows, one for each slot. Then the buffer
    leaves in full, in drawn order, and the last batch may be short. Adds slot, batch and place (in the batch).
    """

    def stage(df: DataFrame) -> DataFrame:
        names = [f.name for f in df.schema.fields if f.name != slot]
        fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name != slot]
        ends = F.pmod(F.xxhash64(order), F.lit(slots)).cast("int")
        placed = df.withColumn(slot, F.when(F.col(order).isNull(), F.col(slot).cast("int")).otherwise(ends) if slot in df.columns else ends)
        out = T.StructType([*fields, T.StructField(slot, T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("place", T.IntegerType())])
        held = T.StructType([T.StructField("buffer", T.ArrayType(T.StructType(fields))), T.StructField("seen", T.LongType()), T.StructField("left", T.LongType())])

        def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            buffer, seen, left = state.get if state.exists else ([], 0, 0)
            buffer, out_rows = [tuple(r) for r in buffer], []
            rows = pd.concat(list(batches))
            closes = bool(rows[order].isna().any())
            rows = rows[rows[order].notna()].sort_values(order, kind="stable")
            for row in rows[names].itertuples(index=False, name=None):
                row = tuple(None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x for x in row)
                if len(buffer) < size:
                    buffer.append(row)
                else:
                    at = draw(seed, key[0], seen, size)
                    buffer[at], row = row, buffer[at]
                    out_rows.append(row)
                seen += 1
            while closes and buffer:
                at = draw(seed, key[0], seen, len(buffer))
                buffer[at], buffer[-1] = buffer[-1], buffer[at]
                out_rows.append(buffer.pop())
                seen += 1
            numbers = range(left, left + len(out_rows))
            state.update((buffer, seen, left + len(out_rows)))
            frame = pd.DataFrame(out_rows, columns=names, dtype=object)
            for f in fields:
                if isinstance(f.dataType, (T.LongType, T.IntegerType)) and not frame[f.name].isna().any():
                    frame[f.name] = frame[f.name].astype("int64" if isinstance(f.dataType, T.LongType) else "int32")
            yield frame.assign(**{slot: key[0], "batch": [n // batch for n in numbers], "place": [n % batch for n in numbers]})

        return placed.groupBy(slot).applyInPandasWithState(update, out, held, "append", "NoTimeout")

    return stage


def closing(df: DataFrame, order: str, slots: int = 8, slot: str = "slot") -> DataFrame:
    """Rows that end an epoch: those of a stream's columns, all null but the slot."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in df.dtypes if c != slot]
    return df.sparkSession.range(slots).select(*nothing, F.col("id").cast("int").alias(slot))
