"""Incremental forms of the batch metrics (ST1-ST7) by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    """ST1: files as micro-batches."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def sliding_metrics(stream: DataFrame, key: str, order: str, value: str, window: int = 20) -> DataFrame:
    """ST3: after each micro-batch and key the mean and maximum of the last values and the mean of all so far."""

    def update(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n, total = state.get if state.exists else ([], 0, 0.0)
        last = list(last)
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[value]:
            last, n, total = [*last, float(v)][-window:], n + 1, total + float(v)
        state.update((last, n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "avg": [sum(last) / len(last)], "max": [max(last)], "global_avg": [total / n]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, avg double, max double, global_avg double", "last array<double>, n long, total double", "update", "NoTimeout")


def ema(stream: DataFrame, key: str, order: str, value: str, warm: int = 100, fast: float = 0.9, slow: float = 0.99) -> DataFrame:
    """ST4, A42: exponential mean: the first value, then the fast decay for ``warm`` updates, then the slow one."""

    def update(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        for v in pd.concat(list(batches)).sort_values(order)[value]:
            decay = 0.0 if n == 0 else fast if n < warm else slow
            n, mean = n + 1, decay * mean + (1 - decay) * float(v)
        state.update((n, mean))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [mean]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, ema double", "n long, mean double", "update", "NoTimeout")


def windowed(stream: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Extension: event-time windows with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)


def log_every(stream: DataFrame, group: str, value: str, sink):
    """ST5: each micro-batch's means to a function (batch id, DataFrame)."""
    return stream.writeStream.foreachBatch(lambda df, i: sink(i, df.groupBy(group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))))


def unseen(stream: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """ST6: each id once, and none that is done already."""
    once = stream.dropDuplicates([key])
    return once.join(done, key, "left_anti") if done is not None else once


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """ST7: an append-only cache of metrics; the file sink's log makes replays exact."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
