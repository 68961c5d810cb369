"""Length-aware batches, padding, rolling metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def megabatches(df: DataFrame, key: Column, length: str, size: int, id_col: str) -> DataFrame:
    """Rows in hashed order, cut into groups of ``size``; rank: place by descending length within the group."""
    from .rows import with_row_index

    x = with_row_index(df.withColumn("_k", key), "_k", id_col, name="_i")
    x = x.withColumn("mega", F.floor(F.col("_i") / size).cast("int")).drop("_k", "_i")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("mega").orderBy(F.desc(length), id_col)) - 1)


def even_chunks(df: DataFrame, chunks: int, id_col: str, length: str) -> DataFrame:
    """Within a megabatch the next longest goes to the shortest chunk with room; strided if it does not divide."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        n = len(rows)
        if n % chunks:
            rows["chunk"] = [i % chunks for i in range(n)]
        else:
            load, held, chosen = [0.0] * chunks, [0] * chunks, []
            for value in rows[length]:
                c = min(range(chunks), key=lambda k: (load[k], k))
                chosen.append(c)
                held[c] += 1
                load[c] = float("inf") if held[c] == n // chunks else load[c] + value
            rows["chunk"] = chosen
        return rows[["mega", "rank", id_col, length, "chunk"]]

    return df.select("mega", "rank", id_col, length).groupBy("mega").applyInPandas(deal, f"mega int, rank int, {id_col} long, {length} long, chunk int")


def modality_megabatches(df: DataFrame, key: Column, length: str, size: int, id_col: str) -> DataFrame:
    """As W11 for each sign of length; both last groups merge into one that is ordered by id."""
    signed = df.withColumn("modality", F.when(F.col(length) > 0, "image").otherwise("text")).withColumn("_n", F.abs(length))
    out = None
    for m in ("image", "text"):
        part = megabatches(signed.where(F.col("modality") == m), key, "_n", size, id_col)
        last = part.agg(F.max("mega").alias("_last"))
        part = part.join(F.broadcast(last), how="cross").withColumn("merged", F.col("mega") == F.col("_last")).drop("_last", "_n")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rank", F.when(F.col("merged"), F.row_number().over(Window.partitionBy("merged", F.when(~F.col("merged"), F.xxhash64("modality", "mega"))).orderBy(id_col)) - 1).otherwise(F.col("rank")))


def padded(ids: Column, width: Column, pad: int) -> Column:
    """Q8: cut or fill at the right."""
    n = F.greatest(width - F.size(ids), F.lit(0)).cast("int")
    return F.concat(F.slice(ids, 1, width.cast("int")), F.array_repeat(F.lit(pad), n))


def left_padded(ids: Column, width: Column, pad: int) -> Column:
    """Q23."""
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0)).cast("int")), ids)


def pad_mask(ids: Column, pad: int) -> Column:
    """Q8: true where there is no padding, and at the first padded place."""
    first = F.array_position(ids, F.lit(pad)) - 1
    return F.transform(ids, lambda x, i: (x != pad) | (i == first))


def collated(df: DataFrame, batch: str, order: str, ids: str, labels: str, pad: int, ignore: int = -100) -> DataFrame:
    """One row for each batch: input_ids, labels and attention_mask, arrays of rows of equal length in ``order``. A batch is a
    bounded number of records, so it fits a row."""
    listed = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("i"), F.col(labels).alias("y")))).alias("r"), F.max(F.size(ids)).alias("w"))
    width = F.col("w")
    return listed.select(
        batch, F.transform("r", lambda x: padded(x["i"], width, pad)).alias("input_ids"), F.transform("r", lambda x: padded(x["y"], width, ignore)).alias("labels"),
        F.transform("r", lambda x: F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda k: k <= F.size(x["i"]))).alias("attention_mask"),
    )


def rolling(df: DataFrame, group: str, order: list[str], value: str, window: int = 20) -> DataFrame:
    """Mean, maximum, lower and averaged median of the last values, and the mean so far."""
    w = Window.partitionBy(group).orderBy(*order)
    last, sofar = w.rowsBetween(-(window - 1), 0), w.rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_w", F.array_sort(F.collect_list(value).over(last)))
    n = F.size("_w")
    lower = F.get("_w", F.floor((n - 1) / 2).cast("int"))
    return x.withColumns({"avg": F.avg(value).over(last), "max": F.max(value).over(last), "global_avg": F.avg(value).over(sofar), "median_low": lower, "median": (lower + F.get("_w", F.floor(n / 2).cast("int"))) / 2}).drop("_w")


def sessions(df: DataFrame, order: str, key: str, suffix: str) -> DataFrame:
    """Members of a tar in order: a new sample where the key changes or a suffix repeats within the run.

    Runs are inside one file (``url``); files are independent.
    """
    w = Window.partitionBy("url").orderBy(order)
    changed = df.withColumn("_run", F.sum(F.when(F.lag(key).over(w) == F.col(key), 0).otherwise(1)).over(w))
    nth = F.row_number().over(Window.partitionBy("url", "_run", suffix).orderBy(order))
    repeated = changed.withColumn("_nth", nth)
    # a repeat opens a sample: the sample's number is the largest count any suffix has reached so far
    opened = F.max("_nth").over(Window.partitionBy("url", "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return repeated.withColumn("sample", F.concat_ws("-", F.col("_run"), opened)).drop("_run", "_nth")
