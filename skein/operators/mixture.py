"""Mixtures (U1, L3, L6, M10, M11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_spec(names: str, fractions: str, sep: str = "^^") -> list[tuple[int, str, float]]:
    """'a^^b' with '0.5^^1.0': as many fractions as names, else an error."""
    a, b = names.split(sep), [float(x) for x in fractions.split(sep)]
    if len(a) != len(b):
        raise ValueError("a fraction for each data set is needed")
    return [(i, n, f) for i, (n, f) in enumerate(zip(a, b, strict=True))]


def prefix_mixture(df: DataFrame, dataset: str, order: str, spec: list[tuple[int, str, float]]) -> DataFrame:
    """The first int(n * fraction) rows of each data set in the spec, in order; a data set may be in it twice.

    Rows are numbered in one order of data set and order column, less where their data set begins: a data set with a third of
    all rows is many ranges of that order, and no window sees it. What is broadcast has a row for each entry of the spec.
    """
    from .rows import with_row_index

    table = F.broadcast(df.sparkSession.createDataFrame(spec, "mix_pos int, _name string, fraction double"))
    wanted = df.join(table.select(F.col("_name").alias("_w")).distinct(), F.col(dataset) == F.col("_w"), "left_semi")
    placed = with_row_index(wanted, dataset, order, name="_i")
    spans = placed.groupBy(F.col(dataset).alias("_d")).agg(F.min("_i").alias("_from"), F.count("*").alias("_n"))
    parts = spans.join(table, F.col("_d") == F.col("_name")).withColumn("_upto", F.col("_from") + F.floor(F.col("_n").cast("double") * F.col("fraction")))
    return placed.join(F.broadcast(parts), (F.col(dataset) == F.col("_d")) & (F.col("_i") < F.col("_upto"))).drop("_i", "_d", "_from", "_n", "_upto", "_name", "fraction")


def accumulation_steps(global_batch: int, per_device: int, devices: int, nodes: int) -> int:
    """M10."""
    steps, rest = divmod(global_batch, per_device * devices * nodes)
    if rest or not steps:
        raise ValueError("the global batch is no multiple of the devices' batches")
    return steps


def epoch_batches(samples: int, batch: int, workers: int, floor: bool = False) -> tuple[int, int]:
    """Batches and samples of an epoch, rounded to whole batches for each worker."""
    per = samples // (batch * workers) if floor else -(-samples // (batch * workers))
    return per * workers, per * workers * batch


def tasks_by_position(idx: Column, n: Column, t2i: float = 0.8, unconditional: float = 0.08) -> Column:
    """The first part is text to image, of it the first part unconditional."""
    return F.when(idx < F.floor(n * F.lit(unconditional)), "unconditional").when(idx < F.floor(n * F.lit(t2i)), "t2i").otherwise("caption")
