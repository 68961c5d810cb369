"""Row numbers, shards, splits, orders and samples without a single-task window.

Where the original works by position, order is by explicit columns. Randomness is a hash of an id and a seed, so results
do not change with partitioning.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_folder(spark, what: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir); a folder of its own only where the
    session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(f"/tmp/skein-shared-{os.getpid()}")
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession, "probe")
    return df.checkpoint(eager=True)


def with_row_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """A gapless number from 0 in the given total order: range partitions are sorted on their own and shifted by the sizes
    of those before (a few numbers on the driver, one for each partition)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).cast("int")
    sizes, at, offsets = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()), 0, []
    for p, c in sizes:
        offsets.append((p, at))
        at += c
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p int, _o long")
    return placed.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_o")


#: Bytes that a piece of an ordered table holds, about.
PIECE = 1 << 24


def in_pieces(df: DataFrame, size: Column, *order: Column | str, least: int = 1) -> DataFrame:
    """Range partitions of about ``PIECE`` bytes by ``size``, each sorted by the given total order: their number grows with the table,
    so what a task holds does not. ``least`` is how many there are of a small table."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return df.repartitionByRange(max(least, -(-total // PIECE)), *order).sortWithinPartitions(*order)


def shard(idx: Column, n: Column | int, k: int, how: str) -> Column:
    """Which of k shards row idx of n belongs to.

    contiguous: floor shares, the last takes the rest (W2); array_split: the first n % k are one longer (W3); ceil: chunks of
    ceil(n / k) (W4); round_robin: idx % k (W5, W6); linspace: borders floor(j * n / k) (W7); rounded: borders
    round-half-even(j * n / k) (W8).
    """
    n = F.lit(n) if isinstance(n, int) else n
    n = n.cast("long")
    if how == "contiguous":
        per = F.floor(n / k).cast("long")
        return F.when(per == 0, F.lit(k - 1)).otherwise(F.least(F.expr("1") * F.floor(idx / F.when(per == 0, 1).otherwise(per)), F.lit(k - 1))).cast("int")
    if how == "array_split":
        small, longer = F.floor(n / k).cast("long"), n % k
        head = longer * (small + 1)
        return F.when(idx < head, F.floor(idx / (small + 1))).otherwise(longer + F.floor((idx - head) / F.greatest(small, F.lit(1)))).cast("int")
    if how == "ceil":
        return F.floor(idx / F.greatest(F.ceil(n / k), F.lit(1))).cast("int")
    if how == "round_robin":
        return F.pmod(idx, F.lit(k)).cast("int")
    borders = [(F.floor(n * j / k) if how == "linspace" else F.bround(n * j / F.lit(k).cast("double"))).cast("long") for j in range(1, k)]
    return sum((F.when(idx >= b, 1).otherwise(0) for b in borders), F.lit(0)).cast("int")


def hash_order(id_col: str, seed: int) -> Column:
    """Production order key of a seeded shuffle."""
    return F.xxhash64(F.col(id_col), F.lit(seed))


def lcg(id_col: Column | str, seed: int) -> Column:
    """An order key that other engines can compute as well: a linear congruence of an integer id."""
    return (F.col(id_col) if isinstance(id_col, str) else id_col).cast("long") * 1103515245 % 2147483648 + F.lit((12345 + seed * 7919) % 2147483648)


def tail_split(df: DataFrame, n_tail: int, *order: Column | str) -> DataFrame:
    """L4: column split: the last n rows are val."""
    indexed = with_row_index(df, *order)
    total = indexed.count()
    return indexed.withColumn("split", F.when(F.col("idx") >= total - n_tail, "val").otherwise("train")).drop("idx")


def holdout(df: DataFrame, n: int, key: Column, id_col: str) -> DataFrame:
    """The n rows of lowest key are val if there are more than n, all others train."""
    small = df.count() <= n
    if small:
        return df.withColumn("split", F.lit("train"))
    picked = df.select(id_col, key.alias("_k")).orderBy("_k", id_col).limit(n).select(id_col, F.lit("val").alias("split"))
    return df.join(picked, id_col, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def first_fraction(indexed: DataFrame, n: Column, fraction: float) -> DataFrame:
    """L3: rows whose idx is below int(n * fraction), in binary floating point."""
    return indexed.where(F.col("idx") < F.floor(n.cast("double") * F.lit(fraction)))


def bernoulli(id_col: str, seed: int, share: float) -> Column:
    """A coin for each row that does not depend on partitioning."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) / 1e6 < share


def choose(options: Column, id_col: str, seed: int) -> Column:
    """One element by hash."""
    return F.element_at(options, (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.size(options)) + 1).cast("int"))


def per_group_first(df: DataFrame, group: str, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each group."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


#: Cells of one alias table.
CELLS = 4096


def alias_cells(weights):
    """Walker's method: for each of n cells the share that stays (of the cell) and who gets the rest, so that a uniform cell
    and a uniform number choose by weight."""
    import numpy as np

    w = np.asarray(weights, np.float64)
    n = len(w)
    share, other = w * n / w.sum(), np.arange(n)
    low, high = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] >= 1]
    while low and high:
        i, j = low.pop(), high[-1]
        other[i] = j
        share[j] -= 1 - share[i]
        if share[j] < 1:
            low.append(high.pop())
    for i in low + high:  # what rounding left over
        share[i], other[i] = 1.0, i
    return share, other


def alias_table(items: DataFrame, weight: str, id_col: str) -> list[DataFrame]:
    """Levels of alias tables, the top one first. A level deals its members out by order of id into tables of at most
    ``CELLS``; a table is then one member of the level above, with the sum of its weights. Columns: grp (its table), cell, n
    (cells of the table), own and other (members), share. Weights must be positive and finite: others raise."""
    import pandas as pd

    bad = F.col(weight).isNull() | F.isnan(F.col(weight).cast("double")) | (F.col(weight) <= 0) | (F.col(weight).cast("double") == float("inf"))
    checked = items.select(F.col(id_col).cast("long").alias("own"), F.when(bad, F.raise_error(F.lit("weights must be positive and finite"))).otherwise(F.col(weight).cast("double")).alias("w"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell")
        share, other = alias_cells(rows["w"])
        own = rows["own"].to_numpy()
        return pd.DataFrame({"grp": rows["grp"], "cell": rows["cell"], "n": len(own), "own": own, "other": own[other], "share": share})

    levels, members = [], checked
    while True:
        placed = cut(with_row_index(members, "own").select((F.floor(F.col("idx") / CELLS)).alias("grp"), (F.col("idx") % CELLS).alias("cell"), "own", "w"))
        levels.append(placed.groupBy("grp").applyInPandas(build, "grp long, cell long, n long, own long, other long, share double"))
        members = cut(placed.groupBy("grp").agg(F.sum("w").alias("w")).select(F.col("grp").alias("own"), "w"))
        if members.count() <= 1:
            return levels[::-1]


def weighted_with_replacement(items: DataFrame, weight: str, n: int, seed: int, id_col: str) -> DataFrame:
    """N draws (draw, and the columns of items) by weight, by alias tables: each level is one join on a cell that is
    chosen uniformly, so a heavy item is no hot key of it, and nothing is broadcast. Draws are hashes of their number."""
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"), F.lit(0).cast("long").alias("grp"))
    for k, level in enumerate(alias_table(items, weight, id_col)):
        u = [F.pmod(F.xxhash64("draw", F.lit(seed), F.lit(2 * k + i)), F.lit(1 << 52)) / float(1 << 52) for i in (0, 1)]
        level = cut(level)
        sizes = level.where("cell = 0").select("grp", "n")
        top = sizes.first() if k == 0 else None
        if k == 0 and top is None:
            raise ValueError("there is nothing to draw from")
        aimed = draws.withColumn("n", F.lit(top["n"])) if k == 0 else draws.join(sizes, "grp")
        met = aimed.withColumn("cell", F.floor(u[0] * F.col("n"))).drop("n").join(level.drop("n"), ["grp", "cell"])
        draws = met.select("draw", F.when(u[1] < F.col("share"), F.col("own")).otherwise(F.col("other")).alias("grp"))
    return draws.withColumnRenamed("grp", "_own").join(items, F.col("_own") == F.col(id_col)).drop("_own")


def alias_mass(items: DataFrame, weight: str, id_col: str) -> DataFrame:
    """The chance of each item in the lowest level's tables, of its table: what ``weighted_with_replacement`` draws by."""
    level = alias_table(items, weight, id_col)[-1]
    halves = F.array(F.struct(F.col("own").alias("item"), (F.col("share") / F.col("n")).alias("p")), F.struct(F.col("other").alias("item"), ((1 - F.col("share")) / F.col("n")).alias("p")))
    return level.select("grp", F.inline(halves)).groupBy("grp", "item").agg(F.sum("p").alias("chance"))
