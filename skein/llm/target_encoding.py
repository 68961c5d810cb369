"""Time-ordered target encoding: what was known of a value before each row, from other folds only.

``add_history`` gives every row the count and the positives of the rows that have the same key, another fold and a strictly
earlier time. It is a divide and conquer (CDQ) over the order of key and time in which history and probes are merged:

* A range shuffle deals the order out into as many blocks as there are shuffle partitions. Ties are split by further columns,
  so no key, no time and no group of equal rows has to fit one block.
* Base case: one pass over each block in order, with running totals by fold for the key and the time it is at. It holds a
  few numbers, whatever the length of the block.
* Each level joins halves of twice the length: the left half's totals by key and fold meet the right half's probes of the
  same key. All rows of a block need the same from outside, so a block is one probe, and log2(blocks) Spark rounds do.
  What lies left but has the very time of a probe is not earlier and is taken off (``tail``).
* What a table knows of a key (an item's kind) stands in the order before all rows of the key and is handed on the same
  way, within blocks and across them: no join on a key that may be hot.

Blocks are as many as spark.sql.shuffle.partitions says; what the rounds handle is five rows for each, however long the
input, so all rounds of a pass are one small task. Tables between passes are Parquet in the shared folder; each goes when
the one after the next is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import remove, shared_folder

FOLDS = 5
#: The time of what a table knows of a key.
BEFORE_ALL = -(1 << 62)
#: Added to every row by the pass over blocks: where it stands (0 anywhere, 1 in the first key of its block, 2 there at the
#: first time too), its block, and in one more row for each block the block's ends.
PLACE = "place tinyint, block int, ends struct<first_key:{key},first_time:bigint,last_key:{key},last_time:bigint,value:string,n:array<bigint>,s:array<bigint>,tail_n:array<bigint>,tail_s:array<bigint>>"


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    """Unsigned CRC-32 of the decimal digits, modulo the folds."""
    return (F.crc32(key.cast("string").cast("binary")) % folds).cast("int")


def rate(n: Column, s: Column, prior: Column, weight: int = 50) -> Column:
    """Millionths of positives, drawn to the prior as by ``weight`` rows of it; the prior itself without history. Longs."""
    seen = F.call_function("div", 1_000_000 * s + weight * prior, n + weight)
    return F.when(n < 1, prior).otherwise(seen).cast("long")


class Running:
    """Totals by fold before each row of a stream that is in order of key and time."""

    def __init__(self, folds: int):
        self.folds, self.key, self.time = folds, None, None
        self.run = np.zeros((2 * folds, 1), np.int64)  # of the key so far
        self.strict = np.zeros((2 * folds, 1), np.int64)  # of it, before the present time
        self.first = self.value = None
        self.in_first_run = self.in_first_tie = True

    def add(self, key: pa.Array, value: pa.Array, time: np.ndarray, fold: np.ndarray, n: np.ndarray, s: np.ndarray):
        """Counts and positives before each row, where it stands, and the value that its key's first row has."""
        m, k = len(time), self.folds
        new_key, new_time = np.ones(m, bool), np.ones(m, bool)
        new_key[1:] = pc.not_equal(key.slice(1), key.slice(0, m - 1)).to_numpy(zero_copy_only=False)
        new_time[1:] = time[1:] != time[:-1]
        opening = self.first is None
        if opening:
            self.first = (key[0].as_py(), int(time[0]))
        else:
            new_key[0], new_time[0] = key[0].as_py() != self.key, time[0] != self.time
        new_time |= new_key
        at = np.arange(m)
        run, tie = np.maximum.accumulate(np.where(new_key, at, -1)), np.maximum.accumulate(np.where(new_time, at, -1))
        each = np.zeros((2 * k, m + 1), np.int64)
        each[fold, at + 1] = n
        each[fold + k, at + 1] = s
        sums = each.cumsum(axis=1)
        before = sums[:, tie] - np.where(run >= 0, sums[:, run], -self.run)
        before = np.where(tie >= 0, before, self.strict)
        start = 0 if opening else -1
        first_run = (run == start) & self.in_first_run
        first_tie = (tie == start) & self.in_first_tie & first_run
        self.in_first_run, self.in_first_tie = bool(first_run[-1]), bool(first_tie[-1])
        self.run = sums[:, -1:] - (sums[:, run[-1:]] if run[-1] >= 0 else -self.run)
        self.strict = before[:, -1:]
        self.key, self.time = key[m - 1].as_py(), int(time[-1])
        values = pc.if_else(pa.array(run >= 0), value.take(pa.array(np.maximum(run, 0))), pa.scalar(self.value, pa.string()))
        self.value = values[m - 1].as_py()
        return before[:k].sum(0) - before[fold, at], before[k:].sum(0) - before[fold + k, at], first_run.astype(np.int8) + first_tie, values

    def ends(self) -> dict:
        k, run, tail = self.folds, self.run[:, 0].tolist(), (self.run - self.strict)[:, 0].tolist()
        return {"first_key": self.first[0], "first_time": self.first[1], "last_key": self.key, "last_time": self.time, "value": self.value, "n": run[:k], "s": run[k:], "tail_n": tail[:k], "tail_s": tail[k:]}


def within_blocks(rows: DataFrame, key: str, time: str, fold: str, n: str, s: str, ties: list[str], out_n: str, out_s: str, value: str, folds: int, blocks: int) -> DataFrame:
    """Rows in blocks of the order with what their own block holds of their history, and a row of ends for each block. Rows
    of time ``BEFORE_ALL`` give their value and go."""
    order = [key, time, *(c for c in ties if c != key)]
    placed = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    added = T.StructType.fromDDL(f"{out_n} bigint, {out_s} bigint, " + PLACE.format(key=rows.schema[key].dataType.simpleString()))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*placed.schema.fields, *added.fields]])
    arrow, names = to_arrow_schema(schema), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, running, at_value = TaskContext.get().partitionId(), Running(folds), names.index(value)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            cols = {c: batch.column(i) for i, c in enumerate(names)}
            times = cols[time].to_numpy(zero_copy_only=False)
            got_n, got_s, place, values = running.add(cols[key], cols[value], times, *(cols[c].to_numpy(zero_copy_only=False) for c in (fold, n, s)))
            more = [pa.array(got_n), pa.array(got_s), pa.array(place, pa.int8()), pa.array(np.full(m, block, np.int32)), pa.nulls(m, arrow.field("ends").type)]
            columns = [*batch.columns, *more]
            columns[at_value] = values
            out = pa.RecordBatch.from_arrays(columns, schema=arrow)
            yield out if times[0] != BEFORE_ALL and (times != BEFORE_ALL).all() else out.filter(pa.array(times != BEFORE_ALL))
        if running.first is not None:
            last = {f.name: [None] for f in arrow} | {"block": [block], "ends": [running.ends()]}
            yield pa.RecordBatch.from_arrays([pa.array(last[f.name], f.type) for f in arrow], schema=arrow)

    return placed.mapInArrow(run, schema)


def across_blocks(ends: DataFrame, blocks: int, folds: int) -> DataFrame:
    """By block, what the blocks before it hold of its first key: its value, and arrays by fold of counts and positives, of
    all times (n, s) and of times before the block's first one (strict_n, strict_s). One round for each level of halves.
    ``ends`` has a row for each block and is one partition, so that rounds need no shuffle."""
    by_fold = F.posexplode(F.arrays_zip("ends.n", "ends.s", "ends.tail_n", "ends.tail_s"))
    history = ends.select("block", F.col("ends.last_key").alias("key"), F.col("ends.last_time").alias("time"), F.col("ends.value").alias("value"), by_fold.alias("fold", "x")).select("block", "key", "time", "value", "fold", "x.*")
    probes = ends.select("block", F.col("ends.first_key").alias("key"), F.col("ends.first_time").alias("at"))
    rounds = []
    for level in range(max(1, (blocks - 1).bit_length())):
        right_half, node = F.shiftright("block", level).bitwiseAND(1) == 1, F.shiftright("block", level + 1)
        # All parts of one time first, so that the latest time's part is known as a whole.
        by_time = history.where(~right_half).withColumn("node", node).groupBy("node", "key", "fold", "time").agg(*(F.sum(c).alias(c) for c in ("n", "s", "tail_n", "tail_s")), F.max("value").alias("value"))
        left = by_time.groupBy("node", "key", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("value").alias("value"), F.max(F.struct("time", "tail_n", "tail_s")).alias("latest"))
        met = probes.where(right_half).withColumn("node", node).join(left.hint("shuffle_hash"), ["node", "key"])
        not_before = F.col("latest.time") == F.col("at")
        off = {c: F.when(not_before, F.col(f"latest.tail_{c}")).otherwise(0) for c in ("n", "s")}
        rounds.append(met.select("block", "fold", "value", "n", "s", (F.col("n") - off["n"]).alias("strict_n"), (F.col("s") - off["s"]).alias("strict_s")))
    total = rounds[0]
    for more in rounds[1:]:
        total = total.unionByName(more)
    by_fold = [F.array(*(F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)) for k in range(folds))).alias(f"_{c}") for c in ("n", "s", "strict_n", "strict_s")]
    return total.coalesce(1).groupBy("block").agg(*by_fold, F.max("value").alias("_value"))


def add_history(rows: DataFrame, key: str, time: str, fold: str, n: str, s: str, ties: list[str], out_n: str, out_s: str, folds: int = FOLDS, known: DataFrame | None = None, value: str = "value") -> tuple[DataFrame, str]:
    """The rows with ``out_n`` and ``out_s``: sums of ``n`` and ``s`` over rows of the same key, another fold and an earlier
    time; and the folder of the table behind them, which the caller removes. Key, time (long), fold (0 to folds - 1), n and s
    must not be null; ``ties`` are columns that with key and time tell rows apart as far as they differ. Rows that do not
    differ count each. An empty table comes back empty. With ``known`` (the key once, and ``value`` as text) rows have their key's
    value too, or null."""
    spark = rows.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = rows.withColumn(value, F.lit(None).cast("string"))
    if known is not None:
        first = known.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).cast(rows.schema[key].dataType).alias(key), value)
        fixed = {time: F.lit(BEFORE_ALL), fold: F.lit(0), n: F.lit(0), s: F.lit(0)}
        wide = wide.unionByName(first.withColumns({c: x.cast(rows.schema[c].dataType) for c, x in fixed.items()}), allowMissingColumns=True)
    within_blocks(wide, key, time, fold, n, s, ties, out_n, out_s, value, folds, blocks).write.parquet(path := shared_folder(spark, f"history-{key}"))
    table = spark.read.parquet(path)
    table.where("ends is not null").select("block", "ends").write.parquet(ended := f"{path}-ends")
    across_blocks(spark.read.parquet(ended).coalesce(1), blocks, folds).write.parquet(carried := f"{path}-carried")
    remove(spark, ended)
    carry = F.broadcast(spark.read.parquet(carried))  # one row for each block at most
    own = F.col(fold) + 1

    def others(c: str) -> Column:
        every = F.aggregate(f"_{c}", F.lit(0).cast("long"), lambda a, x: a + x)
        return every - F.element_at(f"_{c}", own)

    def whole(out: str, c: str) -> Column:
        outside = F.when(F.col("place") == 2, others(f"strict_{c}")).when(F.col("place") == 1, others(c))
        return (F.col(out) + F.coalesce(outside, F.lit(0))).alias(out)

    out = table.where("ends is null").drop("ends").join(carry, "block", "left")
    handed = [] if known is None else [F.coalesce(value, F.when(F.col("place") > 0, F.col("_value"))).alias(value)]
    return out.select(*rows.columns, whole(out_n, "n"), whole(out_s, "s"), *handed), path


def facts(table: DataFrame, key: str, value: str) -> DataFrame:
    """A key once with its least value as text."""
    return table.select(F.col(key).cast("long").alias(key), F.col(value).cast("string").alias("value")).groupBy(key).agg(F.min("value").alias("value"))


def encode_sales(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, flag: str = "returned") -> DataFrame:
    """Per sale_id, item_id and vendor_id: own lines, own lines with the flag, and for item, vendor and client the history
    count and the smoothed rate; priors go from all history over kind, nation and segment to the ids.

    Lines without a sale, or whose sale has no sold_at, go; null item_id and client_id are -1, an ordinary id; null vendor_id
    stays a group of its own that counts as -1 too and comes back null. Repeated lines count each. Of repeated sale_ids the
    earliest sold_at (then the least client_id) holds. Repeated ids of items, vendors or clients take the least value. Empty
    tables give no rows. Extra columns of any name are ignored. Equal times are never each other's history."""
    spark = lines.sparkSession
    sold = sales.where("sale_id is not null and sold_at is not null").select(
        F.col("sale_id").cast("long").alias("sale_id"), F.struct(F.unix_micros(F.col("sold_at").cast("timestamp")).alias("time"), F.coalesce(F.col("client_id").cast("long"), F.lit(-1)).alias("client_id")).alias("x")
    ).groupBy("sale_id").agg(F.min("x").alias("x")).select("sale_id", "x.*")
    got = lines.where("sale_id is not null").select(F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"), (F.col("flag") == flag).alias("flag"))
    counts = [F.count("*").alias("n"), F.count_if("flag").alias("s")]
    folders: list[str] = []

    def step(rows: DataFrame, key: str, ties: list[str], known: DataFrame | None = None) -> DataFrame:
        out, path = add_history(rows, key, "time", "fold", "n", "s", ties, "hn", "hs", known=known)
        folders.append(path)
        for old in folders[:-2]:  # the last but one is what this one was made of
            remove(spark, old)
            remove(spark, f"{old}-carried")
        del folders[:-2]
        return out

    def encoded(rows: DataFrame, key: str, name: str, known: DataFrame, ties: list[str]) -> DataFrame:
        """First the key's own history, with what is known of it; then that value's, which gives the prior."""
        out = step(rows, key, ties, known).withColumns({"own_n": F.col("hn"), "own_s": F.col("hs"), "value": F.coalesce(F.concat(F.lit("="), F.col("value")), F.lit("?"))}).drop("hn", "hs")
        out = step(out.withColumnRenamed("value", "parent"), "parent", ties)
        prior = rate(F.col("hn"), F.col("hs"), F.col("p_all"))
        return out.withColumns({f"{name}_n": F.col("own_n"), f"{name}_rate": rate(F.col("own_n"), F.col("own_s"), prior)}).drop("hn", "hs", "own_n", "own_s", "parent")

    by_sale = sold.join(got.groupBy("sale_id").agg(*counts).hint("merge"), "sale_id").withColumns({"fold": fold_of(F.col("sale_id")), "every": F.lit(0).cast("long")})
    by_sale = step(by_sale, "every", ["sale_id"]).withColumn("p_all", rate(F.col("hn"), F.col("hs"), F.lit(500_000).cast("long"))).drop("every", "hn", "hs")
    by_sale = encoded(by_sale, "client_id", "client", facts(clients, "client_id", "segment"), ["sale_id"]).drop("client_id", "n", "s")
    rows = got.groupBy("sale_id", "item_id", "vendor_id").agg(*counts).join(by_sale.hint("merge"), "sale_id").withColumn("vendor", F.coalesce("vendor_id", F.lit(-1)))
    one = ["sale_id", "item_id", "vendor"]
    rows = encoded(rows, "item_id", "item", facts(items, "item_id", "kind"), one)
    rows = encoded(rows, "vendor", "vendor", facts(vendors.select(F.col("vendor_id").alias("vendor"), "nation_id"), "vendor", "nation_id"), one)
    return rows.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")
