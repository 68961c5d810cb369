"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader (so any file system works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; SKEIN_TOKENIZERS overrides the folder."""
    folder = os.environ.get("SKEIN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns with fixed names, so that clashing extra columns cannot matter."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_rows(df: DataFrame, start: Callable[[], Callable[..., Iterable[tuple]]], schema: pa.Schema, ddl: str, rows_per_batch: int = 512) -> DataFrame:
    """Run a row function over Arrow batches without ever holding a partition.

    ``start()`` is called once in each task and returns a function of one row's values that yields output tuples. Batches
    come in Spark's size (its own bound on bytes); output is cut into batches of ``rows_per_batch`` rows, so a run of very
    long texts cannot pile up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begin(start)
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, FEW):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, FEW).columns), strict=True):
                    out.extend(each(*row))
                    if len(out) >= rows_per_batch:
                        yield to_batch(out, schema)
                        out = []
        if hasattr(each, "finish"):
            for row in each.finish():
                out.append(row)
                if len(out) >= rows_per_batch:
                    yield to_batch(out, schema)
                    out = []
        if out:
            yield to_batch(out, schema)
        tidy()

    return df.mapInArrow(run, ddl)


def map_column(df: DataFrame, col: str, start: Callable[[], Callable], keep: bool = False) -> DataFrame:
    """The same rows and columns with ``start()``'s function applied to one text column, a few rows at a time; with ``keep``
    the function says instead which rows stay. Other columns are handed through as they are, whatever their names."""
    at_col = df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begin(start)
        for batch in batches:
            for at in range(0, batch.num_rows, FEW):
                rows = batch.slice(at, FEW)
                column = rows.column(at_col)
                out = [each(x) for x in column.to_pylist()]
                if keep:
                    yield rows.filter(pa.array(out, pa.bool_()))
                else:
                    columns = list(rows.columns)
                    columns[at_col] = pa.array(out, column.type)
                    yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)
        tidy()

    return df.mapInArrow(run, df.schema)


#: Rows whose values are Python objects at one time.
FEW = 64
_held: dict = {}
_asked = False


def hold(key, build: Callable):
    """What ``build`` makes, kept in this process for later tasks that ask for the same; one thing is kept at a time, so
    workers that serve one operator after the other do not pile up vocabularies."""
    global _asked
    _asked = True
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def begin(start: Callable):
    """``start()``; what an earlier operator held in this process goes unless it is asked for again."""
    global _asked
    _asked = False
    each = start()
    if not _asked:
        _held.clear()
    return each


def tidy() -> None:
    """Give memory that a task no longer needs back to the machine: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir. Where that is unset a session on this
    machine alone, as a test's, gets a folder of its own; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"/tmp/skein-shared-{os.getpid()}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder: a lost executor costs no recomputation and no data. It is written by
    as many tasks as compute it, so none grows with the input."""
    shared_folder(df.sparkSession, "probe")  # sets a folder where none is set
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """``cut`` for what follows a shuffle and is far smaller than the input: each file costs the executors a process of its
    own to set its rights, so eight reducers share one."""
    return cut(df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism // 2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)))


def release(spark: SparkSession) -> None:
    """Let Spark drop at once the shuffle files of plans that nothing refers to any more; else they stay on the executors'
    disks until the driver happens to collect its garbage. The threads of its
    scheduler refer to the last tasks they saw until they see others, hence the job of many tasks."""
    gc.collect()
    spark.range(0, 64, 1, 64).count()
    spark.sparkContext._jvm.System.gc()


class Memo(dict):
    """A dictionary that computes what it lacks, in bounded memory. It holds two generations: when the young one has
    ``most`` / 2 entries, or keys that with their values are taken to need ``most_bytes`` / 2, the old one goes, so what is
    frequent stays. Texts of over 64 letters are computed and not kept."""

    def __init__(self, compute: Callable, most: int = 300_000, most_bytes: int = 48 << 20):
        super().__init__()
        self.compute, self.most, self.most_bytes, self.old, self.bytes = compute, most // 2, most_bytes // 2, {}, 0

    def __missing__(self, key):
        size = 0 if isinstance(key, int) else len(key)
        if size > 64:
            return self.compute(key)
        if len(self) >= self.most or self.bytes >= self.most_bytes:
            self.old, self.bytes = dict(self), 0
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        self.bytes += 200 + 8 * size  # an entry, its key, and a value that grows with the key
        return value
