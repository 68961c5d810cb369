"""Readers (S1-S26)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str, schema=None, strict: bool = True, suffix: str | None = None) -> DataFrame:
    """JSON lines (also .zst and .gz), of a folder and those below it; bad lines raise or go."""
    r = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", True)
    if suffix:
        r = r.option("pathGlobFilter", f"*{suffix}")
    return (r.schema(schema) if schema else r).json(path)


def json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A file that is one JSON array."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def any_format(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """By suffix; folders and all else are parquet."""
    if path.endswith((".jsonl", ".jsonl.zst", ".jsonl.gz")):
        return jsonl(spark, path, schema)
    if path.endswith(".json"):
        return json_array(spark, path, schema)
    if path.endswith((".tsv", ".csv")):
        return delimited(spark, path, schema, "\t" if path.endswith(".tsv") else ",")
    return spark.read.parquet(path)


def delimited(spark: SparkSession, path: str, schema=None, sep: str = "\t") -> DataFrame:
    """S14, S15."""
    r = spark.read.option("header", True).option("sep", sep)
    return (r.schema(schema) if schema else r).csv(path)


def listing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Files with sizes, contents untouched."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length", "modificationTime")


def folders(files: DataFrame) -> DataFrame:
    """Listed files by folder, where a shard is a folder of files: path, length, modificationTime (of the last)."""
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))


def shard_sample(files: DataFrame, share: float, seed: int, tail: bool = False) -> DataFrame:
    """Of the hashed order of shards the first share, or the last (at least one); names with // go."""
    kept = files.where(~F.regexp_replace("path", "^[a-z0-9]+:/+", "").contains("//"))
    n = max(1, int(kept.count() * share))
    key = F.xxhash64("path", F.lit(seed))
    return kept.orderBy(key.desc() if tail else key.asc(), "path").limit(n)


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """Url, pos, key, suffix, part, data and error of the members of every tar (see ``tars``): a damaged archive says so
    in a row of its own."""
    from . import tars

    return tars.members(spark, path)


def tar_samples(spark: SparkSession, path: str) -> DataFrame:
    """Members of one sample as a map from suffix to data."""
    from . import tars

    return tars.samples(tars.whole(tars.members(spark, path)))


#: Blocks of text files up to which the shifts of their lines are broadcast.
BLOCKS = 100_000


def lines(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """File, stem, value and line_no (from 1, by place in the file) of every line. ``text`` is a pattern whose group
    names, in a file's path, the text that the file is a piece of: its files follow one another by number and name and are
    numbered through. A file that does not match it is a text of its own.

    Large files are read in blocks, each by a task. What was read is stored once with its place, since another reading may cut
    other blocks; a block's lines are then shifted by the sizes of those before it, so no task holds a file."""
    from pyspark.sql import Window

    from ..operators.rows import cut, shared_folder

    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("stem"), "value", F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    out = shared_folder(spark, "lines-read")
    read.write.parquet(out)
    placed = spark.read.schema(read.schema).parquet(out)
    whole = F.coalesce(F.nullif(F.regexp_extract("file", text, 1), F.lit("")), F.col("file")) if text else F.col("file")
    number = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.partitionBy("_w").orderBy("_k", "file", "_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("file", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_o")).withColumns({"_w": whole, "_k": number})
    shifts = cut(sizes.select("file", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_o")).alias("_s")))
    few = shifts.count() <= BLOCKS
    return placed.join(F.broadcast(shifts) if few else shifts, ["file", "_b"]).select("file", "stem", "value", (F.col("_m") + F.col("_s")).alias("line_no"))


def concatenated(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files as one: chunk (of a folder chunk=, whose files are one chunk, else the last number of a file's name), line_no
    and value; ``orderBy("chunk", "line_no")`` is the order of the whole."""
    found = lines(spark, path, r"^(.*/chunk=[^/]*/)[^/]*$")
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    parent = F.regexp_extract("file", r"/chunk=([^/]*)/[^/]*$", 1)
    number = F.when(parent != "", parent).otherwise(F.regexp_extract(name, r"(\d+)\D*$", 1))
    return found.select(number.try_cast("long").alias("chunk"), "line_no", "value")


def named_objects(spark: SparkSession, path: str, value_ddl: str) -> DataFrame:
    """An object of objects; each key becomes the column name."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value_ddl}>")).alias("name", "v")).select("name", "v.*")


def keyed_union(frames: list[DataFrame], key: str, number: str = "number") -> DataFrame:
    """Of rows with one key the last frame's stays; then numbered from 1 in key order."""
    from ..operators.rows import with_row_index

    both = None
    for i, f in enumerate(frames):
        f = f.withColumn("_f", F.lit(i))
        both = f if both is None else both.unionByName(f)
    last = both.groupBy(key).agg(F.max_by(F.struct("*"), "_f").alias("_r")).select("_r.*").drop("_f")
    return with_row_index(last, key, name=number).withColumn(number, F.col(number) + 1)


def constant_rows(spark: SparkSession, n: int, **columns) -> DataFrame:
    """S25."""
    return spark.range(n).select("id", *[F.lit(v).alias(k) for k, v in columns.items()])


def shard_sizes(manifest: DataFrame | None, data: DataFrame) -> int:
    """Rows by a manifest (path, n) if there is one, else counted."""
    return manifest.agg(F.sum("n")).first()[0] if manifest is not None else data.count()


def numpy_array(spark: SparkSession, path: str, name: str = "arr_0") -> DataFrame:
    """Rows of an array in .npz or .npy files, read file by file on the executors."""
    import numpy as np

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                loaded = np.load(io.BytesIO(content))
                x = loaded[name] if hasattr(loaded, "files") else loaded
                x = x.reshape(len(x), -1).astype(np.float32)
                for at in range(0, len(x), 1024):
                    part = x[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([url] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float32()))], names=["path", "row", "vec"])

    return files.mapInArrow(read, "path string, row long, vec array<float>")
