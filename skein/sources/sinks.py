"""Writers (K1-K15). All go through Spark's committers, so a lost task leaves nothing half-written in the result."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, rows_per_file: int = 10_000, mode: str = "errorifexists") -> None:
    """JSON lines; the tail after the last full batch is written too."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).json(path)


def shuffled_shards(df: DataFrame, path: str, shards: int, id_col: str, seed: int = 42, mode: str = "errorifexists") -> None:
    """K3: hashed order, a fixed number of shards: one range exchange."""
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    df.withColumn("_k", key).repartitionByRange(shards, "_k").sortWithinPartitions("_k").drop("_k").write.mode(mode).parquet(path)


def parts(df: DataFrame, path: str, n: int, idx: str, mode: str = "errorifexists") -> None:
    """K7: parquet in n parts of ceil(rows / n)."""
    total = df.count()
    df.withColumn("part", F.floor(F.col(idx) / max(1, -(-total // n))).cast("int")).repartition(n, "part").write.mode(mode).partitionBy("part").parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """K11."""
    df.write.mode("append").option("header", True).csv(path)


def tar_of(rows, idx: str, text: str, metadata: tuple[str, ...]) -> bytes:
    """K4, K5: the tar of a frame's rows in order; names count within it in eight digits, text and metadata apart."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for i, row in enumerate(rows.sort_values(idx).to_dict("records")):
            for suffix, data in (("txt", row[text] or ""), ("json", json.dumps({m: row[m] for m in metadata}, default=str))):
                info = tarfile.TarInfo(f"{i:08d}.{suffix}")
                raw = data.encode()
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
    return out.getvalue()


def put(folder: str, name: str, data: bytes) -> str:
    """A whole file in a folder that all executors share; the last attempt's stays."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    temp, path = f"{root}/.{uuid.uuid4().hex}-{TaskContext.get().attemptNumber()}", f"{root}/{name}"
    with system.open_output_stream(temp) as f:
        f.write(data)
    system.move(temp, path)
    return path


def tar_files(df: DataFrame, idx: str, per_tar: int, folder: str, text: str = "text", *metadata: str) -> DataFrame:
    """K4, K5: tars of ``per_tar`` rows, each written by the task that makes it as soon as it is made, so that a task holds
    one; tar_id, n and path of each."""
    import pandas as pd

    def save(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["tar_id"].iloc[0])
        return pd.DataFrame({"tar_id": [number], "n": [len(rows)], "path": [put(folder, f"{number:06d}.tar", tar_of(rows, idx, text, metadata))]})

    numbered = df.select(idx, text, *metadata).withColumn("tar_id", F.floor(F.col(idx) / per_tar))
    return numbered.groupBy("tar_id").applyInPandas(save, "tar_id long, n long, path string")


def tar_blobs(df: DataFrame, idx: str, per_tar: int, text: str = "text", *metadata: str) -> DataFrame:
    """K4, K5: tar_id, n and the bytes of each tar. A tar is a bounded number of samples, so a group is bounded; for files,
    ``tar_files`` does without the table of tars."""
    import pandas as pd

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tar_id": [int(rows["tar_id"].iloc[0])], "n": [len(rows)], "data": [tar_of(rows, idx, text, metadata)]})

    numbered = df.select(idx, text, *metadata).withColumn("tar_id", F.floor(F.col(idx) / per_tar))
    return numbered.groupBy("tar_id").applyInPandas(build, "tar_id long, n long, data binary")


def save_blobs(blobs: DataFrame, folder: str) -> DataFrame:
    """Write tars to a folder that all executors share; returns tar_id, n, path of what finished tasks wrote."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [put(folder, f"{k:06d}.tar", data.as_py()) for k, data in zip(b.column(0).to_pylist(), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names)], names=["tar_id", "n", "path"])

    return blobs.mapInArrow(write, "tar_id long, n long, path string")


def npy_files(df: DataFrame, idx: str, vector: str, folder: str, per_file: int) -> DataFrame:
    """Vectors as .npy files of ``per_file`` rows, in a folder that all executors share; file, n and path of each. ``idx``
    counts from 0 without gaps; a file is a bounded number of rows."""
    import numpy as np
    import pandas as pd

    def save(part: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, number = io.BytesIO(), int(part["file"].iloc[0])
        np.save(out, np.stack(part.sort_values("idx")["vec"].to_list()).astype(np.float32))
        temp, name = f"{root}/.{uuid.uuid4().hex}", f"{root}/{number:06d}.npy"
        with system.open_output_stream(temp) as f:
            f.write(out.getvalue())
        system.move(temp, name)  # the last attempt's file is whole
        return pd.DataFrame({"file": [number], "n": [len(part)], "path": [name]})

    numbered = df.select(F.floor(F.col(idx) / per_file).alias("file"), F.col(idx).alias("idx"), F.col(vector).alias("vec"))
    return numbered.groupBy("file").applyInPandas(save, "file long, n long, path string")


def resolved_names(files: DataFrame, folder: str = "folder", name: str = "name", order: str = "path") -> DataFrame:
    """K8: folder_name for each file, with _k behind it from the second file of that name on."""
    from pyspark.sql import Window

    flat = F.concat_ws("_", folder, name)
    w = Window.partitionBy("flat").orderBy(order)
    k = F.row_number().over(w) - 1
    return files.withColumn("flat", flat).withColumn("target", F.when(k == 0, F.col("flat")).otherwise(F.regexp_replace("flat", r"^(.*?)(\.[^.]*)?$", F.concat(F.lit("$1_"), k.cast("string"), F.lit("$2"))))).drop("flat")


def resume(done: DataFrame, todo: DataFrame, key: str, compute) -> DataFrame:
    """Compute only what is not done, then all by key."""
    return done.unionByName(compute(todo.join(done, key, "left_anti"))).orderBy(key)


def submission(df: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON object of a benchmark's answers (bounded by its questions)."""
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value)))))).alias("json"))


def combined(frames: list[DataFrame], order_key: str, seed: int) -> DataFrame:
    """Stacked, in a seeded order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(F.xxhash64(F.col(order_key), F.lit(seed)))
