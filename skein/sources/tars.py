"""Tar shards as a stream of members (S7, X8): one row of a listing becomes as many rows as the archive has members.

An archive is read from its file from front to back; what is held is one member, or ``PART`` bytes of it where members are
asked for in parts. A damaged archive gives what stands before the damage and one more row that says what is wrong.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import listing

#: Bytes of a part of a member.
PART = 16 << 20
#: Bytes and rows that a task sends on at once.
SENT, ROWS = 4 << 20, 1000
MEMBERS = "url: string, pos: long, key: string, suffix: string, part: int, data: binary, error: string"


def split_name(name: str) -> tuple[str, str] | None:
    """Folder and name up to the first dot, and the rest in lower case; None without a dot or a name before it."""
    folder, _, base = name.rpartition("/")
    key, dot, suffix = base.partition(".")
    if not dot or not key:
        return None
    return (f"{folder}/{key}" if folder else key), suffix.lower()


def open_stream(url: str):
    from pyarrow import fs

    # file:/x is how Spark writes local paths, file:///x how Arrow does.
    system, path = fs.FileSystem.from_uri(url.replace("file:/", "file:///", 1) if url.startswith("file:/") and not url.startswith("file://") else url)
    return system.open_input_stream(path)


class Members:
    """The members of one archive, also as a table function for each row of a listing (which holds an archive's rows)."""

    def eval(self, url: str, part_bytes: int) -> Iterator[tuple]:
        pos = 0
        try:
            with open_stream(url) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                for member in tar:
                    named = split_name(member.name) if member.isfile() else None
                    if named is not None:
                        source, left, part = tar.extractfile(member), member.size, 0
                        while left or not part:
                            data = source.read(min(part_bytes, left)) if left else b""
                            if left and not data:
                                raise tarfile.ReadError("unexpected end of data")
                            left -= len(data)
                            yield url, pos, *named, part, data, None
                            part += 1
                    pos += 1
        except (tarfile.TarError, EOFError, OSError) as e:
            yield url, pos, None, None, None, None, f"{type(e).__name__}: {e}"


def batches_of(urls: Iterator[str], part_bytes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Members in batches that end as soon as they have ``SENT`` bytes or ``ROWS`` rows."""
    held, size = [], 0
    for row in (row for url in urls for row in Members().eval(url, part_bytes)):
        held.append(row)
        size += len(row[5] or b"")
        if size >= SENT or len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def expanded(urls: DataFrame, part_bytes: int = PART) -> DataFrame:
    """One row of a listing (its first column, the path) to as many as the archive has members, also in a stream."""
    schema = to_arrow_schema(T.StructType.fromDDL(MEMBERS))
    return urls.mapInArrow(lambda batches: batches_of((url for b in batches for url in b.column(0).to_pylist()), part_bytes, schema), MEMBERS)


def members(spark: SparkSession, path: str, part_bytes: int = PART) -> DataFrame:
    """Url, pos (place in its archive), key, suffix, part, data and error of all members of all tars below a
    folder. Members that are no files, or whose name has no suffix, are passed over but counted in ``pos``. The listing is
    dealt out so that as many archives are read at a time as there are cores."""
    tars = listing(spark, path, ".tar").where("length > 0").select("path")
    return expanded(tars.repartition(max(1, spark.sparkContext.defaultParallelism), "path"), part_bytes)


def whole(parts: DataFrame) -> DataFrame:
    """Members in one piece, for those that fit a row: error rows go."""
    listed = parts.where("error is null").groupBy("url", "pos", "key", "suffix").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("p"))
    return listed.select("url", "pos", "key", "suffix", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data"))


def samples(rows: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """Members of one key that follow one another, as a map from suffix to data. A new key, or a suffix that the
    sample has already, begins a new one; only wanted suffixes are kept, and samples without any go. Needs whole members:
    url, pos, key, suffix, data."""
    from ..operators.batching import sessions

    grouped = sessions(rows, "pos", "key", "suffix")
    kept = grouped if suffixes is None else grouped.where(F.col("suffix").isin(suffixes))
    return kept.groupBy("url", "sample").agg(F.min("pos").alias("pos"), F.first("key").alias("key"), F.map_from_entries(F.collect_list(F.struct("suffix", "data"))).alias("members"))


def captioned(found: DataFrame, members: str = "members") -> DataFrame:
    """Samples with a caption and an image, of whatever kind."""
    keys = F.map_keys(members)
    return found.where(F.array_contains(keys, "txt") & F.arrays_overlap(keys, F.array(*[F.lit(x) for x in ("png", "jpg", "jpeg", "webp")])))


def unified(found: DataFrame, members: str = "members") -> DataFrame:
    """Samples as unified records: text from the txt member, source, url and id from the json member, 'no' where it says
    nothing or cannot be read."""
    said = F.col(members)["json"].cast("string")
    of = {c: F.coalesce(F.get_json_object(said, f"$.{c}"), F.lit("no")) for c in ("source", "url", "id")}
    return found.withColumns({"text": F.col(members)["txt"].cast("string"), "data_type": F.lit("text_pretrain"), **of})


def damaged(rows: DataFrame) -> DataFrame:
    """Archives that could not be read to their end: url, pos of the damage, error."""
    return rows.where("error is not null").select("url", "pos", "error")
