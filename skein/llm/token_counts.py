"""Document token counts from flat token files without an index, by separator scan.

A file is nothing but little-endian ids, one end-of-document id after each document. Files are read in blocks, each by
its own task; a block is searched for the separator as a whole array. What a block cannot know, the tokens its first
document had in earlier blocks, comes from a prefix scan over a few numbers for each block. Documents longer than many
blocks are right, and so are empty ones (two separators in a row), files that lack a last separator (what follows the
last one counts as one open document if it is not empty) and empty files.

``write_tokens`` makes such files from documents. Each task writes one file of its own under a name no other attempt
uses, and only the names that finished tasks report are read: a lost executor leaves at worst an unread file.
Null text counts as empty. Repeated rows are documents of their own; other columns pass by.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_text, map_rows, shared_folder, vocabulary
from .tokens import byte_tokenizer


@functools.cache
def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def opened(uri: str, mode: str):
    """A file on any file system that Arrow knows (local, HDFS, S3, ...)."""
    root, _, name = uri.rpartition("/")
    system, path = _file_system(root)
    if mode == "w":
        system.create_dir(path, recursive=True)
        return system.open_output_stream(f"{path}/{name}", compression=None)
    return system.open_input_file(f"{path}/{name}")


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, separator: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files; returns, from the shared folder, (file, ordinal, doc_id, bytes) of every document."""
    path = path or vocabulary("byte_bpe_50k.json")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def start():
        t, task = byte_tokenizer(path), TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:12]}.bin"

        class Writer:
            def __init__(self):
                self.file, self.rows, self.at = None, 0, 0

            def __call__(self, doc_id, text):
                if self.file is None:
                    self.file = opened(name, "w")
                data = np.append(t.ids(text, special=False), np.uint32(separator)).astype("<u2" if separator < 1 << 16 else "<u4").tobytes()
                self.file.write(data)
                self.at += len(data)
                yield name, self.rows, doc_id, self.at
                self.rows += 1

            def finish(self):
                if self.file is not None:
                    self.file.close()
                return ()

        return Writer()

    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("bytes", pa.int64())])
    return cut(map_rows(id_text(docs, id_col, text_col), start, schema, "file string, ordinal long, doc_id long, bytes long", 4096))


def scan_blocks(files: DataFrame, separator: int = 50256, width: int = 2, block_bytes: int = 8 << 20) -> DataFrame:
    """(file, block, first, ends): of each block its first id's place in the file and the places of its separators.

    ``files`` has file (a URI) and bytes; ``width`` is the bytes of an id.
    """
    block_bytes -= block_bytes % width
    blocks = files.where("bytes >= 0").select("file", F.col("bytes").cast("long").alias("bytes"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes).cast("long")))).alias("block"))

    def start():
        def each(file, size, block):
            begin = block * block_bytes
            with opened(file, "r") as f:
                f.seek(begin)
                ids = np.frombuffer(f.read(min(block_bytes, size - begin) // width * width), f"<u{width}")
            ends = np.flatnonzero(ids == separator).astype(np.int64) + begin // width
            yield file, block, begin // width, len(ids), ends

        return each

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("tokens", pa.int64()), ("ends", pa.list_(pa.int64()))])
    spread = blocks.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file", "block")
    return map_rows(spread, start, schema, "file string, block long, first long, tokens long, ends array<long>", 8)


def count_tokens(files: DataFrame, separator: int = 50256, width: int = 2, block_bytes: int = 8 << 20) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in the files; the separator itself is not counted."""
    blocks = cut(scan_blocks(files, separator, width, block_bytes))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    light = blocks.select("file", "block", "first", "tokens", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    carried = light.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("end"),
        (F.max("block").over(Window.partitionBy("file")) == F.col("block")).alias("is_last"),
    )
    stitched = blocks.join(carried, ["file", "block"])
    # every separator against the one before it; the first one against the end carried in
    ends = F.concat(F.array("end"), F.col("ends"), F.when(F.col("is_last") & (F.col("first") + F.col("tokens") - 1 > F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("end"))), F.array(F.col("first") + F.col("tokens"))).otherwise(F.array().cast("array<long>")))
    lengths = F.zip_with(F.slice("all", 2, F.size("all")), F.slice("all", 1, F.size("all") - 1), lambda a, b: a - b - 1)
    rows = stitched.withColumn("all", ends).select("file", "documents", F.size("ends").alias("n"), F.posexplode(lengths).alias("pos", "n_tokens"))
    return rows.select("file", (F.col("documents") + F.col("pos")).alias("ordinal"), "n_tokens", (F.col("pos") < F.col("n")).alias("closed"))


def count_document_tokens(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens: documents written to flat files in the shared folder, then counted from those files alone."""
    written = write_tokens(docs, shared_folder(spark, "tokens"), id_col=id_col, text_col=text_col)
    files = written.groupBy("file").agg(F.max("bytes").alias("bytes"))
    return written.select("file", "ordinal", "doc_id").join(count_tokens(files), ["file", "ordinal"]).select("doc_id", "n_tokens")
