"""Pluggable tokenizers (X3, X4): what turns images into codes and texts into ids, as stages of a DataFrame.

A tokenizer is made once in each task, by a function without arguments that can be sent there, so a model is loaded where it
is used; it then sees batches of a bounded number of rows. Rows that it cannot read have null instead of codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import sequences


class ImageTokenizer(Protocol):
    """Codes of images (their bytes), in order; None for one that is no image."""

    def encode(self, images: list[bytes]) -> list[list[int] | None]: ...


class TextTokenizer(Protocol):
    def encode(self, texts: list[str]) -> list[list[int] | None]: ...


class DigestCodes:
    """A stand-in that other engines can follow: code i is the first seven hexadecimal digits of the MD5 of the image and i,
    modulo the size of the codebook. Empty images cannot be read."""

    def __init__(self, codes: int = 16, book: int = 8192):
        self.codes, self.book = codes, book

    def encode(self, images: list[bytes]) -> list[list[int] | None]:
        return [[int(hashlib.md5(x + str(i).encode()).hexdigest()[:7], 16) % self.book for i in range(self.codes)] if x else None for x in images]


def with_codes(df: DataFrame, column: str, make: Callable[[], ImageTokenizer | TextTokenizer], out: str = "codes", rows: int = 64) -> DataFrame:
    """The rows with ``out``, an array of ints. ``column`` holds bytes or text; null is not sent to the tokenizer and
    has null codes. A column of the name ``out`` is replaced."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))])
    arrow, at = to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])), [f.name for f in kept].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make()
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                values = part.column(at).to_pylist()
                codes = iter(tokenizer.encode([v for v in values if v is not None]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if v is None else next(codes) for v in values], arrow.field(out).type)], schema=arrow)

    return df.select(*[f.name for f in kept]).mapInArrow(run, schema)


def with_text_ids(df: DataFrame, text: str, tokenizer: str | Callable[[], TextTokenizer], out: str = "ids", vocab: int = 32_000) -> DataFrame:
    """``whitespace`` and ``utf8_bytes`` are expressions; anything else is a function that makes a tokenizer."""
    if tokenizer == "whitespace":
        return df.withColumn(out, sequences.word_ids(F.col(text), vocab))
    if tokenizer == "utf8_bytes":
        return df.withColumn(out, sequences.byte_ids(F.col(text)))
    if isinstance(tokenizer, str):
        raise ValueError(f"no tokenizer {tokenizer}")
    return with_codes(df, text, tokenizer, out)


def whitened(pixels: str, out: str = "rgb") -> Column:
    """M9: an array of (r, g, b, a) from 0 to 255 over white, as (r, g, b), cut to whole numbers."""

    def over(p, c):
        a = p["a"] / 255.0
        return F.floor(((1 - a) + a * (p[c] / 255.0)) * 255.0 + 1e-9).cast("int").alias(c)

    return F.transform(pixels, lambda p: F.struct(over(p, "r"), over(p, "g"), over(p, "b"))).alias(out)
