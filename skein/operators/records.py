"""Unified corpus records: projections, filters and conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, source_dataset

UNIFIED = "tokenized boolean, source string, data_type string, text string, conversation array<struct<from:string,value:string>>, length int, vqcode_256 array<int>, vqcode_512 array<int>, vqcode_multi768 array<int>, width int, height int, url string, timestamp string, id string"
DATASET_IDS = {"dclm": 1, "laion-aesthetics": 2, "midjourney": 3, "blip3o-60k-short": 4}


def unify_text(df: DataFrame, text: str = "text", min_length: int | None = None) -> DataFrame:
    """Raw text to unified columns; with min_length, texts shorter once stripped go."""
    if min_length is not None:
        df = df.where(F.length(py_strip(F.col(text))) >= min_length)
    return df.withColumns({"data_type": F.lit("text_pretrain"), "length": F.length(text), "n_bytes": F.octet_length(text)})


def with_defaults(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Url, timestamp and id with their defaults."""
    return df.withColumns({"url": F.coalesce("url", F.lit("")), "timestamp": F.coalesce("timestamp", F.lit("")), "id": F.coalesce("id", F.concat(F.lit("sample_"), F.col(idx).cast("string")))})


def complete(df: DataFrame, *needed: str) -> DataFrame:
    """Rows that failed go: those that lack any of what they need. A batch of which nothing is left is no batch."""
    return df.where(F.forall(F.array(*[F.col(c).isNotNull() for c in needed]), lambda ok: ok))


def unify_image(df: DataFrame, text: str, codes: str) -> DataFrame:
    """Length counts four for each code; rows without a caption go."""
    return df.where(F.col(text).isNotNull()).withColumns({"tokenized": F.lit(True), "data_type": F.lit("image_text"), "length": F.length(text) + 4 * F.size(codes)})


def score_range(df: DataFrame, score: str, low: float, high: float | None = None, width: str | None = None, height: str | None = None, least: int = 0) -> DataFrame:
    """P5: low <= score < high, and sizes of at least ``least`` where both columns exist; NULL goes."""
    df = df.where(F.col(score) >= low)
    if high is not None:
        df = df.where(F.col(score) < high)
    if width in df.columns and height in df.columns:
        df = df.where((F.col(width) >= least) & (F.col(height) >= least))
    return df


def aspect_ok(w: Column, h: Column, bound: float, inclusive: bool) -> Column:
    """Longer to shorter side within a bound."""
    ratio = F.greatest(w, h) / F.least(w, h)
    return ratio <= bound if inclusive else ratio < bound


def filter_stats(df: DataFrame, keep: Column, file: Column | None = None) -> DataFrame:
    """Total, kept, rate (0 if empty) and, with a file column, the number of files."""
    out = [F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.coalesce(F.try_divide(F.count_if(keep), F.count("*")), F.lit(0.0)).alias("rate")]
    return df.agg(*out, *([F.count_distinct(file).alias("n_files")] if file is not None else []))


def turns(col: str) -> Column:
    """P10: conversation turns with nothing but from and value."""
    return F.transform(col, lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value")))


def text_to_turns(text: Column) -> Column:
    """A text as one answer turn; NULL is empty."""
    return F.array(F.struct(F.lit("gpt").alias("from"), F.coalesce(text, F.lit("")).alias("value")))


def turns_from_pairs(pairs: str) -> Column:
    """{user, assistant} pairs as alternating human and gpt turns; NULL stays NULL (nothing leaks between rows)."""
    return F.flatten(F.transform(pairs, lambda p: F.array(F.struct(F.lit("human").alias("from"), p["user"].alias("value")), F.struct(F.lit("gpt").alias("from"), p["assistant"].alias("value")))))


def dataset_id(source: Column) -> Column:
    """Dictionary code of a source; NULL is 1, unknown names are NULL."""
    table = F.create_map(*[F.lit(x) for kv in DATASET_IDS.items() for x in kv])
    return F.when(source.isNull(), 1).otherwise(F.try_element_at(table, source_dataset(source)))


def no_to_null(c: Column) -> Column:
    """The sentinel 'no' and JSON lists of codes: array or NULL."""
    return F.from_json(c, "array<int>")


def null_to_no(c: Column) -> Column:
    return F.coalesce(F.to_json(c), F.lit("no"))


def class_index(df: DataFrame, name: str) -> DataFrame:
    """Index of a class among the sorted distinct classes. Spark broadcasts them if they are small enough."""
    from .rows import with_row_index

    return df.join(with_row_index(df.select(name).where(F.col(name).isNotNull()).distinct(), name, name="class_index"), name)
