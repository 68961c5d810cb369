"""Codebooks: nearest code, usage, perplexity, entropies, bit and mixed-radix codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Codes that a task holds at most.
MOST_CODES = 1 << 20


def nearest_code(df: DataFrame, codebook: DataFrame, vector: str = "embedding", cosine: bool = False) -> DataFrame:
    """The code of least squared distance (or largest cosine), of equals the first, by tiles of matrix products.

    A codebook is bounded by its vocabulary (some 10^5 codes); it is collected once and sent to the tasks.
    """
    if codebook.limit(MOST_CODES + 1).count() > MOST_CODES:
        raise ValueError(f"a codebook of more than {MOST_CODES} codes")
    rows = sorted((r[0], r[1]) for r in codebook.select("code", "vec").collect())
    codes, book = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.float64)
    if cosine:
        book = book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-12)
    half = (book**2).sum(1) / 2

    @F.pandas_udf("int")
    def near(vectors: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(vectors), 1024):
            x = np.stack(vectors.iloc[at : at + 1024].to_list()).astype(np.float64)
            out.append(codes[((x @ book.T) if cosine else (x @ book.T - half)).argmax(1)])
        return pd.Series(np.concatenate(out) if out else np.empty(0, np.int32))

    return df.withColumn("code", near(vector))


def gather(df: DataFrame, codebook: DataFrame) -> DataFrame:
    """Codes back to vectors."""
    return df.join(codebook, "code")


def remap(df: DataFrame, table: DataFrame, unknown: int) -> DataFrame:
    """Codes to new ids, unknown ones to a fixed id."""
    return df.join(table.select("code", "new_code"), "code", "left").withColumn("new_code", F.coalesce("new_code", F.lit(unknown)))


def usage(df: DataFrame, size: int, code: str = "code") -> DataFrame:
    """Used codes, utilisation, share of codes above a hundredth of the even share, perplexity."""
    counts = df.groupBy(code).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    p = F.col("c") / F.col("total")
    return counts.join(F.broadcast(total), how="cross").agg(
        F.count("*").alias("used"), (F.count("*") / size).alias("utilisation"), (100.0 * F.count_if(p > 0.01 / size) / size).alias("usage_percent"), F.exp(-F.sum(p * F.ln(p + 1e-10))).alias("perplexity")
    )


def unit(vector: Column, eps: float = 1e-12) -> Column:
    """M6: a vector over its length, or over ``eps`` where that is greater."""
    from .sequences import bound

    length = F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)), F.lit(eps))
    return bound(length, lambda n: F.transform(vector, lambda x: x / n))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def expanded_distance(a: Column, b: Column) -> Column:
    """M6: squared distance as |a|^2 + |b|^2 - 2 ab."""
    return inner(a, a) + inner(b, b) - 2 * inner(a, b)


def softmax(scores: Column) -> Column:
    """Of an array, shifted by its largest element."""
    from .sequences import bound

    e = bound(scores, lambda held: bound(F.array_max(held), lambda top: F.transform(held, lambda s: F.exp(s - top))))
    return bound(e, lambda held: bound(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(held, lambda x: x / total)))


def entropies(df: DataFrame, row: str, code: str, distance: str, temperature: float) -> DataFrame:
    """Mean entropy of rows, and entropy of the mean distribution, of softmax(-distance / temperature)."""
    from pyspark.sql import Window

    w = Window.partitionBy(row)
    e = F.exp((F.min(distance).over(w) - F.col(distance)) / temperature)
    p = df.withColumn("_e", e).withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    rows = p.groupBy(row).agg((-F.sum(F.col("_p") * F.ln(F.col("_p") + 1e-10))).alias("h")).agg(F.avg("h").alias("sample_entropy"))
    mean = p.groupBy(code).agg(F.avg("_p").alias("m")).agg((-F.sum(F.col("m") * F.ln(F.col("m") + 1e-10))).alias("average_entropy"))
    return rows.join(F.broadcast(mean), how="cross")


def sign_code(vector: Column) -> Column:
    """Bit i is set where part i is positive, least significant first."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)


def code_signs(code: Column, n: int) -> Column:
    return F.array(*[F.when(F.shiftright(code, i).bitwiseAND(F.lit(1).cast("long")) == 1, 1.0).otherwise(-1.0) for i in range(n)])


def radix_code(digits: list[Column], levels: list[int]) -> Column:
    """Digits to one number, the basis being the product of the levels before."""
    out, base = F.lit(0).cast("long"), 1
    for d, n in zip(digits, levels, strict=True):
        out, base = out + d.cast("long") * base, base * n
    return out


def radix_digits(code: Column, levels: list[int]) -> list[Column]:
    out, base = [], 1
    for n in levels:
        out.append(F.floor(code / base).cast("long") % n)
        base *= n
    return out


def bounded_digit(x: Column, level: int) -> Column:
    """A real number to one of ``level`` digits by tanh and rounding half to even."""
    half = (level - 1) / 2
    shift = 0.0 if level % 2 else 0.5
    return (F.rint(F.tanh(x) * half - shift) + F.lit(float(level // 2))).cast("int")


def clamp_codes(codes: Column, offset: int, most: int) -> Column:
    """Q18."""
    return F.transform(codes, lambda c: F.greatest(F.lit(0), F.least(F.lit(most), c - offset)))
