"""Corpus BLEU over any number of references (A14), as counts that Spark adds up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL, TINY = 1e-9, 1e-15  # fixed values of the public scorer
#: What the scorer's tokenizer drops.
SEPARATORS = " \t\n\x0b\f\r.,?!:;'`-"
#: Bytes of texts that are counted together.
PORTION = 4 << 20


def caption_words(text: Column) -> Column:
    """Words of a caption in lower case, without the punctuation that the scorer's tokenizer drops."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^\x20\x09-\x0D.,?!:;'`-]+"), F.lit(0))


def clipped(texts: pa.ListArray, most: int) -> list[np.ndarray]:
    """Of rows of texts, the first being the prediction and the rest references: hits of 1 to ``most`` words, n-grams of 1 to
    ``most`` words, length of the prediction, length of the nearest reference (0 without any).

    Words are numbers, and an n-gram is the number of its first words with its last one, so a step is as large as the texts."""
    rows, first = len(texts), texts.offsets.to_numpy()
    sides = np.diff(first)
    listed = pc.split_pattern(texts.flatten(), " ")
    words, ends = listed.flatten(), listed.offsets.to_numpy()
    side = np.repeat(np.arange(len(listed)), np.diff(ends))
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.filter(pa.array(real)).dictionary_encode()
    word, side = coded.indices.to_numpy().astype(np.int64), side[real]
    row_of = np.repeat(np.arange(rows), sides)  # of a side
    place = np.arange(len(row_of)) - np.repeat(first[:-1] - first[0], sides)  # 0: the prediction
    size = np.bincount(side, minlength=len(row_of))
    vocabulary, most_sides, own = max(1, len(coded.dictionary)), int(sides.max(initial=1)), place == 0

    hits, totals, gram, at = [], [], np.zeros(len(word), np.int64), np.arange(len(word))
    for n in range(most):
        stays = at + n < len(word)
        gram, at = gram[stays], at[stays]
        stays = side[at + n] == side[at]
        gram, at = gram[stays], at[stays]
        gram = pd.factorize(gram * vocabulary + word[at + n])[0].astype(np.int64)
        width = int(gram.max(initial=0)) + 1
        met, keys = pd.factorize(row_of[side[at]] * width + gram)
        pair, pairs = pd.factorize(met.astype(np.int64) * most_sides + place[side[at]])
        count, key, predicted = np.bincount(pair, minlength=len(pairs)), pairs // most_sides, pairs % most_sides == 0
        said, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        said[key[predicted]] = count[predicted]
        np.maximum.at(best, key[~predicted], count[~predicted])
        hits.append(np.bincount(keys // width, np.minimum(said, best), rows).astype(np.int64))
        totals.append(np.bincount(keys // width, said, rows).astype(np.int64))
    length, near = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    length[row_of[own]] = size[own]
    order = np.flatnonzero(~own)
    order = order[np.lexsort((size[order], np.abs(size[order] - length[row_of[order]]), row_of[order]))]
    found, where = np.unique(row_of[order], return_index=True)
    near[found] = size[order[where]]
    return [*hits, *totals, length, near]


def portions(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch cut where its texts reach ``limit`` bytes; a row is never cut."""
    texts = batch.column(column)
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy(zero_copy_only=False))])
    ends = sizes[texts.offsets.to_numpy() - texts.offsets[0].as_py()]  # before each row
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def corpus_bleu(df: DataFrame, group: str, key: str, predicted: str, references: str, most: int = 4) -> DataFrame:
    """For each group bleu1 to bleu4, and both lengths, of ``predicted`` (text) against ``references`` (array of texts).

    Matches of an n-gram are clipped by the most that one reference has of it. A prediction is compared with the reference
    whose length is nearest (the shorter of two). N-grams are counted within their row, some ``PORTION`` bytes of rows at a
    time, so only a row of sums leaves a row, and a group is added up by parts. ``key`` must tell rows apart; null
    predictions are empty, null references none; a prediction without references counts with its length and matches nothing.
    """
    kind = df.schema[group].dataType
    plain = lambda c: F.translate(F.lower(c), SEPARATORS, " " * len(SEPARATORS))
    given = F.filter(F.coalesce(F.col(references), F.array().cast("array<string>")), lambda r: r.isNotNull())
    rows = df.select(F.col(group).alias("g"), F.transform(F.concat(F.array(F.coalesce(F.col(predicted), F.lit(""))), given), plain).alias("texts"))
    sums = [*[f"{c}{n}" for c in ("hit", "all") for n in range(1, most + 1)], "predicted_length", "reference_length"]
    schema = T.StructType([T.StructField("g", kind), *[T.StructField(c, T.LongType()) for c in sums]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, PORTION):
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in clipped(part.column(1), most)]], names=["g", *sums])

    out = rows.mapInArrow(count, schema).groupBy("g").agg(*[F.sum(c).alias(c) for c in sums])
    ratio = (F.col("predicted_length") + TINY) / (F.col("reference_length") + SMALL)
    penalty = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    product, scores = F.lit(1.0), []
    for n in range(1, most + 1):
        product = product * (F.col(f"hit{n}") + TINY) / (F.col(f"all{n}") + SMALL)
        scores.append((F.pow(product, F.lit(1 / n)) * penalty).alias(f"bleu{n}"))
    return out.select(F.col("g").alias(group), *scores, "predicted_length", "reference_length")
