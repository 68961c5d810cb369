"""Training sequences over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE, IMAGE = -100, -200  # fixed values: ignored label, image placeholder
T2I, CAPTION, TEXT = 1, 2, 3
# Prompts of the text-to-image task.
PROMPTS = [
    " Generate an image based on this description.",
    " Create an image that captures the provided description.",
    " Based on the previous text, produce a corresponding image.",
    " Please illustrate the above text with a picture.",
    " Translate the given description into a image.",
    " Construct a visual representation of the above description.",
    " Create a image that matches the text.",
    " Formulate a visual expression that reflects the narrative just provided.",
    " Give a visual depiction based on the above sentences.",
    " Create an image using the information mentioned above as guidance.",
]


def words(text: Column) -> Column:
    """The deterministic stand-in tokenizer: words by white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_ids(text: Column, vocab: int) -> Column:
    """Ids of words by CRC-32 modulo the vocabulary, which other engines can follow."""
    return F.transform(words(text), lambda w: (F.crc32(w.cast("binary")) % vocab).cast("int"))


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes as ids."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def offset_codes(codes: Column, vocab: int) -> Column:
    """Q1."""
    return F.transform(codes, lambda c: c + vocab)


def t2i(text_ids: Column, codes: Column, boi: int, eoi: int, eos: int, most: int) -> Column:
    """Q2: text, begin, codes, end, eos; truncation comes before the splice, as in the original, then the whole is cut."""
    base = F.slice(F.concat(text_ids, F.array(F.lit(boi), F.lit(eoi), F.lit(eos))), 1, most)
    n = F.size(base)
    return F.slice(F.concat(F.slice(base, 1, F.greatest(n - 2, F.lit(0))), codes, F.slice(base, F.greatest(n - 1, F.lit(1)), F.lit(2))), 1, most)


def caption(codes: Column, rest: Column, text_ids: Column, boi: int, eos: int, most: int) -> Column:
    """Q4: begin, codes, rest of the instruction, caption, eos."""
    return F.slice(F.concat(F.array(F.lit(boi)), codes, rest, text_ids, F.array(F.lit(eos))), 1, most)


def text_only(text_ids: Column, eos: int, most: int) -> Column:
    """Q5."""
    return F.slice(F.concat(text_ids, F.array(F.lit(eos))), 1, most)


def labels(ids: Column, instruction: Column, ntp: bool = False) -> Column:
    """Q6, Q15: the instruction's places are ignored, unless every token is predicted."""
    return ids if ntp else F.transform(ids, lambda x, i: F.when(i < instruction, IGNORE).otherwise(x))


def modality_ids(ids: Column, labels_: Column, instruction: Column, modality: Column) -> Column:
    """Q7: the modality, plus 3 in the instruction; ignored where the label is."""
    return F.transform(labels_, lambda y, i: F.when(y == IGNORE, IGNORE).otherwise(F.when(i < instruction, modality + 3).otherwise(modality)))


def insert_after_first(ids: Column, codes: Column, marker: int) -> Column:
    """Q12: codes after the first marker; unchanged without one."""
    at = F.array_position(ids, F.lit(marker)).cast("int")
    return F.when(at > 0, F.concat(F.slice(ids, 1, at), codes, F.slice(ids, at + 1, F.greatest(F.size(ids) - at, F.lit(0))))).otherwise(ids)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, even where the body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def within(ids: Column, spans: Column) -> Column:
    """Ids inside of any (a, b), IGNORE elsewhere."""
    return bound(spans, lambda held: F.transform(ids, lambda x, i: F.when(F.exists(held, lambda s: (i >= s["a"]) & (i < s["b"])), x).otherwise(IGNORE)))


def occurrences(ids: Column, marker: list[int]) -> Column:
    """Places (from 0) where a short sequence begins: the array compared with itself, shifted."""

    def search(held: Column) -> Column:
        n = F.size(held) - (len(marker) - 1)

        def here(i: Column) -> Column:
            hit = F.get(held, i) == marker[0]
            for k, m in enumerate(marker[1:], 1):
                hit = hit & (F.get(held, i + k) == m)
            return hit

        return F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), here)

    return bound(ids, search)


def marker_spans(ids: Column, marker: list[int], end: int) -> Column:
    """Q13: (from, to) of what follows each marker up to and with the next end token, or all there is. The search goes on
    behind a span, so a marker within one does not count; one at the very end has nothing behind it."""
    k = len(marker)

    def walk(ids_and_ends: Column) -> Column:
        n, ends = F.size(ids_and_ends["ids"]), ids_and_ends["ends"]

        def step(acc: Column, s: Column) -> Column:
            last = F.coalesce(F.get(F.filter(ends, lambda e: e >= s + k), F.lit(0)) + 1, n)
            return F.when((s >= acc["upto"]) & (s < n - k), F.struct(last.alias("upto"), F.concat(acc["spans"], F.array(F.struct((s + k).alias("a"), last.alias("b")))).alias("spans"))).otherwise(acc)

        zero = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
        return F.aggregate(occurrences(ids_and_ends["ids"], marker), zero, step)["spans"]

    ends = F.filter(F.transform(ids, lambda x, i: F.when(x == end, i)), lambda i: i.isNotNull())
    return bound(F.struct(ids.alias("ids"), ends.alias("ends")), walk)


def assistant_labels(ids: Column, marker: list[int], end: int) -> Column:
    """Q13: only answers are predicted."""
    return bound(ids, lambda held: within(held, marker_spans(held, marker, end)))


def with_placeholders(parts: Column) -> Column:
    """Q16: token arrays of the parts of a prompt split at images, joined by the image placeholder."""
    joined = F.flatten(F.transform(parts, lambda p: F.concat(F.array(F.lit(IMAGE)), p)))
    return F.slice(joined, 2, F.greatest(F.size(joined) - 1, F.lit(0)))


def splice_images(ids: Column, codes: Column, boi: int, eoi: int) -> Column:
    """Q17: each placeholder becomes begin, codes, end."""
    return F.flatten(F.transform(ids, lambda x: F.when(x == IMAGE, F.concat(F.array(F.lit(boi)), codes, F.array(F.lit(eoi)))).otherwise(F.array(x))))


def split_codebooks(codes: Column, books: int) -> Column:
    """Q22: one flat list as equal parts, one for each codebook."""
    per = F.floor(F.size(codes) / books).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(books - 1)), lambda b: F.slice(codes, b * per + 1, per))


def signed_length(text_lengths: Column, has_image: Column, per_image: int = 128) -> Column:
    """Q20: words plus 128 for an image; negative without one."""
    n = F.aggregate(text_lengths, F.lit(0), lambda a, x: a + x)
    return F.when(has_image, n + per_image).otherwise(-n)


def grid_groups(df, index: str, codes: str, n: int = 4):
    """Q19: the n generations of one index side by side; an index with another number of them raises."""
    return df.groupBy(index).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("pos", codes))).alias("parts")).select(index, "parts", F.assert_true(F.col("_n") == n).alias("_ok")).drop("_ok")
