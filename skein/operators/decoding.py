"""Token selection from logits, as arrays in one row or as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, seq: str, logit: str, k: int) -> DataFrame:
    """Tokens at least as large as the k-th; ties stay."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(seq).orderBy(F.desc(logit)))).where(F.col("_r") <= k).drop("_r")


def with_probability(df: DataFrame, seq: str, logit: str) -> DataFrame:
    """M7: softmax within a sequence."""
    w = Window.partitionBy(seq)
    e = df.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_p(df: DataFrame, seq: str, logit: str, token: str, p: float, ascending: bool = False) -> DataFrame:
    """Tokens until the mass before them exceeds p (the first over the line stays). ``ascending`` is L13's form:
    tokens whose mass counted from the smallest is above 1 - p, and the largest in any case."""
    x = with_probability(df, seq, logit)
    if ascending:
        w = Window.partitionBy(seq).orderBy(F.asc(logit), F.desc(token))
        top = F.row_number().over(Window.partitionBy(seq).orderBy(F.desc(logit), F.asc(token)))
        return x.withColumn("_c", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", top).where((F.col("_c") > 1 - p) | (F.col("_t") == 1)).drop("_c", "_t")
    w = Window.partitionBy(seq).orderBy(F.desc(logit), F.asc(token)).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("_c", F.sum("p").over(w) - F.col("p")).where(F.col("_c") <= p).drop("_c")


def renormalised(df: DataFrame, seq: str, p: str = "p") -> DataFrame:
    """L14."""
    return df.withColumn(p, F.col(p) / F.sum(p).over(Window.partitionBy(seq)))


def pick(df: DataFrame, seq: str, token: str, p: str = "p", seed: int | None = None) -> DataFrame:
    """The likeliest token, or with a seed the one at a hashed place of the cumulative mass."""
    if seed is None:
        return df.groupBy(seq).agg(F.max_by(token, F.struct(F.col(p), -F.col(token))).alias(token))
    w = Window.partitionBy(seq).orderBy(F.desc(p), F.asc(token)).rowsBetween(Window.unboundedPreceding, 0)
    u = F.pmod(F.xxhash64(F.col(seq), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    x = df.withColumn("_c", F.sum(p).over(w))
    return x.where(F.col("_c") > u * F.sum(p).over(Window.partitionBy(seq))).groupBy(seq).agg(F.min_by(token, "_c").alias(token))


def guided(cond: Column, uncond: Column, scale: float) -> Column:
    """M2: u + (c - u) * s, over arrays."""
    return F.zip_with(cond, uncond, lambda c, u: u + (c - u) * scale)


def guided_twice(full: Column, image: Column, none: Column, text_scale: float, image_scale: float) -> Column:
    """M3: none + image_scale * (image - none) + text_scale * (full - image)."""
    return F.zip_with(F.zip_with(none, image, lambda n, i: n + image_scale * (i - n)), F.zip_with(full, image, lambda f, i: text_scale * (f - i)), lambda a, b: a + b)


def masked(logits: Column, allow: Column) -> Column:
    """M4: minus infinity where a token (0-based) is not in the array of allowed ones."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(allow, i), x).otherwise(float("-inf")))


def in_range(length: Column, start: Column | int, end: Column | int | None) -> Column:
    """M4: whether the sequence is as long as the range says: from ``start``, below ``end`` (none: open). Both may be columns,
    so that each sequence has its own range."""
    begun = length >= start
    return begun if end is None else begun & (F.coalesce(length < end, F.lit(True)) if isinstance(end, Column) else length < end)


def disallow_in_range(ids: Column, logits: Column, tokens: list[int], start: Column | int, end: Column | int | None = None) -> Column:
    """M4: these tokens may not follow while the sequence's length is in the range."""
    bad = F.array(*[F.lit(x) for x in tokens]).cast("array<int>")
    return F.when(in_range(F.size(ids), start, end), F.transform(logits, lambda x, i: F.when(F.array_contains(bad, i), float("-inf")).otherwise(x))).otherwise(logits)


def allow_in_range(ids: Column, logits: Column, tokens: list[int], start: Column | int, end: Column | int | None = None) -> Column:
    """M4: no others may follow then."""
    return F.when(in_range(F.size(ids), start, end), masked(logits, F.array(*[F.lit(x) for x in tokens]).cast("array<int>"))).otherwise(logits)


def allow_at_offset(ids: Column, logits: Column, trigger: int, tokens: list[int], offset: int) -> Column:
    """M4: where the token ``offset`` places back is the trigger, no others may follow."""
    hit = (F.size(ids) >= offset) & F.coalesce(F.try_element_at(ids, F.lit(-offset)) == trigger, F.lit(False))
    return F.when(hit, masked(logits, F.array(*[F.lit(x) for x in tokens]).cast("array<int>"))).otherwise(logits)


def allow_in_window(ids: Column, logits: Column, trigger: int, tokens: list[int], width: int) -> Column:
    """M4: where the trigger is among the last ``width`` tokens, no others may follow."""
    hit = F.array_contains(F.slice(ids, F.greatest(F.size(ids) - (width - 1), F.lit(1)), F.lit(width)), trigger)
    return F.when(hit, masked(logits, F.array(*[F.lit(x) for x in tokens]).cast("array<int>"))).otherwise(logits)


#: Rows of a sequence that are sorted together.
BLOCK = 4096


def after_triggers(df: DataFrame, seq: str, pos: str, token: str, windows: dict[str, tuple[int, int]], offsets: dict[str, tuple[int, int]]) -> DataFrame:
    """M4 for sequences as rows: columns of the names in ``windows`` (trigger, width), whether the trigger stands among the
    ``width`` tokens before a row, and in ``offsets`` (trigger, offset), whether it stands ``offset`` places before it.
    ``pos`` counts from 0 without gaps and tells a sequence's rows apart.

    No window over a whole sequence: rows are sorted in blocks, and the last rows of a block, as far as a trigger reaches,
    are also put before the next one. All triggers are found in one pass; where the rows are dealt out by ``seq`` already
    (or made from such rows), they stay where they are.
    """
    reach = max([n for _, n in [*windows.values(), *offsets.values()]], default=0)
    size = max(BLOCK, reach)
    own = F.floor(F.col(pos) / size)
    x = df.withColumn("_block", F.explode(F.when(F.col(pos) % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))))
    order = Window.partitionBy(seq, "_block").orderBy(pos)
    last = {n: F.max(F.when(F.col(token) == n, F.col(pos))).over(order.rowsBetween(Window.unboundedPreceding, -1)) for n, _ in windows.values()}
    found = {name: F.coalesce(last[n] >= F.col(pos) - width, F.lit(False)) for name, (n, width) in windows.items()}
    found |= {name: F.coalesce(F.lag(token, offset).over(order) == n, F.lit(False)) for name, (n, offset) in offsets.items()}
    return x.withColumns(found).where(F.col("_block") == own).drop("_block")


def after_trigger(df: DataFrame, seq: str, pos: str, token: str, trigger: int, width: int, offset: int, window_name: str = "in_window", offset_name: str = "at_offset") -> DataFrame:
    """M4 for sequences as rows: ``after_triggers`` for one trigger."""
    return after_triggers(df, seq, pos, token, {window_name: (trigger, width)}, {offset_name: (trigger, offset)})


def only(condition: Column, tokens: list[int]) -> Column:
    """M4 for up to 32 tokens as bits: those that may follow where the condition holds; all where it does not."""
    return F.when(condition, F.lit(sum(1 << k for k in tokens))).otherwise(F.lit(-1))


def penalised(logit: Column, count: Column, repetition: float = 1.0, frequency: float = 0.0, presence: float = 0.0) -> Column:
    """M5: seen tokens are divided by the repetition penalty if positive, multiplied if not; then counts and presence cost."""
    seen = F.coalesce(count, F.lit(0)) > 0
    x = F.when(seen, F.when(logit > 0, logit / repetition).otherwise(logit * repetition)).otherwise(logit)
    return x - frequency * F.coalesce(count, F.lit(0)) - F.when(seen, presence).otherwise(0.0)


def stop_at(tokens: Column, end_id: int, max_length: int, start: int = 0) -> Column:
    """Q24: tokens up to and with the first end token at or after a place, and at most max_length."""
    tail = F.slice(tokens, start + 1, F.size(tokens))
    at = F.array_position(tail, F.lit(end_id))
    return F.slice(tokens, 1, F.least(F.lit(max_length), F.when(at > 0, at + start).otherwise(F.size(tokens))).cast("int"))


def stop_at(tokens: Column, end_id: int, max_length: int, start: int = 0) -> Column:
    """Q24: tokens up to and with the first end token at or after a place, and at most max_length."""
    tail = F.slice(tokens, start + 1, F.size(tokens))
    at = F.array_position(tail, F.lit(end_id))
    return F.slice(tokens, 1, F.least(F.lit(max_length), F.when(at > 0, at + start).otherwise(F.size(tokens))).cast("int"))


def stops(ids: Column, max_length: int, end_id: int, end_from: Column | int, keywords: list[list[int]], begin: Column | int = 0) -> Column:
    """Q24: for each criterion the length at which it first holds (null: never), as a struct, and the least as ``first``.

    max_length: the sequence is that long; end: there is an end token; end_after: there is one at or behind a place;
    keyword: the sequence, longer than its prompt of ``begin`` tokens, ends with one of the keywords. Suffixes roll: a keyword is looked for by
    comparing the array with itself shifted, once for each of its tokens.
    """
    from .sequences import occurrences

    n = F.size(ids)
    first_end = F.nullif(F.array_position(ids, F.lit(end_id)), F.lit(0)).cast("int")
    places = F.filter(F.transform(ids, lambda x, i: F.when(x == end_id, i)), lambda i: i.isNotNull())
    later = F.get(F.filter(places, lambda i: i >= end_from), F.lit(0)) + 1

    def ends_of(k: list[int]) -> Column:
        return F.transform(occurrences(ids, k), lambda i: i + len(k))

    ends = F.concat(*[ends_of(k) for k in keywords]) if keywords else F.array().cast("array<int>")
    keyword = F.array_min(F.filter(ends, lambda e: e > begin))
    out = {"max_length": F.when(n >= max_length, F.lit(max_length)), "end": first_end, "end_after": later, "keyword": keyword}
    return F.struct(*[c.alias(k) for k, c in out.items()], F.least(*out.values()).alias("first"))


def batch_stops(df: DataFrame, batch: str, stop: str) -> DataFrame:
    """Q24: a batch goes on until one criterion holds for all of its sequences: per batch that criterion's length for each
    criterion (null: it never holds for all) and the least of them as ``first``."""
    names = ["max_length", "end", "end_after", "keyword"]
    all_rows = df.groupBy(batch).agg(*[F.when(F.count(f"{stop}.{c}") == F.count("*"), F.max(f"{stop}.{c}")).alias(c) for c in names])
    return all_rows.withColumn("first", F.least(*names))


def cross_entropy(df: DataFrame, seq: str, logit: str, token: str, target: str) -> DataFrame:
    """M7: -log softmax of the target token of each sequence, as an aggregate: log of the sum of exponents, less the target's
    logit. A sequence whose target is not among its tokens has a null loss."""
    top = df.groupBy(seq).agg(F.max(logit).alias("_top"), F.max(F.when(F.col(token) == F.col(target), F.col(logit))).alias("_own"))
    total = df.join(top, seq).groupBy(seq).agg(F.sum(F.exp(F.col(logit) - F.col("_top"))).alias("_sum"), F.first("_top").alias("_top"), F.first("_own").alias("_own"))
    return total.select(seq, (F.ln("_sum") + F.col("_top") - F.col("_own")).alias("loss"))
