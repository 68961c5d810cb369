"""Joins, cell updates, choices and geometry around evaluation runs (J7-J9, J11, J17, P13, P17, P19, Q21, A43, A46, W15, L14,
L16, L17, U3, U6, F15, M8, M14). Keys are explicit id columns; nothing depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predicted_or_failed(split: DataFrame, problems: DataFrame, predictions: DataFrame, key: str, column: str) -> DataFrame:
    """Problems of a split with their predictions; where there is none, FAILED."""
    return split.select(key).join(problems, key).join(predictions.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit("FAILED")))


def merged(first: DataFrame, key: str, needed: list[DataFrame], optional: list[DataFrame] | None = None) -> DataFrame:
    """Rows that all tables have; J9: beside them what optional tables know, null where they know nothing."""
    for other in needed:
        first = first.join(other, key)
    for other in optional or []:
        first = first.join(other, key, "left")
    return first


def updated(table: DataFrame, updates: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """The cells of one column replaced where there is an update, the last one by ``order`` (without one: the greatest
    value), so that rows stay as many as they are."""
    new = updates.groupBy(key).agg(F.max_by(column, order or column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def with_codes(rows: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Image codes attached by id; a row without image gets 'no'. No row is lost, and none shifts another's codes."""
    return rows.join(codes.select(key, "codes"), key, "left").withColumn("codes", F.coalesce("codes", F.lit("no")))


def caption_choice(first: Column, second: Column, draw: Column, share: float = 0.8) -> Column:
    """Q21: of two captions ('no': there is none) the first if the draw is above ``share``, else the second; the only one
    there is; <unconditional> without any."""
    a, b = first != "no", second != "no"
    return F.when(a & b, F.when(draw > share, first).otherwise(second)).when(a, first).when(b, second).otherwise("<unconditional>")


def review_version(name: Column) -> Column:
    """The judge's version by its name."""
    return F.when(F.contains(name, F.lit("0613")), "0613").otherwise("0314")


def filled(table: DataFrame, index: str, batch: int, times: int = 1) -> DataFrame:
    """Every index ``times`` times in a row, and as many of the first indices again as fill the last batch. ``index``
    runs from 0. The first indices are fewer than a batch and sit on no single task."""
    n = table.agg(F.max(index).alias("m")).first()["m"]
    if n is None:
        return table.select(index, F.lit(0).cast("long").alias("position"))
    total = (n + 1) * times
    missing = -total % batch
    all_rows = table.select(index, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_k")).select(index, (F.col(index) * times + F.col("_k")).cast("long").alias("position"))
    again = all_rows.where(F.col("position") < missing).withColumn("position", F.col("position") + total)
    return all_rows.unionByName(again)


def next_points(searches: DataFrame, tried: DataFrame, group: list[str], setting: str, score: str, order: str, start: float, step: float = 0.25, low: float | None = 1.0, high: float | None = None, increase_first: bool = False) -> DataFrame:
    """Where each search goes on. ``searches`` has the groups (a schedule with its annotation), ``tried`` what was run.

    Beside the best setting (lowest score, the first of equal ones by ``order``) the point one step lower is next, then the
    one a step higher, or the other way round with ``increase_first``; points beyond the bounds and points that were tried
    are passed over. A group that has not begun begins at ``start``. Columns: the group, next (null where the search ends), best (score
    so far) and ended. Runs without a score count as tried, not as best."""
    bad = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    best = F.min_by(setting, F.when(~bad, F.struct(score, order)))
    runs = tried.groupBy(*group).agg(best.alias("_at"), F.min(F.when(~bad, F.col(score))).alias("best"), F.collect_set(setting).alias("_tried"))
    out = searches.select(*group).distinct().join(runs, group, "left")
    beside = [F.col("_at") + step, F.col("_at") - step] if increase_first else [F.col("_at") - step, F.col("_at") + step]

    def open_(x: Column) -> Column:
        ok = ~F.array_contains("_tried", x)
        if low is not None:
            ok = ok & (x >= low)
        return ok if high is None else ok & (x <= high)

    point = F.get(F.filter(F.array(*beside), open_), F.lit(0))
    begun = F.col("_at").isNotNull()
    return out.select(*group, F.when(begun, point).otherwise(F.lit(float(start))).alias("next"), "best", (begun & point.isNull()).alias("ended"))


def grid(starts: DataFrame, ends: DataFrame, start: str, end: str, most: int = 10_000) -> DataFrame:
    """All pairs of the settings of two tables with start below end, and their annotation. The settings are distinct
    values, ``most`` of them at either side: more raise, since every start meets every end above it."""
    from .rows import cut

    a, b = (cut(df.select(F.col(c).cast("double").alias(c)).where(F.col(c).isNotNull()).distinct()) for df, c in ((starts, start), (ends, end)))
    for side in (a, b):
        if side.count() > most:
            raise ValueError(f"more than {most} settings")
    listed = b.agg(F.array_sort(F.collect_set(end)).alias("_ends"))
    met = a.join(F.broadcast(listed), how="cross").select(start, F.explode(F.filter("_ends", lambda e: e > F.col(start))).alias(end))
    return met.withColumn("annotation", F.format_string(f"{start}=%.2f;{end}=%.2f", start, end))


def kept_at(url_column: str, index: str, folder: str = "images", suffix: str = ".jpg", width: int = 8) -> Column:
    """Where a row's image is kept, by its number."""
    return F.concat(F.lit(f"{folder}/"), F.lpad(F.col(index).cast("string"), width, "0"), F.lit(suffix)).alias(url_column)


def pooled(ranks: DataFrame, correct: str, loss: str, total: str) -> DataFrame:
    """Sums of each rank's sums over the sums of their counts."""
    return ranks.agg((F.sum(correct) / F.sum(total)).alias("accuracy"), (F.sum(loss) / F.sum(total)).alias("mean_loss"))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by an explicit order, however the input is cut into batches."""
    return df.orderBy(*order).limit(n)


def without(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """All rows but those whose key another set has; repeated rows stay as many."""
    return df.join(others.select(key).distinct(), key, "left_anti")


def batches_of_groups(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Rows with their batch within the group, and whether it is the group's last, partial one. Numbers in a group come
    from one order over all rows, less where the group begins: no group is one task."""
    from .rows import with_row_index

    placed = with_row_index(df, group, order, name="_i")
    spans = placed.groupBy(group).agg(F.min("_i").alias("_from"), F.count("*").alias("_n")).withColumnRenamed(group, "_g")
    at = placed.join(spans, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_i", F.col("_i") - F.col("_from"))
    return at.withColumn("batch", F.floor(F.col("_i") / size)).withColumn("partial", F.col("batch") == F.floor(F.col("_n") / size)).drop("_i", "_g", "_from", "_n")


def scaled(x: Column, low: float, high: float, to_low: float, to_high: float, clamp: bool = False) -> Column:
    """M8: a range of values onto another, in a line; with ``clamp`` not beyond it."""
    out = (x - low) / (high - low) * (to_high - to_low) + to_low
    return F.greatest(F.least(out, F.lit(float(max(to_low, to_high)))), F.lit(float(min(to_low, to_high)))) if clamp else out


def top_p_probabilities(df: DataFrame, seq: str, p: str, token: str, most: float, keep: int = 1) -> DataFrame:
    """Tokens until the mass before them exceeds ``most``, ``keep`` at least; the rest goes and mass is made 1 again."""
    order = Window.partitionBy(seq).orderBy(F.desc(p), F.asc(token))
    x = df.withColumn("_c", F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(p)).withColumn("_r", F.row_number().over(order))
    x = x.where((F.col("_c") <= most) | (F.col("_r") <= keep)).drop("_c", "_r")
    return x.withColumn(p, F.col(p) / F.sum(p).over(Window.partitionBy(seq)))


def model_name(path: Column) -> Column:
    """last part of a path without slashes at its ends; of a checkpoint folder the part before it too."""
    parts = F.split(F.btrim(path, F.lit("/")), "/")
    last = F.element_at(parts, -1)
    return F.when(last.startswith("checkpoint-"), F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("_"), last)).otherwise(last)


def centre_crop(width: Column, height: Column, to_width: int = 512, to_height: int = 512) -> Column:
    """M8: size after scaling the shorter side, and the place of the middle cut."""
    factor = F.least(width, height) / F.lit(min(to_width, to_height))
    w, h = (width / factor).cast("long"), (height / factor).cast("long")
    return F.struct(w.alias("w"), h.alias("h"), F.floor((w - to_width) / 2).alias("left"), F.floor((h - to_height) / 2).alias("top"), F.floor((w + to_width) / 2).alias("right"), F.floor((h + to_height) / 2).alias("bottom"))


def square_pad(width: Column, height: Column) -> Column:
    """Side of the square around an image, and where the image begins in it."""
    side = F.greatest(width, height)
    return F.struct(side.alias("side"), F.floor((side - width) / 2).alias("x"), F.floor((side - height) / 2).alias("y"))


def beside(width: Column, height: Column, width2: Column, height2: Column) -> Column:
    """Size of two images side by side."""
    return F.struct((width + width2).alias("w"), F.greatest(height, height2).alias("h"))
