"""Benchmark scores: joins of predictions to truth, then reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed look-up tables: of rows with one key the last stays."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("_r")).select("_r.*")


def attach(questions: DataFrame, predictions: DataFrame, key: str, value: str, missing: Column | None) -> DataFrame:
    """Left join with a default."""
    out = questions.join(predictions.select(key, value), key, "left")
    return out.withColumn(value, F.coalesce(F.col(value), missing)) if missing is not None else out


def missing_keys(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys that have no partner."""
    return expected.join(present, key, "left_anti")


def required(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join whose left rows must all have a partner: one without raises when the result is computed."""
    found = left.join(right.withColumn("_found", F.lit(True)), on, "left")
    return found.where(F.coalesce("_found", F.raise_error(F.concat(F.lit("no partner for "), F.to_json(F.struct(*on)))).cast("boolean"))).drop("_found")


def composite_key(image: str, question: str, name: str = "question_id") -> Column:
    """Image id and question in lower case as one key."""
    return F.struct(F.col(image).alias("image"), F.lower(question).alias("question")).alias(name)


def subset_accuracy(df: DataFrame, correct: Column, inside: Column) -> DataFrame:
    """Rows, correct ones, and the accuracy in percent of all and of a subset such as prompts with an image (null
    without such rows)."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(correct).alias("correct"), (100 * F.try_divide(F.count_if(correct), F.count("*"))).alias("accuracy"),
        F.count_if(inside).alias("inside"), (100 * F.try_divide(F.count_if(correct & inside), F.count_if(inside))).alias("inside_accuracy"),
    )


def requery_counters(df: DataFrame, ours: str, judge: str, requery: str, answer: str) -> DataFrame:
    """The seven counters over predicted choices, where null is a failed answer: all rows, judge failed, judge correct, judge
    correct or, where it failed, ours, ours correct, requery correct (ours where it failed), either correct."""
    right = {c: F.coalesce(F.col(c) == F.col(answer), F.lit(False)) for c in (ours, judge, requery)}
    failed = F.col(judge).isNull()
    return df.agg(
        F.count("*").alias("total"), F.count_if(failed).alias("judge_failed"), F.count_if(right[judge]).alias("judge_correct"), F.count_if(F.when(failed, right[ours]).otherwise(right[judge])).alias("judge_or_ours_correct"),
        F.count_if(right[ours]).alias("our_correct"), F.count_if(F.when(F.col(requery).isNull(), right[ours]).otherwise(right[requery])).alias("requery_correct"), F.count_if(right[judge] | right[ours]).alias("upper_bound"),
    )


def confusion(df: DataFrame, predicted: Column, actual: Column, *group: str) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and share of yes; NULL where a ratio has no denominator."""
    out = df.groupBy(*group).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & ~actual).alias("tn"), F.count_if(~predicted & actual).alias("fn")
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return out.withColumns({"accuracy": F.try_divide(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall, "f1": F.try_divide(2 * precision * recall, precision + recall), "yes_ratio": F.try_divide(tp + fp, tp + fp + tn + fn)})


def soft_accuracy(answers: DataFrame, predictions: DataFrame, question: str = "question_id", answer: str = "answer", predicted: str = "predicted") -> DataFrame:
    """Leave-one-out agreement with ten human answers, in closed form; mean over questions is left to the caller."""
    counts = answers.groupBy(question, answer).agg(F.count("*").alias("c"))
    c = F.col("c").cast("double")
    scored = counts.withColumn("score", (c * F.least(F.lit(1.0), (c - 1) / 3) + (10 - c) * F.least(F.lit(1.0), c / 3)) / 10)
    return predictions.join(scored.select(question, F.col(answer).alias(predicted), "score"), [question, predicted], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def anls(predicted: Column, truths: Column) -> Column:
    """Edit similarity to the nearest of an array of truths, in lower case and stripped, zero below one half. Two empty
    strings are equal; without any truth the score is 0."""

    def similar(truth: Column) -> Column:
        a, b = F.lower(F.trim(predicted)), F.lower(F.trim(truth))
        longest = F.greatest(F.length(a), F.length(b))
        return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)

    s = F.coalesce(F.array_max(F.transform(truths, similar)), F.lit(0.0))
    return F.when(s >= 0.5, s).otherwise(0.0)


def with_total(df: DataFrame, group: str, *aggregates: Column) -> DataFrame:
    """Per group and over all ('all')."""
    return df.rollup(group).agg(*aggregates, F.grouping_id().alias("_g")).withColumn(group, F.when(F.col("_g") == 1, "all").otherwise(F.col(group).cast("string"))).drop("_g")


def ensemble(df: DataFrame, first: Column, second: Column, failed: Column) -> DataFrame:
    """Accuracy of two models, of the first with the second where it failed, of either (upper bound), and the
    share of failures."""
    n = F.count("*")
    return df.agg(
        n.alias("n"), (F.count_if(first) / n).alias("first"), (F.count_if(second) / n).alias("second"), (F.count_if(F.when(failed, second).otherwise(first)) / n).alias("fallback"),
        (F.count_if(first | second) / n).alias("upper_bound"), (F.count_if(failed) / n).alias("failed"),
    )


def topk_accuracy(df: DataFrame, rank_of_target: str, *ks: int) -> DataFrame:
    """A37."""
    return df.agg(*[(100.0 * F.count_if(F.col(rank_of_target) <= k) / F.count("*")).alias(f"top{k}") for k in ks])


def mean_of_batches(df: DataFrame, batch: str, value: str) -> DataFrame:
    """The mean of batch means."""
    return df.groupBy(batch).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_of_means"), F.count("*").alias("batches"))


def by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Join by place; the longer side's rest goes."""
    from .rows import with_row_index

    a, b = with_row_index(left, left_order, name="_i"), with_row_index(right, right_order, name="_i")
    return a.join(b, "_i").drop("_i")


def keyed_number(key: Column) -> Column:
    """An integer or text key as one number; NULL if it is neither."""
    return key.cast("string").try_cast("long")


def bleu4(predicted: str, truth: str) -> Column:
    """Sums for corpus BLEU-4, per row: clipped matches and totals of 1- to 4-grams, both lengths."""

    def grams(words: Column, n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    p, t = F.split(predicted, " "), F.split(truth, " ")
    parts = []
    for n in range(1, 5):
        g, h = grams(p, n), grams(t, n)
        hit = F.aggregate(F.array_distinct(g), F.lit(0), lambda s, x, g=g, h=h: s + F.least(F.size(F.filter(g, lambda y: y == x)), F.size(F.filter(h, lambda y: y == x))))
        parts += [hit.alias(f"hit{n}"), F.size(g).alias(f"all{n}")]
    return F.struct(*parts, F.size(p).alias("len_p"), F.size(t).alias("len_t"))


def best_setting(df: DataFrame, group: str, metric: str) -> DataFrame:
    """The row of least metric in each group."""
    return df.groupBy(group).agg(F.min_by(F.struct("*"), metric).alias("_b")).select("_b.*")


def token_bins(df: DataFrame, seq: str, token: str) -> DataFrame:
    """Counts of each token in each sequence."""
    return df.groupBy(seq, token).agg(F.count("*").alias("n"))


def retention(df: DataFrame, step: str, milestone: int, start: int, max_milestones: int = 5, max_others: int = 10) -> DataFrame:
    """Which checkpoints stay: the last milestones, and the last others unless older than the last milestone."""
    is_m = (F.col(step) >= start) & ((F.col(step) - start) % milestone == 0)
    w = Window.partitionBy("is_milestone").orderBy(F.desc(step))
    ranked = df.withColumn("is_milestone", is_m).withColumn("_r", F.row_number().over(w))
    last = df.where(is_m).agg(F.max(step).alias("_last"))
    out = ranked.join(F.broadcast(last), how="cross")
    keep = F.when(F.col("is_milestone"), F.col("_r") <= max_milestones).otherwise((F.col("_r") <= max_others) & (F.col("_last").isNull() | (F.col(step) >= F.col("_last"))))
    return out.withColumn("keep", keep).drop("_r", "_last")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with their key."""
    return old.join(new, key, "left_anti").unionByName(new)
