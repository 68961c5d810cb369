"""Dependency benchmarks: the table of questions and the means of their categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import with_row_index
from .rubrics import parents, tuple_levels


def question_table(lines: DataFrame, order: str, item: str = "item_id", qid: str = "proposition_id", tuple_: str = "tuple", dependency: str = "dependency", question: str = "question") -> DataFrame:
    """Per item and question its place, tuple, parents and text.

    Lines are taken in ``order``, which must tell them apart; the first one is passed over, as in the original. Lines of one
    item that follow one another are a run. Where an item comes up again later, its last run replaces those before; within a
    run a question's last line holds, at the place (from 1, by line) where the question came first. Runs are found by a join of each line with
    the one before, and the last run is an aggregate by item, so no item is gathered in a task.
    """
    rows = with_row_index(lines.select(F.col(order).alias("_order"), F.col(item).alias("item"), F.col(qid).cast("int").alias("qid"), F.col(tuple_).alias("tuple"), F.col(dependency).alias("dependency"), F.col(question).alias("question")), "_order", name="line").drop("_order")
    rows = rows.where("line > 0")
    before = rows.select((F.col("line") + 1).alias("line"), F.col("item").alias("_before"))
    # The second line opens a run too: the one before it is passed over.
    marked = rows.join(before, "line", "left").withColumn("opens", (F.col("line") == 1) | ~F.col("item").eqNullSafe(F.col("_before")))
    last = marked.where("opens").groupBy("item").agg(F.max("line").alias("_from"))
    held = marked.join(last.withColumnRenamed("item", "_item"), F.col("item").eqNullSafe(F.col("_item"))).where(F.col("line") >= F.col("_from"))
    kept = held.groupBy("item", "qid").agg(F.min("line").alias("place"), F.max_by(F.struct("tuple", "dependency", "question"), "line").alias("x"))
    return kept.select("item", "qid", "place", F.col("x.tuple").alias("tuple"), parents(F.col("x.dependency")).alias("parents"), F.col("x.question").alias("question"))


def parent_scores(questions: DataFrame, scores: DataFrame) -> DataFrame:
    """Each question with its parents' answers, by a join within the item: item, qid, parents (how many were asked) and
    blocked, whether one of them was answered no. Parent 0 is none, and one that was not asked blocks nothing. ``scores`` has item, qid,
    score."""
    wanted = questions.select("item", "qid", F.explode_outer("parents").alias("parent"))
    asked = scores.select(F.col("item").alias("_i"), F.col("qid").alias("_q"), "score")
    met = wanted.join(asked, F.col("item").eqNullSafe(F.col("_i")) & (F.col("parent") == F.col("_q")) & (F.col("parent") != 0), "left")
    return met.groupBy("item", "qid").agg(F.count("score").alias("parents"), F.coalesce(F.max(F.col("score") == 0), F.lit(False)).alias("blocked"))


def category_means(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Per level (1, 2) and category the mean score and the number of scores, over the items that have answers.

    ``answers`` has item, crop, qid and answer; what counts is the last crop's answer, before any gating by parents. Level 2
    is the tuple up to its bracket, level 1 that up to its first hyphen; level 1 pools scores, it is no mean of means."""
    last = answers.groupBy("item", "qid").agg(F.max_by(F.col("answer") == "yes", "crop").alias("yes"))
    levels = tuple_levels(F.col("tuple"))
    scored = questions.join(last, ["item", "qid"]).select(F.col("yes").cast("double").alias("score"), F.explode(F.array(F.struct(F.lit(1).alias("level"), levels["level1"].alias("category")), F.struct(F.lit(2).alias("level"), levels["level2"].alias("category")))).alias("l"))
    return scored.groupBy("l.level", "l.category").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
