"""Loss reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def loss_table(df: DataFrame, task: str = "task", nll: str = "nll", tokens: str = "n_tokens", nbytes: str = "n_bytes") -> DataFrame:
    """A1, A3: per task the sums, bits per token, perplexity and bits per byte; tasks without tokens are not reported."""
    out = df.groupBy(task).agg(F.sum(nll).alias("nll"), F.sum(nbytes).alias("n_bytes"), F.sum(tokens).alias("n_tokens"), F.count("*").alias("n"))
    return out.where("n_tokens > 0").withColumns({"bpt": F.col("nll") / F.col("n_tokens") / LN2, "ppl": F.exp(F.col("nll") / F.col("n_tokens")), "bpb": F.when(F.col("n_bytes") > 0, F.col("nll") / LN2 / F.col("n_bytes"))})


def with_skills(df: DataFrame, task: Column, skills: Column) -> DataFrame:
    """One row for the task and for each skill of a sample."""
    return df.withColumn("task", F.explode(F.array_union(F.array(task), F.coalesce(skills, F.array().cast("array<string>")))))


def mean_loss(df: DataFrame, group: str, loss: str = "loss", low: int = 1, high: int = 5) -> DataFrame:
    """A4, A5: mean token loss of each id in range."""
    return df.where(F.col(group).between(low, high)).groupBy(group).agg(F.sum(loss).alias("loss_sum"), F.count("*").alias("n"), (F.sum(loss) / F.count("*")).alias("loss_mean"))


def weighted_loss(df: DataFrame, weight: float, dataset: str = "dataset_id", loss: str = "loss", weighted_id: int = 1) -> DataFrame:
    """Weighted losses over the unweighted count."""
    return df.agg((F.sum(F.when(F.col(dataset) == weighted_id, F.col(loss) * weight).otherwise(F.col(loss))) / F.count("*")).alias("weighted_loss"))


def causal_shift(df: DataFrame, seq: str, pos: str, label: str, ignore: int = -100) -> DataFrame:
    """The next position's label; the last has none."""
    return df.withColumn("shifted", F.lead(label, 1, ignore).over(Window.partitionBy(seq).orderBy(pos)))
