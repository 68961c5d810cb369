"""Generation benchmarks: weighted rubrics, tag groups and dependency-gated questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompt id ranges and weights of the rubric benchmark.
RANGES = {"CULTURE": (1, 400), "TIME": (401, 567), "SPACE": (568, 700), "BIOLOGY": (701, 800), "PHYSICS": (801, 900), "CHEMISTRY": (901, 1000)}
WEIGHTS = {"CULTURE": 0.4, "TIME": 0.167, "SPACE": 0.133, "BIOLOGY": 0.1, "PHYSICS": 0.1, "CHEMISTRY": 0.1}


def wiscore(consistency: Column, realism: Column, aesthetic: Column) -> Column:
    return (0.7 * consistency + 0.2 * realism + 0.1 * aesthetic) / 2


def rubric_category(prompt_id: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (low, high) in reversed(RANGES.items()):
        out = F.when(prompt_id.between(low, high), name).otherwise(out)
    return out


def rubric_means(df: DataFrame, prompt_id: str = "prompt_id", score: str = "wiscore") -> DataFrame:
    """Mean per category."""
    return df.withColumn("category", rubric_category(F.col(prompt_id))).where("category is not null").groupBy("category").agg(F.avg(score).alias("score"), F.count("*").alias("n"))


def rubric_overall(df: DataFrame, prompt_id: str = "prompt_id", score: str = "wiscore") -> DataFrame:
    """Weighted mean; NULL unless all categories have scores and all ids from 1 to 1000 are present."""
    means = rubric_means(df, prompt_id, score)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("category"))
    present = df.where(F.col(prompt_id).between(1, 1000)).agg(F.count_distinct(prompt_id).alias("ids"))
    total = means.agg(F.sum(F.col("score") * weight).alias("s"), F.count("score").alias("k"))
    return total.join(F.broadcast(present), how="cross").select(F.when((F.col("k") == len(WEIGHTS)) & (F.col("ids") == 1000), F.col("s")).alias("overall"), "ids")


def tag_means(scores: DataFrame, tags: DataFrame, idx: str = "idx", tag: str = "tag", score: str = "score") -> DataFrame:
    """Mean and sample deviation of each tag; 'all' counts an item of several tags once."""
    joined = tags.join(scores, idx)
    each = joined.groupBy(tag).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count("*").alias("n"))
    once = scores.join(tags.select(idx).distinct(), idx, "left_semi").agg(F.lit("all").alias(tag), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count("*").alias("n"))
    return each.unionByName(once)


def gate_scores(questions: str) -> Column:
    """Questions is array<struct<qid:int, yes:double, parents:array<int>>> in order; each score is zero if any parent
    other than 0 has, by then, score zero: gating cascades in order. Returns array<struct<qid, score>>."""
    from .sequences import bound

    def gated(qs: Column) -> Column:
        # Parents as places; 0 and ids that are no question have none. A place that is not done yet has its raw score.
        def placed(ids: Column) -> Column:
            return F.transform(qs, lambda q: F.struct(q["qid"].alias("qid"), q["yes"].cast("double").alias("yes"), F.filter(F.transform(F.filter(q["parents"], lambda p: p != 0), lambda p: (F.array_position(ids, p) - 1).cast("int")), lambda j: j >= 0).alias("at")))

        def walk(rows: Column) -> Column:
            def step(done: Column, q: Column) -> Column:
                blocked = F.exists(q["at"], lambda j: F.coalesce(F.get(done, j), F.get(rows, j)["yes"]) == 0)
                return F.concat(done, F.array(F.when(blocked, 0.0).otherwise(q["yes"])))

            scores = F.aggregate(rows, F.array().cast("array<double>"), step)
            return F.zip_with(rows, scores, lambda q, s: F.struct(q["qid"].alias("qid"), s.alias("score")))

        return bound(bound(F.transform(qs, lambda q: q["qid"]), placed), walk)

    return bound(F.col(questions), gated)


def dependency_score(df: DataFrame, item: str, crop: str, questions: str = "questions") -> DataFrame:
    """Mean over questions, then over crops."""
    gated = df.withColumn("_g", gate_scores(questions))
    per_crop = gated.select(item, crop, (F.aggregate("_g", F.lit(0.0), lambda s, x: s + x["score"]) / F.size("_g")).alias("s"))
    return per_crop.groupBy(item).agg(F.avg("s").alias("score"))


def tuple_levels(c: Column) -> dict[str, Column]:
    """Category of a tuple such as 'entity - whole (car)'."""
    broad = F.split_part(c, F.lit("("), F.lit(1))
    return {"level2": F.trim(broad), "level1": F.trim(F.split_part(broad, F.lit("-"), F.lit(1)))}


def parents(c: Column) -> Column:
    """A dependency list such as '1,3' as integers."""
    return F.transform(F.split(F.regexp_replace(c, r"\s", ""), ","), lambda p: p.try_cast("int"))


def prompts_by_source(prompts: DataFrame, sources: list[str], order: str = "line_no", text: str = "prompt") -> DataFrame:
    """Every non-blank prompt numbered from 1, its five-digit index, times every source."""
    from .rows import with_row_index

    kept = with_row_index(prompts.where(F.trim(text) != ""), order, name="_i")
    listed = prompts.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return kept.join(F.broadcast(listed), how="cross").withColumn("Index", F.lpad((F.col("_i") + 1).cast("string"), 5, "0")).withColumn("path", F.concat_ws("/", "source", F.concat("Index", F.lit(".jpg")))).drop("_i")
