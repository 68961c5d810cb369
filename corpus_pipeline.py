"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Where a
stage changes a text, n_chars (if there is such a column) follows it.

1. toxicity: documents that the classifier scores 0.7 or more go.
2. lines: repeated lines of every length and nearly repeated ones go, the first one stays; a document of which nothing is left goes.
3. near_duplicates: of documents linked by five-word shingles at a similarity of 0.8 or more one stays.
4. pii: personal data gives way to its kind in angle brackets.
5. packing: one row for each piece of each document, with its sequence and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import jaccard, lines, packing, pii, toxicity
from skein.llm.common import remove, shared_folder, table


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(docs, lines.BY_LENGTH, every_repeat=True)
    repeated, near = lines.free_names(docs.columns, "lines_repeated", "lines_near")
    emptied = (F.col(repeated) + F.col(near) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return sized(out.where(F.col("text").isNull() | ~emptied).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, words=5, percent=80)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sized(pii.mask_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("pii", mask_pii), ("packing", pack)]
#: A trained classifier and a tokenizer are no SQL; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages a table in the shared folder cuts the lineage. A table goes when the one
    after it is written; the last is what the result reads."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := shared_folder(spark, f"stage-{name}"))
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
