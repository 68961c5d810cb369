"""Streaming and writer queries of the catalogue: each runs to completion and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources, streaming
from ..operators import rows
from ..sources import sinks
from .catalog import SQL, query, r6, rounded, t
from .scores import W20

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def table_stream(spark, sf_dir, name: str, schema: str):
    """A table as a stream of its files, be it one file or a folder of parts. (Braces make the path a pattern: a stream takes a
    plain path for a folder.)"""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def settled(spark, stream, what: str):
    """Run a stream over all there is, each micro-batch to a table in the shared folder, and read that table. A stream that
    finds nothing leaves a table without rows."""
    out = rows.shared_folder(spark, what)
    spark.createDataFrame([], stream.schema).write.parquet(out)

    def save(batch, _):
        batch.write.mode("append").parquet(out)

    q = stream.writeStream.outputMode("update").option("checkpointLocation", rows.shared_folder(spark, f"{what}-log")).trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def events(spark, sf_dir):
    return table_stream(spark, sf_dir, "events", EVENTS).select("user_id", "value", F.struct("ts", "event_id").alias("at"), F.col("ts").cast("string").alias("time"), "event_id")


@query(SQL["ema_usage"])
def streaming_ema(spark, sf_dir):
    """ST1, ST4, A42: the exponential mean as keyed state."""
    return rounded(settled(spark, streaming.ema(events(spark, sf_dir).select("user_id", "time", "event_id", "value"), "user_id", ["time", "event_id"], "value"), "ema"), "ema")


@query(f"SELECT user_id, n, round(avg, 6) AS avg, round(max, 6) AS max, round(global_avg, 6) AS global_avg FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c, avg(value) {W20} AS avg, max(value) {W20} AS max, avg(value) OVER (PARTITION BY user_id) AS global_avg FROM events) WHERE n = c")
def streaming_sliding(spark, sf_dir):
    """ST1, ST3, W9: bounded windows as keyed state."""
    return rounded(settled(spark, streaming.sliding_metrics(events(spark, sf_dir).select("user_id", "time", "event_id", "value"), "user_id", ["time", "event_id"], "value"), "sliding"), "avg", "max", "global_avg")


@query("SELECT user_id % 4 AS grp, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY grp")
def streaming_log(spark, sf_dir):
    """ST5, ST7: means of each micro-batch, appended to a log (here one batch)."""
    out = rows.shared_folder(spark, "log")
    stream = events(spark, sf_dir).select((F.col("user_id") % 4).alias("grp"), "value")
    q = streaming.log_every(stream, "grp", "value", lambda _, df: df.write.mode("append").parquet(out)).option("checkpointLocation", rows.shared_folder(spark, "log-cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("grp", "n", r6("mean").alias("mean"))


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def streaming_resume(spark, sf_dir):
    """ST6: each id once, done ids skipped."""
    stream = table_stream(spark, sf_dir, "documents", "doc_id long, text string").select("doc_id", F.length("text").cast("long").alias("chars"))
    return settled(spark, streaming.unseen(stream, t(spark, sf_dir, "labels").select("doc_id"), "doc_id"), "resume")


@query("SELECT tar_id, n FROM (SELECT i // 100 AS tar_id, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) GROUP BY tar_id)")
def tar_shards(spark, sf_dir):
    """Documents to tars of 100 samples in the shared folder, and the samples found in them."""
    docs = rows.with_row_index(t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    folder = rows.shared_folder(spark, "tars")
    sinks.tar_files(docs, "idx", 100, folder if "://" in folder else f"file://{folder.removeprefix('file:')}", "text", "doc_id", "lang").count()
    found = sources.tar_samples(spark, folder)
    return found.groupBy(F.regexp_extract("url", r"(\d+)\.tar$", 1).cast("long").alias("tar_id")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) AS chars FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """JSON lines, the tail batch included."""
    out = rows.shared_folder(spark, "jsonl")
    sinks.jsonl(t(spark, sf_dir, "documents").select("doc_id", "text"), out, 300)
    return sources.jsonl(spark, out, "doc_id long, text string").select("doc_id", F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id FROM documents")
def shuffled_shards(spark, sf_dir):
    """K3, K7: a hashed order in a fixed number of parquet shards."""
    out = rows.shared_folder(spark, "shards")
    sinks.shuffled_shards(t(spark, sf_dir, "documents").select("doc_id"), out, 8, "doc_id")
    return spark.read.parquet(out)


@query("SELECT lang || '_' || (doc_id % 50) || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.jsonl' AS target, doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, doc_id % 50 ORDER BY doc_id) - 1 AS k FROM documents)")
def name_collisions(spark, sf_dir):
    """K8: flat names, numbered from the second file of a name on."""
    files = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("folder"), F.concat((F.col("doc_id") % 50).cast("string"), F.lit(".jsonl")).alias("name"))
    return sinks.resolved_names(files, order="doc_id").select("target", "doc_id")
