"""Queries of the catalogue that write the given tables as files of a kind and read them with the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators import records, rows
from ..sources import sinks, tars
from .catalog import query, t


def documents(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def folder(spark, what: str) -> str:
    return rows.shared_folder(spark, what)


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def compressed_lines(spark, sf_dir):
    """JSON lines packed with gzip, in folders below one another, read by suffix; files of another suffix stay."""
    out = folder(spark, "gz")
    d = documents(spark, sf_dir)
    d.select("doc_id", "text", F.col("lang").alias("part")).write.partitionBy("part").option("compression", "gzip").json(f"{out}/deep")
    d.select(F.lit("no record").alias("value")).write.text(f"{out}/other")
    return sources.jsonl(spark, out, "doc_id long, text string", suffix=".json.gz").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, doc_id % 3 AS third FROM documents WHERE doc_id % 5 > 0")
def broken_lines_go(spark, sf_dir):
    """Lines that are no JSON and records without what they must have go; the rest of the batch stays."""
    out, k = folder(spark, "broken"), F.col("doc_id")
    line = F.when(k % 10 == 0, F.concat(F.lit('{"doc_id": '), k.cast("string"))).when(k % 10 == 5, F.lit('{"third": 1}')).otherwise(F.to_json(F.struct("doc_id", (k % 3).alias("third"))))
    documents(spark, sf_dir).select(line.alias("value")).write.text(out)
    return records.complete(sources.jsonl(spark, out, "doc_id long, third long", strict=False), "doc_id", "third")


@query("SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM documents GROUP BY lang")
def one_array_file(spark, sf_dir):
    """An object of answers is written as one JSON text, and a file that is one JSON array is read."""
    out = folder(spark, "array")
    d = documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))
    d.agg(F.to_json(F.collect_list(F.struct("lang", "n", "id_sum"))).alias("value")).write.text(out)
    return sources.json_array(spark, out, "lang string, n long, id_sum long")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def named_counts(spark, sf_dir):
    """An object of objects; each key becomes a column."""
    out = folder(spark, "named")
    d = documents(spark, sf_dir).groupBy("lang").agg(F.struct(F.count("*").alias("n")).alias("v"))
    sinks.submission(d, "lang", "v").select("json").write.text(out)
    return sources.named_objects(spark, out, "struct<n:long>").withColumnRenamed("name", "lang")


@query("SELECT doc_id, lang, source, 4 AS formats FROM documents")
def formats_alike(spark, sf_dir):
    """The same rows by suffix as JSON lines, tab- and comma-separated files and parquet."""
    d, out = documents(spark, sf_dir).select("doc_id", "lang", "source"), folder(spark, "formats")
    sinks.jsonl(d, f"{out}/a.jsonl", 500)
    d.write.option("header", True).option("sep", "\t").csv(f"{out}/a.tsv")
    sinks.append_csv(d.where("doc_id % 2 = 0"), f"{out}/a.csv")
    sinks.append_csv(d.where("doc_id % 2 = 1"), f"{out}/a.csv")
    d.write.parquet(f"{out}/a")
    schema = "doc_id long, lang string, source string"
    found = [sources.any_format(spark, f"{out}/{name}", schema) for name in ("a.jsonl", "a.tsv", "a.csv", "a")]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return both.groupBy("doc_id", "lang", "source").agg(F.count("*").alias("formats"))


@query("SELECT 'first' AS which, greatest(1, count(DISTINCT doc_id % 16) // 4) AS shards, true AS apart FROM documents UNION ALL SELECT 'last', greatest(1, count(DISTINCT doc_id % 16) // 4), true FROM documents")
def sampled_shards(spark, sf_dir):
    """Shards listed without their contents, folders of files that every task adds to; the first quarter of their hashed
    order, and the last, have nothing in common. Which shards they are follows from paths, which differ from run to run."""
    out = folder(spark, "shards")
    documents(spark, sf_dir).withColumn("part", F.col("doc_id") % 16).write.partitionBy("part").parquet(out)
    listed = sources.folders(sources.listing(spark, out, ".parquet"))
    first, last = sources.shard_sample(listed, 0.25, 7), sources.shard_sample(listed, 0.25, 7, tail=True)
    both = first.select("path", F.lit("first").alias("which")).unionByName(last.select("path", F.lit("last").alias("which")))
    times = both.groupBy("path").agg(F.count("*").alias("times"))
    return both.join(times, "path").groupBy("which").agg(F.count("*").alias("shards"), (F.max("times") == 1).alias("apart"))


@query("SELECT 'train' AS split, doc_id, row_number() OVER (ORDER BY doc_id) AS number, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS of FROM documents")
def union_by_key(spark, sf_dir):
    """Of rows with one key the last frame's stays, numbered in key order; constant columns."""
    d = documents(spark, sf_dir).select("doc_id")
    both = sources.keyed_union([d.withColumn("of", F.lit("first")), d.where("doc_id % 3 = 0").withColumn("of", F.lit("second"))], "doc_id")
    constant = sources.constant_rows(spark, 1, split="train").drop("id")
    return both.join(F.broadcast(constant), how="cross").select("split", "doc_id", F.col("number").cast("long").alias("number"), "of")


@query(r"SELECT doc_id % 16 AS part, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS line_no, md5(regexp_replace(coalesce(text, ''), '[\r\n\v\f\x{85}\x{2028}\x{2029}]', ' ', 'g')) AS digest FROM documents")
def text_lines(spark, sf_dir):
    """File, number and value of every line of text files: a text to a line, sixteen folders in order of id, whose files follow one
    another and are as many as the table asks for."""
    out = folder(spark, "lines")
    line = F.regexp_replace("text", "[\\r\\n\\x0B\\f\\x85\\u2028\\u2029]", " ")
    placed = documents(spark, sf_dir).select("text", (F.col("doc_id") % 16).alias("part"), "doc_id")
    rows.in_pieces(placed, F.octet_length("text"), "part", "doc_id", least=8).select(line.alias("value"), "part").write.partitionBy("part").text(out)
    of = r"/part=([^/]*)/[^/]*$"
    found = sources.lines(spark, out, of)
    return found.select(F.regexp_extract("file", of, 1).try_cast("long").alias("part"), "line_no", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("SELECT source, count(*) AS counted, count(*) AS listed FROM documents GROUP BY source")
def shard_counts(spark, sf_dir):
    """Sizes by a manifest where there is one, else counted; rows come in batches of files sorted by name."""
    out, d = folder(spark, "sized"), documents(spark, sf_dir)
    d.write.partitionBy("source").parquet(out)
    manifest = d.groupBy("source").agg(F.count("*").alias("n"))
    total = sources.shard_sizes(manifest, d)
    if total != sources.shard_sizes(None, spark.read.parquet(out)):
        raise ValueError("the manifest does not fit the data")
    counted = spark.read.parquet(out).groupBy("source").agg(F.count("*").alias("counted"))
    return counted.join(manifest.withColumnRenamed("n", "listed"), "source")


@query("SELECT vec_id AS row, round(list_sum(embedding::FLOAT[]::DOUBLE[]), 4) AS total FROM embeddings")
def array_rows(spark, sf_dir):
    """Vectors written as .npy by the tasks that hold them, and read back row by row."""
    out = folder(spark, "npy")
    saved = sinks.npy_files(t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", out if "://" in out else f"file://{out}", 1000)
    saved.count()
    found = sources.numpy_array(spark, out)
    row = F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("long") * 1000 + F.col("row")
    return found.select(row.alias("row"), F.round(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT doc_id, length(text) + 64 AS length FROM documents WHERE doc_id % 4 > 0 AND text IS NOT NULL")
def captioned_images(spark, sf_dir):
    """Image rows count four letters for each code; rows without a caption go, as do those that cannot be read,
    where the original would draw another one."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("caption"), F.array_repeat(F.lit(7), 16).alias("codes"))
    return records.unify_image(d, "caption", "codes").select("doc_id", F.col("length").cast("long").alias("length"))


@query("SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS different FROM (SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0) GROUP BY lang")
def combined_sets(spark, sf_dir):
    """Several sets stacked, in a seeded order that is written as it is."""
    out, d = folder(spark, "combined"), documents(spark, sf_dir).select("doc_id", "lang")
    sinks.combined([d, d.where("doc_id % 2 = 0")], "doc_id", 5).write.parquet(out)
    return spark.read.parquet(out).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("different"))


@query("SELECT doc_id, ['a', 'b', 'c'][((doc_id * 1103515245 % 2147483648 + 12345) % 3 + 1)] AS choice FROM documents")
def chosen_once(spark, sf_dir):
    """One of several options for each row, by a number that follows from its id."""
    pick = (rows.lcg("doc_id", 0) % 3).cast("int")
    return documents(spark, sf_dir).select("doc_id", F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), pick).alias("choice"))


@query("SELECT doc_id % 8 AS chunk, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS line_no, doc_id FROM documents")
def chunk_answers(spark, sf_dir):
    """Answers that eight workers wrote, put together in the order of chunks and lines."""
    out = folder(spark, "chunks")
    placed = documents(spark, sf_dir).select(F.to_json(F.struct("doc_id")).alias("value"), (F.col("doc_id") % 8).alias("chunk"), "doc_id")
    rows.in_pieces(placed, F.octet_length("value"), "chunk", "doc_id", least=8).drop("doc_id").write.partitionBy("chunk").text(out)
    return sources.concatenated(spark, out).select("chunk", "line_no", F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))


@query("SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'no' END AS source, 'no' AS url, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE 'no' END AS id FROM documents WHERE doc_id % 5 IN (0, 1, 3)")
def paired_samples(spark, sf_dir):
    """Samples with a caption and some kind of image, as records; what their metadata does not say is 'no'."""
    k, data = F.col("doc_id"), F.col("text").cast("binary")
    image = F.when(k % 5 == 0, "jpg").when(k % 5 == 1, "webp").when(k % 5 == 2, "mp4").otherwise("png")
    said = F.when(k % 3 == 0, F.to_json(F.struct("source", F.concat(F.lit("d"), k.cast("string")).alias("id")))).when(k % 3 == 1, F.lit("{broken"))
    caption = F.when(k % 5 == 4, "cap").otherwise("txt")
    d = documents(spark, sf_dir).select(k, F.map_from_arrays(F.array(caption, image, F.lit("json")), F.array(data, F.lit(b"\x00"), said.cast("binary"))).alias("members"))
    return tars.unified(tars.captioned(d)).select("doc_id", "text", "source", "url", "id")
