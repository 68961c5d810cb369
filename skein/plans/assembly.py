"""Queries of the catalogue for the assembly of training sequences: routes, images in prompts, splices, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching, codes, conversation, decoding, rows, sequences, tokenizers
from .catalog import BOI, EOI, EOS, PAD, TOKENS_SQL, VOCAB, query, rounded, t, tokens, turns_of

# Q9, Q10: conversations of which every second has an image mark in its third turn (or in none, if it is shorter)

IMAGED = "WITH x AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system'), m AS (SELECT conv_id, i, CASE WHEN conv_id % 2 = 0 AND i = 2 THEN ' <image>' || text || '<image> ' ELSE text END AS v FROM x), f AS (SELECT *, coalesce(min(i) FILTER (contains(v, '<image>')) OVER (PARTITION BY conv_id), 0) AS pt FROM m)"


def imaged(spark, sf_dir):
    x = turns_of(spark, sf_dir).where(F.size("turns") > 0)
    marked = F.transform("turns", lambda v, i: F.struct(v["from"].alias("from"), F.when((F.col("conv_id") % 2 == 0) & (i == 2), F.concat(F.lit(" <image>"), v["value"], F.lit("<image> "))).otherwise(v["value"]).alias("value")))
    return x.select("conv_id", marked.alias("turns"))


@query(IMAGED + " SELECT conv_id, md5(string_agg(CASE WHEN i = pt THEN '<boi><eoi>' || chr(10) || trim(replace(v, '<image>', '')) ELSE v END, '|' ORDER BY i)) AS digest, min(pt) AS place FROM f GROUP BY conv_id")
def placed_images(spark, sf_dir):
    """Q10: the image goes to the front of the first turn that marks it, of the first turn without a mark."""
    x = imaged(spark, sf_dir)
    mark = F.array_position(F.transform("turns", lambda v: F.contains(v["value"], F.lit("<image>"))), F.lit(True)) - 1
    x = x.select("conv_id", F.greatest(mark, F.lit(0).cast("long")).alias("place"), conversation.place_image(F.col("turns")).alias("turns"))
    return x.select("conv_id", F.md5(F.array_join(F.transform("turns", lambda v: v["value"]), "|").cast("binary")).alias("digest"), "place")


@query("SELECT CASE WHEN source IN ('src1', 'src3') THEN 't2i' WHEN doc_id % 3 = 0 THEN 'qa' ELSE 'text' END AS route, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY route")
def sft_routes(spark, sf_dir):
    """Q9: by source, then by whether there are codes."""
    d = t(spark, sf_dir, "documents")
    return d.groupBy(conversation.sft_route(F.col("source"), F.col("doc_id") % 3 == 0, ["src1", "src3"]).alias("route")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# Q12, Q15-Q18: token arrays of documents, their codes, and images in them


def digest(ids):
    """An order-dependent sum that other engines can follow."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda a, v: (a * 31 + v) % 1_000_000_007)


def sql_digest(ids: str) -> str:
    return f"list_reduce(list_prepend(0::BIGINT, list_transform({ids}, lambda v: v::BIGINT)), lambda a, v: (a * 31 + v) % 1000000007)"


@query(TOKENS_SQL + f", m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ids ELSE list_concat(ids[1:doc_id % 9], [{BOI}], ids[doc_id % 9 + 1:], [{BOI}]) END AS ids, codes FROM k), s AS (SELECT doc_id, CASE WHEN list_contains(ids, {BOI}) THEN list_concat(ids[1:list_position(ids, {BOI})], codes, ids[list_position(ids, {BOI}) + 1:]) ELSE ids END AS ids FROM m) SELECT doc_id, len(ids) AS length, {sql_digest('ids')}::BIGINT AS digest FROM s")
def codes_after_mark(spark, sf_dir):
    """Q12: codes go behind the first mark; every fourth text has none."""
    at = (F.col("doc_id") % 9).cast("int")
    marked = F.concat(F.slice("ids", 1, at), F.array(F.lit(BOI)), F.slice("ids", at + 1, F.greatest(F.size("ids"), F.lit(1))), F.array(F.lit(BOI)))
    x = tokens(spark, sf_dir).withColumn("ids", F.when(F.col("doc_id") % 4 == 0, F.col("ids")).otherwise(marked))
    out = x.select("doc_id", sequences.insert_after_first(F.col("ids"), F.col("codes"), BOI).alias("ids"))
    return out.select("doc_id", F.size("ids").cast("long").alias("length"), digest("ids").alias("digest"))


@query(
    TOKENS_SQL
    + f""", p AS (SELECT doc_id, codes, ids[1:doc_id % 5] AS a, ids[doc_id % 5 + 1:doc_id % 11 + 3] AS b, ids[greatest(doc_id % 5, doc_id % 11 + 3) + 1:] AS c FROM k),
    q AS (SELECT doc_id, list_concat(a, [-200], b, [-200], c) AS held, list_concat(a, [{BOI}], codes, [{EOI}], b, [{BOI}], codes, [{EOI}], c) AS whole FROM p)
    SELECT doc_id, {sql_digest('held')}::BIGINT AS held, len(whole) AS length, {sql_digest('whole')}::BIGINT AS digest, greatest(len(whole) - 18, 0) AS predicted, {sql_digest('list_transform(codes, lambda v: greatest(0, least(700, v - ' + str(VOCAB + 10) + ')))')}::BIGINT AS clamped FROM q JOIN k USING (doc_id)"""
)
def image_prompts(spark, sf_dir):
    """Q15-Q18: a prompt split at two images, its placeholders, the splice of codes, plain labels, codes clamped back."""
    a, b = (F.col("doc_id") % 5).cast("int"), (F.col("doc_id") % 11 + 3).cast("int")
    n = F.greatest(F.size("ids"), F.lit(1))
    parts = F.array(F.slice("ids", 1, a), F.slice("ids", a + 1, F.greatest(b - a, F.lit(0))), F.slice("ids", F.greatest(a, b) + 1, n))
    x = tokens(spark, sf_dir).withColumn("held", sequences.with_placeholders(parts))
    x = x.withColumn("whole", sequences.splice_images(F.col("held"), F.col("codes"), BOI, EOI))
    x = x.withColumn("labels", sequences.labels(F.col("whole"), F.lit(18)))
    kept = F.size(F.filter("labels", lambda y: y != sequences.IGNORE)).cast("long")
    return x.select("doc_id", digest("held").alias("held"), F.size("whole").cast("long").alias("length"), digest("whole").alias("digest"), kept.alias("predicted"), digest(codes.clamp_codes(F.col("codes"), VOCAB + 10, 700)).alias("clamped"))


@query(f"SELECT doc_id // 4 AS idx, array_to_string(list(doc_id ORDER BY (doc_id * 7) % 4), ',') AS parts FROM documents WHERE doc_id // 4 < (SELECT count(*) // 4 FROM documents) GROUP BY doc_id // 4")
def grids_of_four(spark, sf_dir):
    """Q19: four generations of one index, in the order of their places."""
    d = t(spark, sf_dir, "documents")
    x = d.where(F.floor(F.col("doc_id") / 4) < d.count() // 4).select(F.floor(F.col("doc_id") / 4).alias("idx"), ((F.col("doc_id") * 7) % 4).alias("pos"), F.col("doc_id").alias("codes"))
    return sequences.grid_groups(x, "idx", "codes").select("idx", F.array_join(F.transform("parts", lambda p: p["codes"].cast("string")), ",").alias("parts"))


@query(TOKENS_SQL + f", s AS (SELECT doc_id, doc_id // 16 AS batch, list_slice(list_concat(ids, [{EOS}]), 1, 512) AS seq FROM k), v AS (SELECT *, max(len(seq)) OVER (PARTITION BY batch) AS width FROM s) SELECT doc_id, width - len(seq) AS padded, {sql_digest('list_concat(list_transform(range(width - len(seq)), lambda i: ' + str(PAD) + '), seq)')}::BIGINT AS digest FROM v")
def left_padded_prompts(spark, sf_dir):
    """Q23: prompts of a batch that end together. The batch's width is an aggregate that joins back, no window."""
    x = tokens(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), sequences.text_only(F.col("ids"), EOS, 512).alias("seq"))
    x = x.join(x.groupBy("batch").agg(F.max(F.size("seq")).alias("width")), "batch")
    return x.select("doc_id", (F.col("width") - F.size("seq")).cast("long").alias("padded"), digest(batching.left_padded(F.col("seq"), F.col("width"), PAD)).alias("digest"))


@query(
    TOKENS_SQL
    + f""", s AS (SELECT doc_id, doc_id // 16 AS batch, list_slice(list_concat(ids, [{EOS}]), 1, 512) AS seq FROM k), b AS (SELECT batch, count(*) AS rows, max(len(seq)) AS width, sum(len(seq)) AS real, sum(list_sum(seq))::BIGINT AS id_sum, sum(least(len(seq), 2)) AS masked FROM s GROUP BY batch)
    SELECT batch, rows, width, (id_sum + {PAD} * (rows * width - real))::BIGINT AS id_sum, (rows * width - real + masked)::BIGINT AS ignored, real::BIGINT AS attended FROM b"""
)
def collated_batches(spark, sf_dir):
    """Records to batches of equal length, with labels and mask."""
    x = tokens(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), sequences.text_only(F.col("ids"), EOS, 512).alias("seq"))
    x = x.withColumn("labels", sequences.labels(F.col("seq"), F.lit(2)))
    out = batching.collated(x, "batch", "doc_id", "seq", "labels", PAD)
    flat = lambda c, keep: F.size(F.filter(F.flatten(c), keep)).cast("long")
    add = F.aggregate(F.flatten("input_ids"), F.lit(0).cast("long"), lambda a, v: a + v)
    return out.select("batch", F.size("input_ids").cast("long").alias("rows"), F.size(F.get("input_ids", F.lit(0))).cast("long").alias("width"), add.alias("id_sum"), flat("labels", lambda y: y == sequences.IGNORE).alias("ignored"), flat("attention_mask", lambda m: m).alias("attended"))


@query(
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE -1 END * (length(coalesce(text, '')) + 1) AS n FROM documents), k AS (SELECT *, CASE WHEN n > 0 THEN 'image' ELSE 'text' END AS modality, (doc_id * 1103515245 % 2147483648 + (12345 + 7 * 7919) % 2147483648) AS k FROM d), "
    "i AS (SELECT *, (row_number() OVER (PARTITION BY modality ORDER BY k, doc_id) - 1) // 64 AS mega, (count(*) OVER (PARTITION BY modality) - 1) // 64 AS last FROM k) "
    "SELECT doc_id, modality, mega = last AS merged, CASE WHEN mega = last THEN row_number() OVER (PARTITION BY mega = last ORDER BY doc_id) - 1 ELSE row_number() OVER (PARTITION BY modality, mega ORDER BY abs(n) DESC, doc_id) - 1 END AS rank FROM i"
)
def modality_batches(spark, sf_dir):
    """Groups of 64 of one modality by length, and the last partial ones merged in order of id."""
    d = t(spark, sf_dir, "documents").select("doc_id", (F.when(F.col("doc_id") % 3 == 0, 1).otherwise(-1) * (F.length(F.coalesce("text", F.lit(""))) + 1)).alias("n"))
    return batching.modality_megabatches(d, rows.lcg("doc_id", 7), "n", 64, "doc_id").select("doc_id", "modality", "merged", F.col("rank").cast("long").alias("rank"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE * 8 AS x, unnest(range(len(embedding))) AS i FROM embeddings), p AS (SELECT vec_id, i, x, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM x), c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY x, i DESC ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM p) SELECT vec_id, count(*) AS kept, sum(i)::BIGINT AS tokens FROM c WHERE c > 0.3 OR r = 1 GROUP BY vec_id")
def topp_from_below(spark, sf_dir):
    """The mass counted from the least likely token on."""
    x = t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 8)).alias("token", "logit"))
    return decoding.top_p(x, "vec_id", "logit", "token", 0.7, ascending=True).groupBy("vec_id").agg(F.count("*").alias("kept"), F.sum("token").alias("tokens"))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: i * (c.embedding[i]::DOUBLE + 1.5 * (b.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) + 3 * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))), 6) AS mixed FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2")
def guided_twice(spark, sf_dir):
    """M3: logits with text and image, with the image alone, with neither."""
    v = lambda k, name: t(spark, sf_dir, "embeddings").select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").cast("array<double>").alias(name))
    x = v(0, "full").join(v(1, "image"), "vec_id").join(v(2, "none"), "vec_id")
    mixed = F.transform(decoding.guided_twice(F.col("full"), F.col("image"), F.col("none"), 3.0, 1.5), lambda y, i: y * (i + 1))
    return rounded(x.select("vec_id", F.aggregate(mixed, F.lit(0.0), lambda a, y: a + y).alias("mixed")), "mixed")


@query("SELECT item_id, md5(CASE WHEN item_id % 2 = 0 THEN 'hint ' || item_id || chr(10) ELSE '' END || text || chr(10) || 'A. ' || item_id || chr(10) || 'B. none' || chr(10) || 'C. ' || (item_id * 2)) AS digest FROM benchmark")
def choice_prompts(spark, sf_dir):
    """hint (every second has one), question and lettered options."""
    k = F.col("item_id")
    options = F.array(k.cast("string"), F.lit("none"), (k * 2).cast("string"))
    return t(spark, sf_dir, "benchmark").select("item_id", F.md5(conversation.choice_prompt(F.col("text"), F.when(k % 2 == 0, F.concat(F.lit("hint "), k.cast("string"))), options).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) || ' end' ELSE trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) || ' end' END) AS digest FROM documents")
def trimmed_reviews(spark, sf_dir):
    """a review without its blank ends, and without the line of scores that opens every second one."""
    words = F.concat(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")), F.lit(" end"))
    review = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("8 7.5\n"), words, F.lit("\n  "))).otherwise(F.concat(F.lit("  \n"), words, F.lit("\n")))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(T.trim_hanging(review).cast("binary")).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR coalesce(text, '') = '' THEN NULL ELSE list_sum(list_transform(range(16), lambda i: (i + 1) * (('0x' || md5(text || i)[1:7])::BIGINT % 8192)))::BIGINT END AS digest FROM documents")
def image_codes(spark, sf_dir):
    """Bytes to codes by a tokenizer that each task makes; what is null or no image has no codes."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.coalesce("text", F.lit("")).cast("binary")).alias("image"), F.lit("clash").alias("codes"))
    made = tokenizers.with_codes(d, "image", tokenizers.DigestCodes)
    total = F.aggregate(F.transform("codes", lambda c, i: (i + 1) * c.cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return made.select("doc_id", total.alias("digest"))


@query(f"WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (SELECT doc_id, length(h) // 2 AS n, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS ids FROM h) SELECT doc_id, n, {sql_digest('ids')}::BIGINT AS digest FROM b")
def byte_ids(spark, sf_dir):
    """UTF-8 bytes as ids."""
    d = tokenizers.with_text_ids(t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "utf8_bytes")
    return d.select("doc_id", F.size("ids").cast("long").alias("n"), digest("ids").alias("digest"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: trunc(((1 - (abs(x::DOUBLE) * 500 % 256)::INT / 255.0::DOUBLE) + (abs(x::DOUBLE) * 500 % 256)::INT / 255.0::DOUBLE * ((vec_id * 7 % 256) / 255.0::DOUBLE)) * 255 + 1e-9)))::BIGINT AS red FROM embeddings")
def whitened_pixels(spark, sf_dir):
    """M9: pixels over white; transparency from a vector's parts."""
    alpha = lambda x: F.rint(F.abs(x.cast("double")) * 500 % 256).cast("int")
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.struct((F.col("vec_id") * 7 % 256).alias("r"), F.lit(0).alias("g"), F.lit(255).alias("b"), alpha(x).alias("a"))).alias("p"))
    return e.select("vec_id", tokenizers.whitened("p")).select("vec_id", F.aggregate("rgb", F.lit(0).cast("long"), lambda s, p: s + p["r"]).alias("red"))
