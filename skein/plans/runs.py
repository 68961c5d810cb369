"""Queries of the catalogue around evaluation runs: asserted joins, counters, losses, kernels, resumed results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import codes, decoding, manifold, scoring
from ..operators import evaluation as E
from ..sources import sinks
from .catalog import query, r6, rounded, t


@query("SELECT source, count(*) AS n, sum(quality)::BIGINT AS good FROM labels JOIN documents USING (doc_id) GROUP BY source")
def asserted_sides(spark, sf_dir):
    """Every label must have its document."""
    d = t(spark, sf_dir, "documents").select("doc_id", "source")
    out = scoring.required(t(spark, sf_dir, "labels").select("doc_id", "quality"), d, ["doc_id"])
    return out.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


@query(
    """WITH a AS (SELECT doc_id % 7 AS image, 'what is ' || doc_id || '?' AS question, (doc_id * 3 + i * i) % 4 AS answer FROM documents, range(10) r(i)),
    c AS (SELECT image, question, answer, count(*)::DOUBLE AS c FROM a GROUP BY ALL), s AS (SELECT *, (c * least(1.0, (c - 1) / 3) + (10 - c) * least(1.0, c / 3)) / 10 AS score FROM c)
    SELECT d.doc_id, round(coalesce(s.score, 0), 6) AS score FROM documents d LEFT JOIN s ON s.image = d.doc_id % 7 AND s.question = 'what is ' || d.doc_id || '?' AND s.answer = d.doc_id % 4"""
)
def composite_soft_accuracy(spark, sf_dir):
    """Results meet annotations by image and question in any case; each must have one."""
    k, ask = F.col("doc_id"), F.concat(F.lit("What is "), F.col("doc_id").cast("string"), F.lit("?"))
    d = t(spark, sf_dir, "documents").select("doc_id", (k % 7).alias("image"), ask.alias("question"))
    answers = d.select(scoring.composite_key("image", "question"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"), "doc_id").select("question_id", ((k * 3 + F.col("i") * F.col("i")) % 4).cast("string").alias("answer"))
    results = d.select("doc_id", "image", F.upper("question").alias("question"), (k % 4).cast("string").alias("predicted")).select("doc_id", scoring.composite_key("image", "question"), "predicted")
    asserted = scoring.required(results, answers.select("question_id").distinct(), ["question_id"])
    return scoring.soft_accuracy(answers, asserted).select("doc_id", r6("score").alias("score"))


@query("SELECT d.doc_id, d.lang, l.quality, e.label, p.url, n.n_turns FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id JOIN pages p ON p.page_id = d.doc_id JOIN (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) n ON n.conv_id = d.doc_id")
def five_sides(spark, sf_dir):
    """Five tables by one id, rows that all have."""
    named = lambda name, key: t(spark, sf_dir, name).withColumnRenamed(key, "doc_id")
    sides = [t(spark, sf_dir, "labels").select("doc_id", "quality"), named("embeddings", "vec_id").select("doc_id", "label"), named("pages", "page_id").select("doc_id", "url"), named("conversations", "conv_id").groupBy("doc_id").agg(F.count("*").alias("n_turns"))]
    return E.merged(t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", sides)


CHOSEN = "CASE WHEN doc_id % 4 = 3 THEN -1 WHEN (doc_id * 3) % 7 < 5 THEN (doc_id * 3) % 7 ELSE -1 END"


def said(letter, form):
    """A letter in one of the forms in which models answer, or nothing of use."""
    return F.when(form == 0, letter).when(form == 1, F.concat(letter, F.lit(". because"))).when(form == 2, F.concat(F.lit("So. The answer is "), letter, F.lit("."))).otherwise("none of them")


@query(f"WITH p AS (SELECT {CHOSEN} = doc_id % 5 AS ok, doc_id % 3 = 0 AS img FROM documents) SELECT count(*) AS total, count(*) FILTER (ok) AS correct, round(100 * avg(ok::INT), 6) AS accuracy, count(*) FILTER (img) AS inside, round(100 * avg(ok::INT) FILTER (img), 6) AS inside_accuracy FROM p")
def image_subset_accuracy(spark, sf_dir):
    """All questions, and those with an image in the prompt."""
    k = F.col("doc_id")
    d = t(spark, sf_dir, "documents").select(k, F.when(k % 3 == 0, "<image>\nwhich?").otherwise("which?").alias("prompt"))
    idx = T.letter_index(T.choice_letter(said(F.char(65 + k * 3 % 7), k % 4)), 5)
    return rounded(scoring.subset_accuracy(d, idx == k % 5, F.contains("prompt", F.lit("<image>"))), "accuracy", "inside_accuracy")


@query(
    "WITH p AS (SELECT doc_id % 5 AS a, nullif(doc_id % 6, 5) AS o, CASE WHEN doc_id % 7 < 5 THEN doc_id % 7 END AS j, CASE WHEN doc_id % 11 < 5 THEN doc_id % 11 END AS r FROM documents), x AS (SELECT *, coalesce(o = a, false) AS oo, coalesce(j = a, false) AS jj, coalesce(r = a, false) AS rr FROM p) "
    "SELECT count(*) AS total, count(*) FILTER (j IS NULL) AS judge_failed, count(*) FILTER (jj) AS judge_correct, count(*) FILTER (CASE WHEN j IS NULL THEN oo ELSE jj END) AS judge_or_ours_correct, count(*) FILTER (oo) AS our_correct, count(*) FILTER (CASE WHEN r IS NULL THEN oo ELSE rr END) AS requery_correct, count(*) FILTER (jj OR oo) AS upper_bound FROM x"
)
def requery_counts(spark, sf_dir):
    """The seven counters."""
    k = F.col("doc_id")
    d = t(spark, sf_dir, "documents").select((k % 5).alias("answer"), F.nullif(k % 6, F.lit(5)).alias("ours"), F.when(k % 7 < 5, k % 7).alias("judge"), F.when(k % 11 < 5, k % 11).alias("requery"))
    return scoring.requery_counters(d, "ours", "judge", "requery", "answer")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE length(coalesce(text, '')) END AS score FROM documents")
def resumed_results(spark, sf_dir):
    """What is done stays, the rest is computed, all comes by id."""
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    done = d.where("doc_id % 3 = 0").select("doc_id", F.lit(-1).cast("long").alias("score"))
    return sinks.resume(done, d, "doc_id", lambda todo: todo.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("score")))


@query("WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) SELECT vec_id, round(ln(sum(exp(x))) - max(x) FILTER (i = label), 6) AS loss FROM x GROUP BY vec_id")
def token_cross_entropy(spark, sf_dir):
    """M7: each vector as logits, its label as target."""
    x = t(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("token", "logit"))
    return rounded(decoding.cross_entropy(x, "vec_id", "logit", "token", "label"), "loss")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 6) AS squared FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def unit_products(spark, sf_dir):
    """M6: cosine of unit vectors and expanded squared distance of each vector and the next."""
    v = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    both = both.withColumns({"u": codes.unit(F.col("a")), "w": codes.unit(F.col("b"))})
    return both.select("vec_id", r6(codes.inner(F.col("u"), F.col("w"))).alias("cosine"), r6(codes.expanded_distance(F.col("a"), F.col("b"))).alias("squared"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 127.5 - 1, 6) AS signed, round((greatest(-1, least(1, l_discount * 30 - 1)) + 1) * 127.5, 6) AS pixel FROM lineitem")
def scaled_ranges(spark, sf_dir):
    """M8: 0..255 to -1..1, and back with what is beyond cut off."""
    l = t(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", r6(E.scaled(F.col("l_quantity"), 0, 255, -1, 1)).alias("signed"), r6(E.scaled(F.col("l_discount") * 30 - 1, -1, 1, 0, 255, clamp=True)).alias("pixel"))


@query("WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM x) SELECT round(100 * avg((r <= 1)::INT), 6) AS top1, round(100 * avg((r <= 5)::INT), 6) AS top5, round(100 * avg((r <= 20)::INT), 6) AS top20 FROM r WHERE i = label")
def topk_hits(spark, sf_dir):
    """The label's rank among a vector's parts, by counting the greater ones."""
    x = t(spark, sf_dir, "embeddings").withColumn("own", F.get("embedding", F.col("label")))
    x = x.select((F.size(F.filter("embedding", lambda v: v > F.col("own"))) + 1).alias("rank"))
    return rounded(scoring.topk_accuracy(x, "rank", 1, 5, 20), "top1", "top5", "top20")


@query("WITH v AS (SELECT vec_id % 2 AS s, vec_id, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT a.s AS s, b.s AS u, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE (list_inner_product(a.v, b.v) / len(a.v) + 1) ** 3 END) AS k FROM v a, v b GROUP BY ALL), n AS (SELECT count(*) FILTER (s = 0) AS n, count(*) FILTER (s = 1) AS m FROM v) SELECT round(sum(CASE WHEN s = 0 AND u = 0 THEN k / (n * (n - 1)) WHEN s = 1 AND u = 1 THEN k / (m * (m - 1)) ELSE -k / (n * m) END), 6) AS mmd FROM k, n")
def kernel_distance(spark, sf_dir):
    """The even vectors against the odd ones."""
    v = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return spark.createDataFrame([(round(manifold.polynomial_mmd(v.where("id % 2 = 0"), v.where("id % 2 = 1")), 6),)], "mmd double")
