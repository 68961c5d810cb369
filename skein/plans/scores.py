"""More queries of the catalogue: scores, codes, features, decoding, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching, codes, decoding, manifold, records, rows, rubrics, scoring, sequences
from .catalog import q, query, r6, rounded, t

CONFUSED = "count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (NOT p AND a) AS fn"


def judged(spark, sf_dir):
    """Documents with labels; the stand-in answer is no for even lengths of text."""
    labels = t(spark, sf_dir, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 1).alias("a"))
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.length("text") % 2 == 0, F.concat(F.lit("no, "), "text")).otherwise("yes").alias("answer"))
    return docs.join(labels, "doc_id").select("doc_id", "lang", (T.yes_no(F.col("answer")) == "yes").alias("p"), "a")


JUDGED = "WITH j AS (SELECT lang, length(text) % 2 = 1 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"{JUDGED}, c AS (SELECT lang, {CONFUSED} FROM j GROUP BY lang), d AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re FROM c) SELECT lang, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / nullif(pr + re, 0), 6) AS f1, round((tp + fp) / (tp + fp + tn + fn), 6) AS yes_ratio FROM d")
def yesno_confusion(spark, sf_dir):
    """F5, J4, A8."""
    return rounded(scoring.confusion(judged(spark, sf_dir), F.col("p"), F.col("a"), "lang"), "accuracy", "precision", "recall", "f1", "yes_ratio")


@query(f"{JUDGED}, c AS (SELECT lang, {CONFUSED} FROM j GROUP BY lang) SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, count(*) AS categories FROM c")
def macro_f1(spark, sf_dir):
    """A category without true positives counts as 0."""
    return scoring.confusion(judged(spark, sf_dir), F.col("p"), F.col("a"), "lang").agg(r6(F.avg(F.coalesce("f1", F.lit(0.0)))).alias("macro_f1"), F.count("*").alias("categories"))


@query("SELECT CASE item_id % 3 WHEN 0 THEN 'w' || item_id WHEN 1 THEN 'x' || item_id ELSE 'y' || item_id END AS answer, count(*) AS n FROM benchmark GROUP BY answer")
def single_answers(spark, sf_dir):
    """answers behind each marker, and without one."""
    k = F.col("item_id").cast("string")
    said = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("So the answer is W"), k, F.lit(" and more"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("Answer: no. ANSWER: X"), k, F.lit(".."))).otherwise(F.concat(F.lit("Y"), k, F.lit(" of them")))
    return t(spark, sf_dir, "benchmark").groupBy(T.gqa_answer(T.single_answer(said)).alias("answer")).agg(F.count("*").alias("n"))


@query("SELECT round(100.0 * avg((lower(lang) = CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'en' END)::INT), 6) AS accuracy, count(*) AS n FROM documents")
def exact_match(spark, sf_dir):
    """A10, A12."""
    predicted = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("en")
    return t(spark, sf_dir, "documents").agg(r6(100.0 * F.avg((F.lower("lang") == predicted).cast("int"))).alias("accuracy"), F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT item_id AS question_id, ((item_id * 7 + i * i) % 4)::VARCHAR AS answer FROM benchmark, range(0, 10) r(i)), c AS (SELECT question_id, answer, count(*)::DOUBLE AS c FROM a GROUP BY ALL),
    s AS (SELECT *, (c * least(1.0, (c - 1) / 3) + (10 - c) * least(1.0, c / 3)) / 10 AS score FROM c)
    SELECT b.item_id AS question_id, round(coalesce(s.score, 0), 6) AS score FROM benchmark b LEFT JOIN s ON s.question_id = b.item_id AND s.answer = (b.item_id % 4)::VARCHAR"""
)
def soft_accuracy(spark, sf_dir):
    """A11, J3."""
    b = t(spark, sf_dir, "benchmark")
    answers = b.select(F.col("item_id").alias("question_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("question_id", ((F.col("question_id") * 7 + F.col("i") * F.col("i")) % 4).cast("string").alias("answer"))
    predictions = b.select(F.col("item_id").alias("question_id"), (F.col("item_id") % 4).cast("string").alias("predicted"))
    return scoring.soft_accuracy(answers, predictions).select("question_id", r6("score").alias("score"))


@query("WITH p AS (SELECT s_suppkey, lower(trim(' ' || s_name || ' ')) AS p, unnest(['supplier' || s_nationkey, lower(replace(s_name, '0', '')), lower(s_name || s_suppkey)]) AS g FROM supplier), s AS (SELECT s_suppkey, max(CASE WHEN 1 - levenshtein(p, trim(g)) / greatest(length(p), length(trim(g))) >= 0.5 THEN 1 - levenshtein(p, trim(g)) / greatest(length(p), length(trim(g))) ELSE 0 END) AS s FROM p GROUP BY s_suppkey) SELECT s_suppkey, round(s, 6) AS anls FROM s")
def anls(spark, sf_dir):
    """The best of three truths, in any case and without white space around."""
    s = t(spark, sf_dir, "supplier")
    truths = F.array(F.concat(F.lit("Supplier"), F.col("s_nationkey").cast("string")), F.replace("s_name", F.lit("0"), F.lit("")), F.concat("s_name", F.col("s_suppkey").cast("string")))
    return s.select("s_suppkey", r6(scoring.anls(F.concat(F.lit(" "), F.upper("s_name"), F.lit(" ")), truths)).alias("anls"))


@query("SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, round(avg(quality), 6) AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ROLLUP (lang)")
def type_accuracy_rollup(spark, sf_dir):
    """A15, A18, J10."""
    labels = t(spark, sf_dir, "labels").where("quality is not null").select(scoring.keyed_number(F.col("doc_id").cast("string")).alias("doc_id"), "quality")
    x = t(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id")
    return scoring.with_total(x, "lang", r6(F.avg("quality")).alias("accuracy"), F.count("*").alias("n"))


@query("SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS category, round(avg(o_totalprice), 3) AS first, round(avg(o_custkey % 10), 3) AS second, round(100 * avg(o_custkey % 10) / avg(o_totalprice), 6) AS ratio FROM orders GROUP BY ROLLUP (o_orderpriority)")
def pair_score_rollup(spark, sf_dir):
    """A19, F11."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 10).alias("y"))
    return scoring.with_total(o, "category", F.round(F.avg("x"), 3).alias("first"), F.round(F.avg("y"), 3).alias("second"), r6(100 * F.avg("y") / F.avg("x")).alias("ratio"))


@query("SELECT count(*) AS n, round(count(*) FILTER (a) / count(*), 6) AS first, round(count(*) FILTER (b) / count(*), 6) AS second, round(count(*) FILTER (CASE WHEN f THEN b ELSE a END) / count(*), 6) AS fallback, round(count(*) FILTER (a OR b) / count(*), 6) AS upper_bound, round(count(*) FILTER (f) / count(*), 6) AS failed FROM (SELECT quality = 1 AS a, toxic = 0 AS b, doc_id % 5 = 0 AS f FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)")
def ensemble_accuracy(spark, sf_dir):
    """A16, A17."""
    x = t(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    return rounded(scoring.ensemble(x, F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 5 == 0), "first", "second", "fallback", "upper_bound", "failed")


SCORED = "SELECT o_orderkey % 1000 + 1 AS prompt_id, o_custkey % 3 AS c, o_custkey % 2 AS r, o_orderkey % 3 AS a FROM orders"
CATEGORY = "CASE WHEN prompt_id <= 400 THEN 'CULTURE' WHEN prompt_id <= 567 THEN 'TIME' WHEN prompt_id <= 700 THEN 'SPACE' WHEN prompt_id <= 800 THEN 'BIOLOGY' WHEN prompt_id <= 900 THEN 'PHYSICS' ELSE 'CHEMISTRY' END"


def scored(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 1000 + 1).alias("prompt_id"), rubrics.wiscore(F.col("o_custkey") % 3, F.col("o_custkey") % 2, F.col("o_orderkey") % 3).alias("wiscore"))


@query(f"SELECT {CATEGORY} AS category, round(avg((0.7::DOUBLE * c + 0.2::DOUBLE * r + 0.1::DOUBLE * a) / 2), 6) AS score, count(*) AS n FROM ({SCORED}) GROUP BY category")
def wiscore(spark, sf_dir):
    """A20."""
    return rounded(rubrics.rubric_means(scored(spark, sf_dir)), "score")


@query(f"WITH m AS (SELECT {CATEGORY} AS category, avg((0.7::DOUBLE * c + 0.2::DOUBLE * r + 0.1::DOUBLE * a) / 2) AS score FROM ({SCORED}) GROUP BY category) SELECT round(CASE WHEN count(*) = 6 AND (SELECT count(DISTINCT prompt_id) FROM ({SCORED})) = 1000 THEN sum(score * CASE category WHEN 'CULTURE' THEN 0.4::DOUBLE WHEN 'TIME' THEN 0.167::DOUBLE WHEN 'SPACE' THEN 0.133::DOUBLE ELSE 0.1::DOUBLE END) END, 6) AS overall, (SELECT count(DISTINCT prompt_id) FROM ({SCORED})) AS ids FROM m")
def wiscore_overall(spark, sf_dir):
    """A21, J13."""
    return rounded(rubrics.rubric_overall(scored(spark, sf_dir)), "overall")


@query("WITH s AS (SELECT doc_id AS idx, length(text)::DOUBLE AS score FROM documents), g AS (SELECT doc_id AS idx, lang AS tag FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0) SELECT tag, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(*) AS n FROM g JOIN s USING (idx) GROUP BY tag UNION ALL SELECT 'all', round(avg(score), 6), round(stddev_samp(score), 6), count(*) FROM s WHERE idx IN (SELECT idx FROM g)")
def tag_group_mean_std(spark, sf_dir):
    """A22, J15, U2."""
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang", "source", F.length("text").cast("double").alias("score"))
    tags = F.array_compact(F.array(F.when(F.col("idx") % 2 == 0, F.col("lang")), F.when(F.col("idx") % 3 == 0, F.col("source"))))
    return rounded(rubrics.tag_means(d.select("idx", "score"), d.select("idx", F.explode(tags).alias("tag"))), "mean", "std")


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS item, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS qid, (event_type <> 'click' AND event_id % 3 <> 0)::INT::DOUBLE AS yes, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    r(item, qid, score, n) AS (SELECT item, qid, yes, n FROM e WHERE qid = 1 UNION ALL SELECT e.item, e.qid, CASE WHEN r.score = 0 AND e.qid % 4 <> 0 THEN 0 ELSE e.yes END, e.n FROM r JOIN e ON e.item = r.item AND e.qid = r.qid + 1)
    SELECT item, round(sum(score) / any_value(n), 6) AS score FROM r GROUP BY item"""
)
def dpg_dependency(spark, sf_dir):
    """Each question depends on the one before it, every fourth on none; zeros cascade in order."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_type") != "click") & (F.col("event_id") % 3 != 0)).cast("double").alias("yes"))
    listed = e.groupBy(F.col("user_id").alias("item")).agg(F.array_sort(F.collect_list(F.struct("event_id", "yes"))).alias("l"))
    questions = F.transform("l", lambda x, i: F.struct((i + 1).alias("qid"), x["yes"].alias("yes"), F.array(F.when((i + 1) % 4 == 0, 0).otherwise(i)).alias("parents")))
    return rounded(rubrics.dependency_score(listed.select("item", F.lit(0).alias("crop"), questions.alias("questions")), "item", "crop"), "score")


def book(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").where("vec_id < 16").select(F.col("vec_id").cast("int").alias("code"), F.col("embedding").alias("vec"))


NEAREST = "WITH b AS (SELECT vec_id::INT AS code, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 16), n AS (SELECT e.vec_id, arg_min(b.code, (round(list_distance(e.embedding::DOUBLE[], b.v), 9), b.code)) AS code FROM embeddings e, b GROUP BY e.vec_id)"


@query(NEAREST + " SELECT vec_id, code FROM n")
def nearest_code(spark, sf_dir):
    """J19."""
    return codes.nearest_code(t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), book(spark, sf_dir)).select("vec_id", "code")


@query(NEAREST + ", c AS (SELECT code, count(*) AS c FROM n GROUP BY code), p AS (SELECT c / (SELECT count(*) FROM n) AS p FROM c) SELECT count(*) AS used, round(count(*) / 16, 6) AS utilisation, round(100.0 * count(*) FILTER (p > 0.01 / 16) / 16, 6) AS usage_percent, round(exp(-sum(p * ln(p + 1e-10))), 6) AS perplexity FROM p")
def code_usage(spark, sf_dir):
    """A26-A28."""
    coded = codes.nearest_code(t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), book(spark, sf_dir))
    return rounded(codes.usage(coded, 16), "utilisation", "usage_percent", "perplexity")


@query(NEAREST + " SELECT vec_id, CASE WHEN code % 2 = 0 THEN code // 2 ELSE 99 END AS new_code FROM n")
def code_remap(spark, sf_dir):
    """J20, J21."""
    coded = codes.nearest_code(t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), book(spark, sf_dir))
    table = book(spark, sf_dir).where("code % 2 = 0").select("code", (F.col("code") / 2).cast("int").alias("new_code"))
    return codes.remap(coded, table, 99).select("vec_id", "new_code")


@query("SELECT vec_id, book, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN part[i] > 0 THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS code, len(list_filter(part, lambda x: x > 0)) AS positive FROM (SELECT vec_id, b AS book, embedding[16 * b + 1:16 * b + 16] AS part FROM embeddings, range(4) r(b))")
def lookup_free_code(spark, sf_dir):
    """M12 and its inverse, Q22: all dimensions, as four codebooks of 16 bits."""
    x = t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(sequences.split_codebooks(F.col("embedding"), 4)).alias("book", "part"))
    x = x.select("vec_id", F.col("book").cast("long").alias("book"), codes.sign_code(F.col("part")).alias("code"))
    return x.withColumn("positive", F.size(F.filter(codes.code_signs(F.col("code"), 16), lambda x: x > 0)).cast("long"))


@query("WITH d AS (SELECT vec_id, list_transform(range(1, 4), lambda i: (round_even(tanh(embedding[i]::DOUBLE * 4) * (CASE i WHEN 1 THEN 3.5 WHEN 2 THEN 2 ELSE 2 END) - CASE i WHEN 1 THEN 0.5 ELSE 0 END, 0) + CASE i WHEN 1 THEN 4 ELSE 2 END)::INT) AS d FROM embeddings) SELECT vec_id, (d[1] + d[2] * 8 + d[3] * 40)::BIGINT AS code, d[3] AS third FROM d")
def mixed_radix_code(spark, sf_dir):
    """M13 and its inverse."""
    levels = [8, 5, 5]
    digits = [codes.bounded_digit(F.get("embedding", F.lit(i)).cast("double") * 4, n) for i, n in enumerate(levels)]
    x = t(spark, sf_dir, "embeddings").select("vec_id", codes.radix_code(digits, levels).alias("code"))
    return x.select("vec_id", "code", codes.radix_digits(F.col("code"), levels)[2].cast("int").alias("third"))


@query("WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) SELECT a.label, a.i, b.i AS j, round(avg(a.x), 6) AS mean_i, round(covar_samp(a.x, b.x), 6) AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.label, a.i, b.i")
def mean_cov(spark, sf_dir):
    """A30 over all dimensions."""
    return rounded(manifold.whole_covariance(t(spark, sf_dir, "embeddings"), "label"), "mean_i", "cov")


@query()
def frechet(spark, sf_dir):
    """Distance of the even ids' vectors from the odd ones'."""
    e = t(spark, sf_dir, "embeddings")
    a, b = (manifold.moments(e.where(F.col("vec_id") % 2 == k)) for k in (0, 1))
    return spark.createDataFrame([(int(a[0]), int(b[0]), round(manifold.frechet(a[1:], b[1:]), 6))], "n_even long, n_odd long, distance double")


POINTS = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.v, b.v) ** 2 END AS d FROM v a, v b), r AS (SELECT a AS id, list_sort(list(d))[4] AS radius FROM d WHERE a % 2 = b % 2 GROUP BY a)"


@query(POINTS + ", h AS (SELECT a, bool_or(d <= radius * (1 + 1e-12)) AS hit FROM d JOIN r ON r.id = d.b WHERE a % 2 <> b % 2 GROUP BY a) SELECT round(avg(hit::INT) FILTER (a % 2 = 1), 6) AS precision, round(avg(hit::INT) FILTER (a % 2 = 0), 6) AS recall FROM h")
def manifold_pr(spark, sf_dir):
    """Even ids are the reference, odd ids the samples."""
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rounded(manifold.precision_recall(e.where("id % 2 = 0"), e.where("id % 2 = 1")), "precision", "recall")


LOGITS = "WITH l AS (SELECT user_id AS seq, event_id AS token, value AS logit FROM events), p AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seq)) AS e FROM l), s AS (SELECT seq, token, logit, e / sum(e) OVER (PARTITION BY seq) AS p FROM p)"


def logits(spark, sf_dir):
    return t(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("token"), F.col("value").alias("logit"))


@query("SELECT user_id AS seq, event_id AS token FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM events) WHERE r <= 5")
def topk_filter(spark, sf_dir):
    """L11."""
    return decoding.top_k(logits(spark, sf_dir), "seq", "logit", 5).select("seq", "token")


@query(LOGITS + " SELECT seq, token FROM (SELECT seq, token, p, sum(p) OVER (PARTITION BY seq ORDER BY logit DESC, token ROWS UNBOUNDED PRECEDING) - p AS before FROM s) WHERE before <= 0.7::DOUBLE")
def topp_filter(spark, sf_dir):
    """L12, L14, W17, M7."""
    return decoding.top_p(logits(spark, sf_dir), "seq", "logit", "token", 0.7).select("seq", "token")


@query(LOGITS + " SELECT seq, arg_max(token, (p, -token)) AS token FROM s GROUP BY seq")
def argmax_token(spark, sf_dir):
    """L15."""
    return decoding.pick(decoding.with_probability(logits(spark, sf_dir), "seq", "logit"), "seq", "token")


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE + (embedding[65 - i]::DOUBLE - embedding[i]::DOUBLE) * 3) ), 6) AS total FROM embeddings")
def cfg_mix(spark, sf_dir):
    """M2."""
    d = F.col("embedding").cast("array<double>")
    return t(spark, sf_dir, "embeddings").select("vec_id", r6(F.aggregate(decoding.guided(F.reverse(d), d, 3.0), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_id, round(CASE WHEN n > 3 THEN CASE WHEN value > 0 THEN value / 1.2 ELSE value * 1.2 END ELSE value END - 0.1 * CASE WHEN n > 3 THEN n ELSE 0 END - CASE WHEN n > 3 THEN 0.5 ELSE 0 END, 6) AS logit FROM events JOIN c USING (user_id, event_type)")
def penalties(spark, sf_dir):
    """M5, A40."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    bins = scoring.token_bins(e, "user_id", "event_type")
    count = F.when(F.col("n") > 3, F.col("n")).otherwise(0)
    return e.join(bins, ["user_id", "event_type"]).select("event_id", r6(decoding.penalised(F.col("value"), count, 1.2, 0.1, 0.5)).alias("logit"))


W20 = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, round(avg(value) {W20}, 6) AS avg, round(max(value) {W20}, 6) AS max, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS global_avg, round(quantile_disc(value, 0.5) {W20}, 6) AS median_low, round(median(value) {W20}, 6) AS median FROM events")
def rolling_metrics(spark, sf_dir):
    """W9."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return rounded(batching.rolling(e, "user_id", ["ts", "event_id"], "value").select("event_id", "avg", "max", "global_avg", "median_low", "median"), "avg", "max", "global_avg", "median_low", "median")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r(user_id, i, m) AS (SELECT user_id, i, value FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN r.i < 100 THEN 0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * value ELSE 0.99::DOUBLE * m + (1 - 0.99::DOUBLE) * value END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, max(i) AS n, round(arg_max(m, i), 6) AS ema FROM r GROUP BY user_id"""
)
def ema_usage(spark, sf_dir):
    """A42."""
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("l"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).cast("double").alias("m"))

    def step(s, x):
        decay = F.when(s["n"] == 0, 0.0).when(s["n"] < 100, 0.9).otherwise(0.99)
        return F.struct((s["n"] + 1).alias("n"), (decay * s["m"] + (1 - decay) * x["value"]).alias("m"))

    out = F.aggregate("l", start, step)
    return e.select("user_id", out.alias("s")).select("user_id", F.col("s.n").cast("long").alias("n"), r6("s.m").alias("ema"))


@query("WITH s AS (SELECT DISTINCT event_id * 500 AS step FROM events), m AS (SELECT step, step >= 100000 AND (step - 100000) % 97000 = 0 AS is_milestone FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY is_milestone ORDER BY step DESC) AS r, max(step) FILTER (is_milestone) OVER () AS last FROM m) SELECT step, is_milestone, CASE WHEN is_milestone THEN r <= 5 ELSE r <= 10 AND (last IS NULL OR step >= last) END AS keep FROM r")
def checkpoint_retention(spark, sf_dir):
    """W16 with every event as a step, so that there are milestones."""
    steps = t(spark, sf_dir, "events").select((F.col("event_id") * 500).alias("step")).distinct()
    return scoring.retention(steps, "step", 97000, 100000)


@query("WITH o AS (SELECT lang AS metric, count(*)::DOUBLE AS value FROM documents GROUP BY lang), n AS (SELECT lang AS metric, avg(length(text)) AS value FROM documents WHERE lang IN ('en', 'de') GROUP BY lang UNION ALL SELECT 'new', 1.0) SELECT metric, round(coalesce(n.value, o.value), 6) AS value FROM o FULL JOIN n USING (metric)")
def upsert_metrics(spark, sf_dir):
    """K12."""
    d = t(spark, sf_dir, "documents")
    old = d.groupBy(F.col("lang").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    new = d.where(F.col("lang").isin("en", "de")).groupBy(F.col("lang").alias("metric")).agg(F.avg(F.length("text")).alias("value")).unionByName(spark.createDataFrame([("new", 1.0)], "metric string, value double"))
    return rounded(scoring.upsert(old, new, "metric"), "value")


@query("SELECT l_returnflag AS grp, arg_min(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS best FROM lineitem GROUP BY grp")
def best_setting(spark, sf_dir):
    """A41, L16."""
    l = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("best"), F.struct("l_extendedprice", "l_orderkey", "l_linenumber").alias("m"))
    return scoring.best_setting(l, "grp", "m").select("grp", "best")


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 10")
def per_class_sample(spark, sf_dir):
    """A38."""
    return rows.per_group_first(t(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", 10, "vec_id")


@query("SELECT round(avg(m), 6) AS mean_of_means, count(*) AS batches FROM (SELECT avg(value) AS m FROM events GROUP BY event_id // 64)")
def mean_of_batches(spark, sf_dir):
    """A36, A39."""
    e = t(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 64).alias("batch"), "value")
    return rounded(scoring.mean_of_batches(e, "batch", "value"), "mean_of_means")


@query("WITH c AS (SELECT DISTINCT lang FROM documents) SELECT doc_id, (SELECT count(*) FROM c WHERE c.lang < d.lang) AS class_index FROM documents d")
def class_index(spark, sf_dir):
    """S26."""
    return records.class_index(t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").select("doc_id", F.col("class_index").cast("long").alias("class_index"))


@query("WITH p AS (SELECT lpad((row_number() OVER (ORDER BY item_id))::VARCHAR, 5, '0') AS Index, text FROM benchmark WHERE trim(text) <> '') SELECT source, Index, source || '/' || Index || '.jpg' AS path FROM p, (VALUES ('a'), ('b'), ('c')) s(source)")
def prompt_sources(spark, sf_dir):
    """S16, S17, L17."""
    return rubrics.prompts_by_source(t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt")), ["a", "b", "c"], "item_id").select("source", "Index", "path")


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _entities(x: str) -> str:
    for _ in range(2):
        for a, b in ENTITIES:
            x = f"replace({x}, {q(a)}, {q(b)})"
    return x


@query(f"SELECT page_id, md5(trim(lower(regexp_replace({_entities('html')}, '[\\s\\v\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')))) AS digest FROM pages")
def clean_pages(spark, sf_dir):
    """F13."""
    return t(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_html(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT user_id % 100 AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels) GROUP BY k")
def resume_anti(spark, sf_dir):
    """J12, K13, ST6."""
    left = t(spark, sf_dir, "events").select("user_id", "value").join(t(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id")), "user_id", "left_anti")
    return left.groupBy((F.col("user_id") % 100).alias("k")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("WITH p AS (SELECT vec_id, vec_id // 100 AS split, list_transform(embedding, lambda x: exp(x::DOUBLE * 4)) AS e FROM embeddings), n AS (SELECT vec_id, split, list_transform(e, lambda x: x / list_sum(e)) AS p FROM p), x AS (SELECT vec_id, split, unnest(p) AS p, unnest(range(len(p))) AS c FROM n), m AS (SELECT *, avg(p) OVER (PARTITION BY split, c) AS m FROM x), k AS (SELECT split, sum(p * (ln(p) - ln(m))) AS kl FROM m GROUP BY split, vec_id), s AS (SELECT exp(avg(kl)) AS s FROM k GROUP BY split) SELECT round(avg(s), 6) AS inception_score FROM s")
def inception_score(spark, sf_dir):
    """Over all dimensions."""
    p = codes.softmax(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 4))
    e = t(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    return rounded(manifold.inception_score(e, 100, "vec_id", "p"), "inception_score")


@query("WITH b AS (SELECT vec_id::INT AS code, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 16), d AS (SELECT e.vec_id, code, list_distance(e.embedding::DOUBLE[], b.v) AS d FROM embeddings e, b), x AS (SELECT vec_id, code, exp((min(d) OVER (PARTITION BY vec_id) - d) / 0.1) AS x FROM d), p AS (SELECT vec_id, code, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM x), h AS (SELECT -sum(p * ln(p + 1e-10)) AS h FROM p GROUP BY vec_id), m AS (SELECT avg(p) AS m FROM p GROUP BY code) SELECT round((SELECT avg(h) FROM h), 6) AS sample_entropy, round(-sum(m * ln(m + 1e-10)), 6) AS average_entropy FROM m")
def entropies(spark, sf_dir):
    """A29, M6."""
    e, b = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), book(spark, sf_dir).select("code", F.col("vec").cast("array<double>").alias("w"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    pairs = e.join(F.broadcast(b), how="cross").select("vec_id", "code", d.alias("d"))  # 16 codes: the codebook is a constant
    return rounded(codes.entropies(pairs, "vec_id", "code", "d", 0.1), "sample_entropy", "average_entropy")
