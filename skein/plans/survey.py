"""Queries of the catalogue for evaluation joins, choices, geometry and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from .catalog import query, r6, t


def answers(spark, sf_dir):
    return t(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", F.concat(F.lit("t"), F.col("toxic").cast("string")).alias("prediction"))


@query("SELECT lang, coalesce('t' || p.toxic::INT::VARCHAR, 'FAILED') AS prediction, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) s JOIN documents d USING (doc_id) LEFT JOIN (SELECT * FROM labels WHERE toxic IS NOT NULL) p USING (doc_id) GROUP BY ALL")
def split_predictions(spark, sf_dir):
    """The split is the even ids."""
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    out = E.predicted_or_failed(d.where("doc_id % 2 = 0"), d, answers(spark, sf_dir), "doc_id", "prediction")
    return out.groupBy("lang", "prediction").agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 3) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def all_sides(spark, sf_dir):
    """Rows that three tables have."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_totalprice")
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"))
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return E.merged(E.merged(o, "custkey", [c]), "nationkey", [n]).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 3).alias("total"))


@query("SELECT lang, count(*) AS n, count(quality) AS judged, count(item_id) AS asked_again FROM documents JOIN (SELECT DISTINCT user_id AS doc_id FROM events) u USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN (SELECT item_id, item_id AS doc_id FROM benchmark) b USING (doc_id) GROUP BY lang")
def optional_sides(spark, sf_dir):
    """Two sides that must be there, two that may."""
    d, u = t(spark, sf_dir, "documents").select("doc_id", "lang"), t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    b = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "item_id")
    out = E.merged(d, "doc_id", [u], [t(spark, sf_dir, "labels").select("doc_id", "quality"), b])
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("judged"), F.count("item_id").alias("asked_again"))


@query("SELECT coalesce('t' || l.toxic::INT::VARCHAR, d.lang) AS cell, count(*) AS n FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic IS NOT NULL) l USING (doc_id) GROUP BY cell")
def updated_cells(spark, sf_dir):
    """J11."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("prediction"))
    return E.updated(d, answers(spark, sf_dir), "doc_id", "prediction").groupBy(F.col("prediction").alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(v.label::VARCHAR, 'no') AS codes, count(*) AS n FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id GROUP BY ALL")
def attached_codes(spark, sf_dir):
    """P13."""
    codes = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("codes"))
    return E.with_codes(t(spark, sf_dir, "documents").select("doc_id"), codes, "doc_id").groupBy("codes").agg(F.count("*").alias("n"))


@query("SELECT page_id, 'images/' || lpad(page_id::VARCHAR, 8, '0') || '.jpg' AS image_url FROM pages")
def image_urls(spark, sf_dir):
    """The image column gives way to where it is kept."""
    return t(spark, sf_dir, "pages").select("page_id", E.kept_at("image_url", "page_id"))


@query("SELECT CASE WHEN contains(name, '0613') THEN '0613' ELSE '0314' END AS version, count(*) AS n FROM (SELECT 'review-' || o_orderkey AS name, o_orderkey AS k FROM orders) WHERE k NOT IN (7, 39) AND contains(name, '1') GROUP BY version")
def review_versions(spark, sf_dir):
    """P19."""
    o = t(spark, sf_dir, "orders").select(F.concat(F.lit("review-"), F.col("o_orderkey").cast("string")).alias("name"), "o_orderkey")
    kept = o.where(~F.col("o_orderkey").isin(7, 39) & F.contains("name", F.lit("1")))
    return kept.groupBy(E.review_version(F.col("name")).alias("version")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no' ELSE lang END AS a, CASE WHEN doc_id % 5 = 0 THEN 'no' ELSE source END AS b, (doc_id * 37 % 100) / 100.0::DOUBLE AS r FROM documents) SELECT CASE WHEN a <> 'no' AND b <> 'no' THEN CASE WHEN r > 0.8 THEN a ELSE b END WHEN a <> 'no' THEN a WHEN b <> 'no' THEN b ELSE '<unconditional>' END AS caption, count(*) AS n FROM c GROUP BY caption")
def caption_choices(spark, sf_dir):
    """Q21, with a draw that follows from the id."""
    a, b = F.when(F.col("doc_id") % 3 == 0, "no").otherwise(F.col("lang")), F.when(F.col("doc_id") % 5 == 0, "no").otherwise(F.col("source"))
    return t(spark, sf_dir, "documents").groupBy(E.caption_choice(a, b, (F.col("doc_id") * 37 % 100) / 100).alias("caption")).agg(F.count("*").alias("n"))


@query("SELECT round(sum(correct) / sum(total), 6) AS accuracy, round(sum(loss) / sum(total), 6) AS mean_loss FROM (SELECT user_id % 8 AS rank, count(*) FILTER (event_type = 'click') AS correct, count(*) AS total, sum(value) AS loss FROM events GROUP BY rank)")
def pooled_means(spark, sf_dir):
    """Sums of each rank's sums over the sums of their counts."""
    ranks = t(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("rank")).agg(F.count_if(F.col("event_type") == "click").alias("correct"), F.count("*").alias("total"), F.sum("value").alias("loss"))
    return E.pooled(ranks, "correct", "loss", "total").select(r6("accuracy").alias("accuracy"), r6("mean_loss").alias("mean_loss"))


@query("WITH n AS (SELECT count(*) * 3 AS n FROM documents), a AS (SELECT doc_id, doc_id * 3 + k AS position FROM documents, range(3) r(k)) SELECT doc_id, position FROM a UNION ALL SELECT doc_id, position + n FROM a, n WHERE position < (64 - n % 64) % 64")
def filled_batches(spark, sf_dir):
    """Three augmentations of each, batches of 64."""
    return E.filled(t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64, 3)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def head_rows(spark, sf_dir):
    """The first rows by an explicit order, however the input is cut into batches."""
    return E.head(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 100, "o_orderdate", "o_orderkey")


BESIDE = "list_filter([pt - 0.25, pt + 0.25], lambda x: x >= 1.0 AND x <= 3.0 AND NOT list_contains(tried, x))[1]"


@query(f"WITH s AS (SELECT o_orderstatus, o_orderpriority, o_orderkey, 1 + (o_orderkey % 9) * 0.25::DOUBLE AS cfg, o_totalprice AS fid FROM orders WHERE o_orderstatus <> 'P' AND (o_orderkey % 9 + length(o_orderpriority)) % 4 <> 0), r AS (SELECT o_orderstatus, o_orderpriority, arg_min(cfg, (fid, o_orderkey)) AS pt, min(fid) AS best, list(DISTINCT cfg) AS tried FROM s GROUP BY ALL), g AS (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders) SELECT o_orderstatus, o_orderpriority, CASE WHEN pt IS NULL THEN 2.0 ELSE {BESIDE} END::DOUBLE AS next, best, pt IS NOT NULL AND {BESIDE} IS NULL AS ended FROM g LEFT JOIN r USING (o_orderstatus, o_orderpriority)")
def next_search_point(spark, sf_dir):
    """A search for each status and priority; those of one status have not begun."""
    o = t(spark, sf_dir, "orders")
    tried = o.where("o_orderstatus <> 'P' and (o_orderkey % 9 + length(o_orderpriority)) % 4 <> 0").select("o_orderstatus", "o_orderpriority", "o_orderkey", "o_totalprice", (1 + (F.col("o_orderkey") % 9) * 0.25).cast("double").alias("cfg"))
    return E.next_points(o, tried, ["o_orderstatus", "o_orderpriority"], "cfg", "o_totalprice", "o_orderkey", 2.0, high=3.0)


@query("WITH a AS (SELECT DISTINCT round(l_discount * 10, 2) AS s FROM lineitem), b AS (SELECT DISTINCT round(l_tax * 10 + 0.15, 2) AS e FROM lineitem) SELECT s AS start, e AS \"end\", printf('start=%.2f;end=%.2f', s, e) AS annotation FROM a, b WHERE s < e")
def search_grid(spark, sf_dir):
    """Windows from the settings that two tables hold."""
    l = t(spark, sf_dir, "lineitem")  # noqa: E741
    return E.grid(l.select(F.round(F.col("l_discount") * 10, 2).alias("start")), l.select(F.round(F.col("l_tax") * 10 + 0.15, 2).alias("end")), "start", "end")


@query("WITH p AS (SELECT o_custkey AS seq, o_orderkey AS token, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS p FROM orders), c AS (SELECT *, sum(p) OVER (PARTITION BY seq ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) - p AS c, row_number() OVER (PARTITION BY seq ORDER BY p DESC, token) AS r FROM p), k AS (SELECT seq, token, p / sum(p) OVER (PARTITION BY seq) AS p FROM c WHERE c <= 0.45 OR r <= 2) SELECT seq, token, round(p, 6) AS p FROM k")
def topp_min_tokens(spark, sf_dir):
    """L14."""
    from pyspark.sql import Window

    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderkey").alias("token"), "o_totalprice")
    p = o.select("seq", "token", (F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("seq"))).alias("p"))
    return E.top_p_probabilities(p, "seq", "p", "token", 0.45, 2).withColumn("p", r6("p"))


@query("SELECT source, count(*) AS n FROM (SELECT doc_id, source FROM documents EXCEPT SELECT doc_id, source FROM documents JOIN labels USING (doc_id)) GROUP BY source")
def except_labelled(spark, sf_dir):
    """All without those of another set."""
    d = t(spark, sf_dir, "documents").select("doc_id", "source")
    return E.without(d, t(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, i // 32 AS batch, i >= n // 32 * 32 AS partial, count(*) AS rows, sum(doc_id)::BIGINT AS id_sum FROM g GROUP BY ALL")
def last_partials(spark, sf_dir):
    """Full batches of each group, and behind them the groups' last partial ones."""
    d = E.batches_of_groups(t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 32)
    return d.groupBy("lang", "batch", "partial").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("id_sum"))


@query("WITH p AS (SELECT page_id, trim(CASE WHEN page_id % 3 = 0 THEN '/runs/' || page_id || '/checkpoint-' || page_id || '/' ELSE url END, '/') AS u FROM pages), s AS (SELECT page_id, string_split(u, '/') AS s FROM p) SELECT page_id, CASE WHEN starts_with(s[-1], 'checkpoint-') THEN s[-2] || '_' || s[-1] ELSE s[-1] END AS name FROM s")
def model_names(spark, sf_dir):
    """F15."""
    k = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/runs/"), k, F.lit("/checkpoint-"), k, F.lit("/"))).otherwise(F.col("url"))
    return t(spark, sf_dir, "pages").select("page_id", E.model_name(path).alias("name"))


@query("WITH s AS (SELECT p_partkey, p_partkey * 37 % 1500 + 300 AS w, p_partkey * 91 % 1700 + 200 AS h FROM part), f AS (SELECT *, (w / (least(w, h) / 512))::DOUBLE AS fw, (h / (least(w, h) / 512))::DOUBLE AS fh FROM s), z AS (SELECT *, trunc(fw)::BIGINT AS cw, trunc(fh)::BIGINT AS ch FROM f) SELECT p_partkey, cw, ch, floor((cw - 512) / 2)::BIGINT AS \"left\", floor((ch - 512) / 2)::BIGINT AS top, greatest(w, h) AS side, floor((greatest(w, h) - w) / 2)::BIGINT AS x, floor((greatest(w, h) - h) / 2)::BIGINT AS y, w + h AS both_w FROM z")
def image_geometry(spark, sf_dir):
    """M8, M14."""
    s = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 1500 + 300).alias("w"), (F.col("p_partkey") * 91 % 1700 + 200).alias("h"))
    out = s.select("p_partkey", E.centre_crop(F.col("w"), F.col("h")).alias("c"), E.square_pad(F.col("w"), F.col("h")).alias("q"), E.beside(F.col("w"), F.col("h"), F.col("h"), F.col("w")).alias("b"))
    return out.select("p_partkey", F.col("c.w").alias("cw"), F.col("c.h").alias("ch"), "c.left", "c.top", "q.side", "q.x", "q.y", F.col("b.w").alias("both_w"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN chr(65 + (item_id % 7)::INT) WHEN 1 THEN chr(65 + (item_id % 7)::INT) WHEN 2 THEN chr(65 + (item_id % 7)::INT) ELSE 'FAILED' END AS letter, CASE WHEN item_id % 4 < 3 AND item_id % 7 < 5 THEN item_id % 7 ELSE -1 END AS idx FROM benchmark")
def choice_letters(spark, sf_dir):
    """The three forms of an answer, and one that says nothing."""
    letter = F.char(65 + F.col("item_id") % 7)
    said = F.when(F.col("item_id") % 4 == 0, letter).when(F.col("item_id") % 4 == 1, F.concat(letter, F.lit(". because"))).when(F.col("item_id") % 4 == 2, F.concat(F.lit("I think. The answer is "), letter, F.lit("."))).otherwise("none of them")
    b = t(spark, sf_dir, "benchmark").select("item_id", T.choice_letter(said).alias("letter"))
    return b.select("item_id", "letter", T.letter_index(F.col("letter"), 5).cast("long").alias("idx"))


@query("SELECT n_nationkey, list_sort(list_concat(range(n_nationkey, n_nationkey + 3), [100 + n_nationkey])) AS wanted FROM nation")
def id_ranges(spark, sf_dir):
    """P20."""
    k = F.col("n_nationkey").cast("string")
    spec = F.concat(k, F.lit("-"), (F.col("n_nationkey") + 3).cast("string"), F.lit(", "), (F.col("n_nationkey") + 100).cast("string"))
    return t(spark, sf_dir, "nation").select("n_nationkey", F.transform(T.int_ranges(spec), lambda x: x.cast("long")).alias("wanted"))


@query("SELECT p_partkey, 'IMGIMG' || translate(p_partkey::VARCHAR, '0123456789', 'ABCDEFGHIJ') || 'Z' AS name, p_partkey AS code FROM part")
def image_token_names(spark, sf_dir):
    """F21, there and back."""
    named = t(spark, sf_dir, "part").select("p_partkey", T.code_image_token(F.col("p_partkey")).alias("name"))
    return named.withColumn("code", T.image_token_code(F.col("name")).cast("long"))


@query("SELECT item_id, lower('what is ' || item_id || '?') AS question FROM benchmark")
def prompt_questions(spark, sf_dir):
    """the three layouts."""
    ask = F.concat(F.lit("What is "), F.col("item_id").cast("string"), F.lit("?"))
    prompt = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("OCR tokens: a, b. Question: "), ask, F.lit(" Short answer:"))).when(F.col("item_id") % 3 == 1, F.concat(ask, F.lit("\nReference OCR token: a\nAnswer with a word."))).otherwise(F.concat(ask, F.lit("\nAnswer with a word.")))
    return t(spark, sf_dir, "benchmark").select("item_id", T.prompt_question(prompt).alias("question"))


@query("SELECT item_id, (item_id % 3)::DOUBLE AS consistency, (item_id % 2)::DOUBLE AS realism FROM benchmark")
def judged_metrics(spark, sf_dir):
    """the last mention of a metric counts."""
    a, b = (F.col("item_id") % 3).cast("string"), (F.col("item_id") % 2).cast("string")
    said = F.concat(F.lit("Consistency: 2\n**Realism**: "), b, F.lit("\n**Consistency**: "), a)
    return t(spark, sf_dir, "benchmark").select("item_id", T.judge_scores(said).alias("m")).select("item_id", F.col("m")["consistency"].alias("consistency"), F.col("m")["realism"].alias("realism"))


@query("SELECT doc_id, (lang IS NULL OR lower(lang) IN ('nan', 'none')) AS none, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 3 END AS options FROM documents")
def options_given(spark, sf_dir):
    """P18."""
    options = F.array(F.lit("a"), F.when(F.col("doc_id") % 4 == 0, "None").otherwise("b"), F.lit("c"))
    return t(spark, sf_dir, "documents").select("doc_id", T.is_none(F.col("lang")).alias("none"), F.size(T.options_before_none(options)).alias("options"))
