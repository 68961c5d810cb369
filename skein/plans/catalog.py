"""The engine's queries over the driver's tables, each with the SQL it is held against.

Names start with what they show; the operator ids behind them are in the docstrings. Numbers are rounded to six places on
both sides. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching, codes, conversation, decoding, losses, manifold, mixture, records, rows, rubrics, scoring, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def lcg_sql(col: str, seed: int) -> str:
    return f"({col} * 1103515245 % 2147483648 + {(12345 + seed * 7919) % 2147483648})"


MIX = [(0, "src0", 0.2222), (1, "src1", 1.0), (2, "src2", 0.29), (3, "src1", 0.563)]


@query(
    """
    WITH d AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
      FROM documents WHERE length(regexp_replace(text, '^[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+|[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+$', '', 'g')) >= 10),
    m AS (SELECT * FROM (VALUES (0, 'src0', 0.2222::DOUBLE), (1, 'src1', 1.0::DOUBLE), (2, 'src2', 0.29::DOUBLE), (3, 'src1', 0.563::DOUBLE)) v(mix_pos, name, fraction))
    SELECT mix_pos, source, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, sum(doc_id)::BIGINT AS id_sum
    FROM d JOIN m ON d.source = m.name WHERE i < floor(n::DOUBLE * fraction) GROUP BY mix_pos, source
    """
)
def prefix_mixture(spark, sf_dir):
    """Min-length filter, then prefix-sampled union with one source listed twice, and its sizes."""
    docs = records.unify_text(t(spark, sf_dir, "documents").select("doc_id", "source", "text"), min_length=10)
    mixed = mixture.prefix_mixture(docs.select("doc_id", "source", "length", "n_bytes"), "source", "doc_id", MIX)
    return mixed.groupBy("mix_pos", "source").agg(F.count("*").alias("docs"), F.sum("length").alias("chars"), F.sum("n_bytes").alias("bytes"), F.sum("doc_id").alias("id_sum"))


@query(
    """
    SELECT doc_id, 'text_pretrain' AS data_type, length(text) AS length, strlen(text) AS n_bytes, '' AS url, 'sample_' || (row_number() OVER (ORDER BY doc_id) - 1) AS id
    FROM documents WHERE length(regexp_replace(text, '^[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+|[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+$', '', 'g')) >= 10
    """
)
def text_unify(spark, sf_dir):
    """P1, P2."""
    docs = records.unify_text(t(spark, sf_dir, "documents").select("doc_id", "text"), min_length=10)
    out = rows.with_row_index(docs.select("doc_id", "data_type", "length", "n_bytes"), "doc_id").withColumns({c: F.lit(None).cast("string") for c in ("url", "timestamp", "id")})
    return records.with_defaults(out).select("doc_id", "data_type", F.col("length").cast("long").alias("length"), F.col("n_bytes").cast("long").alias("n_bytes"), "url", "id")


@query("SELECT count(*) AS total, count(*) FILTER (length(text) >= 1000) AS kept, round(count(*) FILTER (length(text) >= 1000) / count(*), 6) AS rate, count(DISTINCT source) AS n_files FROM documents")
def min_length_filter_stats(spark, sf_dir):
    """A7."""
    return records.filter_stats(t(spark, sf_dir, "documents"), F.length("text") >= 1000, F.col("source")).withColumn("rate", r6("rate"))


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean_score FROM part WHERE p_retailprice >= 950 AND p_retailprice < 1500 AND p_size >= 10 GROUP BY p_brand")
def aesthetic_range_filter(spark, sf_dir):
    """P5: half-open score range and least sizes, pushed to the scan."""
    part = t(spark, sf_dir, "part").select("p_brand", "p_retailprice", F.col("p_size").alias("width"), F.col("p_size").alias("height"))
    return records.score_range(part, "p_retailprice", 950, 1500, "width", "height", 10).groupBy("p_brand").agg(F.count("*").alias("n"), r6(F.avg("p_retailprice")).alias("mean_score"))


@query("SELECT CASE WHEN greatest(p_size, 7) / least(p_size, 7) <= 2 THEN 'pretrain' WHEN greatest(p_size, 7) / least(p_size, 7) < 3 THEN 'multi' ELSE 'dropped' END AS kind, count(*) AS n FROM part GROUP BY kind")
def aspect_ratio_filter(spark, sf_dir):
    """The inclusive bound of two and the exclusive bound of three."""
    w, h = F.col("p_size"), F.lit(7)
    kind = F.when(records.aspect_ok(w, h, 2, True), "pretrain").when(records.aspect_ok(w, h, 3, False), "multi").otherwise("dropped")
    return t(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {lcg_sql('doc_id', 42)}, doc_id) - 1 AS place FROM documents")
def seeded_order(spark, sf_dir):
    """A seeded permutation."""
    return rows.with_row_index(t(spark, sf_dir, "documents").select("doc_id", rows.lcg("doc_id", 42).alias("k")), "k", "doc_id", name="place").select("doc_id", "place")


@query("SELECT CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 >= count(*) OVER () - 100 THEN 'val' ELSE 'train' END AS split, doc_id FROM documents")
def tail_split(spark, sf_dir):
    """L4."""
    return rows.tail_split(t(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id").select("split", "doc_id")


@query(f"SELECT doc_id, CASE WHEN count(*) OVER () > 150 AND row_number() OVER (ORDER BY {lcg_sql('doc_id', 42)}, doc_id) <= 150 THEN 'val' ELSE 'train' END AS split FROM documents")
def holdout_split(spark, sf_dir):
    """L5, U5."""
    return rows.holdout(t(spark, sf_dir, "documents").select("doc_id"), 150, rows.lcg("doc_id", 42), "doc_id")


SHARDS = {
    "contiguous": "least(i // (n // 7), 6)",
    "array_split": "CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END",
    "ceil": "i // ceil(n / 7)::BIGINT",
    "round_robin": "i % 7",
    "linspace": " + ".join(f"(i >= n * {j} // 7)::INT" for j in range(1, 7)),
    "rounded": " + ".join(f"(i >= round_even(n * {j} / 7::DOUBLE, 0)::BIGINT)::INT" for j in range(1, 7)),
}


def _shards(how: str):
    def run(spark, sf_dir):
        docs = rows.with_row_index(t(spark, sf_dir, "documents").select("doc_id"), "doc_id")
        n = F.broadcast(docs.agg(F.count("*").alias("n")))
        out = docs.join(n, how="cross").select("doc_id", rows.shard(F.col("idx"), F.col("n"), 7, how).cast("int").alias("shard"))
        return out.groupBy("shard").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))

    run.__name__, run.__doc__ = f"shards_{how}", "W2-W8, W18: index shards and their borders."
    return run


for _how, _expr in SHARDS.items():
    query(f"WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT ({_expr})::INT AS shard, count(*) AS docs, min(doc_id) AS first_id, max(doc_id) AS last_id FROM d GROUP BY shard")(_shards(_how))


@query("WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n, text FROM documents) SELECT CASE WHEN i < floor(n * 0.08::DOUBLE) THEN 'unconditional' WHEN i < floor(n * 0.8::DOUBLE) THEN 't2i' ELSE 'caption' END AS task, count(*) AS n, sum(length(text))::BIGINT AS chars FROM d GROUP BY task")
def positional_task_routing(spark, sf_dir):
    """W1."""
    docs = rows.with_row_index(t(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("len")), "doc_id")
    n = F.broadcast(docs.agg(F.count("*").alias("n")))
    return docs.join(n, how="cross").groupBy(mixture.tasks_by_position(F.col("idx"), F.col("n")).alias("task")).agg(F.count("*").alias("n"), F.sum("len").cast("long").alias("chars"))


@query(f"SELECT doc_id, CASE WHEN {lcg_sql('doc_id', 1)} % 1000000 < 500000 THEN 't2i' ELSE 'caption' END AS task, {lcg_sql('doc_id', 2)} % 1000000 > 900000 AS unconditional, {lcg_sql('doc_id', 3)} % 10 AS template FROM documents")
def hash_task_routing(spark, sf_dir):
    """Coins and templates by hash of the id."""
    k = lambda seed: rows.lcg("doc_id", seed)
    return t(spark, sf_dir, "documents").select("doc_id", F.when(k(1) % 1000000 < 500000, "t2i").otherwise("caption").alias("task"), (k(2) % 1000000 > 900000).alias("unconditional"), (k(3) % 10).alias("template"))


@query(f"SELECT len(string_split(p, ' ')) AS words, p AS prompt, count(*) AS n FROM (SELECT ({sequences.PROMPTS!r})[{lcg_sql('doc_id', 3)} % 10 + 1] AS p FROM documents) GROUP BY p".replace('"', "'"))
def template_choice(spark, sf_dir):
    """L10."""
    options = F.array(*[F.lit(p) for p in sequences.PROMPTS])
    p = F.element_at(options, (rows.lcg("doc_id", 3) % 10 + 1).cast("int"))
    return t(spark, sf_dir, "documents").select(p.alias("prompt")).groupBy("prompt").agg(F.count("*").alias("n")).select(F.size(F.split("prompt", " ")).cast("long").alias("words"), "prompt", "n")


@query("SELECT source, sum(CASE WHEN source = 'src1' THEN 2 WHEN source = 'src2' THEN 3 ELSE 1 END)::BIGINT AS ids, min(CASE WHEN lower(source || '/LAION') LIKE '%laion%' THEN 'laion' END) AS dataset FROM documents GROUP BY source")
def source_parse(spark, sf_dir):
    """JSON or plain sources, dictionary codes, names by path."""
    names = {"src1": "laion-aesthetics", "src2": "midjourney"}
    plain = F.coalesce(F.try_element_at(T.lookup(names), F.col("source")), F.lit("dclm"))
    packed = F.to_json(F.struct(plain.alias("images"), F.lit("x").alias("captions")))
    return t(spark, sf_dir, "documents").groupBy("source").agg(F.sum(records.dataset_id(packed)).cast("long").alias("ids"), F.min(T.path_dataset(F.concat("source", F.lit("/LAION")))).alias("dataset"))


def turns_of(spark, sf_dir) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    x = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    said = F.transform(F.filter("all", lambda v: v["role"] != "system"), lambda v: F.struct(F.when(v["role"] == "user", "human").otherwise("gpt").alias("from"), v["text"].alias("value")))
    system = F.get(F.filter("all", lambda v: v["role"] == "system"), F.lit(0))["text"]
    return x.select("conv_id", said.alias("turns"), system.alias("system"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS human, count(*) FILTER (role = 'assistant') AS gpt, string_agg(CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END, ',' ORDER BY turn) FILTER (role <> 'system') AS roles FROM conversations GROUP BY conv_id")
def role_map(spark, sf_dir):
    """Turns of a conversation with mapped roles."""
    x = turns_of(spark, sf_dir)
    count = lambda who: F.size(F.filter("turns", lambda v: v["from"] == who)).cast("long")
    roles = F.nullif(F.array_join(F.transform("turns", lambda v: v["from"]), ","), F.lit(""))
    return x.select("conv_id", count("human").alias("human"), count("gpt").alias("gpt"), roles.alias("roles"))


@query("SELECT doc_id, 1 AS turns, 'gpt' AS role, length(coalesce(text, '')) AS chars FROM documents")
def sft_wrap(spark, sf_dir):
    """P11."""
    x = t(spark, sf_dir, "documents").select("doc_id", records.text_to_turns(F.col("text")).alias("c"))
    return x.select("doc_id", F.size("c").alias("turns"), F.get("c", F.lit(0))["from"].alias("role"), F.length(F.get("c", F.lit(0))["value"]).cast("long").alias("chars"))


RENDERED = """
WITH s AS (SELECT conv_id, min(text) FILTER (role = 'system') AS sys FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system'),
b AS (SELECT conv_id, string_agg({turn}, '' ORDER BY i) AS body FROM (SELECT x.*, coalesce(s.sys, {system}) AS sys FROM x JOIN s USING (conv_id)) x GROUP BY conv_id)
SELECT conv_id, length(p) AS chars, md5(p) AS digest FROM (SELECT s.conv_id, {whole} AS p FROM s LEFT JOIN b USING (conv_id))
"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rendered(name: str, template: str, turn: str, whole: str):
    tpl = conversation.TEMPLATES[template]

    def run(spark, sf_dir):
        p = conversation.render(F.col("turns"), tpl, F.col("system"))
        return turns_of(spark, sf_dir).select("conv_id", p.alias("p")).select("conv_id", F.length("p").cast("long").alias("chars"), F.md5(F.col("p").cast("binary")).alias("digest"))

    run.__name__, run.__doc__ = name, "F16, F17: rendered conversations."
    query(RENDERED.format(turn=turn, whole=whole, system=q(tpl.system)))(run)


_rendered("chat_render_single", "v0", "CASE role WHEN 'user' THEN 'Human' ELSE 'Assistant' END || ':' || CASE WHEN text <> '' THEN ' ' || text || '###' ELSE '' END", f"coalesce(sys, {q(conversation.TEMPLATES['v0'].system)}) || '###' || coalesce(body, '')")
_rendered("chat_render_two_sep", "vicuna_v1", "CASE role WHEN 'user' THEN 'USER' ELSE 'ASSISTANT' END || ':' || CASE WHEN text <> '' THEN ' ' || text || CASE WHEN i % 2 = 0 THEN ' ' ELSE '</s>' END ELSE '' END", f"coalesce(sys, {q(conversation.TEMPLATES['vicuna_v1'].system)}) || ' ' || coalesce(body, '')")
_rendered("chat_render_chatml", "chatml_direct", "'<|im_start|>' || role || chr(10) || CASE WHEN text <> '' THEN text || '<|im_end|>' ELSE '' END", "coalesce(sys, '<|im_start|>system' || chr(10) || 'Answer the questions.') || '<|im_end|>' || coalesce(body, '')")
_rendered("chat_render_gemma", "gemma", "'<start_of_turn>' || CASE role WHEN 'user' THEN 'user' ELSE 'model' END || chr(10) || CASE WHEN text <> '' THEN text || '<end_of_turn>' || chr(10) || CASE WHEN i % 2 = 0 THEN '' ELSE '<eos>' END ELSE '' END", "coalesce(sys, '') || coalesce(body, '')")
_rendered("chat_render_plain", "plain", "CASE WHEN text <> '' THEN text || CASE WHEN i % 2 = 0 THEN chr(10) ELSE '' END ELSE '' END", "coalesce(sys, '') || coalesce(body, '')")
_rendered(
    "chat_render_llama2",
    "llava_llama_2",
    "CASE WHEN text = '' THEN '' WHEN i % 2 = 1 THEN ' ' || text || ' </s>' ELSE '<s>[INST] ' || CASE WHEN i = 0 AND sys <> '' THEN '<<SYS>>' || chr(10) || sys || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || text || ' [/INST]' END",
    "ltrim(coalesce(body, ''), '<s>')",
)


@query("WITH x AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system') SELECT conv_id, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS alternates, sum(length(text)) FILTER (role = 'assistant')::BIGINT AS assistant_chars, sum(length(text)) FILTER (role = 'user')::BIGINT AS masked_chars FROM x GROUP BY conv_id")
def assistant_mask_stats(spark, sf_dir):
    """Q11, Q13 by turns: what is predicted and what is masked."""
    x = turns_of(spark, sf_dir).where(F.size("turns") > 0)
    chars = lambda who: F.when(F.exists("turns", lambda v: v["from"] == who), F.aggregate(F.filter("turns", lambda v: v["from"] == who), F.lit(0).cast("long"), lambda a, v: a + F.length(v["value"])))
    return x.select("conv_id", conversation.alternating(F.col("turns")).alias("alternates"), chars("gpt").alias("assistant_chars"), chars("human").alias("masked_chars"))


# sequences: the codes of a document are 16 numbers from its id, its tokens white-space words
VOCAB, BOI, EOI, EOS, PAD, MOST = 32000, 32000, 32001, 32002, 32003, 512
WORDS_SQL = "list_filter(regexp_split_to_array(text, '[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+'), lambda w: w <> '')"


def tokens(spark, sf_dir) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", F.size(sequences.words(F.col("text"))).alias("n_words"))
    ids = F.transform(F.when(F.col("n_words") > 0, F.sequence(F.lit(1), F.col("n_words"))).otherwise(F.array().cast("array<int>")), lambda i: ((F.col("doc_id") * 31 + i * 7) % VOCAB).cast("int"))
    made = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((F.col("doc_id") * 13 + i * 5) % 1024).cast("int"))
    return docs.select("doc_id", "n_words", ids.alias("ids"), sequences.offset_codes(made, VOCAB + 10).alias("codes"))


TOKENS_SQL = f"WITH w AS (SELECT doc_id, len({WORDS_SQL}) AS n_words FROM documents), k AS (SELECT doc_id, n_words, list_transform(range(1, n_words + 1), lambda i: (doc_id * 31 + i * 7) % {VOCAB}) AS ids, list_transform(range(0, 16), lambda i: (doc_id * 13 + i * 5) % 1024 + {VOCAB + 10}) AS codes FROM w)"


@query(
    TOKENS_SQL
    + f""", b AS (SELECT doc_id, codes, list_slice(list_concat(ids, [{BOI}, {EOI}, {EOS}]), 1, {MOST}) AS base FROM k),
    s AS (SELECT doc_id, len(base) AS n, list_slice(list_concat(list_slice(base, 1, len(base) - 2), codes, list_slice(base, len(base) - 1, len(base))), 1, {MOST}) AS seq FROM b)
    SELECT doc_id, len(seq) AS length, list_sum(seq)::BIGINT AS id_sum, len(list_filter(list_transform(range(1, len(seq) + 1), lambda i: i > n - 2), lambda x: x)) AS predicted,
    (list_sum(list_transform(range(1, len(seq) + 1), lambda i: CASE WHEN i > n - 2 THEN seq[i] ELSE 0 END)))::BIGINT AS label_sum FROM s"""
)
def sequence_t2i(spark, sf_dir):
    """Q1-Q3, Q6, Q7: text-to-image sequences, truncated before the splice."""
    x = tokens(spark, sf_dir).withColumn("n", F.least(F.size("ids") + 3, F.lit(MOST)))
    x = x.withColumn("seq", sequences.t2i(F.col("ids"), F.col("codes"), BOI, EOI, EOS, MOST))
    x = x.withColumn("labels", sequences.labels(F.col("seq"), F.col("n") - 2))
    kept = F.filter("labels", lambda y: y != sequences.IGNORE)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return x.select("doc_id", F.size("seq").cast("long").alias("length"), add("seq").alias("id_sum"), F.size(kept).cast("long").alias("predicted"), add(kept).alias("label_sum"))


@query(
    TOKENS_SQL
    + f""", s AS (SELECT doc_id, list_slice(list_concat([{BOI}], codes, [{EOI}], ids, [{EOS}]), 1, {MOST}) AS seq FROM k)
    SELECT doc_id, len(seq) AS length, list_sum(seq)::BIGINT AS id_sum, greatest(len(seq) - 18, 0) AS caption_modality, least(len(seq), 18) AS ignored FROM s"""
)
def sequence_caption(spark, sf_dir):
    """Q4, Q6, Q7."""
    x = tokens(spark, sf_dir).withColumn("seq", sequences.caption(F.col("codes"), F.array(F.lit(EOI)), F.col("ids"), BOI, EOS, MOST))
    x = x.withColumn("labels", sequences.labels(F.col("seq"), F.lit(18)))
    x = x.withColumn("m", sequences.modality_ids(F.col("seq"), F.col("labels"), F.lit(18), F.lit(sequences.CAPTION)))
    count = lambda v: F.size(F.filter("m", lambda z: z == v)).cast("long")
    return x.select("doc_id", F.size("seq").cast("long").alias("length"), F.aggregate("seq", F.lit(0).cast("long"), lambda a, v: a + v).alias("id_sum"), count(sequences.CAPTION).alias("caption_modality"), count(sequences.IGNORE).alias("ignored"))


@query(
    TOKENS_SQL
    + f""", s AS (SELECT doc_id, doc_id // 16 AS batch, list_slice(list_concat(ids, [{EOS}]), 1, {MOST}) AS seq FROM k), v AS (SELECT *, max(len(seq)) OVER (PARTITION BY batch) AS width FROM s)
    SELECT doc_id, width, width - len(seq) AS padded, len(seq) + (width > len(seq))::INT AS attended FROM v"""
)
def pad_clip_batch(spark, sf_dir):
    """Q5, Q8: right padding to the batch's longest; the first padded place stays visible."""
    x = tokens(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), sequences.text_only(F.col("ids"), EOS, MOST).alias("seq"))
    x = x.withColumn("width", F.max(F.size("seq")).over(Window.partitionBy("batch"))).withColumn("ids", batching.padded(F.col("seq"), F.col("width"), PAD))
    mask = batching.pad_mask(F.col("ids"), PAD)
    return x.select("doc_id", F.col("width").cast("long").alias("width"), F.size(F.filter("ids", lambda v: v == PAD)).cast("long").alias("padded"), F.size(F.filter(mask, lambda v: v)).cast("long").alias("attended"))


@query(TOKENS_SQL + " SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_words + 128 ELSE -n_words END AS signed_length FROM k")
def signed_lengths(spark, sf_dir):
    """Q20."""
    return tokens(spark, sf_dir).select("doc_id", sequences.signed_length(F.array("n_words"), F.col("doc_id") % 3 == 0).cast("long").alias("signed_length"))


@query(f"WITH d AS (SELECT doc_id, length(text) AS len, row_number() OVER (ORDER BY {lcg_sql('doc_id', 7)}, doc_id) - 1 AS i FROM documents) SELECT doc_id, (i // 32)::INT AS mega, (row_number() OVER (PARTITION BY i // 32 ORDER BY len DESC, doc_id) - 1)::INT AS place FROM d")
def length_grouped_order(spark, sf_dir):
    """W11."""
    docs = t(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("len"))
    return batching.megabatches(docs, rows.lcg("doc_id", 7), "len", 32, "doc_id").select("doc_id", "mega", F.col("rank").cast("int").alias("place"))


@query()
def length_balanced_chunks(spark, sf_dir):
    """Greedy even chunks in each megabatch (held against a brute force in the tests)."""
    docs = t(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("len"))
    mega = batching.megabatches(docs, rows.lcg("doc_id", 7), "len", 32, "doc_id")
    return batching.even_chunks(mega, 4, "doc_id", "len").select("doc_id", "mega", "chunk")


@query("SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS label, coalesce(lead(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), -100) AS shifted FROM events")
def causal_shift(spark, sf_dir):
    """W14."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("pos"), F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3).alias("label"))
    return losses.causal_shift(e, "user_id", "pos", "label").select("user_id", "event_id", "label", "shifted")


@query("SELECT user_id % 6 AS modality_id, round(sum(value), 6) AS loss_sum, count(*) AS n, round(sum(value) / count(*), 6) AS loss_mean FROM events WHERE user_id % 6 BETWEEN 1 AND 5 GROUP BY modality_id")
def token_loss_by_modality(spark, sf_dir):
    """A4, A5."""
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 6).alias("modality_id"), F.col("value").alias("loss"))
    return losses.mean_loss(e, "modality_id").withColumns({"loss_sum": r6("loss_sum"), "loss_mean": r6("loss_mean")})


@query("SELECT round(sum(CASE WHEN user_id % 4 + 1 = 1 THEN value * 0.25 ELSE value END) / count(*), 6) AS weighted_loss FROM events")
def weighted_loss(spark, sf_dir):
    """A6."""
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 4 + 1).alias("dataset_id"), F.col("value").alias("loss"))
    return losses.weighted_loss(e, 0.25).select(r6("weighted_loss").alias("weighted_loss"))


BPB_SQL = "SELECT task, round(sum(nll), 6) AS nll, sum(n_bytes)::BIGINT AS n_bytes, sum(n_tokens)::BIGINT AS n_tokens, count(*) AS n, round(sum(nll) / sum(n_tokens) / ln(2), 6) AS bpt, round(exp(sum(nll) / sum(n_tokens)), 6) AS ppl, round(CASE WHEN sum(n_bytes) > 0 THEN sum(nll) / ln(2) / sum(n_bytes) END, 6) AS bpb FROM s GROUP BY task HAVING sum(n_tokens) > 0"
SAMPLES_SQL = f"WITH d AS (SELECT doc_id, lang, source, strlen(text) AS n_bytes, len({WORDS_SQL}) AS n_tokens FROM documents), e AS (SELECT doc_id, lang, source, n_bytes, n_tokens, n_tokens * (1 + doc_id % 7) / 3.0::DOUBLE AS nll FROM d)"


def loss_samples(spark, sf_dir) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.octet_length("text").alias("n_bytes"), F.size(sequences.words(F.col("text"))).alias("n_tokens"))
    return docs.withColumn("nll", F.col("n_tokens") * (1 + F.col("doc_id") % 7) / F.lit(3.0))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in names})


@query(SAMPLES_SQL + ", s AS (SELECT lang AS task, * EXCLUDE (lang) FROM e) " + BPB_SQL)
def bpb_table(spark, sf_dir):
    """Bits per byte and token and perplexity by task."""
    return rounded(losses.loss_table(loss_samples(spark, sf_dir).withColumnRenamed("lang", "task")), "nll", "bpt", "ppl", "bpb")


@query(SAMPLES_SQL + ", s AS (SELECT lang AS task, nll, n_bytes, n_tokens FROM e UNION ALL SELECT 'skill-' || source, nll, n_bytes, n_tokens FROM e WHERE doc_id % 2 = 0) " + BPB_SQL)
def bpb_with_skills(spark, sf_dir):
    """A sample counts for its task and for each of its skills."""
    skills = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("skill-"), "source")))
    return rounded(losses.loss_table(losses.with_skills(loss_samples(spark, sf_dir), F.col("lang"), skills)), "nll", "bpt", "ppl", "bpb")


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, '') AS answer, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def vqa_left_join(spark, sf_dir):
    """Predictions to questions with a default."""
    predictions = t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("answer"), F.lit(False).alias("missing"))
    out = t(spark, sf_dir, "documents").select("doc_id").join(predictions, "doc_id", "left")
    return out.select("doc_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("missing", F.lit(True)).alias("missing"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def vqa_missing_anti(spark, sf_dir):
    """J2, J12, J13, U4."""
    return scoring.missing_keys(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents), b AS (SELECT doc_id AS label_id, quality, row_number() OVER (ORDER BY doc_id) AS i FROM labels) SELECT doc_id, label_id, quality FROM a JOIN b USING (i)")
def positional_zip(spark, sf_dir):
    """J5."""
    return scoring.by_position(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "quality"), "doc_id", "label_id")


@query()
def answer_normalize_rows(spark, sf_dir):
    """F1-F4 over whole documents (held against the rule in Python in the tests)."""
    x = t(spark, sf_dir, "documents").select("doc_id", T.normalise_answer(F.col("text")).alias("a"))
    return x.select("doc_id", F.length("a").alias("chars"), F.md5(F.col("a").cast("binary")).alias("digest"))


def normalise_sql() -> str:
    ws = "[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"
    steps = ["x0 AS (SELECT item_id, regexp_replace(translate(regexp_replace(replace(replace(replace(lower(text), ',', ''), '?', ''), '''s', ' ''s'), '^%s+|%s+$', '', 'g'), chr(10) || chr(9), '  '), '^%s+|%s+$', '', 'g') AS x FROM benchmark)" % (ws, ws, ws, ws), "y0 AS (SELECT item_id, x, x AS y FROM x0)"]
    for i, p in enumerate(T.PUNCTUATION):
        steps.append(f"y{i + 1} AS (SELECT item_id, x, CASE WHEN contains(x, {q(p + ' ')}) OR contains(x, {q(' ' + p)}) THEN replace(y, {q(p)}, '') ELSE replace(y, {q(p)}, ' ') END AS y FROM y{i})")
    n = len(T.PUNCTUATION)
    steps.append(f"s AS (SELECT item_id, string_split(y, '.') AS v FROM y{n})")
    steps.append("f AS (SELECT item_id, v, list_transform(range(1, len(v)), lambda i: CASE WHEN regexp_matches(v[i + 1], '^[0-9]') THEN 0 ELSE 1 END) AS gone FROM s)")
    steps.append("g AS (SELECT item_id, array_to_string(list_transform(range(1, len(v) + 1), lambda i: v[i] || CASE WHEN i = len(v) OR (gone[i] = 1 AND list_sum(gone[1:i]) <= 32) THEN '' ELSE '.' END), '') AS y FROM f)")
    numbers = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in T.NUMBERS.items()) + "}"
    short = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in T.CONTRACTIONS.items()) + "}"
    steps.append(f"w AS (SELECT item_id, list_filter(list_transform(list_filter(regexp_split_to_array(lower(y), '{ws}+'), lambda a: a <> ''), lambda a: coalesce({numbers}[a], a)), lambda a: a NOT IN ('a', 'an', 'the')) AS l FROM g)")
    return "WITH " + ", ".join(steps) + f" SELECT item_id, array_to_string(list_transform(l, lambda a: coalesce({short}[a], a)), ' ') AS answer FROM w"


@query(normalise_sql())
def answer_normalize(spark, sf_dir):
    """The benchmark answer normaliser."""
    return t(spark, sf_dir, "benchmark").select("item_id", T.normalise_answer(F.col("text")).alias("answer"))
