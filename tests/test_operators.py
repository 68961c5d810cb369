"""Operators on small literals."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import sources, streaming
from skein.functions import text as T
from skein.operators import batching, codes, conversation, decoding, losses, manifold, mixture, records, rows, rubrics, scoring, sequences
from skein.sources import sinks


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("n,k", [(0, 3), (1, 3), (7, 3), (9, 3), (10, 4)])
@pytest.mark.parametrize("how", ["contiguous", "array_split", "ceil", "round_robin", "linspace", "rounded"])
def test_shards_cover(spark, n, k, how):
    got = [r[0] for r in spark.range(n).select(rows.shard(F.col("id"), n, k, how)).collect()]
    assert len(got) == n and all(0 <= s < k for s in got)
    if how == "array_split":
        assert got == [i for i, part in enumerate(np.array_split(range(n), k)) for _ in part]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_row_index_is_gapless_whatever_the_partitions(spark, parts):
    got = rows.with_row_index(spark.range(50).repartition(parts), F.desc("id")).collect()
    assert {r.id: r.idx for r in got} == {i: 49 - i for i in range(50)}


def test_mixture_truncates_binary_products(spark):
    df = spark.range(100).select(F.lit("a").alias("d"), "id")
    assert mixture.prefix_mixture(df, "d", "id", [(0, "a", 0.29), (1, "a", 1.0)]).groupBy("mix_pos").count().orderBy("mix_pos").collect() == [(0, 28), (1, 100)]
    assert mixture.accumulation_steps(512, 4, 8, 4) == 4
    with pytest.raises(ValueError):
        mixture.accumulation_steps(500, 4, 8, 4)
    assert mixture.parse_spec("a^^b", "0.5^^1") == [(0, "a", 0.5), (1, "b", 1.0)]


def python_normalise(item):
    import re

    item = item.lower().replace(",", "").replace("?", "").replace("'s", " 's").strip().replace("\n", " ").replace("\t", " ").strip()
    out = item
    for p in T.PUNCTUATION:
        out = out.replace(p, "") if p + " " in item or " " + p in item or re.search(r"(?<=\d),+(?=\d)", item) else out.replace(p, " ")
    out = re.sub(r"\.(?!\d)", "", out, count=32)
    words = [T.NUMBERS.get(w, w) for w in out.lower().split()]
    return " ".join(T.CONTRACTIONS.get(w, w) for w in words if w not in T.ARTICLES)


@pytest.mark.parametrize("text", ["The two cats, aren't they?", "  one-two three/four ", "U.S.A. 3.5 dogs.", "dont stop! it's <b>none</b>", ". " * 40 + "end.", "", "a an the"])
def test_answer_normaliser(spark, text):
    assert one(spark, T.normalise_answer(F.col("t")), t=text) == python_normalise(text)


def test_text_functions(spark):
    assert one(spark, T.py_strip(F.col("t")), t=" \t a b \n　") == "a b"
    assert one(spark, T.yes_no(F.col("t")), t="Yes, not really. no") == "no"
    assert one(spark, T.yes_no(F.col("t")), t="Yes. no") == "yes"
    assert one(spark, T.single_answer(F.col("t")), t="So the Answer: Red. ") == "red"
    assert one(spark, T.single_answer(F.col("t")), t="the answer is: red") == ":"  # as in the original, the shorter marker cuts first
    assert one(spark, T.single_answer(F.col("t")), t="") == ""
    assert one(spark, T.choice_letter(F.col("t")), t="B. because") == "B"
    assert one(spark, T.choice_letter(F.col("t")), t="The answer is A. The answer is B.") == "FAILED"
    assert one(spark, T.letter_index(F.col("t"), 3), t="D") == -1
    assert one(spark, T.judge_scores(F.col("t")), t="**Consistency**: 1\nRealism 2\nconsistency: 0\nAesthetic Quality: 1") == {"consistency": 0.0, "realism": 2.0, "aesthetic_quality": 1.0}
    assert one(spark, T.pair_score(F.col("t")), t="8 9\nmore") == [8.0, 9.0]
    assert one(spark, T.pair_score(F.col("t")), t="8") == [-1.0, -1.0]
    assert one(spark, T.prompt_question(F.col("t")), t="OCR tokens: x Question: What\nis? Short answer:") == "what\nis?"
    assert one(spark, T.int_ranges(F.col("t")), t="5-8, 2") == [2, 5, 6, 7]
    assert one(spark, T.options_before_none(F.array(F.lit("a"), F.lit("nan"), F.lit("c")))) == ["a"]
    assert one(spark, T.image_token_code(T.code_image_token(F.lit(123)))) == 123
    assert T.brace_list(["t-000.tar", "t-001.tar"]) == "t-{000..001}.tar" and T.brace_list(["a", "b"]) == "{a,b}"


def test_soft_accuracy_is_the_leave_one_out_mean(spark):
    answers = ["a"] * 3 + ["b"] * 5 + ["c", "d"]
    want = {}
    for a in "abcd":
        scores = [min(1, sum(x == a for j, x in enumerate(answers) if j != i) / 3) for i in range(10)]
        want[a] = sum(scores) / 10
    df = spark.createDataFrame([(1, a) for a in answers], "question_id int, answer string")
    got = {p: scoring.soft_accuracy(df, spark.createDataFrame([(1, p)], "question_id int, predicted string")).first().score for p in "abcdz"}
    assert got == pytest.approx(want | {"z": 0.0})


def test_gating_cascades_in_order(spark):
    questions = [(1, 0.0, [0]), (2, 1.0, [1]), (3, 1.0, [2]), (4, 1.0, [5]), (5, 1.0, [1])]
    df = spark.createDataFrame([(questions,)], "q array<struct<qid:int,yes:double,parents:array<int>>>")
    assert [s.score for s in df.select(rubrics.gate_scores("q")).first()[0]] == [0, 0, 0, 1, 0]


def test_sequences(spark):
    ids, codes_ = F.array(*[F.lit(i) for i in (1, 2, 3)]), F.array(F.lit(90), F.lit(91))
    assert one(spark, sequences.t2i(ids, codes_, 7, 8, 9, 100)) == [1, 2, 3, 7, 90, 91, 8, 9]
    assert one(spark, sequences.caption(codes_, F.array(F.lit(8)), ids, 7, 9, 100)) == [7, 90, 91, 8, 1, 2, 3, 9]
    assert one(spark, sequences.insert_after_first(F.array(*[F.lit(i) for i in (5, 7, 8)]), codes_, 7)) == [5, 7, 90, 91, 8]
    x = F.array(*[F.lit(i) for i in (1, 50, 51, 4, 5, 99, 2, 50, 51, 6)])
    assert one(spark, sequences.assistant_labels(x, [50, 51], 99)) == [-100, -100, -100, 4, 5, 99, -100, -100, -100, 6]
    assert one(spark, sequences.with_placeholders(F.array(F.array(F.lit(1)), F.array(F.lit(2))))) == [1, -200, 2]
    assert one(spark, batching.pad_mask(batching.padded(ids, F.lit(5), 0), 0)) == [True, True, True, True, False]
    assert one(spark, sequences.byte_ids(F.lit("aé"))) == [97, 195, 169]
    assert one(spark, sequences.split_codebooks(F.array(*[F.lit(i) for i in range(6)]), 2)) == [[0, 1, 2], [3, 4, 5]]


def test_conversations(spark):
    turns = F.array(F.struct(F.lit("human").alias("from"), F.lit("hi <image>").alias("value")), F.struct(F.lit("gpt").alias("from"), F.lit("yo").alias("value")))
    assert one(spark, conversation.render(turns, conversation.TEMPLATES["gemma"])) == "<start_of_turn>user\nhi <image><end_of_turn>\n<start_of_turn>model\nyo<end_of_turn>\n<eos>"
    assert one(spark, conversation.place_image(turns))[0].value == "<boi><eoi>\nhi"
    assert one(spark, conversation.alternating(turns)) is True
    pairs = spark.createDataFrame([([("q", "a")],), (None,)], "p array<struct<user:string,assistant:string>>")
    assert [r.x and [tuple(t) for t in r.x] for r in pairs.select(records.turns_from_pairs("p").alias("x")).collect()] == [[("human", "q"), ("gpt", "a")], None]


def test_decoding(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([3.0, 2.0, 2.0, 0.0])], "seq int, token int, logit double")
    assert {r.token for r in decoding.top_k(df, "seq", "logit", 2).collect()} == {0, 1, 2}
    p = np.exp([3, 2, 2, 0]) / np.exp([3, 2, 2, 0]).sum()
    assert [r.p for r in decoding.with_probability(df, "seq", "logit").orderBy("token").collect()] == pytest.approx(list(p))
    assert {r.token for r in decoding.top_p(df, "seq", "logit", "token", 0.6).collect()} == {0, 1}
    assert one(spark, decoding.stop_at(F.array(*[F.lit(i) for i in (1, 9, 2, 9)]), 9, 10, 2)) == [1, 9, 2, 9]


def test_even_chunks_follow_the_greedy_rule(spark):
    df = spark.createDataFrame([(0, r, r, 100 - r * r) for r in range(8)], "mega int, rank int, id long, len long")
    load, held, want = [0.0] * 2, [0] * 2, {}
    for r in range(8):
        c = load.index(min(load))
        want[r] = c
        held[c] += 1
        load[c] = float("inf") if held[c] == 4 else load[c] + 100 - r * r
    assert {r.id: r.chunk for r in batching.even_chunks(df, 2, "id", "len").collect()} == want


def test_manifold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    n, mean, cov = manifold.moments(df, "v")
    assert n == 60 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    assert manifold.frechet((mean, cov), (mean, cov)) == pytest.approx(0, abs=1e-8)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert [r.radius for r in manifold.radii(df).orderBy("id").collect()] == pytest.approx(np.sort(d, 1)[:, 3].tolist())
    assert manifold.polynomial_mmd(df.where("id < 30"), df.where("id >= 30")) == pytest.approx(mmd(x[:30], x[30:]))


def mmd(a, b):
    k = lambda p, q: (p @ q.T / p.shape[1] + 1) ** 3
    n, m = len(a), len(b)
    return (k(a, a).sum() - np.trace(k(a, a))) / (n * (n - 1)) + (k(b, b).sum() - np.trace(k(b, b))) / (m * (m - 1)) - 2 * k(a, b).mean()


def test_retention_scenario(spark):
    steps = [20_000, 40_000, 60_000, 80_000, 100_000, 120_000, 140_000, 160_000, 180_000, 200_000, 210_000, 220_000]
    got = scoring.retention(spark.createDataFrame([(s,) for s in steps], "step long"), "step", 100_000, 100_000, 2).collect()
    assert {r.step for r in got if r.keep} == {100_000, 200_000, 210_000, 220_000}


def test_loss_table_guards(spark):
    df = spark.createDataFrame([("a", 2.0, 0, 0), ("b", 3.0, 4, 0)], "task string, nll double, n_tokens long, n_bytes long")
    rows_ = losses.loss_table(df).collect()
    assert [r.task for r in rows_] == ["b"] and rows_[0].bpb is None


def test_codes(spark):
    v = F.array(*[F.lit(float(x)) for x in (1, -1, 1)])
    assert one(spark, codes.sign_code(v)) == 5
    assert one(spark, codes.code_signs(F.lit(5).cast("long"), 3)) == [1.0, -1.0, 1.0]


def test_tar_and_json_round_trip(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in (("x.txt", b"1"), ("x.json", b"{}"), ("x.txt", b"2"), ("y.TXT", b"3")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = sources.tar_samples(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.key, {k: bytes(v) for k, v in r.members.items()}) for r in got] == [("x", {"txt": b"1", "json": b"{}"}), ("x", {"txt": b"2"}), ("y", {"txt": b"3"})]
    df = spark.range(5).select("id", F.concat(F.lit("t"), "id").alias("text"))
    saved = sinks.save_blobs(sinks.tar_blobs(df, "id", 2), f"file://{tmp_path}/out").collect()
    assert sorted((r.tar_id, r.n) for r in saved) == [(0, 2), (1, 2), (2, 1)]
    sinks.jsonl(df, str(tmp_path / "j"))
    assert sources.jsonl(spark, str(tmp_path / "j"), "id long, text string").count() == 5
    assert [r.line_no for r in sources.lines(spark, str(tmp_path / "j")).where("line_no = 1").collect()]
    np.savez(tmp_path / "z.npz", arr_0=np.arange(6.0).reshape(3, 2))
    assert [r.vec for r in sources.numpy_array(spark, str(tmp_path / "z.npz")).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_streams_agree_with_batches(spark, tmp_path):
    data = [(i % 2, i, float(i * i % 17)) for i in range(300)]
    spark.createDataFrame(data, "k int, i long, v double").orderBy("i").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streaming.file_stream(spark, str(tmp_path / "in"), "k int, i long, v double")
    q = streaming.ema(s, "k", "i", "v").writeStream.format("memory").queryName("ema").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    for k in (0, 1):
        m, n = 0.0, 0
        for kk, _, v in data:
            if kk == k:
                decay = 0 if n == 0 else 0.9 if n < 100 else 0.99
                m, n = decay * m + (1 - decay) * v, n + 1
        assert spark.sql(f"select ema from ema where k = {k} and n = {n}").first()[0] == pytest.approx(m)
