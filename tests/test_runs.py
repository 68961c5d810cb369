"""Search points, asserted joins, counters, tokenizers, batches and readers: edge cases that the catalogue's tables do not hold."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from skein import sources, streaming
from skein.operators import batching, codes, decoding, questions, records, rubrics, scoring, sequences, tokenizers
from skein.operators import evaluation as E
from skein.sources import tars


def test_next_points_follow_the_rule(spark):
    groups = spark.createDataFrame([("a", ""), ("b", ""), ("c", ""), ("d", ""), ("e", "")], "s string, n string")
    runs = [
        ("a", 2.0, 5.0, 0), ("a", 1.75, 4.0, 1), ("a", 1.5, 4.5, 2),  # lower and higher neighbour tried: ends
        ("b", 1.0, 3.0, 0),  # at the lower bound: goes up
        ("c", 2.0, float("nan"), 0), ("c", 1.75, None, 1),  # nothing scored: begins again
        ("d", 3.0, 1.0, 0), ("d", 2.75, 1.0, 1),  # equal scores: the first holds
    ]
    tried = spark.createDataFrame([(*r, "") for r in runs], "s string, cfg double, fid double, o int, n string")
    got = {r.s: (r.next, r.best, r.ended) for r in E.next_points(groups, tried, ["s", "n"], "cfg", "fid", "o", 1.5, high=3.0).collect()}
    assert got == {"a": (None, 4.0, True), "b": (1.25, 3.0, False), "c": (1.5, None, False), "d": (None, 1.0, True), "e": (1.5, None, False)}
    up = {r.s: r.next for r in E.next_points(groups, tried, ["s", "n"], "cfg", "fid", "o", 1.5, low=None, increase_first=True).collect()}
    assert up["b"] == 1.25 and up["d"] == 3.25


def test_grid_is_bounded(spark):
    a, b = spark.createDataFrame([(0.1,), (0.5,), (0.5,), (None,)], "s double"), spark.createDataFrame([(0.5,), (1.0,)], "e double")
    assert sorted(tuple(r) for r in E.grid(a, b, "s", "e").collect()) == [(0.1, 0.5, "s=0.10;e=0.50"), (0.1, 1.0, "s=0.10;e=1.00"), (0.5, 1.0, "s=0.50;e=1.00")]
    with pytest.raises(ValueError):
        E.grid(a, b, "s", "e", most=1)


def test_updates_do_not_multiply_rows(spark):
    table, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert sorted(tuple(r) for r in E.updated(table, new, "k", "v", "o").collect()) == [(1, "y"), (2, "b")]


def test_required_partners(spark):
    a, b = spark.createDataFrame([(1, "Q"), (2, "R")], "i int, q string"), spark.createDataFrame([(1, "Q", 5), (1, "Q", 6)], "i int, q string, v int")
    assert scoring.required(a.where("i = 1"), b, ["i", "q"]).count() == 2
    with pytest.raises(Exception, match="no partner"):
        scoring.required(a, b, ["i", "q"]).count()


def test_counters(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, None, None, 1), (0, 1, 0, 1), (None, None, None, 1)], "o int, j int, r int, a int")
    assert tuple(scoring.requery_counters(df, "o", "j", "r", "a").first()) == (4, 2, 2, 3, 2, 2, 3)
    got = scoring.subset_accuracy(df, F.col("o") == F.col("a"), F.lit(False)).first()
    assert (got.total, got.correct, got.inside, got.inside_accuracy) == (4, 2, 0, None)


def test_batches_of_groups(spark):
    df = spark.createDataFrame([("a", k) for k in range(7)] + [(None, 1), ("b", 0), ("b", 1)], "g string, k int")
    got = {(r.g, r.k): (r.batch, r.partial) for r in E.batches_of_groups(df, "g", "k", 3).collect()}
    assert got[("a", 5)] == (1, False) and got[("a", 6)] == (2, True) and got[(None, 1)] == (0, True) and got[("b", 1)] == (0, True) and len(got) == 10


def test_window_of_one(spark, tmp_path):
    for k, v in enumerate((5.0, 1.0, 3.0)):
        spark.createDataFrame([("a", k, v)], "g string, o int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.file_stream(spark, str(tmp_path / "in"), "g string, o int, v double")
    out = streaming.sliding_metrics(stream, "g", "o", "v", window=1)
    q = out.writeStream.format("memory").queryName("window_of_one").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.n, r.avg, r.max) for r in spark.table("window_of_one").collect())
    assert [g[0] for g in got] == [1, 2, 3] and all(a == m for _, a, m in got)


def test_cross_entropy_keeps_sequences(spark):
    df = spark.createDataFrame([(1, 0, 1000.0, 0), (1, 1, 1000.0, 0), (2, 0, 1.0, 9)], "s int, t int, x double, y int")
    got = {r.s: r.loss for r in decoding.cross_entropy(df, "s", "x", "t", "y").collect()}
    assert got[1] == pytest.approx(0.6931471805599453) and got[2] is None


def test_codes_and_units(spark):
    x = spark.range(1).select(codes.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), codes.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), sequences.byte_ids(F.lit("é!")).alias("b"), sequences.byte_ids(F.lit("")).alias("e")).first()
    assert x.u == pytest.approx([0.6, 0.8]) and x.z == [0.0, 0.0] and x.b == [0xC3, 0xA9, 33] and x.e == []
    s = spark.range(1).select(codes.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p")).first().p
    assert s == [0.5, 0.5]


def test_gates_look_at_later_parents(spark):
    q = [(1, 1.0, [3]), (2, 1.0, [1]), (3, 0.0, [0]), (4, 1.0, [9]), (5, 1.0, [2, 0])]
    df = spark.createDataFrame([(q,)], "q array<struct<qid:int,yes:double,parents:array<int>>>")
    assert [(s.qid, s.score) for s in df.select(rubrics.gate_scores("q").alias("s")).first().s] == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 1.0), (5, 0.0)]
    assert spark.createDataFrame([([],)], df.schema).select(rubrics.gate_scores("q").alias("s")).first().s == []


def test_parents_by_join(spark):
    q = spark.createDataFrame([("a", 1, [0]), ("a", 2, [1, 9]), (None, 1, [2]), ("b", 1, None)], "item string, qid int, parents array<int>")
    s = spark.createDataFrame([("a", 1, 0.0), (None, 2, 1.0), ("a", 0, 0.0)], "item string, qid int, score double")
    got = {(r.item, r.qid): (r.parents, r.blocked) for r in questions.parent_scores(q, s).collect()}
    assert got == {("a", 1): (0, False), ("a", 2): (1, True), (None, 1): (1, False), ("b", 1): (0, False)}


def test_tokenizers_in_tasks(spark):
    df = spark.createDataFrame([(1, b"x", "clash"), (2, None, "c"), (3, b"", "c")], "k int, image binary, codes string")
    got = {r.k: r.codes for r in tokenizers.with_codes(df, "image", tokenizers.DigestCodes).collect()}
    assert got == {1: tokenizers.DigestCodes().encode([b"x"])[0], 2: None, 3: None}
    texts = spark.createDataFrame([("a b",)], "t string")
    assert len(tokenizers.with_text_ids(texts, "t", "whitespace").first().ids) == 2 and tokenizers.with_text_ids(texts, "t", "utf8_bytes").first().ids == [97, 32, 98]
    with pytest.raises(ValueError):
        tokenizers.with_text_ids(texts, "t", "other")
    white = spark.range(1).select(F.array(F.struct(F.lit(10).alias("r"), F.lit(0).alias("g"), F.lit(255).alias("b"), F.lit(0).alias("a")), F.struct(F.lit(10).alias("r"), F.lit(0).alias("g"), F.lit(255).alias("b"), F.lit(255).alias("a"))).alias("p")).select(tokenizers.whitened("p")).first().rgb
    assert [tuple(p) for p in white] == [(255, 255, 255), (10, 0, 255)]


def test_collated(spark):
    df = spark.createDataFrame([(1, 2, [7], [7]), (1, 1, [5, 6], [-100, 6]), (2, 3, [], [])], "b int, o int, i array<int>, y array<int>")
    got = {r.b: r for r in batching.collated(df, "b", "o", "i", "y", 0).collect()}
    assert got[1].input_ids == [[5, 6], [7, 0]] and got[1].labels == [[-100, 6], [7, -100]] and got[1].attention_mask == [[True, True], [True, False]]
    assert got[2].input_ids == [[]]


def test_incomplete_rows_go(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "k int, v string")
    assert [r.k for r in records.complete(df, "k", "v").collect()] == [1] and records.complete(df, "v").count() == 2


def test_damaged_tars_say_so(spark, tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name in ("a.txt", "a.JPG", "b.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "x.tar").write_bytes(out.getvalue()[:-8000])
    (tmp_path / "y.tar").write_bytes(b"?" * 600)
    rows = sources.tar_members(spark, str(tmp_path))
    assert rows.where("error is not null").count() >= 1
    kept = tars.captioned(sources.tar_samples(spark, str(tmp_path))).collect()
    assert [(r.key, sorted(r.members)) for r in kept] == [("a", ["jpg", "txt"])]
    got = tars.unified(sources.tar_samples(spark, str(tmp_path))).where("key = 'a'").first()
    assert (got.text, got.source, got.url) == ("abc", "no", "no")
