"""What the operators measure, against direct computation: likeness, recall, temperature and rejection, the whole pipeline."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from skein.llm import ann, langid, winnow
from skein.llm.common import vocabulary

from .test_llm import ODD, frame, texts_of

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("slices", [None, 1, 5])
def test_likeness_of_edited_and_next(spark, slices):
    docs = frame(spark, [*ODD, *[f"text number {k} " * (k % 7 + 1) for k in range(30)]])
    texts = texts_of(docs)
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in winnow.compare_with_next(docs, slices=slices).collect()}

    def hashes(x):
        return {int(h) for h, _ in winnow.winnow(x)}

    def alike(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    for at, i in enumerate(ids):
        own, following = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        half = len(own) // 2
        new = own[: len(own) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(hashes(own), hashes(new))) and r.near_next == pytest.approx(alike(hashes(own), hashes(following)))
        assert r.fingerprint == winnow.as_text(winnow.winnow(own)) and r.edited_fingerprint == winnow.as_text(winnow.winnow(new))


def test_recall_at_production_blocks(spark):
    rng = np.random.default_rng(9)
    n, d = 10_000, 32
    x = rng.normal(size=(n, d))  # three blocks of rows, no structure to help
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits, by = 0, {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(by) == n // 50 and all([a for a, *_ in sorted(v)] == [1, 2, 3, 4, 5] for v in by.values())
    for q, found in by.items():
        s = u @ u[q]
        s[q] = -2
        best = set(np.lexsort((np.arange(n), -s))[:5].tolist())
        hits += len(best & {v for _, v, _ in found})
        for _, v, score in found:
            assert score == pytest.approx(float(u[v] @ u[q]), abs=1e-12)
    assert hits / (5 * len(by)) >= 0.9


def test_temperature_and_rejection(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        lang = "ab"[k % 2]
        own = rng.integers(0, 40, 12) + (0 if lang == "a" else 30)  # ten n-grams are of both
        ids, n = np.unique(own, return_counts=True)
        rows.append((lang, ids.astype(np.int64), (n / n.sum()).astype(np.float32)))
    model = langid.learn(rows)
    order = np.random.default_rng(7)
    order.normal(0, 0.1, (1 << langid.BITS, langid.WIDTH))
    order.normal(0, 0.1, (langid.WIDTH, 2))
    check = order.permutation(600)[:60]
    z = np.array([rows[k][2] @ model["logits"][rows[k][1]] + model["bias"] for k in check])
    truth = np.array([model["langs"].index(rows[k][0]) for k in check])
    loss = lambda t: -np.log(np.maximum(langid.softmax(z / t)[np.arange(60), truth], 1e-12)).mean()
    assert all(loss(model["temperature"]) <= loss(t) + 1e-9 for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0))
    q = langid.softmax(z / model["temperature"])
    kept = q.max(1) >= model["reject"] - 1e-7
    assert kept.any() and (q.argmax(1) == truth)[kept].mean() >= 0.99
    predict = langid.predictor({**model, "reject": 1.1})
    assert predict("abc")[2] and predict("") == ("und", 0.0, True) and predict(None) == ("und", 0.0, True) and predict("12 .")[0] == "und"
    assert langid.predict_documents(frame(spark, []), model).count() == 0


def test_the_pipeline_packs_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, D).cache()
    kept, t = texts_of(docs), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = p.run(spark, D)
    by = {r.doc_id: (r.n, r.tokens) for r in got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens")).collect()}
    assert set(by) == set(kept)
    for i, text in kept.items():
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        assert by[i] == (n, n)
    sizes = [r.n for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(s != 2048 for s in sizes) <= 11 and all(s == 2048 or s & (s - 1) == 0 for s in sizes)
