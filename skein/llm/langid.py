"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; runs of letters are its words, with a border before and after each. Every 3- and 4-gram inside a
word and its borders is hashed into a table of embeddings; a text is their average. Embeddings and softmax are trained
together by stochastic gradient descent in numpy. A temperature is fitted on a tenth of the sample, and a rejection
threshold so that accepted predictions there are right at least ``precision`` of the time; the threshold only sets the
``rejected`` flag.

Training takes about ``per_language`` texts of each language (lowest hashes of ids). Prediction reads whole texts. A null
text or one without letters is `und` with score 0. Without any training text every row is `und`. Repeated rows get equal
results; other columns are never inputs.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows

BITS, WIDTH = 16, 16


@functools.cache
def letters() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    out[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)  # ideographs
    return out


def grams(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, with repetitions."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    low = letters()[codes]
    low = np.concatenate((np.zeros(1, np.uint32), low, np.zeros(1, np.uint32)))
    low = low[np.concatenate(([True], (low[1:] != 0) | (low[:-1] != 0)))]  # one border between words
    if len(low) < 3:
        return np.empty(0, np.int64)
    h = low * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    tri = (h[:-2] * np.uint32(0x85EBCA77) + h[1:-1]) * np.uint32(0xC2B2AE3D) + h[2:]
    out = [tri[low[1:-1] != 0]]
    if len(low) > 3:
        four = tri[:-1] * np.uint32(0x27D4EB2F) + h[3:] + np.uint32(7)
        out.append(four[(low[1:-2] != 0) & (low[2:-1] != 0)])
    g = np.concatenate(out)
    g ^= g >> np.uint32(16)
    g = g * np.uint32(0x7FEB352D)
    return (g >> np.uint32(32 - BITS)).astype(np.int64)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def learn(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.5, precision: float = 0.99, seed: int = 7) -> dict:
    """From (language, distinct n-grams, shares): table of logits by n-gram, bias, temperature, rejection threshold."""
    rng = np.random.default_rng(seed)
    langs = sorted({r[0] for r in rows})
    place = {x: i for i, x in enumerate(langs)}
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    order = rng.permutation(len(rows))
    tenth = len(rows) // 10
    check, train = order[:tenth], order[tenth:]
    weight = len(rows) / np.maximum(1, np.bincount([place[r[0]] for r in rows], minlength=max(1, len(langs)))) / max(1, len(langs))
    total, done = epochs * max(1, len(train)), 0
    for _ in range(epochs):
        for k in rng.permutation(train):
            lang, ids, share = rows[k]
            lr = rate * (1 - done / total)
            done += 1
            hidden = share @ table[ids]
            g = softmax(hidden @ out + bias)
            g[place[lang]] -= 1
            g *= min(float(weight[place[lang]]), 4.0)
            back = out @ g
            out -= lr * np.outer(hidden, g)
            bias -= lr * g
            table[ids] -= lr * (len(ids) ** 0.5) * share[:, None] * back
    logits = table @ out
    model = {"langs": langs, "logits": logits.astype(np.float32), "bias": bias, "temperature": 1.0, "reject": 0.0}
    z = np.array([rows[k][2] @ logits[rows[k][1]] + bias for k in check])
    if len(z):
        truth = np.array([place[rows[k][0]] for k in check])
        losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        model["temperature"] = min(losses, key=losses.get)
        p = softmax(z / model["temperature"])
        best, right = p.max(1), p.argmax(1) == truth
        by = np.argsort(-best, kind="stable")
        good = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= precision
        model["reject"] = float(best[by][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def fit(docs: DataFrame, per_language: int = 800, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Learn from rows that are not held out and have a text and a language."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return learn([])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def start():
        def each(doc_id, lang, text):
            ids, n = np.unique(grams(text), return_counts=True)
            if len(ids):
                yield doc_id, lang, ids.astype("<u2").tobytes(), (n / n.sum()).astype("<f4").tobytes()

        return each

    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("share", pa.binary())])
    got = map_rows(picked.select("doc_id", "lang", "text"), start, schema, "doc_id long, lang string, ids binary, share binary", 64).collect()
    return learn([(r[1], np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<f4")) for r in sorted(got, key=lambda r: (r[0], r[1], r[2]))])


def predictor(model: dict):
    """A function of one text: language, score, rejected."""
    langs, logits, bias, t = model["langs"], model["logits"], model["bias"], model["temperature"]

    def predict(text: str | None) -> tuple[str, float, bool]:
        g = grams(text)
        if not len(g) or not langs:
            return "und", 0.0, True
        used = np.bincount(g, minlength=1 << BITS) if len(g) > 1 << BITS else None
        z = used @ logits / len(g) if used is not None else logits[g].sum(0, dtype=np.float64) / len(g)
        p = softmax((z + bias) / t)
        best = int(p.argmax())
        return langs[best], float(p[best]), bool(p[best] < model["reject"])

    return predict


SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predict_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""

    def start():
        predict = predictor(model)

        def each(doc_id, text):
            yield doc_id, *predict(text)

        return each

    out = map_rows(id_text(docs, id_col, text_col), start, SCHEMA, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
