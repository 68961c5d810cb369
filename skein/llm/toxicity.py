"""Toxicity by non-negative positive-unlabelled learning.

A document is the set of its words and of the 4- to 6-letter heads of its words, hashed. Confirmed toxic documents are
the positives; documents taken without regard to their label are the unlabelled ones. Each feature is scaled by its shrunk
log-ratio of document frequencies (positives to unlabelled). A linear classifier then minimises the class-prior-corrected
risk ``prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))`` with the logistic loss (numpy, Adam); where the second
part falls below zero its gradient is turned round, as the method prescribes.

Training takes at most ``max_positive`` and ``max_unlabelled`` documents (lowest hashes of their ids, one of each distinct
text, ties by id); the prior is the share of toxic ones among labelled rows open to training, kept between 0.001 and 0.5.
Features are counted on the executors; the driver gets the counts (a fixed number of them) and then, of each sampled document,
the features that say something. Scoring reads every whole text. Null and empty texts get the score of no features. Without
any positive the score is 0 for all. Repeated rows get equal scores; an empty table gives no rows; other columns are never
inputs.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, id_text, map_column, map_rows, remove, shared_folder, tidy

WORD = re.compile(r"\w+")
BITS = 18
HEADS = (4, 5, 6)


def word_features(word: str) -> tuple[int, ...]:
    b = word.encode()
    return (zlib.crc32(b) & ((1 << BITS) - 1), *(zlib.crc32(b"^" + word[:n].encode()) & ((1 << BITS) - 1) for n in HEADS if len(word) >= n))


def features(text: str | None, memo) -> set[int]:
    return set().union(*[memo[w] for w in set(WORD.findall((text or "").lower()))])


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def scales(c_pos: np.ndarray, c_unl: np.ndarray, n_pos: int, n_unl: int) -> np.ndarray:
    """Shrunk log-ratio of each feature's document frequencies; 0 where it is rare or says little."""
    ratio = np.log((c_pos + 0.5) / (n_pos + 1)) - np.log((c_unl + 0.5) / (n_unl + 1))
    seen = c_pos + c_unl * n_pos / n_unl
    scale = ratio * seen / (seen + 5)
    scale[(np.abs(scale) < 0.4) | (c_pos + c_unl < 3)] = 0
    return scale


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 200, rate: float = 0.05, l2: float = 1e-4, scale: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weight of every hashed feature, and the bias. With ``scale`` (from ``scales``) documents need no features of scale 0."""
    size = 1 << BITS
    if not positive or not unlabelled:
        return np.zeros(size, np.float32), -40.0
    n_pos, n_unl = len(positive), len(unlabelled)
    if scale is None:
        counts = (np.bincount(np.concatenate(d), minlength=size).astype(float) for d in (positive, unlabelled))
        scale = scales(*counts, n_pos, n_unl)
    keep = np.flatnonzero(scale)
    place = np.full(size, -1, np.int32)
    place[keep] = np.arange(len(keep))

    def rows(docs):
        cols = [p[p >= 0] for p in (place[d] for d in docs)]
        return np.repeat(np.arange(len(docs), dtype=np.int32), [len(c) for c in cols]), np.concatenate(cols) if cols else np.empty(0, np.int32), len(docs)

    sets = rows(positive), rows(unlabelled)
    values, weights, bias = scale[keep], np.full(len(keep), 0.1), np.log(prior / (1 - prior))
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for t in range(1, steps + 1):
        use = weights * values
        z_pos, z_unl = (np.bincount(r, weights=use[c], minlength=n) + bias for r, c, n in sets)
        g_pos, g_unl = gradients(z_pos, z_unl, prior)
        grads = [np.bincount(c, weights=g[r], minlength=len(keep)) for (r, c, _), g in zip(sets, (g_pos, g_unl), strict=True)]
        g = np.append((grads[0] + grads[1]) * values + l2 * weights, g_pos.sum() + g_unl.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    out = np.zeros(size, np.float32)
    out[keep] = weights * values
    return out, float(bias)


def gradients(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the corrected risk by each document's score. Where the part that cannot be negative is so all the same, the step
    goes up that part alone."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    n_pos, n_unl = len(z_pos), len(z_unl)
    negative = np.logaddexp(0, z_unl).mean() - prior * np.logaddexp(0, z_pos).mean()
    d_pos, d_unl = -prior * sigmoid(z_pos) / n_pos, sigmoid(z_unl) / n_unl  # of the part that must not be negative
    if negative < 0:
        return -d_pos, -d_unl
    return -prior * sigmoid(-z_pos) / n_pos + d_pos, d_unl


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12000, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Learn from rows that are not held out. ``labels`` has doc_id and toxic (0/1; null: no label)."""
    open_docs = id_text(docs, id_col, text_col).where(~held_out() & F.col("text").isNotNull())
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = open_docs.select("doc_id", F.xxhash64("text").alias("h")).join(marks, "doc_id", "left").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    n, n_pos = marks.agg(F.count("toxic"), F.sum("toxic")).first()
    prior = min(max((n_pos or 0) / max(n, 1), 1e-3), 0.5)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    pos = [r[0] for r in texts.where("toxic = 1").orderBy(*order).limit(max_positive).select("doc_id").collect()]
    unl = [r[0] for r in texts.orderBy(*order).limit(max_unlabelled).select("doc_id").collect()]
    picked = docs.sparkSession.createDataFrame([(i, (i in p) * 1 + (i in u) * 2) for p, u in [(set(pos), set(unl))] for i in p | u] or [(None, 0)], "doc_id long, role int")

    def start():
        memo = Memo(word_features, 200_000)

        def each(role, text):
            yield role, np.fromiter(features(text, memo), "<u4").tobytes()

        return each

    # The sample's features stay with the executors: the driver sees counts, and then what those leave of each document.
    picked_docs = open_docs.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).select("role", "text")
    made = map_rows(picked_docs, start, pa.schema([("role", pa.int32()), ("features", pa.binary())]), "role int, features binary", 128)
    made.write.parquet(path := shared_folder(docs.sparkSession, "sample"))
    sample = docs.sparkSession.read.parquet(path)

    class Count:
        def __init__(self):
            self.totals = np.zeros((2, 1 << BITS), np.int32)
            self.n = [0, 0]

        def __call__(self, role, features):
            f = np.frombuffer(features, "<u4")
            for k in (0, 1):
                if role >> k & 1:
                    self.totals[k][f] += 1  # the features of a document differ
                    self.n[k] += 1
            return ()

        def finish(self):
            for k in (0, 1):
                yield k, self.n[k], zlib.compress(self.totals[k].tobytes(), 1)

    counts, n_docs = np.zeros((2, 1 << BITS)), [0, 0]
    for k, m, data in map_rows(sample, Count, pa.schema([("k", pa.int32()), ("n", pa.int64()), ("data", pa.binary())]), "k int, n long, data binary").toLocalIterator():
        counts[k] += np.frombuffer(zlib.decompress(data), np.int32)
        n_docs[k] += m
    if not all(n_docs):
        remove(docs.sparkSession, path)
        return learn([], [], prior)
    scale = scales(*counts, *n_docs)
    wanted = np.packbits(scale != 0).tobytes()

    def thin():
        keep = np.unpackbits(np.frombuffer(wanted, np.uint8)).astype(bool)

        def each(role, features):
            f = np.frombuffer(features, "<u4")
            yield role, f[keep[f]].tobytes()

        return each

    found = [(r[0], np.frombuffer(bytes(r[1]), "<u4")) for r in map_rows(sample, thin, pa.schema([("role", pa.int32()), ("features", pa.binary())]), "role int, features binary", 128).toLocalIterator()]
    remove(docs.sparkSession, path)
    model = learn([f for role, f in found if role & 1], [f for role, f in found if role & 2], prior, scale=scale)
    del found
    tidy()
    return model


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scorer(model: tuple[np.ndarray, float]):
    """A function that scores one text."""
    weights, bias = model
    memo = Memo(lambda w: tuple(f for f in word_features(w) if weights[f]), 300_000)

    def score(text: str | None) -> float:
        z = bias + float(sum(weights[f] for f in features(text, memo)))
        return float(1 / (1 + np.exp(-min(max(z, -40), 40))))

    return score


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def start():
        score = scorer(model)

        def each(doc_id, text):
            yield doc_id, score(text)

        return each

    scored = map_rows(id_text(docs, id_col, text_col), start, SCHEMA, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose score is below the threshold; a null text is scored as an empty one."""

    def start():
        score = scorer(model)
        return lambda text: score(text) < threshold

    return map_column(docs, text_col, start, keep=True)
