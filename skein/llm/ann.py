"""Nearest neighbours by score-aware (anisotropic) product quantisation.

Vectors are scaled to unit length, so the largest inner product is the largest cosine. Each is coded by 4-bit centres in
two-dimensional subspaces. Codes and centres minimise a loss in which the residual parallel to the vector costs ``eta``
times as much as the rest, as it is what changes large inner products; eta follows from the score threshold T as
(d - 1) T^2 / (1 - T^2). Codes are found by coordinate descent, centres by solving the normal equations of the whole loss.

Codebooks are fitted on at most ``sample`` vectors (lowest hashes of ids); every vector is coded and searched. Queries and
candidates meet in bounded blocks: in each, table look-ups over the codes (two 4-bit codes at a time) pick ``rerank``
candidates for each query, ties to the smaller id, and these are scored exactly in double precision; of each block's k best
the overall k best remain. A block costs the same whatever the vectors are, so equal or crowded vectors make no hot task.

Vectors that are null, of another length than the most common one in the sample, zero, or with null or non-finite parts
take no part. A query's own id is never its neighbour (nor are repeated rows of that id). Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUB, CENTRES = 2, 16


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares stay finite and not zero
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta  # centres: subspaces x 16 x 2

    @property
    def subspaces(self) -> int:
        return len(self.centres)

    def split(self, x: np.ndarray) -> np.ndarray:
        """rows x subspaces x 2, padded by zeros."""
        out = np.zeros((len(x), self.subspaces * SUB))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), self.subspaces, SUB)

    def encode(self, x: np.ndarray, rounds: int = 2, codes: np.ndarray | None = None) -> np.ndarray:
        """Codes of unit vectors by coordinate descent on the anisotropic loss."""
        s, c = self.split(x), self.centres
        if codes is None:
            codes = np.stack([((s[:, m, None, :] - c[m]) ** 2).sum(2).argmin(1) for m in range(self.subspaces)], 1)
        par = [s[:, m, :1] * c[m, :, 0] + s[:, m, 1:] * c[m, :, 1] for m in range(self.subspaces)]  # rows x 16: what a centre adds to <x, coded x>; no matrix product, so equal rows get equal codes
        sq = [((s[:, m, None, :] - c[m]) ** 2).sum(2) for m in range(self.subspaces)]
        row = np.arange(len(x))
        got = sum(par[m][row, codes[:, m]] for m in range(self.subspaces))
        for _ in range(rounds):
            for m in range(self.subspaces):
                rest = got - par[m][row, codes[:, m]]
                off = 1.0 - rest[:, None] - par[m]  # parallel residual with each centre
                codes[:, m] = ((self.eta - 1) * off * off + sq[m]).argmin(1)
                got = rest + par[m][row, codes[:, m]]
        return codes.astype(np.uint8)

    @staticmethod
    def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 4, seed: int = 5) -> Quantiser:
        """Fit on unit vectors."""
        n, d = x.shape
        subspaces = -(-d // SUB)
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        q = Quantiser(np.zeros((subspaces, CENTRES, SUB)), eta)
        s = q.split(x)
        q.centres = np.stack([s[rng.integers(0, n, CENTRES), m] for m in range(subspaces)])
        for _ in range(6):  # plain k-means first
            for m in range(subspaces):
                near = ((s[:, m, None, :] - q.centres[m]) ** 2).sum(2).argmin(1)
                count = np.bincount(near, minlength=CENTRES)
                for j in range(SUB):
                    total = np.bincount(near, weights=s[:, m, j], minlength=CENTRES)
                    q.centres[m, :, j] = np.where(count > 0, total / np.maximum(count, 1), q.centres[m, :, j])
        codes, size = None, subspaces * CENTRES * SUB
        for _ in range(rounds):
            codes = q.encode(x, 1, codes)
            gram, right = np.zeros((size, size)), np.zeros(size)
            for at in range(0, n, 1024):
                block, part = codes[at : at + 1024].astype(int), s[at : at + 1024]
                g = np.zeros((len(block), size))  # the vector's own parts at its centres' places
                places = (np.arange(subspaces) * CENTRES + block)[:, :, None] * SUB + np.arange(SUB)
                np.put_along_axis(g, places.reshape(len(block), -1), part.reshape(len(block), -1), 1)
                gram += (eta - 1) * (g.T @ g)
                right += (eta - 1) * g.sum(0) + g.sum(0)
                gram[np.arange(size), np.arange(size)] += np.bincount(places.ravel(), minlength=size)
            idle = np.diag(gram) == 0
            gram[np.arange(size), np.arange(size)] += np.where(idle, 1.0, 1e-6)
            new = np.linalg.solve(gram, right).reshape(subspaces, CENTRES, SUB)
            q.centres = np.where(idle.reshape(q.centres.shape), q.centres, new)
        return q

    def paired(self, codes: np.ndarray) -> np.ndarray:
        """Two 4-bit codes in each byte; subspaces / 2 x rows."""
        if codes.shape[1] % 2:
            codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
        return np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).T)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a coded vector the inner product it stands for."""
        t = np.einsum("mkj,mj->mk", self.centres, self.split(query[None])[0])
        if len(t) % 2:
            t = np.vstack([t, np.zeros((1, CENTRES))])
        return (t[1::2, :, None] + t[::2, None, :]).reshape(-1, 256).astype(np.float32)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, of equals the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    limit = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > limit)
    return np.concatenate((above, np.flatnonzero(scores == limit)[: k - len(above)]))


def search_block(model: Quantiser, rows: pd.DataFrame, queries: pd.DataFrame, k: int, rerank: int) -> pd.DataFrame:
    out = []
    if len(rows) and len(queries):
        rows = rows.sort_values("vec_id", kind="stable")
        ids, x = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_list()).astype(np.float64)
        u, norm = unit(x), np.linalg.norm(x, axis=1)
        codes = model.paired(model.encode(u))
        q = np.stack(queries["vector"].to_list()).astype(np.float64)
        for query_id, v, uv in zip(queries["vec_id"].to_numpy(), q, unit(q), strict=True):
            table = model.tables(uv)
            approx = table[0][codes[0]]
            for t, c in zip(table[1:], codes[1:], strict=True):
                approx += t[c]
            approx[ids == query_id] = -np.inf
            near = best(approx, rerank)
            near = near[ids[near] != query_id]
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (x[near] * v).sum(1) / (norm[near] * np.linalg.norm(v))  # row by row, so equal vectors have equal scores
            exact = np.where(np.isfinite(exact), exact, (u[near] * uv).sum(1))
            for i in np.lexsort((ids[near], -exact))[:k]:
                out.append((query_id, ids[near[i]], exact[i]))
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(vectors: DataFrame, k: int = 5, every: int = 50, sample: int = 8192, block_rows: int = 4096, block_queries: int = 4096, rerank: int = 96, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == lengths[0])
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    model = Quantiser.fit(unit(np.array([r[1] for r in picked])))
    blocks = max(1, -(-lengths[1] // block_rows))
    queries = rows.where(F.col("vec_id") % every == 0)
    query_blocks = max(1, -(-queries.count() // block_queries))

    def own(n, salt):
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")

    def every_of(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.select("vec_id", "vector", own(blocks, 1).alias("b"), every_of(query_blocks).alias("q"))
    right = queries.select("vec_id", "vector", own(query_blocks, 2).alias("q"), every_of(blocks).alias("b"))
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(lambda r, q: search_block(model, r, q, k, rerank), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
