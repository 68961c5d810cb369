"""Feature distributions: moments, Frechet distance, manifold precision and recall, kernel distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def moments(df: DataFrame, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (n - 1): each task adds up a d x d matrix, a tree of sums adds those."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_list()).astype(np.float64)
                n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [total.tobytes()], "g": [gram.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, 0.0, 0.0
        for b in batches:
            for r in b.itertuples():
                n, s, g = n + r.n, s + np.frombuffer(r.s), g + np.frombuffer(r.g)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "g": [g.tobytes()]})

    parts = df.select(F.col(vector).alias("v")).where("v is not null").mapInPandas(partial, "n long, s binary, g binary")
    rows = parts.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(add, "n long, s binary, g binary").collect()
    n = sum(r[0] for r in rows)
    if not n:
        return 0, np.empty(0), np.empty((0, 0))
    s, g = sum(np.frombuffer(r[1]) for r in rows), sum(np.frombuffer(r[2]) for r in rows)
    d = len(s)
    mean = s / n
    return n, mean, (g.reshape(d, d) - n * np.outer(mean, mean)) / max(1, n - 1)


def covariance_table(df: DataFrame, dims: int, vector: str = "embedding", *group: str) -> DataFrame:
    """A30 in expressions: one row for each pair of the first dimensions, by group."""
    x = df.select(*group, *[F.get(vector, F.lit(i)).cast("double").alias(f"x{i}") for i in range(dims)])
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    wide = x.groupBy(*group).agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(dims)], *[F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"m{i}").alias("mean_i"), F.col(f"c{i}_{j}").alias("cov")) for i, j in pairs])
    return wide.select(*group, F.inline(cells))


def whole_covariance(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """One row for each group and pair of dimensions (i <= j), from sums and d x d matrices that each task adds up.

    Vectors are of one length; rows without one are left out.
    """
    kind = dict(df.dtypes)[group]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for label, part in b.groupby("label", dropna=False):
                x = np.stack(part["v"].to_list()).astype(np.float64)
                n, s, g = sums.get(label := None if pd.isna(label) else label, (0, 0.0, 0.0))
                sums[label] = n + len(x), s + x.sum(0), g + x.T @ x
        for label, (n, s, g) in sums.items():
            yield pd.DataFrame({"label": [label], "n": [n], "s": [s.tobytes()], "g": [g.tobytes()]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        n = int(parts["n"].sum())
        mean = sum(np.frombuffer(x) for x in parts["s"]) / n
        d = len(mean)
        cov = (sum(np.frombuffer(x) for x in parts["g"]).reshape(d, d) - n * np.outer(mean, mean)) / max(1, n - 1)
        i, j = np.triu_indices(d)
        return pd.DataFrame({"label": [parts["label"].iloc[0]] * len(i), "i": i, "j": j, "mean_i": mean[i], "cov": cov[i, j] if n > 1 else [None] * len(i)})

    parts = df.select(F.col(group).alias("label"), F.col(vector).alias("v")).where("v is not null").mapInPandas(partial, f"label {kind}, n long, s binary, g binary")
    return parts.groupBy("label").applyInPandas(add, f"label {kind}, i int, j int, mean_i double, cov double").withColumnRenamed("label", group)


def frechet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float = 1e-6) -> float:
    """|m1 - m2|^2 + tr(S1) + tr(S2) - 2 tr(sqrt(S1 S2)), by the symmetric form of the product."""
    (m1, s1), (m2, s2) = a, b
    w, v = np.linalg.eigh(s1)
    if w.min() <= 0:
        s1, s2 = s1 + eps * np.eye(len(s1)), s2 + eps * np.eye(len(s2))
        w, v = np.linalg.eigh(s1)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    mid = np.linalg.eigvalsh(root @ s2 @ root)
    return float(((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.maximum(mid, 0)).sum())


def blocks(df: DataFrame, n: int, name: str, id_col: str, vector: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(name))


#: Blocks of a side, as long as they stay below LARGEST rows: each row is then sent as often, however many rows there are.
GRID, LARGEST = 12, 65_536
#: Cells of one matrix product.
CELLS = 1 << 22


def paired_blocks(left: DataFrame, right: DataFrame, fn, schema: str, block_rows: int = 2048) -> DataFrame:
    """Every block of one side with every block of the other, each pair of blocks as bounded matrix products.

    The pairs of blocks are the work itself (all pairs of points are compared); what leaves a pair is what ``fn`` keeps. A
    row is sent once for each block of the other side: blocks grow with the tables from ``block_rows`` to ``LARGEST`` rows,
    so that what is sent grows with the rows, and only beyond GRID * LARGEST rows with their square. ``fn`` gets ids and
    vectors of some rows of one block, and of all rows of the other; it must not depend on which rows come together.
    """
    a, b = (max(1, -(-n // min(max(block_rows, -(-n // GRID)), max(block_rows, LARGEST)))) for n in (left.count(), right.count()))
    x = blocks(left, a, "a", "id", "v").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    y = blocks(right, b, "b", "id", "v").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))

    def points(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = side.column("v").combine_chunks()
        return side.column("id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        if not len(p) or not len(q):
            return out.empty_table()
        (i, v), (j, w) = points(p), points(q)
        step = max(1, CELLS // len(j))
        return pa.concat_tables([pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(fn(i[at : at + step], v[at : at + step], j, w), out, strict=True)], schema=out) for at in range(0, len(i), step)])

    out = to_arrow_schema(T.StructType.fromDDL(schema))
    return x.groupBy("a", "b").cogroup(y.groupBy("a", "b")).applyInArrow(run, schema)


def squared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.maximum((p**2).sum(1)[:, None] + (q**2).sum(1)[None] - 2 * p @ q.T, 0)


def radii(df: DataFrame, k: int = 3, id_col: str = "id", vector: str = "v") -> DataFrame:
    """Squared distance to the k-th neighbour, the point itself being the 0-th."""
    points = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))

    def near(i: np.ndarray, p: np.ndarray, j: np.ndarray, q: np.ndarray):
        d = squared(p, q)
        d[i[:, None] == j[None]] = 0
        n = min(k + 1, d.shape[1])
        low = np.partition(d, n - 1, axis=1)[:, :n]
        return np.repeat(i, n), low.ravel()

    return paired_blocks(points, points, near, "id long, d double").groupBy("id").agg(F.element_at(F.array_sort(F.collect_list("d")), k + 1).alias("radius"))


def inside(points: DataFrame, balls: DataFrame) -> DataFrame:
    """Ids of points (id, v) inside any ball (id, v, radius)."""
    from .rows import cut

    wide = cut(balls.select("id", F.concat("v", F.array("radius")).alias("v")))

    def hit(i: np.ndarray, p: np.ndarray, j: np.ndarray, q: np.ndarray):
        return (i[(squared(p, q[:, :-1]) <= q[None, :, -1] * (1 + 1e-12)).any(1)],)

    return paired_blocks(points, wide, hit, "id long").distinct()


def precision_recall(reference: DataFrame, samples: DataFrame, k: int = 3) -> DataFrame:
    """Precision: share of samples inside a reference ball; recall: the other way round. Both have (id, v)."""
    from .rows import cut

    def share(points: DataFrame, others: DataFrame) -> float:
        balls = cut(others.join(radii(others, k), "id"))
        return inside(points, balls).count() / max(1, points.count())

    return reference.sparkSession.createDataFrame([(share(samples, reference), share(reference, samples))], "precision double, recall double")


def realism(points: DataFrame, balls: DataFrame, eps: float = 1e-5, prune: bool = False) -> DataFrame:
    """Per point (id, v) the greatest radius / (distance + eps) over the balls (id, v, radius), and its nearest ball
    (the smaller id of two). Distances and radii are squared, as ``radii`` gives them. A pair of blocks keeps one row for
    each point: its greatest ratio, and the nearest ball with its distance. ``prune`` leaves out balls of a radius above the
    median (the exact one, lower of two) as sources of the ratio; as nearest they count all the same."""
    from .rows import cut

    most = balls.agg(F.percentile("radius", 0.5)).first()[0] if prune else None
    counted = F.col("radius") if most is None else F.when(F.col("radius") <= most, F.col("radius"))
    wide = cut(balls.select("id", F.concat("v", F.array(F.coalesce(counted, F.lit(-1.0)))).alias("v")))

    def best(i: np.ndarray, p: np.ndarray, j: np.ndarray, q: np.ndarray):
        d = squared(p, q[:, :-1])
        low = d.min(1)
        near = np.where(d == low[:, None], j[None], np.iinfo(np.int64).max).min(1)  # the smaller id of two
        return i, (q[None, :, -1] / (d + eps)).max(1), near, low

    pairs = paired_blocks(points, wide, best, "id long, ratio double, near long, d double")
    return pairs.groupBy("id").agg(F.max("ratio").alias("realism"), F.min_by("near", F.struct("d", "near")).alias("nearest"))


def inception_score(df: DataFrame, split_rows: int, idx: str, probabilities: str) -> DataFrame:
    """Exp of the mean divergence from the split's mean distribution, averaged over splits."""
    p = df.select(F.floor(F.col(idx) / split_rows).alias("split"), F.col(idx).alias("i"), F.posexplode(probabilities).alias("c", "p"))
    mean = p.groupBy("split", "c").agg(F.avg("p").alias("m"))
    kl = p.join(mean, ["split", "c"]).groupBy("split", "i").agg(F.sum(F.when(F.col("p") > 0, F.col("p") * (F.ln("p") - F.ln("m"))).otherwise(0.0)).alias("kl"))
    return kl.groupBy("split").agg(F.exp(F.avg("kl")).alias("s")).agg(F.avg("s").alias("inception_score"))


def polynomial_mmd(x: DataFrame, y: DataFrame, degree: int = 3) -> float:
    """Unbiased polynomial-kernel distance of two sets (id, v)."""

    def total(a: DataFrame, b: DataFrame, same: bool) -> float:
        def kernel(i: np.ndarray, u: np.ndarray, j: np.ndarray, w: np.ndarray):
            k = (u @ w.T / u.shape[1] + 1) ** degree
            if same:
                k[i[:, None] == j[None]] = 0
            return ([k.sum()],)

        return paired_blocks(a, b, kernel, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]

    n, m = x.count(), y.count()
    return total(x, x, True) / (n * (n - 1)) + total(y, y, True) / (m * (m - 1)) - 2 * total(x, y, False) / (n * m)
