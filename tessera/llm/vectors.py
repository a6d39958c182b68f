"""What the operators on vectors share: which rows take part, a bounded sample, centres, exact products, the best of a block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS, SAMPLE_MB = 16_384, 32  # of what centres are fitted on


def finite(vector: Column | str) -> Column:
    """True where a vector is not null and not empty and holds finite numbers only."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def dimension(rows: DataFrame, vector: str = "v") -> int:
    """The length that most vectors have, of equally frequent ones the largest; 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def sample(rows: DataFrame, d: int, vector: str = "v", id_col: str = "vec_id") -> np.ndarray:
    """At most SAMPLE_ROWS vectors (SAMPLE_MB megabytes), those of the smallest hashes of ids."""
    n = max(1, min(SAMPLE_ROWS, int(SAMPLE_MB * 1e6 / (8 * max(d, 1)))))
    hashed = rows.select(F.xxhash64(id_col, F.lit(11)).alias("h"), F.col(vector).alias("v"))
    found = hashed.orderBy("h", "v").limit(n).select("v").toArrow().column("v").combine_chunks()
    return matrix(found, d)


def matrix(lists, d: int) -> np.ndarray:
    """An Arrow list column of vectors of length d as a matrix of doubles."""
    import pyarrow as pa

    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, d))
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)


def unpacked(column, dtype=np.float64) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1) if values else np.zeros((0, 0), dtype)


def centres(points: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centres of a sample; fewer if it has fewer different points."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    out = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = nearest(points, out)[0]
        sums = np.zeros_like(out)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(out))
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
    return out


def nearest(points: np.ndarray, to: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each point the number of its nearest centre, and the distance."""
    which = np.empty(len(points), np.int64)
    half = (to * to).sum(1) / 2
    for i in range(0, len(points), block):
        which[i : i + block] = (points[i : i + block] @ to.T - half).argmax(1)
    gap = points - to[which]
    return which, np.sqrt((gap * gap).sum(1))


def products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """Inner products of rows a[i] and b[j] in double precision, summed from the first component to the last."""
    out = np.empty(len(i))
    for k in range(0, len(i), block):
        s = slice(k, k + block)
        out[s] = np.cumsum(a[i[s]] * b[j[s]], axis=1)[:, -1]
    return out


def first_k(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k entries of highest score, ties to smaller ids; in that order."""
    order = np.lexsort((ids, -score, owner))
    who = owner[order]
    begins = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
    place = np.arange(len(who)) - np.repeat(begins, np.diff(np.append(begins, len(who))))
    return order[place < k]


def ranked(rows: DataFrame, by: list[str], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k rows of highest score for each value of `by`, with their rank; Spark drops the others before it shuffles."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), id_col)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
