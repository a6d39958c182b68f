"""Approximate nearest neighbours by inner product, over randomly rotated one-bit codes.

Every row belongs to the list of its nearest centre. What is left of it after the centre is taken
away is turned by a fixed random rotation into more dimensions, and only the signs are kept, with
two numbers: its length, and the product of the turned direction with its signs. From these the
product with any query is estimated without bias, with an error that is known but for a factor
(`confidence` standard deviations). Only rows whose upper bound reaches the score to beat are
scored on the original vectors.

A query first scores its nearest lists. The k-th score found there is a bound for all others:
lists that cannot reach it (centre, radius; certain) are left out, rows that can hardly reach it
(code; `confidence`) are not scored. Lists are cut into blocks, and each group of a join holds one
block and a bounded number of queries, so no list, however large, meets in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .vectors import centres, dimension, finite, first_k, matrix, nearest, products, ranked, sample, unpacked

EXPAND = 4  # bits of code per dimension
LEVELS = 4  # bits of a query's components
WEIGHTS = 2.0 ** np.arange(LEVELS)
QUERY_ROWS = 8192  # queries that meet a block in one group


def rotation(d: int, bits: int, seed: int = 17) -> np.ndarray:
    """d orthonormal directions of a random basis of `bits` dimensions: turning keeps all products."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, d)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def code_bits(d: int, expand: int = EXPAND) -> int:
    return 64 * -(-expand * d // 64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths and correction factors of vectors around their centres."""
    rest = x - centre
    norm = np.sqrt((rest * rest).sum(1))
    turned = rest @ turn
    codes = np.packbits(turned > 0, axis=1)
    dot = np.abs(turned).sum(1) / np.maximum(norm, 1e-300) / np.sqrt(turn.shape[1])
    return codes, norm, np.where(norm > 0, dot, 1.0)


def planes(q: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Queries turned and rounded to LEVELS bits: bit planes (query, level, word), least value, step, sum of what is rounded."""
    turned = q @ turn
    least = turned.min(1)
    step = np.maximum((turned.max(1) - least) / (2**LEVELS - 1), 1e-300)
    whole = np.minimum(((turned - least[:, None]) / step[:, None] + 0.5).astype(np.int64), 2**LEVELS - 1)
    packed = np.stack([np.packbits((whole >> k) & 1, axis=1) for k in range(LEVELS)], 1)
    return np.ascontiguousarray(packed).view(np.uint64), least, step, whole.sum(1)


def estimates(codes: np.ndarray, ones: np.ndarray, plane: np.ndarray, least: float, step: float, total: int, bits: int) -> np.ndarray:
    """Products of all signs / sqrt(bits) with one rounded query, from packed bits. codes: (word, row)."""
    counts = np.bitwise_count(codes & plane[:, :, None]).sum(1, dtype=np.uint16)
    both = WEIGHTS @ counts.astype(np.float64)
    return (2 * (step * both + least * ones) - (step * total + least * bits)) / np.sqrt(bits)


def search_block(block: dict, queries: dict, turn: np.ndarray, centre: np.ndarray, k: int, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, number of the row, score): for each query its best k rows of the block among those whose upper bound reaches the score to beat."""
    x, ids, norm, dot = block["x"], block["ids"], block["norm"], block["dot"]
    codes = np.ascontiguousarray(block["codes"].view(np.uint64).T)
    ones = np.bitwise_count(codes).sum(0, dtype=np.int64)
    bits, n = turn.shape[1], len(ids)
    q = queries["q"]
    plane, least, step, total = planes(q, turn)
    lengths, base = np.sqrt((q * q).sum(1)), q @ centre
    scale = norm / dot
    spread, rounding = (1 - np.minimum(dot * dot, 1)) / (bits - 1), step**2 / 12
    at, rows, scores = [], [], []
    top = min(k, n)
    for i in range(len(q)):
        near = base[i] + scale * estimates(codes, ones, plane[i], least[i], step[i], total[i], bits)
        own = ids == queries["ids"][i]
        near[own] = -np.inf
        to_beat = queries["bound"][i]
        if n - own.sum() >= k:  # the k that look best give a score that the k best have at least
            some = np.argpartition(-near, top - 1)[:top]
            to_beat = max(to_beat, products(q[i : i + 1], np.zeros(top, np.int64), x, some).min())
        upper = near + scale * confidence * np.sqrt(spread * lengths[i] ** 2 + rounding[i])
        found = np.flatnonzero((upper >= to_beat) & ~own)
        exact = products(q[i : i + 1], np.zeros(len(found), np.int64), x, found)
        least_kept = max(queries["bound"][i], np.partition(exact, -k)[-k] if len(exact) > k else -np.inf)
        good = exact >= least_kept
        at.append(np.full(good.sum(), i))
        rows.append(found[good])
        scores.append(exact[good])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at, rows, score = np.concatenate(at), np.concatenate(rows), np.concatenate(scores)
    best = first_k(at, score, ids[rows], k)
    return at[best], rows[best], score[best]


class Index:
    """Codes of all rows, as a stored table, and the lists' centres, radii and blocks (bounded by the number of lists)."""

    def __init__(self, rows: DataFrame, d: int, centre: np.ndarray, block_rows: int):
        self.d, self.centre = d, centre
        self.turn = rotation(d, code_bits(d))
        ship(rows.sparkSession)
        turn = self.turn

        def run(batches):
            import pyarrow as pa

            for b in batches:
                x = matrix(b.column(1), d)
                which, _ = nearest(x, centre)
                codes, norm, dot = encode(x, centre[which], turn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(dot), pa.array([v.tobytes() for v in x], pa.binary()), b.column(2)],
                    names=["list", "vec_id", "code", "norm", "dot", "x", "at"],
                )

        coded = rows.select("vec_id", "v", F.monotonically_increasing_id().alias("at")).mapInArrow(run, "list int, vec_id long, code binary, norm double, dot double, x binary, at long")
        self.table = stored(coded, "one-bit")
        found = {r["list"]: r for r in self.table.groupBy("list").agg(F.count("*").alias("n"), F.max("norm").alias("radius")).collect()}
        self.n = np.array([found[k]["n"] if k in found else 0 for k in range(len(centre))])
        self.radius = np.array([found[k]["radius"] if k in found else 0.0 for k in range(len(centre))])
        self.blocks = -(-self.n // block_rows)

    def in_blocks(self, salts: int) -> DataFrame:
        """Every row with its block, once for each salt of the queries."""
        sizes = F.array(*(F.lit(int(b)) for b in np.maximum(self.blocks, 1)))
        block = F.pmod(F.xxhash64("at"), F.element_at(sizes, F.col("list") + 1)).cast("int")
        return self.table.withColumns({"block": block, "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))}).drop("at")

    def visits(self, queries: DataFrame, first_rows: int, salts: int, later: bool) -> DataFrame:
        """(list, block, salt, query_id, q, bound): the nearest lists that hold first_rows rows, or, later, those others that can reach the bound."""
        centre, radius, n, blocks, d = self.centre, self.radius, self.n, self.blocks, self.d

        def run(batches):
            import pyarrow as pa

            for b in batches:
                q = matrix(b.column("q"), d)
                ids, bound = b.column("query_id").to_numpy(), b.column("bound").to_numpy()
                for i in range(0, len(q), 1024):
                    part = q[i : i + 1024]
                    product = part @ centre.T
                    reach = product + np.sqrt((part * part).sum(1))[:, None] * radius * (1 + 1e-9)
                    order = np.argsort(-reach, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    first = np.empty_like(product, bool)
                    np.put_along_axis(first, order, before < first_rows, axis=1)
                    use = (~first & (reach + 1e-9 * np.abs(reach) >= bound[i : i + 1024, None]) if later else first) & (n > 0)
                    who, where = np.nonzero(use)
                    times = blocks[where]
                    block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    who, where = np.repeat(who, times), np.repeat(where, times)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where, pa.int32()), pa.array(block, pa.int32()), pa.array(ids[i + who] // 64 % salts, pa.int32()), pa.array(ids[i + who]), pa.array([v.tobytes() for v in part[who]], pa.binary()), pa.array(bound[i + who])],
                        names=["list", "block", "salt", "query_id", "q", "bound"],
                    )

        return queries.mapInArrow(run, "list int, block int, salt int, query_id long, q binary, bound double")

    def score(self, visits: DataFrame, k: int, salts: int, confidence: float) -> DataFrame:
        """(query_id, vec_id, score): the best k of each block for each query that visits it."""
        turn, centre, d = self.turn, self.centre, self.d

        def run(rows, queries):
            import pyarrow as pa

            out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
            if not rows.num_rows or not queries.num_rows:
                return out.empty_table()
            ids = rows.column("vec_id").to_numpy()
            block = {"x": unpacked(rows.column("x")), "ids": ids, "norm": rows.column("norm").to_numpy(), "dot": rows.column("dot").to_numpy(), "codes": unpacked(rows.column("code"), np.uint8)}
            asked = {"q": unpacked(queries.column("q")).reshape(-1, d), "ids": queries.column("query_id").to_numpy(), "bound": queries.column("bound").to_numpy()}
            i, j, score = search_block(block, asked, turn, centre[rows.column("list")[0].as_py()], k, confidence)
            return pa.table([pa.array(asked["ids"][i]), pa.array(ids[j]), pa.array(score)], schema=out)

        keys = ["list", "block", "salt"]
        return self.in_blocks(salts).groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query, k: int = 20, list_rows: int = 8192, max_lists: int = 1024, block_rows: int = 4096, first_rows: int = 8192, confidence: float = 4.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of largest inner product, nearest first, ties to the smaller id.

    is_query: a condition on the columns of `vectors`. Rows without an id and vectors that are null,
    empty, zero or hold null or non-finite components take no part, nor do vectors of another length
    than most have. A row is no neighbour of queries of its own id. Rows that share an id, or are all
    alike, are neighbours each; as a query such an id counts once, with the vector that sorts first.
    Queries with fewer than k candidates get all. An empty table gives an empty result; other columns
    are not looked at. Centres are fitted on a bounded sample (vectors.SAMPLE_ROWS), all rows are
    indexed. Approximate: a true neighbour is missed only where the error of its estimate exceeds
    `confidence` standard deviations; scores are exact, those of the original vectors in doubles.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks")).where("vec_id is not null").where(finite("v") & F.exists("v", lambda x: x != 0))
    d = dimension(rows)
    rows = rows.where(F.size("v") == d)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index(rows, d, centres(sample(rows, d), min(max_lists, -(-n // list_rows))), block_rows)
    queries = stored(rows.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")), "queries")
    salts = max(1, -(-queries.count() // QUERY_ROWS))
    asking = queries.withColumn("bound", F.lit(float("-inf")))
    found = stored(ranked(index.score(index.visits(asking, first_rows, salts, False), k, salts, confidence), ["query_id"], k), "found")
    kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    bounded = queries.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("kth", F.lit(float("-inf"))).alias("bound"))
    more = index.score(index.visits(bounded, first_rows, salts, True), k, salts, confidence)
    return ranked(found.drop("rank").union(more), ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_one_bit_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


#: Exact search by definition. The operator is approximate; on these tables it finds the same rows.
OP11_SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
