"""Hard negatives by exact search over one-dimensional distance keys.

Largest inner products become smallest distances: each vector x gets one more component,
sqrt(M^2 - |x|^2), where M is the longest vector's length, and an anchor q gets a zero there, so
that |q - x|^2 = |q|^2 + M^2 - 2 q.x. Each row belongs to its nearest pivot; its key is
(pivot, distance to it), and the table is stored sorted by key. For an anchor at distance t from
a pivot, rows at distance s from it lie no closer than |t - s| and no farther than t + s. So a
ring (an interval of keys) holds scores between two known bounds, and the ring is an annulus
around its pivot.

Rings are scanned from the highest bound downwards, in rounds of growing width, until the k-th
best score found is certain to beat whatever the remaining rings can hold. The number of pivots and
rings is bounded by parameters; a ring is cut into blocks of bounded size, and each group of a join
holds one block and a bounded number of anchors. Nothing is approximate: the result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .vectors import centres, dimension, finite, first_k, matrix, nearest, ranked, sample, unpacked

ANCHOR_ROWS = 4096  # anchors that meet a block in one group
EXACT = 2.0**53  # sums of products below this are exact in doubles
FIRST_RINGS, WIDER = 8, 8  # rings an anchor scans in the first round, and how much wider the next ones are


def raised(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes all of them equally long."""
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]], 1)


def bounds(q: np.ndarray, pivots: np.ndarray, of: np.ndarray, near: np.ndarray, far: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and ring, scores that no row of the ring lies below, and none above."""
    own = (q * q).sum(1)
    t = np.sqrt(np.maximum(own[:, None] + (pivots**2).sum(1) - 2 * q @ pivots[:, :-1].T, 0))[:, of]
    slack = 1e-6 * (np.sqrt(own) + longest)[:, None] + 1e-6  # for rounding of distances
    least, most = np.maximum(np.maximum(t - far, near - t) - slack, 0), t + far + slack
    reach = (own + longest**2)[:, None]
    return np.floor((reach - most**2) / 2) - 1, np.ceil((reach - least**2) / 2) + 1


class Keys:
    """Rows (vec_id, v, label) stored sorted by (pivot, distance), and what is known of their rings."""

    def __init__(self, rows: DataFrame, d: int, n: int, longest: float, pivots: int, rings: int, block_rows: int):
        self.d, self.longest = d, longest
        self.pivots = pivot = centres(raised(sample(rows, d), longest), min(pivots, -(-n // block_rows)))

        def run(batches):
            import pyarrow as pa

            for b in batches:
                x = matrix(b.column(1), d)
                which, far = nearest(raised(x, longest), pivot)
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(far), b.column(0), b.column(2), pa.array([v.tobytes() for v in x], pa.binary()), b.column(3)], names=["pivot", "far", "vec_id", "label", "x", "at"])

        keyed = rows.select("vec_id", "v", "label", F.monotonically_increasing_id().alias("at")).mapInArrow(run, "pivot int, far double, vec_id long, label long, x binary, at long")
        parts = max(1, -(-n // (16 * block_rows)))
        self.table = stored(keyed.repartitionByRange(parts, "pivot", "far", "vec_id", "at").sortWithinPartitions("pivot", "far", "vec_id", "at"), "distance-keys")
        # edges of rings: quantiles of the distances of each pivot, so rings hold about equally many rows
        sizes = {r["pivot"]: r for r in self.table.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("far", [k / rings for k in range(1, rings)]).alias("q")).collect()}
        self.edges = []
        for p in range(len(pivot)):
            m = min(rings, -(-sizes[p]["n"] // block_rows)) if p in sizes else 1
            self.edges.append(sorted({sizes[p]["q"][k * rings // m - 1] for k in range(1, m)}) if m > 1 else [])
        self.first = np.cumsum([0] + [len(e) + 1 for e in self.edges])
        known = {r["ring"]: r for r in self.ringed().groupBy("ring").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect()}
        total = int(self.first[-1])
        self.of = np.repeat(np.arange(len(pivot)), np.diff(self.first))
        self.n = np.array([known[k]["n"] if k in known else 0 for k in range(total)])
        self.near = np.array([known[k]["near"] if k in known else 0.0 for k in range(total)])
        self.far = np.array([known[k]["far"] if k in known else 0.0 for k in range(total)])
        self.blocks = np.maximum(1, -(-self.n // block_rows))

    def ringed(self) -> DataFrame:
        """The table with the number of each row's ring."""
        edges = F.array(*(F.array(*map(F.lit, e)).cast("array<double>") for e in self.edges))
        first = F.array(*(F.lit(int(k)) for k in self.first[:-1]))
        at = F.col("pivot") + 1
        return self.table.withColumn("ring", F.element_at(first, at) + F.size(F.filter(F.element_at(edges, at), lambda e: e < F.col("far"))))

    def in_blocks(self, salts: int) -> DataFrame:
        blocks = F.array(*(F.lit(int(b)) for b in self.blocks))
        return self.ringed().withColumns({"block": F.pmod(F.xxhash64("at"), F.element_at(blocks, F.col("ring") + 1)).cast("int"), "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))}).drop("at", "pivot", "far")

    def geometry(self) -> dict:
        """What bounds() needs in tasks: pivots and, for each ring, its pivot and its least and largest distance."""
        return {"pivots": self.pivots, "of": self.of, "near": self.near, "far": self.far, "longest": self.longest}

    def visits(self, anchors: DataFrame, begin: int, end: int, salts: int) -> DataFrame:
        """The blocks that each anchor scans in a round: of the rings that may hold scores it asks for, those from begin to end, without those that can no longer matter."""
        d, n, blocks, rings = self.d, self.n, self.blocks, self.geometry()

        def run(batches):
            import pyarrow as pa

            for b in batches:
                q = unpacked(b.column("q")).reshape(-1, d)
                need = b.column("need").to_numpy()
                top = b.column("top").to_numpy()
                for i in range(0, len(q), 1024):
                    low, high = bounds(q[i : i + 1024], **rings)
                    high[(low > top[i : i + 1024, None]) | (n == 0)] = -np.inf
                    order = np.argsort(-high, axis=1, kind="stable")[:, begin:end]
                    who, place = np.nonzero(np.take_along_axis(high, order, 1) >= np.maximum(need[i : i + 1024], -1e300)[:, None])
                    where = order[who, place]
                    times = blocks[where]
                    block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    who, where = i + np.repeat(who, times), np.repeat(where, times)
                    rest = b.take(pa.array(who))
                    salt = rest.column("anchor_id").to_numpy() // 128 % salts
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(block, pa.int32()), pa.array(salt, pa.int32()), *(rest.column(c) for c in ("anchor_id", "q", "label", "goals"))], names=["ring", "block", "salt", "anchor_id", "q", "label", "goals"])

        return anchors.select("anchor_id", "q", "label", "goals", "need", "top").mapInArrow(run, f"ring int, block int, salt int, anchor_id long, q binary, label long, goals {GOALS}")


GOALS = "array<struct<goal:int,high:double,low:double>>"


def scan(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, queries: dict, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the anchor, goal, number of the row, score): for each goal its k best rows of a block, of the anchor's label or of others, with scores from low to high."""
    out = []
    for i in range(0, len(queries["q"]), 256):
        part = slice(i, i + 256)
        scores = queries["q"][part] @ x.T
        fits = ((queries["label"][part, None] == labels) == same) & (queries["ids"][part, None] != ids)
        for who, goal, high, low in queries["goals"](part):
            s = scores[who]
            s[~fits[who] | (s > high[:, None]) | (s < low[:, None])] = -np.inf
            least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(s), -np.inf)
            r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            best = first_k(r, s[r, c], ids[c], k)
            r, c = r[best], c[best]
            out.append((i + who[r], np.full(len(r), goal), c, s[r, c]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def scanned(keys: Keys, visits: DataFrame, same: bool, k: int, salts: int) -> DataFrame:
    """(anchor_id, goal, vec_id, score) of one round."""
    d = keys.d

    def run(rows, anchors):
        import pyarrow as pa

        out = pa.schema([("anchor_id", pa.int64()), ("goal", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not rows.num_rows or not anchors.num_rows:
            return out.empty_table()
        goals = anchors.column("goals").combine_chunks()
        at, flat = goals.value_lengths().to_numpy(), goals.flatten()
        owner = np.repeat(np.arange(len(at)), at)
        goal, high, low = (flat.field(c).to_numpy() for c in ("goal", "high", "low"))

        def chosen(part):
            inside = (owner >= part.start) & (owner < part.stop)
            for g in np.unique(goal[inside]):
                m = inside & (goal == g)
                yield owner[m] - part.start, g, high[m], low[m]

        ids = rows.column("vec_id").to_numpy()
        asked = {"q": unpacked(anchors.column("q")).reshape(-1, d), "ids": anchors.column("anchor_id").to_numpy(), "label": anchors.column("label").to_numpy(), "goals": chosen}
        i, g, j, score = scan(unpacked(rows.column("x")).reshape(-1, d), ids, rows.column("label").to_numpy(), asked, same, k)
        return pa.table([pa.array(asked["ids"][i], pa.int64()), pa.array(g, pa.int32()), pa.array(ids[j], pa.int64()), pa.array(score.astype(np.int64))], schema=out)

    by = ["ring", "block", "salt"]
    return keys.in_blocks(salts).groupBy(*by).cogroup(visits.groupBy(*by)).applyInArrow(run, "anchor_id long, goal int, vec_id long, score long")


def search(keys: Keys, anchors: DataFrame, same: bool, k: int, salts: int) -> DataFrame:
    """(anchor_id, goal, rank, vec_id, score): for each goal the k rows of highest score from low to high. anchors: (anchor_id, q, label, goals)."""
    found, begin, width = None, 0, FIRST_RINGS
    while True:
        if found is None:
            state = anchors
        else:  # a goal that has k rows asks for no scores below the k-th
            kth = found.groupBy("anchor_id", "goal").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("goal", F.col("kth").cast("double")))).alias("kth"))
            raised_low = F.transform("goals", lambda g: g.withField("low", F.greatest(g["low"], F.element_at("kth", g["goal"]))))
            state = anchors.join(kth, "anchor_id", "left").withColumn("goals", F.when(F.col("kth").isNull(), F.col("goals")).otherwise(raised_low)).drop("kth")
        state = state.withColumns({"need": F.array_min(F.transform("goals", lambda g: g["low"])), "top": F.array_max(F.transform("goals", lambda g: g["high"]))})
        visits = stored(keys.visits(state, begin, begin + width, salts), "visits")
        if found is not None and visits.isEmpty():
            break
        new = scanned(keys, visits, same, k, salts)
        found = stored(ranked((new if found is None else found.drop("rank").union(new)), ["anchor_id", "goal"], k), "found")
        begin, width = begin + width, width * WIDER
        if begin >= len(keys.n):
            break
    return found


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, pivots: int = 32, rings: int = 64, block_rows: int = 2048) -> DataFrame:
    """Rows (vec_id, v, label) with v of whole numbers -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the n_positives other rows of its label of largest inner product; for
    each positive, of the rows of other labels with low * positive <= 100 * negative <= high * positive
    (scores; `low` and `high` are whole per cents), the first n_negatives. Order: score descending,
    then id ascending. Fewer where there are not so many; a positive without any has no row.

    Rows without an id, label or vector, with an empty vector or with null or non-finite components
    take no part, nor do vectors of another length than most have; zero vectors do take part. A row
    is no candidate of anchors of its own id; rows that share an id are candidates each, and as an
    anchor such an id counts once, with the smallest (vector, label). An empty table gives an empty
    result; other columns are not looked at. Vectors of a squared length of 2^53 or more raise
    ValueError: their scores would not be exact.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"), is_anchor.alias("asks")).where("vec_id is not null and label is not null").where(finite("v"))
    d = dimension(rows)
    rows = rows.where(F.size("v") == d)
    n, square = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    if square >= EXACT:
        raise ValueError(f"vectors of squared length {square:g}: scores beyond 2^53 would not be exact")
    keys = Keys(rows, d, n, float(np.sqrt(square)) * (1 + 1e-12), pivots, rings, block_rows)

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in matrix(b.column(1), d)], pa.binary()), b.column(2)], names=["anchor_id", "q", "label"])

    first = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.v", "r.label")
    anchors = stored(first.mapInArrow(pack, "anchor_id long, q binary, label long"), "anchors")
    salts = max(1, -(-anchors.count() // ANCHOR_ROWS))

    def with_goals(df: DataFrame, goals: Column) -> DataFrame:
        return df.select("anchor_id", "q", "label", goals.cast(GOALS).alias("goals"))

    everything = F.array(F.struct(F.lit(0).alias("goal"), F.lit(float("inf")).alias("high"), F.lit(float("-inf")).alias("low")))
    positives = search(keys, with_goals(anchors, everything), True, n_positives, salts).select("anchor_id", F.col("rank").alias("goal"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    score = F.col("positive_score")
    # 100 * negative >= low * positive, <= high * positive, in whole numbers
    least, most = F.ceil(score * low / F.lit(100).cast("decimal(3,0)")), F.floor(score * high / F.lit(100).cast("decimal(3,0)"))
    wanted = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("goal", most.cast("double").alias("high"), least.cast("double").alias("low"))).alias("goals"))
    asking = stored(with_goals(anchors.join(wanted, "anchor_id"), F.col("goals")), "goals")
    negatives = search(keys, asking, False, n_negatives, salts)
    both = positives.join(negatives, ["anchor_id", "goal"])
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_distance_key_negatives(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < float("inf"), F.floor(x * 256).cast("double")).otherwise(x))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", whole.alias("v"), label.alias("label")), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
