import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import one_bit

EXTRA = "list int, block string, salt string, rank string, score string, `a.b` int, VEC int"


@pytest.fixture
def vectors(spark):
    def make(rows, parts=3):
        return spark.createDataFrame([(*r, 1, "b", "s", "r", "x", 2, 3) for r in rows], f"vec_id long, embedding array<float>, {EXTRA}").repartition(parts)

    return make


def cloud(n, d, seed, first=0):
    r = np.random.default_rng(seed)
    return [(first + i, r.standard_normal(d).astype(np.float32).tolist()) for i in range(n)]


def brute(rows, every, k):
    """Rows by definition: products summed from the first component to the last."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good], np.float32).astype(float)
    out = []
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        own = min(tuple(v) for i, v in zip(ids, x.tolist()) if i == q)
        s = np.zeros(len(x))
        for d in range(x.shape[1]):
            s += own[d] * x[:, d]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out += [(q, r, int(ids[j]), s[j]) for r, j in enumerate(order, 1)]
    return out


def test_all_neighbours_of_odd_rows(vectors):
    base = cloud(400, 24, 1)
    same = cloud(1, 24, 2)[0][1]
    rows = base + [(400 + i, same) for i in range(60)] + [(440, same)]  # ties, and an id twice
    rows += [(1000, None), (1020, []), (1040, [0.0] * 24), (1060, [float("nan")] + [1.0] * 23), (1080, [float("inf")] * 24), (1100, [None] * 24), (None, same), (1120, [1.0] * 23)]
    expected = brute([r for r in rows if r[0] != 1120], 20, 7)  # vectors of another length take no part
    for sizes in ({}, {"list_rows": 64, "block_rows": 16, "first_rows": 40}):
        got = [tuple(r) for r in one_bit.search(vectors(rows), F.col("vec_id") % 20 == 0, 7, **sizes).collect()]
        assert sorted(got) == sorted(expected)


def test_recall_on_clusters_and_few_visits(vectors):
    r = np.random.default_rng(3)
    centre = r.standard_normal((12, 32)) * 3
    rows = [(i, (centre[i % 12] + 0.3 * r.standard_normal(32)).astype(np.float32).tolist()) for i in range(3000)]
    got = {(a, c) for a, _, c, _ in one_bit.search(vectors(rows), F.col("vec_id") % 50 == 0, 10, list_rows=250, block_rows=100, first_rows=250).collect()}
    want = {(a, c) for a, _, c, _ in brute(rows, 50, 10)}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)


def test_few_candidates_and_empty_tables(vectors):
    assert one_bit.search(vectors([]).where("false"), F.col("vec_id") % 20 == 0).collect() == []
    assert one_bit.search(vectors([(20, [1.0, 0.0])]), F.col("vec_id") % 20 == 0).collect() == []
    got = one_bit.search(vectors([(20, [1.0, 0.0]), (21, [2.0, 1.0]), (22, [-1.0, 0.0])]), F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in got] == [(20, 1, 21, 2.0), (20, 2, 22, -1.0)]
    assert one_bit.search(vectors([(21, [1.0, 0.0])]), F.col("vec_id") % 20 == 0).collect() == []


def test_estimates_stay_within_their_bounds():
    r = np.random.default_rng(4)
    x, q = r.standard_normal((500, 48)), r.standard_normal((2000, 48))
    centre, turn = r.standard_normal(48), one_bit.rotation(48, one_bit.code_bits(48))
    codes, norm, dot = one_bit.encode(x, centre, turn)
    words = np.ascontiguousarray(codes.view(np.uint64).T)
    plane, least, step, total = one_bit.planes(q, turn)
    ones = np.bitwise_count(words).sum(0, dtype=np.int64)
    near = np.array([q[i] @ centre + norm / dot * one_bit.estimates(words, ones, plane[i], least[i], step[i], total[i], turn.shape[1]) for i in range(len(q))])
    spread = norm / dot * np.sqrt((1 - dot**2) / (turn.shape[1] - 1) * (q * q).sum(1)[:, None] + step[:, None] ** 2 / 12)
    off = (near - q @ x.T) / spread
    assert abs(off.mean()) < 0.05 and 0.5 < off.std() < 1.1 and np.abs(off).max() < 6
