import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import distance_keys


@pytest.fixture
def vectors(spark):
    def make(rows, parts=3):
        return spark.createDataFrame([(*r, 1, "p", "r", 2) for r in rows], "vec_id long, v array<double>, label int, pivot int, ring string, far string, `a.b` int").repartition(parts)

    return make


def cloud(n, d, seed, labels=4, size=60):
    r = np.random.default_rng(seed)
    return [(i, np.floor(size * r.standard_normal(d)).tolist(), int(r.integers(labels))) for i in range(n)]


def brute(rows, every, n_pos=5, n_neg=5):
    good = [(i, [int(x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _, _ in good if i % every == 0}):
        own, label = min((v, y) for i, v, y in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i, y) for i, v, y in good if i != q)
        positives = [(-s, i) for s, i, y in scored if y == label][:n_pos]
        for ps, p in positives:
            fit = [(-s, i) for s, i, y in scored if y != label and 80 * ps <= -100 * s <= 100 * ps][:n_neg]
            out += [(q, p, k, i, ps, s) for k, (s, i) in enumerate(fit, 1)]
    return sorted(out)


ODD = [(1000, None, 1), (1020, [], 1), (1040, [float("nan")] * 12, 1), (1060, [None] * 12, 2), (1080, [1.0] * 12, None), (None, [1.0] * 12, 1), (1100, [0.0] * 12, 1)]


def test_against_brute_force(vectors):
    r = np.random.default_rng(9)
    rows = cloud(500, 12, 1)
    middle = (100 * r.standard_normal((6, 12))).tolist()
    rows += [(500 + i, np.floor(np.array(middle[i % 6]) + 6 * r.standard_normal(12)).tolist(), i % 3) for i in range(300)]  # clusters
    rows += [(800 + i, [7.0] * 12, i % 2) for i in range(90)] + [(820, [7.0] * 12, 1)]  # ties and a repeated id
    rows += ODD
    for sizes in ({}, {"block_rows": 16, "rings": 5, "pivots": 7}):
        got = sorted(tuple(r) for r in distance_keys.hard_negatives(vectors(rows), F.col("vec_id") % 20 == 0, **sizes).collect())
        assert got == brute(rows, 20)
    assert brute(rows, 20)


def test_few_rows_and_empty_tables(vectors):
    asks = F.col("vec_id") % 20 == 0
    assert distance_keys.hard_negatives(vectors([]).where("false"), asks).collect() == []
    assert distance_keys.hard_negatives(vectors([(20, [1.0], 1)]), asks).collect() == []
    few = [(20, [10.0, 0.0], 1), (21, [9.0, 5.0], 1), (22, [9.0, 1.0], 2), (23, [8.0, 1.0], 2), (24, [-3.0, 0.0], 1), (25, [1.0, 1.0], 2)]
    assert sorted(tuple(r) for r in distance_keys.hard_negatives(vectors(few), asks).collect()) == brute(few, 20) == [(20, 21, 1, 22, 90, 90), (20, 21, 2, 23, 90, 80)]


def test_scores_beyond_exact_doubles_raise(vectors):
    with pytest.raises(ValueError, match="2\\^53"):
        distance_keys.hard_negatives(vectors([(20, [1e9, 0.0], 1)]), F.col("vec_id") % 20 == 0)


def test_no_row_lies_outside_the_bounds_of_its_ring():
    r = np.random.default_rng(2)
    x, q = np.floor(50 * r.standard_normal((300, 9))), np.floor(70 * r.standard_normal((30, 9)))
    longest = np.sqrt((x * x).sum(1).max())
    from tessera.llm.vectors import nearest

    full = distance_keys.raised(x, longest)
    pivots = full[:5]
    which, far = nearest(full, pivots)
    low, high = distance_keys.bounds(q, pivots, np.arange(5), np.array([far[which == p].min() for p in range(5)]), np.array([far[which == p].max() for p in range(5)]), longest)
    s = q @ x.T
    assert (s >= low[:, which]).all() and (s <= high[:, which]).all()
    one_low, one_high = distance_keys.bounds(q, pivots, which, far, far, longest)
    assert (s >= one_low).all() and (s <= one_high).all() and (one_high < high[:, which]).any()
