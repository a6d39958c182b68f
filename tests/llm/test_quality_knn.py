import numpy as np

from tessera.llm import quality_knn as Q


def test_held_out_rows_and_clean_texts(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.classify(d, Q.train(d, labels)).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.93
    assert np.mean([r["predicted"] for r in got if r["quality"] == 1]) >= 0.99


def test_odd_texts(spark, docs, words, odd):
    rows = odd + [(100 + i, words(60, i)) for i in range(40)] + [(200 + i, words(40, i).upper().replace(" ", "!! ")) for i in range(40)]
    d = docs(rows)
    labels = spark.createDataFrame([(100 + i, 1, "t") for i in range(40)] + [(200 + i, 0, "t") for i in range(40)] + [(100, None, "t"), (None, 1, "t"), (999, 1, "t")], "doc_id long, quality int, text string")
    space = Q.train(d, labels)
    got = Q.classify(d, space).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert all(by[100 + i] == 1 and by[200 + i] == 0 for i in range(40))
    kept = Q.keep_good(d, space)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"] and r["doc_id"] >= 100} == set(range(100, 140))
    assert all(r["score"] == 0.5 for r in Q.classify(d, Q.train(d, labels.where("false"))).collect())
    assert Q.classify(docs([]).where("false"), space).collect() == []


def test_scores_against_a_plain_loop():
    r = np.random.default_rng(1)
    counts = r.gamma(1.0, 1.0, (30, Q.TERMS)).astype(np.float32)
    space = Q.Space(np.ones(Q.TERMS, np.float32), np.eye(Q.TERMS, 20, dtype=np.float32), np.zeros((0, 20), np.float32), (r.random(30) < 0.6).astype(float))
    space.vectors = space.project(counts)
    got = space.score(counts[:5], 7)
    for k in range(5):
        z = space.project(counts[k : k + 1])[0]
        near = sorted(((float(z @ v), y) for v, y in zip(space.vectors, space.labels)), reverse=True)[:7]
        assert abs(got[k] - sum(s * y for s, y in near) / sum(s for s, _ in near)) < 1e-3


def test_terms_as_they_are_defined(words):
    """Sizes and marks counted by hand; words and shapes by their numbers and by which texts share them."""
    import pyarrow as pa

    texts = ["", None, "ab ab Ab x1 ??!", "one two three four five six one two three four five", words(70, 1)]
    t = Q.term_counts(pa.array(texts, pa.string()))
    for row, text in zip(t, texts):
        w = (text or "").split()
        assert row[: Q.WORDS].sum() == row[Q.WORDS : Q.WORDS + Q.SHAPES].sum() == len(w)
        same = sum(a.lower() == b.lower() for a, b in zip(w[1:], w))
        lower = [x.lower() for x in w]
        again = [k for k in range(len(w) - 4) if sum(lower[k : k + 5] == lower[j : j + 5] for j in range(len(w) - 4)) > 1]
        marks = row[Q.WORDS + Q.SHAPES :]
        assert marks[2] == same and (marks[1] == len(again) or same) and marks[:8].sum() == len(w)
        assert marks[8 + min(int(np.log2(len(w) + 1)), Q.MARKS - 9)] == 1 and marks[8:].sum() == 1
    a, b = Q.term_counts(pa.array(["Haus haus HAUS", "haus haus haus"]))
    assert (a[: Q.WORDS] == b[: Q.WORDS]).all() and not (a[Q.WORDS : Q.WORDS + Q.SHAPES] == b[Q.WORDS : Q.WORDS + Q.SHAPES]).all()


def test_latent_space_and_repeated_ids(spark, docs, words):
    """Directions are the leading singular vectors; an id that many rows repeat is learned from once."""
    rows = [(i, words(30 + i, i)) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(7, 0)] * 5, "doc_id long, quality int")
    space = Q.train(docs(rows), labels, dimensions=6)
    again = Q.train(docs(rows + [(9, words(39, 9))] * 40), labels, dimensions=6)
    assert len(space.labels) == len(again.labels) <= 30
    assert np.allclose(np.sort(space.vectors, axis=0), np.sort(again.vectors, axis=0), atol=1e-4) or np.allclose(np.abs(space.vectors @ space.vectors.T), np.abs(again.vectors @ again.vectors.T), atol=1e-3)
    import pyarrow as pa
    import zlib

    known = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    x = Q.weighted(Q.term_counts(pa.array(known)), space.weights)
    _, _, v = np.linalg.svd(x.astype(np.float64), full_matrices=False)
    assert np.allclose(np.abs(v[:6] @ space.directions), np.eye(6), atol=1e-3)
