import random

import corpus_pipeline
from tessera.llm.near_copies import near_copies


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def slow(rows):
    """The rows that stay, by comparing all."""
    rows = sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {r for i, r in enumerate(rows) if parent[i] == i}


def changed(base, share, seed):
    r, out = random.Random(seed), base.split()
    for k in r.sample(range(len(out)), int(share * len(out))):
        out[k] = f"other{r.randrange(9999)}"
    return " ".join(out)


def test_stage_against_brute_force(spark, docs, odd):
    r = random.Random(4)
    rows = [x for x in odd if x[0] != 5] + [(5, "x"), (5, "x"), (5, "another text of one id"), (50, "A b  c"), (51, "a b c")]
    for g in range(30):
        base = " ".join(f"w{r.randrange(3000)}" for _ in range(r.choice((40, 150, 600))))
        rows += [(1000 + 20 * g + k, changed(base, share, 100 * g + k)) for k, share in enumerate((0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.06, 0.1))]
    d = docs(rows)
    got = [(x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, d, "").collect()]
    want = slow(rows)
    named = [x for x in got if x[0] is not None]
    assert set(named) == want and len(named) == len(want)
    assert len(got) - len(named) == sum(x[0] is None for x in rows)


def test_blocks_of_a_cluster_and_empty_tables(docs, monkeypatch):
    from tessera.llm import near_copies as N

    monkeypatch.setattr(N, "BLOCK", 4)
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, changed(base, 0.01, i)) for i in range(40)] + [(99, "something else")]
    want = {i for i, _ in slow(rows)}
    assert {x["doc_id"] for x in near_copies(docs(rows)).collect()} == want
    monkeypatch.setattr(N, "BLOCK", 512)
    monkeypatch.setattr(N, "BLOCK_BYTES", 8 * 300 * 3)  # three texts: blocks are cut by bytes
    sizes = []
    made = N.stored
    monkeypatch.setattr(N, "stored", lambda df, name: (out := made(df, name), sizes.append(out) if name == "clusters" else None)[0])
    assert {x["doc_id"] for x in near_copies(docs(rows)).collect()} == want
    assert sizes[0].agg({"size": "max"}).first()[0] <= 300 and sizes[0].count() == 40
    assert near_copies(docs([]).where("false")).collect() == []


def test_simhash_alone_finds_its_pairs(docs, monkeypatch):
    """Texts within 3 bits are candidates without any band, by deletion-variant links; exact similarity decides on them."""
    import numpy as np

    from tessera.llm import near_copies as N
    from tessera.llm.simhash import fingerprint

    names = iter(range(1 << 40))
    monkeypatch.setattr(N, "band_keys", lambda hashes, begin: np.array([[next(names) for _ in range(N.BANDS)] for _ in np.flatnonzero(np.diff(begin))], np.uint64).reshape(-1, N.BANDS))
    r = random.Random(11)
    rows = []
    for g in range(40):
        base = " ".join(f"w{r.randrange(3000)}" for _ in range(400))
        rows += [(10 * g, base), (10 * g + 1, changed(base, 0.005, g))]
    bits = {g: (fingerprint(rows[2 * g][1]) ^ fingerprint(rows[2 * g + 1][1])) & (1 << 64) - 1 for g in range(40)}
    near = {g for g in range(40) if bits[g].bit_count() <= 3}
    assert 10 < len(near) < 40 and any(bits[g] for g in near)
    got = {x["doc_id"] for x in near_copies(docs(rows, 1)).collect()}
    assert got == {i for i, _ in rows} - {10 * g + 1 for g in near}
