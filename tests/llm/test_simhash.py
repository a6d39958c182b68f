import random

import numpy as np
import pytest
import xxhash

from tessera.llm.components import components
from tessera.llm.simhash import fingerprint, forest, links, simhash


def slow(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, ids):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    of = {}
    for i, d in enumerate(ids):
        if d is not None:
            of[root(i)] = min(d, of.get(root(i), d))
    return [of.get(root(i)) for i in range(len(ids))]


def test_against_brute_force(docs, words, odd):
    base = words(600, 1).split()
    rows = odd + [(100 + i, words(3 + 40 * i, i)) for i in range(10)]
    for i in range(12):
        w = list(base)
        for k in range(i // 3):
            w[(i * 53 + k * 97) % len(w)] = f"changed{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(50, "A b C"), (51, "a  B\tc"), (52, "Ä b c"), (53, "ä b c")]
    values = [slow(t) for _, t in rows]
    want = sorted((d, f"{v:016x}", c) for (d, _), v, c in zip(rows, values, groups(values, [d for d, _ in rows])) if d is not None)
    got = [tuple(r) for r in simhash(docs(rows)).collect()]
    assert sorted(g for g in got if g[0] is not None) == want
    assert len(got) == len(rows)
    assert len({g[2] for g in got if g[0] is not None and g[0] >= 200}) < 12


def test_empty_table(docs):
    assert simhash(docs([]).where("false")).collect() == []


@pytest.mark.parametrize(("seed", "crowded"), [(0, 2048), (1, 2048), (0, 3), (1, 3), (2, 40)])
def test_links_join_all_within_three_bits(spark, seed, crowded):
    """Also where nearly every half is crowded, so that its keys are cut further."""
    r = random.Random(seed)
    fps = {0}
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))))
    shared = r.getrandbits(32)
    fps |= {shared << 32 | r.getrandbits(9) << 11 for _ in range(60)} | {r.getrandbits(8) << 50 | shared for _ in range(60)}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    made = links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowded).collect()
    assert all((int(np.int64(a).view(np.uint64)) ^ int(np.int64(b).view(np.uint64))).bit_count() <= 3 for a, b in made)
    comp = {n: c for n, c in components(spark.createDataFrame(made, "u long, v long")).collect()}
    got = [comp.get(f, f) for f in signed]
    want = groups(list(fps), signed)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_a_crowded_half_is_spread(spark):
    """20,000 fingerprints with one half: no group of keys holds more than a small part of them."""
    from tessera.llm.simhash import crowded_keys, finer_keys, variants

    r = random.Random(4)
    fps = spark.createDataFrame([(77 << 32 | v,) for v in r.sample(range(1 << 32), 20000)], "fp long")
    crowd = crowded_keys(fps, 2048)
    assert crowd.count() == 33
    largest = finer_keys(variants(fps).join(crowd, "key", "left_semi")).groupBy("key", "sub").count().agg({"count": "max"}).first()[0]
    assert largest < 40


def test_forest_is_a_forest():
    centre = np.int64(12345)
    fps = np.unique(np.array([centre ^ np.int64(1 << a) ^ np.int64(1 << b) for a in range(60) for b in range(a)]))
    found = forest(fps, None, block=64)
    assert len(found) == len(fps) - 1


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_fingerprint_of_long_text(words):
    t = words(3000, 4)
    assert fingerprint(t) % (1 << 64) == slow(t)


@pytest.mark.parametrize("seed", range(4))
def test_forest_joins_what_brute_force_joins(seed):
    r = np.random.default_rng(seed)
    centre = r.integers(0, 1 << 62, 5)
    fps = np.unique(np.concatenate([c ^ (np.int64(1) << r.integers(0, 64, (80, k))).sum(axis=1) for c in centre for k in (1, 2, 3)]).astype(np.int64))
    sides = (fps >> 5 & 1).astype(bool)
    for s in (None, sides):
        pairs = [(i, j) for i in range(len(fps)) for j in range(i) if ((int(fps[i]) ^ int(fps[j])) & (1 << 64) - 1).bit_count() <= 3 and (s is None or s[i] != s[j])]
        label = list(range(len(fps)))
        at = {int(f): i for i, f in enumerate(fps)}

        def joined(edges):
            lab = list(label)
            changed = True
            while changed:
                changed = False
                for a, b in edges:
                    if lab[a] != lab[b]:
                        lab[a] = lab[b] = min(lab[a], lab[b])
                        changed = True
            return lab

        found = [(at[a], at[b]) for a, b in forest(fps, s, block=32)]
        assert joined(found) == joined(pairs) and len(found) == len(fps) - len(set(joined(pairs)))
