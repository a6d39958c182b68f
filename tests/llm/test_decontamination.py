import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontamination as D


@pytest.fixture
def items(spark, words):
    return spark.createDataFrame([(i, words(40, 1000 + i)) for i in range(5)] + [(7, words(9, 2000)), (8, "two words"), (9, None), (None, "x y z"), (10, "")], "item_id long, text string")


def planted(words):
    item = words(40, 1002).split()
    swapped = [w if i % 9 else f"other{i}" for i, w in enumerate(item)]
    rows = [(100 + i, words(200, i)) for i in range(6)]
    rows += [(1, f"{words(30, 50)} {' '.join(item)} {words(30, 51)}"), (2, f"{words(30, 52)} {' '.join(swapped)} {words(10, 53)}"), (3, " ".join(item).upper().replace(" ", ", ")), (4, " ".join(item[10:26])), (5, " ".join(item[10:18])), (6, f"a {words(9, 2000)} b"), (8, "two words"), (9, " ".join(item[:40:2]))]
    return rows


def test_planted(docs, items, words, odd):
    rows = [r for r in odd if r[0] not in (1, 2, 3, 4, 5, 6)] + [(30, None), (31, ""), (32, " \n"), (33, "x"), (33, "x")] + planted(words)
    got = {r["doc_id"]: r for r in D.contaminated(docs(rows), items).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert got[1]["item_ids"] == [2] and got[1]["longest"] == len(words(40, 1002).replace(",", " ").split())
    assert 13 <= got[2]["longest"] < got[1]["longest"]


def test_rows_that_stay_keep_all_columns(docs, items, words):
    d = docs(planted(words) + [(40, None), (None, "")])
    kept = D.clean(d, items)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {100, 101, 102, 103, 104, 105, 5, 8, 9, 40, None}


def test_the_join_of_large_benchmarks_gives_the_same(docs, items, words):
    d = docs(planted(words) + [(None, words(40, 1003)), (40, None), (41, "")])
    one, joined = (sorted((str(r["doc_id"]), r["n_overlaps"], r["item_ids"], r["longest"], r["overlaps"]) for r in D.contaminated(d, items, block_mb=mb).collect()) for mb in (8, 0.0002))
    assert one == joined and len(one) == 6
    kept = D.clean(d, items, block_mb=0.0002)
    assert kept.columns == d.columns and sorted(map(str, kept.collect())) == sorted(map(str, D.clean(d, items).collect()))


def defined(text, items, min_match=13, similarity=0.8):
    """For each item whether any stretch of any alignment is an overlap, by trying them all."""
    plain = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    w, out = plain(text), set()
    for i, t in items:
        v = plain(t)
        need = D.needed(len(v), min_match, similarity)
        for shift in range(-len(v) + 1, len(w)):
            a, z = max(0, -shift), min(len(v), len(w) - shift)
            same = np.array(w[a + shift : z + shift]) == np.array(v[a:z])
            total = np.concatenate([[0], np.cumsum(same)])
            if len(v) >= 8 and total[-1] >= need and any(total[y] - total[x] >= max(need, similarity * (y - x) - 1e-9) for x in range(len(same)) for y in range(x + need, len(same) + 1)):
                out.add(i)
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_contaminated_against_the_definition(docs, spark, words, seed):
    """Random substitutions at all rates, in items of all lengths, against trying every stretch."""
    r = random.Random(seed)
    items = [(i, words(r.randrange(6, 34), 100 * seed + i).replace(",", " ")) for i in range(14)]
    rows = []
    for k in range(60):
        w = r.choice(items)[1].split()
        rate = r.choice((0, 0.05, 0.12, 0.2, 0.25))
        w = [x if r.random() >= rate else f"other{k}" for x in w][r.randrange(3) : len(w) - r.randrange(3)]
        rows.append((k, f"{words(5, 900 + k)} {' '.join(w)} {words(6, 950 + k)}"))
    want = {k: defined(t, items) for k, t in rows}
    table = spark.createDataFrame(items, "item_id long, text string")
    for mb in (8, 0.0001):
        got = {x["doc_id"]: set(x["item_ids"]) for x in D.contaminated(docs(rows), table, block_mb=mb).collect()}
        assert got == {k: v for k, v in want.items() if v}
    assert 10 < len(got) < 60


def test_all_stretches_of_an_alignment():
    same = np.array([1] * 20 + [0] * 30 + [1] * 15 + [0] + [1] * 4 + [0] * 9 + [1] * 12, bool)
    assert D.stretches_in(same, 13, 0.8) == [(0, 20, 20), (50, 70, 19)]


def test_repeated_words_give_alignments_not_pairs():
    """20,000 equal words against an item of 1,000: as many alignments as there are shifts."""
    index = D.Index([(1, "w " * 1000)], 8)
    found = index.alignments(*D.hashed_words(pa.array(["w " * 20000, "w " * 900])))
    assert found.shape[1] == (20000 - 9 + 1 + 1000 - 9) + (900 - 9 + 1 + 1000 - 9)
    assert D.overlaps_in(pa.array(["w " * 20000]), index, 13, 0.8, one=True)[0]


def test_query_against_the_definition(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: set(r["item_ids"]) for r in D.op1_decontamination(spark, d).collect()}
    known = {w for _, t in items for w in t.lower().split()}
    some = [(i, t) for i, t in docs if i in got or len(known & set((t or "").lower().split())) > 12][:60]
    for i, t in some:
        assert defined(t or "", items) == got.get(i, set()), i


def test_empty_tables(docs, items, words):
    assert D.contaminated(docs([]).where("false"), items).collect() == []
    assert D.contaminated(docs(planted(words)), items.where("false")).collect() == []
    assert D.clean(docs(planted(words)), items.where("false")).count() == len(planted(words))


def test_masks_find_any_single_substitution():
    r = random.Random(1)
    words = np.array([r.getrandbits(64) for _ in range(30)], np.uint64)
    for k in range(30):
        other = words.copy()
        other[k] ^= np.uint64(1)
        assert any((D.seed_hashes(words, m) == D.seed_hashes(other, m)).any() for m in D.MASKS)


def test_best_overlap_against_brute_force():
    r = random.Random(2)
    for _ in range(50):
        same = np.array([r.random() < 0.7 for _ in range(25)])
        a, b, n = D.best_overlap(same, 4.0)
        score = lambda x, y: sum(1 if s else -4 for s in same[x:y])
        assert score(a, b) == max(score(x, y) for x in range(26) for y in range(x, 26)) and n == same[a:b].sum()


def test_best_overlap_with_enough_matches_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        same = np.array([r.random() < 0.8 for _ in range(24)])
        for need in (0, 7, 13, 25):
            a, b, n = D.best_overlap(same, 4.0, need)
            score = {(x, y): sum(1 if s else -4 for s in same[x:y]) for x in range(25) for y in range(x, 25) if same[x:y].sum() >= need}
            assert (a, b, n) == (0, 0, 0) if not score else score[a, b] == max(score.values()) and n == same[a:b].sum() >= need


def held(words, item):
    """Whether a copy of an item among other words is reported, and with how many equal words."""
    index = D.Index([(1, " ".join(item))], 8)
    text = " ".join(["some", "words", "before", *words, "and", "others", "behind"])
    return max((x["matched"] for x in D.overlaps_in(pa.array([text]), index, 13, 0.8)[0]), default=0)


@pytest.mark.parametrize("n", range(8, 25))
def test_a_whole_copy_with_one_changed_word_is_found_wherever_it_is(n):
    item = [f"w{i}" for i in range(n)]
    assert held(item, item) == n
    for k in range(n):
        assert held([*item[:k], "other", *item[k + 1 :]], item) >= D.needed(n, 13, 0.8), k


@pytest.mark.parametrize("n", range(8, 15))
def test_short_items_are_found_with_every_fifth_word_changed(n):
    item, k = [f"w{i}" for i in range(n)], n - D.needed(n, 13, 0.8)
    for at in itertools.combinations(range(n), k):
        assert held([w if i not in at else f"other{i}" for i, w in enumerate(item)], item), at
    assert not held([w if i > k else f"other{i}" for i, w in enumerate(item)], item)


def test_other_parameters_keep_seeds_that_find_all():
    item = [f"w{i}" for i in range(12)]
    for words, similarity, min_match in ((12, 0.6, 13), (6, 0.8, 13), (12, 0.8, 5)):
        index = D.Index([(1, " ".join(item[:words]))], 5, min_match, similarity)
        need = D.needed(words, min_match, similarity)
        for at in itertools.combinations(range(words), words - D.needed(words, 99, similarity)):
            text = " ".join(w if i not in at else f"other{i}" for i, w in enumerate(item[:words]))
            assert any(x["matched"] >= need for x in D.overlaps_in(pa.array([text]), index, min_match, similarity)[0]), (words, at)


def best_without_a_hit(masks, need, penalty=4):
    """The highest score of a stretch of any length that has need matches and no mask's words all equal. A state is the last words, newest lowest."""
    n = 1 << max(map(len, masks)) - 1
    states, after = np.arange(n), np.arange(2 * n)
    hit = np.any([after & int(m, 2) == int(m, 2) for m in masks], axis=0)
    best = np.full((need + 1, n), -(10**6))
    best[0, 0] = 0
    for _ in range(1000):
        new = best.copy()
        for same in (0, 1):
            to = states << 1 | same
            for m in range(need + 1):
                score = np.where(hit[to] & bool(same), -(10**6), best[m] + (1 if same else -penalty))
                np.maximum.at(new[min(need, m + same)], to & n - 1, score)
        if (new == best).all() or new[need].max() >= 0:
            return new[need].max()
        best = new
    return 0


def test_masks_hit_every_overlap_of_any_length():
    assert best_without_a_hit(D.MASKS, 13) < 0
    assert best_without_a_hit(("1" * 5,), 13) >= 0


@pytest.mark.parametrize("n,changed", [(15, 3), (16, 3), (20, 4)])
def test_long_items_are_found_however_the_changed_words_lie(n, changed):
    item = np.arange(1, n + 1, dtype=np.uint64)
    for at in itertools.combinations(range(n), changed):
        other = item.copy()
        other[list(at)] += np.uint64(1000)
        assert any((D.seed_hashes(item, m) == D.seed_hashes(other, m)).any() for m in D.masks_of(n, 13, 0.8)), at


def test_neighbouring_changed_words_do_not_hide_an_overlap():
    for n, at in ((20, (9, 10)), (23, (10, 11)), (24, (5, 10, 11, 17))):
        item = [f"w{i}" for i in range(n)]
        assert held([w if i not in at else f"other{i}" for i, w in enumerate(item)], item) >= 13


def test_many_rows_without_an_id_are_told_apart_by_text(docs, words, items, monkeypatch):
    rows = [(None, f"{words(3, i)} {words(40, 1000)}") for i in range(30)] + [(None, words(40, 5000 + i)) for i in range(30)] + [(None, f"{words(3, 0)} {words(40, 1000)}")]
    found = []
    for mb, hits in ((8, None), (0, None), (0, 0)):
        if hits is not None:
            monkeypatch.setattr(D, "BROADCAST_HITS", hits)
        got = D.contaminated(docs(rows), items, block_mb=mb).collect()
        assert len(got) == 30 and all(r["doc_id"] is None and r["item_ids"] == [0] for r in got)
        found.append(sorted(map(str, got)))
    assert found[0] == found[1] == found[2]


def test_bitmap_by_segments(spark, monkeypatch):
    import numpy as np

    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(5)
    monkeypatch.setattr(D, "SEGMENT_BITS", 1 << 10)
    found = D.bitmap(df, 14, 3000)
    place = keys.view(np.uint64) >> np.uint64(64 - 14)
    want = np.zeros(1 << 14, bool)
    want[place.astype(np.int64)] = True
    assert (np.unpackbits(found, bitorder="little").astype(bool) == want).all()
