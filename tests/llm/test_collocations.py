import collections
import random
import re

import numpy as np
import pytest

from tessera.llm import collocations as c
from tessera.llm.perfect_hash import PerfectHash


def brute(rows, longest=5, least=100, first=2000):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if a >= least}
    gone = set()
    for p, a in often.items():
        for k in range(2, len(p) - 1):
            gone |= {q for i in range(1, len(p) - k + 1) if often[q := (p[0], *p[i : i + k])] <= a}
    out = collections.defaultdict(list)
    for p, a in often.items():
        if len(p) > 2 and p not in gone:
            cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1))


def got(*a, **kw):
    return sorted(tuple(r) for r in c.collocations(*a, **kw).collect())


def some(seed, n=300):
    r = random.Random(seed)
    phrases = ["New York City", "au fur et à mesure", "x y", "ba ba", "one two three four five six", "naïve Bayes"]
    rows = []
    for i in range(n):
        words = [r.choice([r.choice(phrases), f"w{r.randint(0, 40)}", "The", "ba"]) + r.choice(["", "", "", ",", ".", "\n", "\t", "?!"]) for _ in range(r.randint(0, 60))]
        rows.append((i, " ".join(words), r.choice(["en", "fr", None])))
    return rows


def test_against_brute_force(docs, odd):
    rows = [(*r, None)[:3] for r in odd] + some(1) + [(900, "ba " * 500, "en"), (901, "z\x00q ba z\x00q ba " * 90, "de"), (902, "Ein Ärger Ein Ärger. " * 120, "de")]
    assert len(brute(rows)) > 10
    assert got(docs(rows)) == brute(rows)


def test_small_segments_passes_chunks_and_rows(docs):
    rows = some(2, 150)
    assert got(docs(rows), longest=4, least=12, first=30, sizes=c.Sizes(60, 100, 256, 64, 50)) == brute(rows, 4, 12, 30)


def test_tables_without_phrases(docs):
    assert got(docs([]).where("false")) == []
    assert got(docs([(1, None, "en"), (2, "a b", "en")])) == []


def test_candidates_are_sent_once(spark, docs):
    """Rare phrases that share a hash with frequent ones are ruled out, and tasks do not all send what all of them have."""
    r = random.Random(7)
    rows = [(i, " ".join(f"p{r.randrange(30)} q{r.randrange(400)}" for _ in range(40)) + " a b c d. e f g h", "en") for i in range(400)]
    frequent = [p for p, a in collections.Counter(w for _, t, _ in rows for s in t.split(".") for w in zip(s.split(), s.split()[1:])).items() if a >= 100]
    every = c.stored(c.word_counts(docs(rows, 8).selectExpr("lang", "text", "cast(doc_id as int) as place")), "words")
    words = c.Slots(every, c.Sizes(), halves=True)
    seq = c.stored(c.encoded(docs(rows, 8).selectExpr("lang", "text", "cast(doc_id as int) as place"), words, 1 << 17), "sequences").where("slot is not null").selectExpr("slot", "cast(null as binary) as word").repartition(8)
    found = c.candidates(seq, c.filters(seq, 100, 1 << 12, 1 << 8), 1 << 8)
    assert len(frequent) == 6 and len(frequent) <= found.count() <= 40
    assert found.count() == found.select("key").distinct().count()


def test_phrases_of_one_hash_are_all_found(docs):
    """With eight hashes all phrases share them with others."""
    rows = some(3, 120)
    assert got(docs(rows), longest=3, least=10, first=40, sizes=c.Sizes(60, 100, 8, 8, 50)) == brute(rows, 3, 10, 40)


def test_perfect_hash_is_minimal_and_knows_strangers():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        made = PerfectHash(keys)
        assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
        assert (made.slots(np.setdiff1d(r.integers(0, 1 << 63, 5000).astype(np.uint64), keys)) == -1).all()
    with pytest.raises(ValueError):
        PerfectHash(np.array([7, 7], np.uint64))


def test_segments_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    keys = np.array([0, 1, -1, 2**62, -(2**63), 123456789012345], np.int64)
    found = spark.createDataFrame([(int(k),) for k in keys], "key long").select(F.pmod(F.xxhash64("key"), F.lit(7)).alias("s")).collect()
    assert c.spread(keys.view(np.uint64), 7).tolist() == [r["s"] for r in found]
