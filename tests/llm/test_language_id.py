import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id as L

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then the other dog is with them this that which while ",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und dann ist der andere Hund mit ihnen nicht auch ",
    "fr": "le renard brun rapide saute par-dessus le chien paresseux et puis l'autre chien est avec eux où été ",
}


def rows_of(odd):
    rows = [(1000 + i, " ".join(t.split()[i % 7 :] * (1 + i % 3)), lang) for i in range(40) for lang, t in [list(TEXTS.items())[i % 3]]]
    return [(*r, None) for r in odd] + rows + [(2000, "der Hund und der Fuchs", None), (2001, "4711 !!", "en")]


def test_predictions(docs, odd):
    rows = rows_of(odd)
    d = docs(rows)
    got = L.identify(d, L.train(d)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows if i and 1000 <= i < 2000)
    assert by[2000]["lang_pred"] == "de"
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 6, 2001)] == ["und"] * 5
    assert by[4]["lang_pred"] in TEXTS
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)


def test_nothing_to_learn_from(docs, odd):
    d = docs([(*r, None) for r in odd])
    assert {r["lang_pred"] for r in L.identify(d, L.train(d)).collect()} == {"und"}
    assert L.identify(docs([]).where("false"), None).collect() == []


def counts(texts):
    data, _, key = L.symbols(pa.array(texts))
    return np.unique(key.astype(np.int64) << 8 | data, return_counts=True)


def test_code_lengths_against_walking_the_trees():
    """Method C with exclusion, written down as it is defined, byte by byte."""
    train = {k: [t * 2, t[5:40]] for k, t in TEXTS.items()}
    model = L.freeze({k: counts(v) for k, v in train.items()})
    trees = {}
    for lang, texts in train.items():
        tree = {}
        for t in texts:
            b = bytes(L.LETTERS[np.frombuffer(t.lower().encode(), np.uint8)])
            for i, s in enumerate(b):
                past = (b"   " + b[:i])[-3:]
                for order in range(4):
                    node = tree.setdefault(past[3 - order :], {})
                    node[s] = node.get(s, 0) + 1
        trees[lang] = tree

    def distribution(tree, past):
        p = np.full(256, 1 / 256)
        for order in range(4):
            node = tree.get(past[3 - order :])
            if node is None:
                break
            total, seen = sum(node.values()) + len(node), list(node)
            rest = 1 - p[seen].sum()
            new = p / rest * (len(node) / total)
            for s in seen:
                new[s] = node[s] / total
            p = new
        return p

    text = "the other Hund, où est le chien 12?"
    got = model.code_lengths(pa.array([text, "", "é"]))
    for k, lang in enumerate(model.languages):
        b = bytes(L.LETTERS[np.frombuffer(text.lower().encode(), np.uint8)])
        want = -sum(math.log2(distribution(trees[lang], (b"   " + b[:i])[-3:])[s]) for i, s in enumerate(b))
        assert got[0, k] == pytest.approx(want, rel=1e-12)
    assert (got[1] == 0).all()


def test_blocks_and_long_texts_change_nothing(monkeypatch):
    model = L.freeze({k: counts([t]) for k, t in TEXTS.items()})
    texts = pa.array(["", "the dog", None, "der Hund " * 300, "é", "", "où est le chien"])
    want = model.code_lengths(texts)
    monkeypatch.setattr(L, "BLOCK", 64)
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-12)
    assert all(np.allclose(model.code_lengths(texts.slice(k, 1))[0], want[k]) for k in range(len(texts)))


def test_every_context_counts_and_every_language_has_a_text(docs):
    """One long text only, past any share of the sample; a context that occurs once decides."""
    rows = [(i, f"{'abc def ' * 3000} qx{'yz'[i % 2]}", ("aa", "bb")[i % 2]) for i in range(10)]
    d = docs(rows)
    model = L.train(d, mb_per_language=0.0001)
    assert model.languages == ["aa", "bb"]
    bits = L.train(d).code_lengths(pa.array(["qxy", "qxz"]))
    assert bits[0, 0] < bits[0, 1] and bits[1, 1] < bits[1, 0]
    with pytest.raises(ValueError):
        L.train(d, max_model_mb=0.001)


def test_repeated_rows(docs):
    rows = [(1, TEXTS["en"], "en"), (2, TEXTS["fr"], "fr")] * 5
    got = L.identify(docs(rows), L.train(docs(rows))).collect()
    assert len(got) == 10 and len({(r["doc_id"], r["lang_pred"], r["score"]) for r in got}) == 2


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(d, L.train(d)).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
