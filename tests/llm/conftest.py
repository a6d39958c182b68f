import random

import pytest

#: Names that operators use inside; extra columns of these names must not matter.
CLASH = "batch string, key string, fp string, part string, rank string, salt string, c0 string, length string"


@pytest.fixture
def docs(spark):
    """docs(rows): a documents table of (doc_id, text[, lang]) with extra columns."""

    def make(rows, parts: int = 3):
        rows = [(*r, None)[:3] if len(r) < 3 else r for r in rows]
        full = [(*r, "s", len(r[1] or ""), *"abcdefgh") for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(parts)

    return make


@pytest.fixture
def words():
    """words(n, seed): n words of a small invented vocabulary."""

    def make(n: int, seed: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(("ba", "co", "di", "fu", "gé", "lo", "mi", "nu", "pa", "ro")) + r.choice(("n", "st", "r", "la", "", ",")) + r.choice(("", "ti", "mo")) for _ in range(n))

    return make


#: Null, empty, blank, tiny, repeated and long texts that every operator must take.
ODD = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c"), (4, "x"), (5, "x"), (5, "x"), (None, "no id at all"), (6, "12 34 §§"), (7, "é" * 3000 + " " + "word " * 4000)]


@pytest.fixture
def odd():
    return list(ODD)
