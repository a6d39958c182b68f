import collections
import math
import re

import pyarrow as pa
import pytest

from tessera.llm import fertility as T
from tessera.llm import tokens


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = [False] * len(w)
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            again[i : i + 5] = [True] * 5
    seen, lines = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, sum(again), len(w) < 10 or 100 * sum(again) > 20 * len(w)


def test_base_counts(docs, words, odd):
    rows = odd + [(100 + i, words(3 + i * 9, i)) for i in range(12)] + [(200, "a b c d e f a b c d e g h"), (201, "x\nx\n \n\nx \ny"), (202, "#a *b $c %d &e |f <g> h"), (203, "日本 語の テキスト\n" * 3)]
    got = T.judged(docs(rows)).collect()
    want = collections.Counter((d, *base(t)) for d, t in rows)
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert T.judged(docs([]).where("false")).collect() == []


def test_measures_against_the_vocabularies(words):
    texts = [words(50, 3) + " ☃ ☃", "", None, "one", "alpha\n\n\n    beta\tgamma", "  "]
    m = T.measure(pa.array(texts), T.Vocabularies())
    pieces, ranks = tokens.piece_bpe(), tokens.byte_bpe()
    for k, t in enumerate(texts):
        ids = pieces.encode(t or "")
        assert m["n_pieces"][k] == len(ids) and m["n_fallback"][k] == sum(pieces.is_byte(i) for i in ids)
        assert m["n_byte_tokens"][k] == len(ranks.encode_ordinary(t or ""))
        c = collections.Counter(ids)
        assert m["entropy"][k] == pytest.approx(-sum(n / len(ids) * math.log2(n / len(ids)) for n in c.values()) if ids else 0)


def quartiles(values):
    """Least bins that a quarter and three quarters of the values lie in or below."""
    bins = sorted(math.floor(v * T.STEP + 0.5) for v in values)
    return tuple(next(b for k, b in enumerate(bins) if k + 1 >= q * len(bins)) / T.STEP for q in (0.25, 0.75))


def test_bands_and_verdicts_as_they_are_defined(docs, words, monkeypatch):
    """Every verdict computed again from the measures: quartiles per language and length class, the script's for small bands."""
    rows = [(i, words(4 + i * 7 % 260, i) + (" ☃" * (i % 9 == 0) * 30), ("xx", "yy")[i % 2]) for i in range(220)] + [(900 + i, words(90, 900 + i), "zz") for i in range(7)] + [(990, "ἄνθρωπος " * 3 + words(12, 1), None), (991, None, "xx"), (992, "", None)]
    got = T.judged(docs(rows)).collect()
    text = dict((i, (t, lang)) for i, t, lang in rows)
    of = {}
    for r in got:
        t, lang = text[r["doc_id"]]
        script = T.script(t)
        size = next((k for k, part in enumerate((1, 2, 4)) if r["n_pieces"] >= 200 / part), 3)
        of[r["doc_id"]] = (lang or script, script, size)
    assert len(of) == len(rows)
    judged = [r for r in got if r["n_pieces"] >= 200 or r["n_words"] >= 10]
    for r in got:
        band, script, size = of[r["doc_id"]]
        wrong = False
        for c, sign, spread in (("chars_per_piece", -1, 2), ("chars_per_byte_token", -1, 2), ("fallback_share", 1, 2), ("entropy_share", -1, 4)):
            own = [x for x in judged if of[x["doc_id"]][0] == band and of[x["doc_id"]][2] == size]
            wide = [x for x in judged if of[x["doc_id"]][1] == script and of[x["doc_id"]][2] == size]
            if r[c] is None or not own:
                continue
            share = len(own) / (len(own) + 50)
            (low, high), (wide_low, wide_high) = quartiles([x[c] for x in own]), quartiles([x[c] for x in wide])
            mixed = lambda a, b: share * a + (1 - share) * b  # noqa: B023, E731
            margin = math.sqrt(1 + 50 / len(own)) * mixed(spread * (high - low) + 0.02, spread * (wide_high - wide_low) + 0.02)
            wrong |= r[c] < mixed(low, wide_low) - margin if sign < 0 else r[c] > mixed(high, wide_high) + margin
        assert r["kept"] == (not r["base_failed"] and not wrong), r
    assert 0 < sum(r["kept"] for r in got) < len(got)
    monkeypatch.setattr(T, "BROADCAST_BANDS", 0)
    assert sorted(map(str, T.judged(docs(rows)).collect())) == sorted(map(str, got))


def test_a_text_outside_its_band_goes(docs, words):
    rows = [(i, words(300, i), "xx") for i in range(80)] + [(500, " ".join(f"☃{i}☃☃☃" for i in range(200)), "xx"), (501, words(300, 501), None)]
    got = {r["doc_id"]: r for r in T.judged(docs(rows)).collect()}
    assert not got[500]["kept"] and not got[500]["base_failed"]
    assert all(got[i]["kept"] for i in range(80)) and got[501]["kept"] and got[501]["band"] == "Latn"


def test_scripts():
    assert [T.script(x) for x in ("abc é", "привет", "日本の", "한국", "", None, "12", "שלום")] == ["Latn", "Cyrl", "Hani", "Hang", "Zyyy", "Zyyy", "Zyyy", "Hebr"]


def test_short_texts_and_small_bands_are_judged(docs, words):
    rows = [(i, words(40, i), "xx") for i in range(80)] + [(500, " ".join(f"☃{i}☃" for i in range(14)), "xx"), (501, " ".join(f"слово{i % 7}а" for i in range(20)), "ru")]
    got = {r["doc_id"]: r for r in T.judged(docs(rows)).collect()}
    assert got[500]["n_pieces"] < 200 and not got[500]["base_failed"] and not got[500]["kept"]
    assert sum(got[i]["kept"] for i in range(80)) >= 79
    long_ = {r["doc_id"]: r for r in T.judged(docs([(i, words(300, i), "xx") for i in range(80)] + [(600, " ".join(f"μικρ{i}ό κείμ{i * 7}ενο" for i in range(120)), "el")])).collect()}
    assert long_[600]["n_pieces"] >= 200 and long_[600]["kept"]
