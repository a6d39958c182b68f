import zlib

import numpy as np
import pytest

from tessera.llm import packing, tokens


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 2]


def check(rows, packed, encode, capacity=1024):
    import collections

    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = encode(text or "")
        n = len(ids)
        cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = collections.Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in packed)
    assert got == want
    by = collections.defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_against_tokenizers(docs, words, odd, encode):
    rows = odd + [(100 + i, words(5 + 37 * i % 900, i)) for i in range(60)] + [(300, words(4000, 1)), (301, "<|endoftext|> x"), (302, "a<|endoftext|><|endoftext|>  b\n<|endoftext|>")]
    packed = packing.pack(docs(rows)).collect()
    n = check(rows, packed, encode)
    assert n <= sum(r["length"] for r in packed) // 1024 + 2


def test_empty_table(docs):
    assert packing.pack(docs([]).where("false")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_solve_places_everything_near_the_bound(seed):
    r = np.random.default_rng(seed)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(np.minimum(r.geometric(0.004, 20000), 1024), return_counts=True))}
    plan = packing.solve(histogram, 1024)
    seen = {}
    for config, n in plan:
        assert sum(a * b for a, b in config) <= 1024
        for a, b in config:
            seen[a] = seen.get(a, 0) + n * b
    assert seen == histogram
    assert sum(n for _, n in plan) <= 1.01 * sum(k * v for k, v in histogram.items()) / 1024 + 1


def test_solve_without_full_configurations():
    assert sum(n for _, n in packing.solve({600: 10}, 1024)) == 10
    assert packing.solve({}, 1024) == []


def test_knapsack_finds_the_dearest_filling():
    import itertools

    lengths, prices = np.array([3, 5, 7]), np.array([2.0, 4.0, 6.5])
    best, _ = packing.knapsack(lengths, prices, 20)
    for room in range(21):
        want = max(sum(n * p for n, p in zip(c, prices)) for c in itertools.product(range(7), range(5), range(3)) if sum(n * k for n, k in zip(c, lengths)) <= room)
        assert best[room] == pytest.approx(want)


def test_ids_are_those_of_the_json_vocabulary_for_every_character(encode):
    """Every code point in several surroundings, the added token, and texts that are cut into stretches."""
    encoder = tokens.byte_bpe()
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    for k in range(0, len(points), 997):
        c = points[k]
        text = f"a{c}b  {c}1 {c}{c}\n{c} <|endoftext|>{c} !{c}?"
        assert [*tokens.byte_ids(encoder, text), 2] == encode(text)
    for k in range(0, len(points), 20000):
        text = " ".join(points[k : k + 20000])
        assert [*tokens.byte_ids(encoder, text), 2] == encode(text)


def test_stretches_change_no_token(words, encode):
    text = words(900, 3).replace("co", "\n\n  co").replace("di", " \tdi ") + "  " + "x" * 500 + " \u00a0 y"
    for size in (1, 7, 100):
        parts = list(tokens.stretches(text, size))
        assert "".join(parts) == text and (size > 50 or len(parts) > 100)
        assert [i for p in parts for i in encode(p)[:-1]] == encode(text)[:-1]
        p = tokens.piece_bpe()
        assert [i for k, s in enumerate(parts) for i in p.encode(s if k == 0 else s[1:])] == p.encode(text)


def test_long_runs_are_encoded_as_by_the_vocabulary_itself():
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")), tokens.byte_bpe()
    for text in ("a" + " " * 1_500_000 + "b", "x" + "\n" * 1_000_000 + "y", " \t\n" * 400_000 + "<|endoftext|>z", "é" * 300_000, "-" * 700_000, ("word " * 150_000) + " " * 1_100_000 + "end"):
        assert tokens.byte_ids(encoder, text).tolist() == t.encode(text, add_special_tokens=False).ids
