import collections
import hashlib
import random

import numpy as np
import pytest

from tessera.llm.suffix_dedup import Run, anchors, front_coded, merged, suffix_dedup


def brute(rows, match=50):
    least = {}
    split = [((t or "").encode(), 1 << 62 if d is None else d) for d, t in rows]
    for b, d in split:
        for i in range(len(b) - match + 1):
            w = b[i : i + match]
            least[w] = min(least.get(w, d), d)
    out = collections.Counter()
    for (doc_id, _), (b, d) in zip(rows, split):
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if least[b[i : i + match]] < d:
                gone[i : i + match] = b"\x01" * match
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[(doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    return out


def test_against_brute_force(docs, words, odd):
    p, q = words(30, 99), words(12, 98)
    rows = odd + [(100 + i, words(10 + i * 9, i)) for i in range(12)] + [(50 - i, f"{words(3, i)} {p} {words(4, i + 9)} {q}") for i in range(4)]
    rows += [(60, "a" * 400), (61, "b" + "a" * 300), (62, words(40, 1)), (63, words(40, 1)), (64, "é" * 60), (65, "x" + "é" * 40), (66, p + "\0" * 80), (67, "\0" * 70 + p)]
    want = brute(rows)
    for batch_mb, bucket, hot in ((6, 500_000, 1024), (0.0015, 40, 1024), (0.0015, 40, 1), (0.004, 100, 2)):
        got = suffix_dedup(docs(rows), batch_mb=batch_mb, bucket_anchors=bucket, fan_in=hot).collect()
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_text_carried_columns_and_empty_table(docs, words):
    p = words(30, 3)
    d = docs([(1, f"first {p} tail"), (2, f"second {p}")])
    got = {r["doc_id"]: r for r in suffix_dedup(d, keep_text=True, carry=("lang", "batch", "c0", "n_chars")).collect()}
    assert got[1]["text"] == f"first {p} tail" and got[2]["text"] == "second" and got[2]["batch"] == "a" and got[2]["c0"] == "g"
    assert suffix_dedup(docs([]).where("false")).collect() == []


@pytest.mark.parametrize("k", [1, 2, 5, 9])
def test_loser_tree_merges_and_knows_prefixes(k):
    r = random.Random(k)
    runs, every = [], []
    for _ in range(k):
        rows = sorted({bytes(r.choice(b"ab") for _ in range(8)) for _ in range(r.randrange(0, 40))})
        every += rows
        shared, rests = front_coded(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 8))
        runs.append(Run(shared.tobytes(), rests, 8))
    out = [(runs[i].head, lcp) for i, _, lcp in merged(runs, 8)]
    assert [x for x, _ in out] == sorted(every)
    for (a, _), (b, lcp) in zip(out, out[1:]):
        assert lcp == next((i for i in range(8) if a[i] != b[i]), 8)


def test_equal_strings_have_equal_anchors(words):
    p = words(40, 5).encode()
    for chunk in (1 << 19, 64):
        found = []
        for before in (b"", b"zz", words(20, 8).encode()):
            data = np.frombuffer(before + p + words(9, len(before)).encode(), np.uint8)
            at, _ = anchors(data, np.array([0, len(data)]), 50, 20, chunk)
            found.append({int(a) - len(before) for a in at if len(before) + 30 <= a <= len(before) + len(p) - 50})
        assert found[0] == found[1] == found[2]


def test_rows_that_are_all_alike_and_the_greatest_id(docs, words):
    """2**63 - 1 and a null id are one document."""
    t = words(30, 1)
    rows = [(7, t)] * 40 + [(3, f"zz {t}")] + [(None, t), (2**63 - 1, f"{t} y")] + [(None, None)] * 9
    for fan_in in (1024, 2):
        got = suffix_dedup(docs(rows), batch_mb=0.002, fan_in=fan_in).collect()
        want = brute([(d if d != 2**63 - 1 else None, x) for d, x in rows])
        assert collections.Counter((r["doc_id"] if r["doc_id"] != 2**63 - 1 else None, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
