import collections
import hashlib
import re

from tessera.llm.substring_dedup import substring_dedup


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return collections.Counter(out)


def rows_of(words, odd):
    passage = words(60, 99)
    rows = odd + [(100 + i, words(20 + i * 11, i)) for i in range(12)]
    rows += [(200, f"start {passage} end"), (201, f"other {passage}\n\nmore"), (202, f"{passage} {words(10, 5)} {passage}"), (203, words(35, 77)), (204, words(35, 77)), (205, words(34, 78)), (206, words(34, 78))]
    return rows


def test_against_brute_force(docs, words, odd):
    rows = rows_of(words, odd)
    for batch_mb, bucket in ((8, 2_000_000), (0.002, 50)):
        got = substring_dedup(docs(rows), batch_mb=batch_mb, bucket_windows=bucket).collect()
        assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(rows, 35)
        assert all(sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_text_and_empty_table(docs, words):
    p = words(40, 3)
    got = {r["doc_id"]: r["text"] for r in substring_dedup(docs([(1, f"a {p} b"), (2, f"c {p}")]), keep_text=True).collect()}
    assert got == {1: "a b", 2: "c"}
    assert substring_dedup(docs([]).where("false")).collect() == []


def test_false_hits_of_the_first_count_change_nothing(docs, words, odd, monkeypatch):
    monkeypatch.setattr("tessera.llm.substring_dedup.SPARE_BITS", -7)  # nearly every window is asked about
    rows = rows_of(words, odd)
    got = substring_dedup(docs(rows), batch_mb=0.002, bucket_windows=50).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(rows, 35)


def test_rows_that_are_all_alike_are_spread(docs, words):
    from tessera.llm.batches import dealt

    rows = [(7, words(60, 1))] * 60 + [(None, None)] * 20 + [(2**63 - 1, words(60, 1))]
    deal, _ = dealt(docs(rows), 0.002)
    sizes = [r["count"] for r in deal.groupBy("batch").count().collect()]
    assert max(sizes) <= 3 * len(rows) / len(sizes)
    got = substring_dedup(docs(rows), batch_mb=0.002).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(rows, 35)
