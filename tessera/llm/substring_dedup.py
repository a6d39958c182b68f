"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Texts are dealt into batches. A batch sends the leading bits of its sorted window hashes, one block
for each range of values; per range the blocks are counted together and each block gets one bit per
hash back. Windows that may be repeated by those bits are sent again with 128 bits (two polynomials,
each over word hashes of its own) and counted again: only those decide. The batch marks the repeated
windows and merges them into maximal removal intervals.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from .batches import Batch, covered, dealt, pack_bits, parts_of, sha256, unpack_bits
from .common import mix, planes, ship, unplanes, window_hash, word_hashes, words_of

WINDOW_BASE = 0xD6E8FEB86659FD93
#: Bases of the second hash, of words and of windows.
OTHER_WORDS, OTHER_WINDOWS = 0xA24BAED4963EE407, 0x9FB21C651E98DF25
SPARE_BITS = 6  # of the first count: one window in 64 is asked about in vain


def windows(batch: Batch, window: int):
    """Word bounds, first words, the place (word number) of each window inside one document, and its hash."""
    starts, stops, first = words_of(batch.data, batch.ends)
    hashes = window_hash(word_hashes(batch.data, starts, stops), window, WINDOW_BASE)
    n = np.diff(first)
    valid = np.zeros(len(starts) + 1, np.int32)
    long_ = n >= window
    np.add.at(valid, first[:-1][long_], 1)
    np.add.at(valid, first[1:][long_] - window + 1, -1)
    places = np.flatnonzero(np.cumsum(valid)[: len(hashes)] > 0)
    return starts, stops, first, places, mix(hashes[places])


def second_hashes(batch: Batch, starts: np.ndarray, stops: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the windows at places, independent of the first ones."""
    return window_hash(word_hashes(batch.data, starts, stops, base=OTHER_WORDS), window, OTHER_WINDOWS)[places]


def distinct(*keys: np.ndarray):
    """Order by keys, where a new value begins in it, and which values occur more than once."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
    at = np.flatnonzero(new)
    return order, new, order[at], np.diff(np.append(at, len(order))) > 1


def repeated_words(docs: DataFrame, window: int, batch_mb: float, bucket_windows: int, finish, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """finish(batch, starts, stops, first, removed flags per word) -> Arrow columns, for every batch."""
    ship(docs.sparkSession)
    deal, n_bytes = dealt(docs, batch_mb, id_col, text_col)
    expected = n_bytes // 6 + 1
    buckets = max(1, expected // bucket_windows + 1)
    drop = np.uint64(max(0, 64 - math.ceil(math.log2(expected + 1)) - SPARE_BITS))

    def blocks_of(number: int, values: np.ndarray, many: np.ndarray, other: np.ndarray | None):
        """Rows of a batch: one for each range that its sorted values (aligned to 64 bits) fall into."""
        cuts = parts_of(values, buckets)
        full = [k for k in range(buckets) if cuts[k + 1] > cuts[k]]
        part = [slice(cuts[k], cuts[k + 1]) for k in full]
        shift = drop if other is None else np.uint64(0)
        return {
            "bucket": full, "batch": [number] * len(full), "hashes": [planes(values[s] >> shift) for s in part],
            "other": [b"" if other is None else other[s].tobytes() for s in part], "many": [pack_bits(many[s]) for s in part],
        }

    def sent_table(rows: dict):
        import pyarrow as pa

        return pa.table({c: pa.array(v, pa.int32() if c in ("bucket", "batch") else pa.binary()) for c, v in rows.items()})

    def flags_in(replies, n: int) -> np.ndarray:
        """The bits that came back, in the order of the values that were sent."""
        told = sorted(zip(*(replies.column(c).to_pylist() for c in ("bucket", "n", "flags"))))
        flags = np.concatenate([unpack_bits(f, k) for b, k, f in told if b >= 0] or [np.zeros(0, bool)])
        if len(flags) != n:
            raise ValueError(f"a batch has {n} hashes and {len(flags)} replies")
        return flags

    def send(table):
        *_, hashes = windows(Batch(table), window)
        narrow = hashes >> drop << drop
        _, _, at, many = distinct(narrow)
        return sent_table(blocks_of(table.column("batch")[0].as_py(), narrow[at], many, None))

    def count(table):
        """Bits for each block: whether the value is in another block or more than once in this one."""
        import pyarrow as pa

        number = table.column("bucket")[0].as_py()
        if number < 0:  # a batch's note to itself
            return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "n": pa.array([0] * table.num_rows, pa.int32()), "flags": table.column("many")})
        blocks = [unplanes(x.as_py()) for x in table.column("hashes")]
        sizes = [len(b) for b in blocks]
        every, others = np.concatenate(blocks), b"".join(x.as_py() for x in table.column("other"))
        if others:
            del blocks
            order, new, _, many = distinct(every, np.frombuffer(others, np.uint64))
            twice = np.zeros(len(every), bool)
            twice[order] = np.repeat(many, np.diff(np.append(np.flatnonzero(new), len(order))))
            flags = np.split(twice, np.cumsum(sizes)[:-1])
        else:
            every.sort()
            again = np.unique(every[1:][every[1:] == every[:-1]])
            flags = [again[np.minimum(np.searchsorted(again, b), len(again) - 1)] == b if len(again) else np.zeros(len(b), bool) for b in blocks]
        replies = [pack_bits(f | unpack_bits(m.as_py(), n)) for f, m, n in zip(flags, table.column("many"), sizes)]
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "n": pa.array(sizes, pa.int32()), "flags": pa.array(replies, pa.binary())})

    def suspects(batch: Batch, flags):
        """Numbers of the windows that the first count found, with both hashes. flags: of the distinct narrow values, from their number."""
        starts, stops, first, places, hashes = windows(batch, window)
        order, new, at, _ = distinct(hashes >> drop << drop)
        told = flags(len(at))
        some = np.sort(order[told[np.cumsum(new) - 1]]) if len(order) else order
        return starts, stops, first, places[some], hashes[some], second_hashes(batch, starts, stops, places[some], window) if len(some) else hashes[:0], told

    def ask(texts, replies):
        number = texts.column("batch")[0].as_py()
        batch = Batch(texts)
        *_, hashes, others, told = suspects(batch, lambda n: flags_in(replies, n))
        _, _, at, many = distinct(hashes, others)
        rows = blocks_of(number, hashes[at], many, others[at])
        for c, v in (("bucket", -1 - number), ("batch", number), ("hashes", b""), ("other", b""), ("many", pack_bits(told))):
            rows[c].append(v)
        return sent_table(rows)

    def apply(texts, replies):
        batch = Batch(texts)
        own = next(f for b, f in zip(replies.column("bucket").to_pylist(), replies.column("flags").to_pylist()) if b < 0)
        starts, stops, first, places, hashes, others, _ = suspects(batch, lambda n: unpack_bits(own, n))
        order, new, at, _ = distinct(hashes, others)
        hit = order[flags_in(replies, len(at))[np.cumsum(new) - 1]] if len(order) else order
        at = places[hit]
        return finish(batch, starts, stops, first, covered(len(starts), at, at + window))

    blocks, bits = "bucket int, batch int, hashes binary, other binary, many binary", "batch int, bucket int, n int, flags binary"
    told = deal.groupBy("batch").applyInArrow(send, blocks).groupBy("bucket").applyInArrow(count, bits)
    asked = deal.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(ask, blocks)
    sure = asked.groupBy("bucket").applyInArrow(count, bits)
    return deal.groupBy("batch").cogroup(sure.groupBy("batch")).applyInArrow(apply, schema)


def kept_text(batch: Batch, starts, stops, first, removed):
    """Each document's kept words joined by one space, as bytes."""
    for k in range(len(batch)):
        i, j = first[k], first[k + 1]
        data, alive = batch.data, ~removed[i:j]
        a, b = starts[i:j][alive], stops[i:j][alive]
        if not len(a):
            yield b""
            continue
        lengths = b - a + 1
        ends = np.cumsum(lengths)
        index = np.repeat(a - (ends - lengths), lengths) + np.arange(ends[-1])
        index[ends - 1] = 0
        out = data[index]
        out[ends - 1] = 32
        yield out[:-1].tobytes()


def substring_dedup(docs: DataFrame, window: int = 35, batch_mb: float = 8, bucket_windows: int = 2_000_000, keep_text: bool = False, **kw) -> DataFrame:
    """Remove every word covered by a window of words that starts anywhere else too.

    Returns doc_id, n_words, n_removed, kept_sha256, spans (removed word intervals [from, to)) and,
    with keep_text, text. Null or empty text: no words, nothing removed, the hash of no bytes.
    Texts of fewer than `window` words are left alone. Repeated rows are copies of each other and
    lose all their windows. Null ids are kept as null. An empty table gives an empty result; other
    columns are not carried.
    """

    def finish(batch, starts, stops, first, removed):
        import pyarrow as pa

        total = np.concatenate([[0], np.cumsum(removed)])
        spans, hashes, texts = [], [], []
        for k, text in enumerate(kept_text(batch, starts, stops, first, removed)):
            i, j = first[k], first[k + 1]
            flags = removed[i:j]
            up = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
            spans.append([{"from": int(a), "to": int(b)} for a, b in up.reshape(-1, 2)])
            hashes.append(sha256(text))
            if keep_text:
                texts.append(text.decode("utf-8", "replace"))
        cols = {
            "doc_id": batch.id_array(), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(total[first[1:]] - total[first[:-1]], pa.int64()),
            "kept_sha256": pa.array(hashes, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
        }
        if keep_text:
            cols["text"] = pa.array(texts, pa.string())
        return pa.table(cols)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<from:int,to:int>>" + (", text string" if keep_text else "")
    return repeated_words(docs, window, batch_mb, bucket_windows, finish, schema, **kw)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
