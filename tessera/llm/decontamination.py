"""Benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some positions of a window of words, so a substituted word under a gap of some
mask leaves that mask's hash unchanged. The masks are chosen so that whatever the verifier accepts
has a hit. Hashes of all benchmark windows are joined with those of all training windows; round
each hit the two texts are laid over each other and the overlap is verified word by word, with
substitutions tolerated up to a rate.

A benchmark of at most `block_mb` of text is broadcast, indexed, and joined in the tasks in one pass
over the documents. A larger one is joined by Spark: both sides give their different seed hashes,
documents only those that pass a filter of bounded size, equal hashes meet by a shuffle, and the
pairs of texts that share one are verified.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, filtered, flat, mix, powers, salted_left_join, ship, slices, stored, total_bytes, word_hashes, words_of

#: Which of a window's words count, mask by mask: every stretch of 13 equal words with at most a fifth of the words changed, of any length, leaves one of them whole, and so do 12 of 15.
MASKS = ("111011011", "111000100111", "11001001000111", "11010100001101", "110001110101", "101101110001", "111100001011")
#: Least words of an item for them.
LONG = 15
#: (least words, masks) for items too short for those: each way to change every fifth word at most leaves one of them whole.
SHORT_MASKS = ((10, ("1110111", "11011011", "111000111", "111111", "1101001011")), (8, ("111111", "11010111", "11101011")))
SEED_BASE = 0x9FB21C651E98DF25

#: ASCII letters and digits in lower case stay, other ASCII is white space, bytes of other characters stay.
PLAIN = np.full(256, 0x20, np.uint8)
PLAIN[128:] = np.arange(128, 256)
for _a, _z in (("0", "9"), ("a", "z")):
    PLAIN[ord(_a) : ord(_z) + 1] = np.arange(ord(_a), ord(_z) + 1)
assert SPACE[0x20]


def hashed_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and the number of each text's first word."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    data, ends = flat(lower)
    data = PLAIN[data]
    starts, stops, first = words_of(data, ends)
    return word_hashes(data, starts, stops), first


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of len(mask) words under one mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, out = powers(SEED_BASE, len(mask)), np.zeros(n, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += words[k : k + n] * np.uint64(p[k])
    return out


def starts_inside(first: np.ndarray, n: int, span: int) -> np.ndarray:
    """True where a window of span words that starts there stays in one text."""
    inside = np.zeros(n + 1, np.int32)
    long_ = np.diff(first) >= span
    np.add.at(inside, first[:-1][long_], 1)
    np.add.at(inside, first[1:][long_] - span + 1, -1)
    return np.cumsum(inside)[: max(0, n - span + 1)] > 0


def needed(words: int, min_match: int, similarity: float) -> int:
    """How many equal words an overlap with an item of so many words must have."""
    return min(min_match, math.ceil(similarity * words - 1e-9))


def sure_run(words: int, min_match: int, similarity: float) -> int:
    """Every overlap with an item of so many words has a run of so many equal ones: k changed words leave k + 1 runs."""
    need = needed(words, min_match, similarity)
    return min(math.ceil(max(need, math.ceil(k * similarity / (1 - similarity) - 1e-6)) / (k + 1)) for k in range(max(1, words - need + 1)))


def masks_of(words: int, min_match: int, similarity: float) -> tuple[str, ...]:
    """The masks for items of so many words; runs where words, matches or similarity are below what the fixed masks are made for."""
    if similarity >= 0.8 and words >= SHORT_MASKS[-1][0] and needed(words, min_match, similarity) >= needed(words, 13, 0.8):
        return next((masks for least, masks in ((LONG, MASKS), *SHORT_MASKS) if words >= least))
    return ("1" * sure_run(words, min_match, similarity),)


class Index:
    """Seed hashes of a block of benchmark items, mask by mask."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, min_match: int = 13, similarity: float = 0.8):
        import pyarrow as pa

        self.ids = [i for i, _ in items]
        self.words, self.first = hashed_words(pa.array([t for _, t in items], pa.string()))
        sizes = np.diff(self.first)
        by_mask: dict[str, list[int]] = {}
        for n in np.unique(sizes[sizes >= max(1, min_words)]).tolist():
            for mask in masks_of(n, min_match, similarity):
                by_mask.setdefault(mask, []).append(n)
        self.tables = []
        for mask, of in by_mask.items():
            hashes = seed_hashes(self.words, mask)
            valid = starts_inside(self.first, len(self.words), len(mask)) & np.repeat(np.isin(sizes, of), sizes)[: len(hashes)]
            at = np.flatnonzero(valid)
            values = np.unique(hashes[at])
            before = np.where((at > 0) & valid[at - 1], np.searchsorted(values, hashes[at - 1]) + 1, 0) if len(at) else at  # of each window, the one before in its item
            key = np.searchsorted(values, hashes[at]) << 32 | before
            order = np.argsort(key, kind="stable")
            self.tables.append((mask, values, key[order], at[order], self.filter(values)))

    @staticmethod
    def filter(values: np.ndarray) -> np.ndarray:
        bits = min(22, max(10, len(values).bit_length() + 6))
        found = np.zeros(1 << bits, bool)
        found[values >> np.uint64(64 - bits)] = True
        return found

    def alignments(self, words: np.ndarray, first: np.ndarray, block: int = 1 << 20) -> np.ndarray:
        """(document, item, shift) of all different alignments with equal hashes, columns sorted.

        Of hits that follow each other along an alignment only the first counts, so repeated words
        give as many pairs as alignments, not as places times places; pairs are made block by block.
        """
        width, n_items = len(words) + len(self.words) + 1, max(1, len(self.ids))
        codes = np.zeros(0, np.int64)
        for mask, values, key, at, sieve in self.tables:
            hashes = seed_hashes(words, mask)
            if not len(hashes) or not len(values):
                continue
            inside = starts_inside(first, len(words), len(mask))
            found = np.flatnonzero(sieve[hashes >> np.uint64(65 - len(sieve).bit_length())] & inside)
            rank = np.minimum(np.searchsorted(values, hashes[found]), len(values) - 1)
            real = values[rank] == hashes[found]
            found, rank = found[real], rank[real]
            before = hashes[np.maximum(found - 1, 0)]
            rank_before = np.minimum(np.searchsorted(values, before), len(values) - 1)
            follows = (found > 0) & inside[np.maximum(found - 1, 0)] & (values[rank_before] == before)
            lo, hi = np.searchsorted(key, rank << 32), np.searchsorted(key, (rank + 1) << 32)
            same = rank << 32 | (rank_before + 1)
            a, z = (np.where(follows, np.searchsorted(key, same, side), lo) for side in ("left", "right"))
            starts, n = np.concatenate([lo, z]), np.concatenate([a - lo, hi - z])
            here = np.concatenate([found, found])
            some = n > 0
            starts, n, here = starts[some], n[some], here[some]
            total = np.cumsum(n)
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + block, "right")))
                times = n[i:j]
                there = at[np.repeat(starts[i:j] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                x = np.repeat(here[i:j], times)
                doc, item = np.searchsorted(first, x, "right") - 1, np.searchsorted(self.first, there, "right") - 1
                codes = np.unique(np.concatenate([codes, (doc * n_items + item) * width + (x - there + len(self.words))]))
                i = j
        pair = codes // width
        return np.stack([pair // n_items, pair % n_items, codes % width - len(self.words)])


def best_overlap(same: np.ndarray, penalty: float, need: int = 0) -> tuple[int, int, int]:
    """Of the stretches [from, to) of an alignment with need matches, the one with the highest score, one a match and -penalty a substitution, and its matches; (0, 0, 0) if there is none. Of equal scores the longest."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1.0, -penalty))])
    matches = np.concatenate([[0], np.cumsum(same)])
    lowest = np.minimum.accumulate(score)
    last = np.minimum(np.searchsorted(matches, matches - need, "right") - 1, np.arange(len(score)))  # the last start with need matches up to each end
    if last[-1] < 0:
        return 0, 0, 0
    gain = np.where(last >= 0, score - lowest[last], -np.inf)
    to = len(gain) - 1 - int((gain >= gain.max() - 1e-9)[::-1].argmax())
    start = int(np.flatnonzero(score[: last[to] + 1] <= lowest[last[to]] + 1e-9)[0])
    return start, to, int(matches[to] - matches[start])


def stretches_in(same: np.ndarray, need: int, similarity: float) -> list[tuple[int, int, int]]:
    """(from, to, matches) of an alignment: the best stretch, then the best of what lies before and behind it, and so on."""
    out, left = [], [(0, len(same))]
    while left:
        lo, hi = left.pop()
        if hi - lo < need:
            continue
        start, to, matched = best_overlap(same[lo:hi], similarity / (1 - similarity), need)
        if matched >= max(need, similarity * (to - start) - 1e-6):
            out.append((lo + start, lo + to, matched))
            left += [(lo, lo + start), (lo + to, hi)]
    return sorted(out)


def overlaps_in(texts, index: Index, min_match: int, similarity: float, one: bool = False) -> list[list[dict]]:
    """Verified overlaps of each text with the items of a block. one: no more than one a text."""
    words, first = hashed_words(texts)
    out = [[] for _ in range(len(texts))]
    for d, i, shift in index.alignments(words, first).T:
        if one and out[d]:
            continue
        a, z = max(index.first[i], first[d] - shift), min(index.first[i + 1], first[d + 1] - shift)
        need = needed(int(index.first[i + 1] - index.first[i]), min_match, similarity)
        for start, to, matched in stretches_in(index.words[a:z] == words[a + shift : z + shift], need, similarity):
            at = int(a + shift - first[d])
            out[d].append({"item_id": index.ids[i], "word_from": at + start, "word_to": at + to, "matched": matched})
    return out


def items_of(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null and item_id is not null").distinct()


def sent_index(benchmark: DataFrame, item_col: str, item_text: str):
    """The items, broadcast: at most block_mb of text, which the caller has checked."""
    items = [(r[0], r[1]) for r in items_of(benchmark, item_col, item_text).orderBy("item_id", "text").collect()]
    return benchmark.sparkSession.sparkContext.broadcast(items)


BROADCAST_HITS = 32_000_000  # bytes of hits with their items' texts that are broadcast; more are joined by a shuffle
OVERLAP = "array<struct<item_id:long,word_from:int,word_to:int,matched:int>>"


def overlap_type():
    import pyarrow as pa

    return pa.list_(pa.struct([("item_id", pa.int64()), ("word_from", pa.int32()), ("word_to", pa.int32()), ("matched", pa.int32())]))


SEGMENT_BITS = 1 << 20  # of a bitmap that meet in one row


def bitmap(keys: DataFrame, most_bits: int, n: int) -> np.ndarray:
    """A bitmap of the leading bits of n 64-bit keys, at most 2**most_bits bits. Segments are joined in Spark, so the driver gets each once."""
    bits = min(most_bits, max(10, n.bit_length() + 6))
    size = min(SEGMENT_BITS, 1 << bits)

    def rows(found):
        import pyarrow as pa

        some = [k for k in sorted(found) if found[k].any()]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([found[k].tobytes() for k in some], pa.binary())], names=["segment", "flags"])

    def mark(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            place = (b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            for k in np.unique(place // size).tolist():
                at = place[place // size == k] - k * size
                np.bitwise_or.at(found.setdefault(k, np.zeros(size >> 3, np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield rows(found)

    def join(batches):
        last, flags = None, None
        for b in batches:
            for k, more in zip(b.column(0).to_pylist(), b.column(1)):
                if k != last:
                    if last is not None:
                        yield rows({last: flags})
                    last, flags = k, np.zeros(size >> 3, np.uint8)
                flags |= np.frombuffer(more.as_buffer(), np.uint8)
        if last is not None:
            yield rows({last: flags})

    schema = "segment int, flags binary"
    whole = np.zeros(1 << bits >> 3, np.uint8)
    for r in keys.mapInArrow(mark, schema).repartition("segment").sortWithinPartitions("segment").mapInArrow(join, schema).toLocalIterator():
        whole[r["segment"] * (size >> 3) : (r["segment"] + 1) * (size >> 3)] |= np.frombuffer(r["flags"], np.uint8)
    return whole


def joined_overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int, min_words: int, similarity: float, id_col: str, text_col: str, item_col: str, item_text: str, filter_bits: int = 29) -> DataFrame:
    """(doc_id, text_hash, overlaps) by an equi-join on seed hashes, for a benchmark of any size."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("text is not null")
    items = items_of(benchmark, item_col, item_text).withColumn("item_hash", F.xxhash64("text"))

    def item_seeds(batches):
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, 1):
                for k in range(b.num_rows):
                    index = Index([(0, b.column(1)[k].as_py())], min_words, min_match, similarity)
                    seeds = np.unique(np.concatenate([np.zeros(0, np.uint64), *(mix(values ^ np.uint64(int(mask, 2))) for mask, values, *_ in index.tables)])).view(np.int64)
                    masks = sorted({mask for mask, *_ in index.tables})
                    yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array([b.column(0)[k].as_py()] * len(seeds), pa.int64()), pa.array([b.column(2)[k].as_py()] * len(seeds), pa.int64()), pa.array([masks] * len(seeds), pa.list_(pa.string()))], names=["seed", "item_id", "item_hash", "masks"])

    asked = stored(items.select("item_id", "text", "item_hash").mapInArrow(item_seeds, "seed long, item_id long, item_hash long, masks array<string>"), "seeds")
    masks = sorted(r[0] for r in asked.select(F.explode("masks")).distinct().collect())  # as many as there are masks
    sent = spark.sparkContext.broadcast(bitmap(asked.select("seed"), filter_bits, asked.count()))
    bits = (len(sent.value) << 3).bit_length() - 1

    def doc_seeds(batches):
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, 2):
                words, first = hashed_words(b.column(2))
                for mask in masks:
                    hashes = mix(seed_hashes(words, mask) ^ np.uint64(int(mask, 2)))
                    place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                    at = np.flatnonzero((sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool) & starts_inside(first, len(words), len(mask)))
                    doc = np.searchsorted(first, at, "right") - 1
                    order = np.lexsort((hashes[at], doc))
                    at, doc = at[order], doc[order]
                    new = np.append(True, (doc[1:] != doc[:-1]) | (hashes[at[1:]] != hashes[at[:-1]])) if len(at) else np.zeros(0, bool)
                    rows = pa.array(doc[new])
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[at[new]].view(np.int64)), b.column(0).take(rows), b.column(1).take(rows)], names=["seed", "doc_id", "text_hash"])

    met = texts.mapInArrow(doc_seeds, "seed long, doc_id long, text_hash long").join(asked.select("seed", "item_id", "item_hash").hint("shuffle_merge"), "seed")
    pairs = stored(met.select("doc_id", "text_hash", "item_id", "item_hash").distinct(), "pairs")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, 2, 64):
                out = [overlaps_in(b.column(2).slice(k, 1), Index([(b.column(3)[k].as_py(), b.column(4)[k].as_py())], min_words, min_match, similarity), min_match, similarity)[0] for k in range(b.num_rows)]
                hit = [k for k, x in enumerate(out) if x]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(hit, pa.int64())) for c in (0, 1)), pa.array([out[k] for k in hit], overlap_type())], names=["doc_id", "text_hash", "overlaps"])

    # texts of items go to the hits, not texts of documents; of the documents only those with a hit are moved
    hits = salted_left_join(pairs, items.select("item_id", "item_hash", F.col("text").alias("item_text")).dropDuplicates(["item_id", "item_hash"]), ["item_id", "item_hash"])
    hits = stored(hits.withColumn("key", F.xxhash64("doc_id", "text_hash")).select("key", "doc_id", "text_hash", "item_id", "item_text"), "hits")
    n, size = hits.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text") + 32), F.lit(0))).first()
    known = spark.sparkContext.broadcast(bitmap(hits.select("key"), filter_bits, n))
    shift = 64 - ((len(known.value) << 3).bit_length() - 1)

    def hit_texts(batches):
        for batch in batches:
            place = (batch.column(3).to_numpy().view(np.uint64) >> np.uint64(shift)).astype(np.int64)
            yield batch.filter(pa_bool((known.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))

    some = texts.withColumn("key", F.xxhash64("doc_id", "text_hash")).mapInArrow(hit_texts, "doc_id long, text_hash long, text string, key long")
    if size > BROADCAST_HITS:  # hits shuffle; rows that are all alike are one text
        some, hits = some.dropDuplicates(["doc_id", "text_hash"]), hits.hint("shuffle_merge")
    else:
        hits = F.broadcast(hits)
    own = F.col("h.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("h.text_hash") == F.col("t.text_hash")) & (F.col("h.key") == F.col("t.key"))
    both = some.alias("t").join(hits.alias("h"), own).select("t.doc_id", "t.text_hash", "t.text", "h.item_id", "h.item_text")
    return both.mapInArrow(verify, f"doc_id long, text_hash long, overlaps {OVERLAP}")


def pa_bool(flags: np.ndarray):
    import pyarrow as pa

    return pa.array(flags, pa.bool_())


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = 13, min_words: int = 8, similarity: float = 0.8, block_mb: float = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, overlaps) for each document, or pair of a document and an item, with a verified overlap."""
    if total_bytes(benchmark, item_text) > block_mb * 1e6:
        return joined_overlaps(docs, benchmark, min_match, min_words, similarity, id_col, text_col, item_col, item_text)
    ship(docs.sparkSession)
    sent = sent_index(benchmark, item_col, item_text)

    def run(batches):
        import pyarrow as pa

        index = Index(sent.value, min_words, min_match, similarity)
        for b in batches:
            for part in slices(b, 1):
                out = overlaps_in(part.column(1), index, min_match, similarity)
                hit = [k for k, x in enumerate(out) if x]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(hit, pa.int64())) for c in (0, 2)), pa.array([out[k] for k in hit], overlap_type())], names=["doc_id", "text_hash", "overlaps"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).where("text is not null").mapInArrow(run, f"doc_id long, text_hash long, overlaps {OVERLAP}")


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 13, min_words: int = 8, similarity: float = 0.8, block_mb: float = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that have no verified overlap with the benchmark."""
    if total_bytes(benchmark, item_text) > block_mb * 1e6:
        found = stored(joined_overlaps(docs, benchmark, min_match, min_words, similarity, id_col, text_col, item_col, item_text).select("doc_id", "text_hash").distinct(), "contaminated")
        gone = F.col(f"d.{id_col}").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(f"d.{text_col}") == F.col("g.text_hash"))
        return docs.alias("d").join(found.alias("g"), gone, "left_anti")
    ship(docs.sparkSession)
    place, sent = docs.columns.index(text_col), sent_index(benchmark, item_col, item_text)

    def run(batches):
        import pyarrow as pa

        index = Index(sent.value, min_words, min_match, similarity)
        for b in batches:
            for part in slices(b, place):
                yield part.filter(pa.array([not x for x in overlaps_in(part.column(place), index, min_match, similarity, one=True)], pa.bool_()))

    return filtered(docs, run)


def contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that hold benchmark text: doc_id, n_overlaps, item_ids, longest (matched words), overlaps.

    An overlap is a stretch of a document and of an item, word by word with at least `similarity`
    equal, with `min_match` equal words or that share of a shorter item's; items of fewer than
    `min_words` words are too common to prove anything and are not searched for. Null and empty
    texts overlap nothing. Repeated rows with one id give one row; rows without an id give one a text. Empty tables give an empty
    result. Other columns do not matter.
    """
    found = overlaps(docs, benchmark, **kw)
    one = found.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("unnamed")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("overlaps")))).alias("overlaps"))
    return one.select("doc_id", F.size("overlaps").cast("long").alias("n_overlaps"), F.array_sort(F.array_distinct("overlaps.item_id")).alias("item_ids"), F.array_max("overlaps.matched").cast("long").alias("longest"), "overlaps")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
