"""Phrase collocations: exact counts of frequent word sequences, level by level, and their weakest cuts.

A phrase of k words is named by one exact number: the slot of its first k - 1 words and the id of
its last word. Only phrases whose first and last k - 1 words are both frequent can be frequent, so
level k looks at those alone (candidates), and all cuts of a frequent phrase are frequent phrases
of lower levels. Each level runs over sequences of slots, which get shorter from level to level:

1. mappers count hashes of phrases in one array; where the sum is below the least count, no phrase with that hash can be frequent;
   phrases that pass are counted again under other hashes, as long as that rules many out;
2. each hash that is left stands for the smallest phrase that has it, found by minima of arrays, so that tasks do not all send what
   all of them have; Spark collects the few others;
3. tasks build minimal perfect hashes over segments of bounded size; mappers find each place's slot
   (checked against the stored key), bincount, and the arrays are summed in two steps of a tree;
4. frequent slots are hashed anew, and the sequences rewritten to them.

Prefix and suffix slots lead to the counts of the parts of each cut.
"""

from __future__ import annotations

import contextlib
import pickle
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, mix, ship, slices, stored, word_hashes, words_of
from .perfect_hash import PerfectHash

#: Where pieces end, and the bytes between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
FAN = 16
SLICE_MB = 0.5  # of text taken apart at once; a task holds some fifty times that
BATCH_ROWS = 1024  # texts that Spark hands over at once; both sides hold them
HELD_WORDS = 300_000  # different words of several slices that a task sums before it sends them
OTHER_BASE = 0xC2B2AE3D27D4EB4F
FILTERS = 4  # of hashed counts at most, in a level


class Sizes(NamedTuple):
    """What bounds memory; no result depends on it."""

    segment: int = 1 << 22  # keys of one perfect hash
    pass_slots: int = 1 << 23  # slots that a mapper counts in one pass; more are counted in further passes
    hashes: int = 1 << 22  # hashed counts, a power of two
    chunk: int = 1 << 15  # slots summed in one row
    run: int = 1 << 17  # places of a sequence in one row, but for runs without a break


BREAK = np.zeros(256, bool)
BREAK[list(PIECE_ENDS)] = True
APART = BREAK.copy()
APART[list(BLANKS)] = True


def tokens(langs: list, texts) -> tuple[np.ndarray, ...]:
    """Words of an Arrow slice of texts with A-Z lower-cased: bytes, starts, stops, (number of the text, whether another piece begins), keys of 128 bits that hold the language too."""
    data, ends = flat(texts)
    upper = (data >= 65) & (data <= 90)
    data = data + (upper.astype(np.uint8) << 5)
    starts, stops, first = words_of(data, ends, APART)
    of = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    piece = np.searchsorted(np.flatnonzero(BREAK[data]), starts)
    new = np.ones(len(starts), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (of[1:] != of[:-1])
    names = sorted(set(langs))
    spoken = np.frombuffer("".join(names).encode(), np.uint8)
    sizes = np.cumsum([0] + [len(n.encode()) for n in names])
    place = {n: k for k, n in enumerate(names)}
    number = np.array([place[x] for x in langs], np.int64)[of] if len(of) else of
    keys = []
    for base in (0x9E3779B97F4A7C15, OTHER_BASE):
        own = word_hashes(spoken, sizes[:-1], sizes[1:], base=base)
        keys.append(mix(word_hashes(data, starts, stops, base=base) ^ (own[number] * np.uint64(0x9E3779B97F4A7C15))))
    return data, starts, stops, of, new, keys[0], keys[1]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, other, a, place): every word's key with its count and the smallest place of a text that has it. docs: (lang, text, place)."""

    names = ["lang", "key", "other", "a", "place"]

    def counted(batches):
        import pyarrow as pa

        for whole in batches:
            for b in slices(whole, 1, 1 << 14, SLICE_MB):
                langs = b.column(0).to_pylist()
                *_, of, _, key, other = tokens(langs, b.column(1))
                if not len(key):
                    continue
                order = np.argsort(key, kind="stable")
                new = np.append(True, key[order][1:] != key[order][:-1])
                if (~new[1:] & (other[order][1:] != other[order][:-1])).any():  # two words with one half key
                    order = np.lexsort((other, key))
                    new = np.append(True, (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1]))
                at, begin = order[new], np.flatnonzero(new)
                count = np.diff(np.append(begin, len(order)))
                place = np.minimum.reduceat(b.column(2).to_numpy()[of[order]], begin)
                yield pa.table([pa.array(langs, pa.string()).take(pa.array(of[at])), pa.array(key[at].view(np.int64)), pa.array(other[at].view(np.int64)), pa.array(count, pa.int64()), pa.array(place)], names=names)

    def run(batches):
        """The counts of several slices are summed before they are sent, as long as few words come of it."""
        import pyarrow as pa

        held = []
        for t in counted(batches):
            held.append(t)
            if sum(len(x) for x in held) >= HELD_WORDS:
                one = pa.concat_tables(held).group_by(names[:3], use_threads=False).aggregate([("a", "sum"), ("place", "min")]).rename_columns(names)
                held = [one]
                if len(one) >= HELD_WORDS / 2:
                    yield from one.to_batches()
                    held = []
        for t in held:
            yield from t.to_batches()

    return docs.mapInArrow(run, "lang string, key long, other long, a long, place int").groupBy("lang", "key", "other").agg(F.sum("a").alias("a"), F.min("place").alias("place"))


class Slots:
    """Perfect hashes over a table of different keys, as segments of bounded size, each built in a task; slots count on from segment to segment."""

    def __init__(self, rows: DataFrame, sizes: Sizes, halves: bool = False):
        """rows: a stored table (key, other, a). halves: other is the second half of the key, as it is for words, and goes into the hash; so does place."""
        self.n = rows.count()
        self.segments = segments = max(1, -(-self.n // sizes.segment))
        number = F.pmod(F.xxhash64("key"), F.lit(segments)).cast("int")

        def build(part):
            import pyarrow as pa

            keys = part.column("key").to_numpy().view(np.uint64)
            made = PerfectHash(keys)
            slot = made.slots(keys)
            other, place = (np.empty(len(keys) if halves else 0, kind) for kind in (np.int64, np.int32))
            if halves:
                other[slot], place[slot] = part.column("other").to_numpy(), part.column("place").to_numpy()
            rows = pa.table({"segment": part.column("segment"), "slot": pa.array(slot), "key": part.column("key"), "other": part.column("other"), "a": part.column("a"), "hash": pa.nulls(len(keys), pa.binary())})
            whole = pa.table({"segment": part.column("segment").slice(0, 1), "slot": pa.nulls(1, pa.int64()), "key": pa.nulls(1, pa.int64()), "other": pa.nulls(1, pa.int64()), "a": pa.nulls(1, pa.int64()), "hash": pa.array([pickle.dumps((made, other, place))], pa.binary())})
            return pa.concat_tables([rows, whole])

        table = stored(rows.select("key", "other", "a", *(["place"] if halves else []), number.alias("segment")).groupBy("segment").applyInArrow(build, "segment int, slot long, key long, other long, a long, hash binary"), "slots")
        found = {r["segment"]: r["n"] for r in table.where("hash is null").groupBy("segment").agg(F.count("*").alias("n")).collect()}
        self.offset = np.concatenate([[0], np.cumsum([found.get(k, 0) for k in range(segments)])])
        self.table = table
        offset = F.array(*(F.lit(int(k)) for k in self.offset[:-1])).cast("array<long>")
        self.rows = table.where("hash is null").select((F.col("slot") + F.element_at(offset, F.col("segment") + 1)).alias("slot"), "key", "other", "a")

    def passes(self, per_pass: int):
        """Groups of segments that together hold at most per_pass slots (one segment at least)."""
        group: list[int] = []
        for k in range(self.segments):
            if group and self.offset[k + 1] - self.offset[group[0]] > per_pass:
                yield group
                group = []
            group.append(k)
        yield group

    def load(self, group: list[int]) -> dict:
        """The segments' hashes: what a broadcast holds, 8 bytes (words: 20) and a few bits a key."""
        found = {r["segment"]: pickle.loads(r["hash"]) for r in self.table.where("hash is not null").where(F.col("segment").isin(group)).select("segment", "hash").collect()}
        return {"segments": self.segments, "hashes": {k: (*v, int(self.offset[k])) for k, v in found.items()}}


def spread(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each key; as Spark's xxhash64 of a long."""
    if segments == 1:
        return np.zeros(len(keys), np.int64)
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(keys), np.uint64(42) + p5 + np.uint64(8), np.uint64)
    k = keys * p2
    h ^= ((k << np.uint64(31)) | (k >> np.uint64(33))) * p1
    h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % segments


def look_up(loaded: dict, keys: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Slots of keys among the loaded segments, else -1; with `other`, only where that half is equal too."""
    keys = keys.view(np.uint64)
    out = np.full(len(keys), -1, np.int64)
    where = spread(keys, loaded["segments"])
    for k, (made, halves, _, offset) in loaded["hashes"].items():
        mine = np.flatnonzero(where == k) if loaded["segments"] > 1 else np.arange(len(keys))
        slot = made.slots(keys[mine])
        if other is not None and len(halves):
            slot[(slot >= 0) & (halves[slot] != other[mine].view(np.int64))] = -1
        out[mine] = np.where(slot >= 0, slot + offset, -1)
    return out


def packed(values: np.ndarray) -> bytes:
    """The length in 8 bytes, then the compressed numbers: the JVM holds many rows at once."""
    import pyarrow as pa

    data = values.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.int32)


def sequences(slot: np.ndarray, word: np.ndarray | None, run: int):
    """(slots, last words) of a sequence, packed, with -1 between runs. Cut at breaks, with none but one kept between runs. word: null if it is the slot."""
    good = slot >= 0
    keep = good.copy()
    keep[1:] |= good[:-1]
    slot, word = slot[keep].astype(np.int32), None if word is None else word[keep].astype(np.int32)
    ends = np.flatnonzero(slot < 0) + 1
    at = 0
    while at < len(slot):
        k = np.searchsorted(ends, at + run)
        to = int(ends[k]) if k < len(ends) else len(slot)
        yield packed(slot[at:to]), None if word is None else packed(word[at:to])
        at = to


SEQUENCE = "slot binary, word binary"


def encoded(docs: DataFrame, words: Slots, length: int) -> DataFrame:
    """Texts as sequences of ids of frequent words; rare words and ends of pieces are breaks. Rows with an id name a word instead; that is done by the text whose place the word has, and copies of it."""
    shared = docs.sparkSession.sparkContext.broadcast(words.load(list(range(words.segments))))

    n = words.n

    def run(batches):
        import pyarrow as pa

        loaded, named = shared.value, np.zeros(n, bool)
        namer = np.zeros(n, np.int32)
        for _, _, place, offset in loaded["hashes"].values():
            namer[offset : offset + len(place)] = place
        for whole in batches:
            for b in slices(whole, 1, 1 << 14, SLICE_MB):
                langs = b.column(0).to_pylist()
                data, starts, stops, of, new, key, other = tokens(langs, b.column(1))
                ids = look_up(loaded, key, other)
                own = np.flatnonzero(ids >= 0)
                own = own[namer[ids[own]] == b.column(2).to_numpy()[of[own]]]
                seen, first = np.unique(ids[own], return_index=True)
                fresh = ~named[seen]
                named[seen] = True
                at = own[first[fresh]]
                text = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), stops[at].tolist())]
                rows = list(sequences(np.insert(ids, np.flatnonzero(new), -1), None, length))
                none = [None] * len(text)
                columns = [s for s, _ in rows] + none, [None] * len(rows) + seen[fresh].tolist(), [None] * len(rows) + [langs[k] for k in of[at].tolist()], [None] * len(rows) + text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string(), pa.string()))], names=["slot", "id", "lang", "phrase"])

    return docs.mapInArrow(run, "slot binary, id long, lang string, phrase string")


def longer(slot: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a phrase and the one a word further on both stand, and the key of the phrase one word longer."""
    at = np.flatnonzero((slot[:-1] >= 0) & (slot[1:] >= 0))
    return at, slot[at].astype(np.int64) << 32 | word[at + 1]


def rows_in(batches):
    for b in batches:
        for slot, word in zip(b.column(0), b.column(1)):
            slot = unpacked(slot.as_py())
            yield slot, slot if not word.is_valid else unpacked(word.as_py())


def narrow(top: int | None):
    """The smallest type of numbers that holds counts cut to `top`."""
    return np.int64 if top is None or top >= 1 << 16 else np.uint8 if top < 1 << 8 else np.uint16


def folded(parts: DataFrame, fold, done) -> DataFrame:
    """(chunk, counts): what is left of all rows of a chunk, in two steps. parts: (chunk, part, counts); fold(total or None, bytes) gives a new total, done(total) its bytes."""

    def run(batches):
        import pyarrow as pa

        key, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([done(total)], pa.binary())], names=["chunk", "part", "counts"])

        for b in batches:
            for chunk, part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (chunk, part) != key:
                    if key is not None:
                        yield row()
                    key, total = (chunk, part), None
                total = fold(total, counts.as_buffer())
        if key is not None:
            yield row()

    schema = "chunk int, part int, counts binary"
    some = parts.withColumn("part", F.pmod("part", F.lit(FAN))).repartition("chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(run, schema)
    return some.withColumn("part", F.lit(0)).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, schema).select("chunk", "counts")


def summed(parts: DataFrame, top: int | None = None) -> DataFrame:
    """(chunk, counts): arrays summed by chunk; sums over `top` are cut to it."""
    kind = narrow(top)

    def add(total, data):
        values = np.frombuffer(data, kind).astype(np.int64)
        total = values if total is None else np.add(total, values, out=total)
        return total if top is None else np.minimum(total, top, out=total)

    return folded(parts, add, lambda total: total.astype(kind).tobytes())


def counted(seq: DataFrame, size: int, chunk: int, slots_of, top: int | None = None) -> DataFrame:
    """(chunk, counts) over all places: slots_of(slot, word) gives the slots to count, below size."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        held, n, kind = [], 0, narrow(top)

        def add():
            if held:
                at, times = np.unique(np.concatenate(held), return_counts=True)
                total[at] += times
                held.clear()

        for slot, word in rows_in(batches):
            at = slots_of(slot, word)
            if len(at) >= size / 8:
                total += np.bincount(at, minlength=size)
                continue
            held.append(at)
            n += len(at)
            if n >= HELD_WORDS:
                add()
                n = 0
        add()
        if top is not None:
            np.minimum(total, top, out=total)
        part = TaskContext.get().partitionId()
        for k in range(0, size, chunk):
            if total[k : k + chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([total[k : k + chunk].astype(kind).tobytes()], pa.binary())], names=["chunk", "part", "counts"])

    return summed(seq.mapInArrow(run, "chunk int, part int, counts binary"), top)


def phrase_hash(key: np.ndarray, size: int, number: int = 0) -> np.ndarray:
    """One of several independent hashes, below size."""
    return (mix(key.view(np.uint64) ^ np.uint64(number * OTHER_BASE & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def passing(key: np.ndarray, told: list[np.ndarray]) -> np.ndarray:
    """Which keys all filters let pass; filter k holds bits by hash k."""
    good = np.arange(len(key))
    for k, bits in enumerate(told):
        h = phrase_hash(key[good], len(bits) * 8, k)
        good = good[(bits[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 > 0]
    return good


def filters(seq: DataFrame, least: int, size: int, chunk: int) -> list[np.ndarray]:
    """Bits by hash, one array for each filter in turn: whether the phrases one word longer that have the hash, and passed the filters before, occur `least` times together.

    Rare phrases that share a hash with a frequent one are ruled out by the next filter, but for one
    in many; where a filter still left many fewer hashes than the one before, another one follows.
    """
    size = max(size, 8)
    told: list[np.ndarray] = []
    left: list[int] = []

    def bits(batches):
        import pyarrow as pa

        for b in batches:
            flags = [np.packbits(np.frombuffer(c.as_buffer(), narrow(least)) >= least).tobytes() for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flags, pa.binary())], names=["chunk", "flags"])

    while len(told) < 2 or len(told) < FILTERS and left[-1] < 0.9 * left[-2]:
        shared = seq.sparkSession.sparkContext.broadcast(told)

        def hashes(slot, word, shared=shared, number=len(told)):
            key = longer(slot, word)[1]
            return phrase_hash(key[passing(key, shared.value)], size, number)

        out = np.zeros(size, bool)
        for r in counted(seq, size, chunk, hashes, least).mapInArrow(bits, "chunk int, flags binary").collect():
            part = out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk]
            part[:] = np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=len(part))
        told.append(np.packbits(out))
        left.append(int(out.sum()))
        if not left[-1]:
            break
    return told


#: A phrase that stands for a hash: its key, and the slot of its last words.
STANDS = np.dtype([("key", "<i8"), ("other", "<i4")])
NONE = np.iinfo(np.int64).max


def candidates(seq: DataFrame, told: list[np.ndarray], chunk: int) -> DataFrame:
    """(key, other, a): different phrases one word longer than those of seq that pass all filters; other is the slot of the last words.

    For each hash of the last filter the smallest phrase is found by minima of arrays; only other
    phrases with such a hash are sent as rows by each task that has them.
    """
    spark = seq.sparkSession
    shared = spark.sparkContext.broadcast(told)
    n = int(np.unpackbits(told[-1]).sum())

    def passed(batches, told):
        """Different phrases of each row that pass: hash of the last filter as a number among those left, key ascending, other."""
        number = np.cumsum(np.unpackbits(told[-1]), dtype=np.int32) - 1
        for slot, word in rows_in(batches):
            at, key = longer(slot, word)
            good = passing(key, told)
            key, first = np.unique(key[good], return_index=True)
            yield number[phrase_hash(key, len(number), len(told) - 1)], key, slot[at[good[first]] + 1]

    def smallest(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        best = np.zeros(n, STANDS)
        best["key"] = NONE
        for hashed, key, other in passed(batches, shared.value):
            own, first = np.unique(hashed, return_index=True)  # keys ascend: the first is the smallest
            less = key[first] < best["key"][own]
            own, first = own[less], first[less]
            best["key"][own], best["other"][own] = key[first], other[first]
        part = TaskContext.get().partitionId()
        for k in range(0, n, chunk):
            if (best["key"][k : k + chunk] != NONE).any():
                yield pa.RecordBatch.from_arrays([pa.array([k // chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([best[k : k + chunk].tobytes()], pa.binary())], names=["chunk", "part", "counts"])

    def less(total, data):
        values = np.frombuffer(data, STANDS)
        return values if total is None else np.where(values["key"] < total["key"], values, total)

    stand = stored(folded(seq.mapInArrow(smallest, "chunk int, part int, counts binary"), less, lambda total: total.tobytes()), "standing")
    best = np.full(n, NONE, np.int64)
    for r in stand.collect():  # 12 bytes a hash, as many as there are candidates, nearly
        best[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["counts"], STANDS)["key"]
    known = spark.sparkContext.broadcast(best)

    def standing(batches):
        import pyarrow as pa

        for b in batches:
            for counts in b.column(1):
                one = np.frombuffer(counts.as_buffer(), STANDS)
                one = one[one["key"] != NONE]
                yield pa.RecordBatch.from_arrays([pa.array(one["key"].copy()), pa.array(one["other"].astype(np.int64))], names=["key", "other"])

    def others(batches):
        import pyarrow as pa

        best, have, held = known.value, [], 0

        def flush():
            both = np.unique(np.concatenate(have), axis=0) if have else np.zeros((0, 2), np.int64)
            have.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["key", "other"])

        for hashed, key, other in passed(batches, shared.value):
            more = key != best[hashed]
            have.append(np.stack([key[more], other[more].astype(np.int64)], 1))
            held += len(have[-1])
            if held > 1 << 21:
                yield flush()
                held = 0
        yield flush()

    pair = "key long, other long"
    return stand.mapInArrow(standing, pair).union(seq.mapInArrow(others, pair).distinct()).withColumn("a", F.lit(None).cast("long"))


def frequent(seq: DataFrame, found: DataFrame, least: int, sizes: Sizes) -> DataFrame:
    """(key, other, a) of the candidates that occur `least` times, counted by slot."""
    slots = Slots(found, sizes)
    spark, out = seq.sparkSession, None
    for group in slots.passes(sizes.pass_slots):
        shared = spark.sparkContext.broadcast(slots.load(group))
        begin, end = int(slots.offset[group[0]]), int(slots.offset[group[-1] + 1])

        def slots_of(slot, word, shared=shared, begin=begin):
            at = look_up(shared.value, longer(slot, word)[1])
            return at[at >= 0] - begin

        def over(batches, begin=begin):
            import pyarrow as pa

            for b in batches:
                for chunk, counts in zip(b.column(0).to_pylist(), b.column(1)):
                    n = np.frombuffer(counts.as_buffer(), np.int64)
                    at = np.flatnonzero(n >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(at + chunk * sizes.chunk + begin), pa.array(n[at])], names=["slot", "a"])

        if end > begin:
            part = counted(seq, end - begin, sizes.chunk, slots_of).mapInArrow(over, "slot long, a long")
            out = part if out is None else out.union(part)
    if out is None:
        return found.where("false")
    return slots.rows.drop("a").join(out, "slot").select("key", "other", "a")


def rewritten(seq: DataFrame, slots: Slots, length: int) -> DataFrame:
    """Sequences of the slots of phrases one word longer."""
    shared = seq.sparkSession.sparkContext.broadcast(slots.load(list(range(slots.segments))))

    def run(batches):
        import pyarrow as pa

        loaded = shared.value
        for slot, word in rows_in(batches):
            at, key = longer(slot, word)
            new = np.full(len(slot), -1, np.int64)
            new[at] = look_up(loaded, key)
            rows = list(sequences(new[:-1], word[1:], length))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["slot", "word"])

    return seq.mapInArrow(run, SEQUENCE)


@contextlib.contextmanager
def small_batches(spark, rows: int = BATCH_ROWS):
    """Arrow batches of at most so many rows in what runs meanwhile; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, first: int = 2000, lang_col: str = "lang", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language its phrases of 2 to `longest` words that hold together best.

    Texts (null: empty) have A-Z lower-cased and are cut at [.,;:!?\\x0A-\\x0D] into pieces, those at
    blanks and tabs into words; null languages are `und`. n counts all words of the language, a all
    occurrences of the phrase within pieces. Phrases with a >= least are candidates. Of the cuts of a
    phrase in two that with the least floor(1000 a n / (l r)) counts, of equal ones the first; l and r
    are the counts of its parts. A candidate that always stands inside the same longer candidate goes.
    Per language the first `first` by score, a (both descending) and phrase (bytes, ascending).

    All counts are exact, scores in decimals of 38 digits. Repeated rows count each; other columns are
    not looked at; an empty table or one without candidates gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.withColumn("place", F.shiftrightunsigned(F.xxhash64("lang", "text"), 33).cast("int"))  # by content, so that tasks that run again agree
    # numbers of a language come with its words, so that texts are read once for both
    with small_batches(spark):
        every = stored(word_counts(docs), "words")
    totals = every.groupBy("lang").agg(F.sum("a").alias("n"))
    vocabulary = stored(every.where(F.col("a") >= least), "vocabulary")
    words = Slots(vocabulary, sizes, halves=True)
    with small_batches(spark):
        texts = stored(encoded(docs, words, sizes.run), "sequences")
    names = texts.where("id is not null").select(F.col("id").alias("slot"), "lang", "phrase").dropDuplicates(["slot"])
    level = stored(words.rows.join(names, "slot").select("slot", "lang", "phrase", "a", F.array("a").alias("heads"), F.array("a").alias("tails")), "phrases")
    single = level
    seq = texts.where("slot is not null").select("slot", F.lit(None).cast("binary").alias("word"))
    levels = []
    for k in range(2, longest + 1):
        told = filters(seq, least, sizes.hashes, sizes.chunk)
        found = stored(frequent(seq, stored(candidates(seq, told, sizes.chunk), "candidates"), least, sizes), "frequent")
        slots = Slots(found, sizes)
        if not slots.n:
            break
        before = level
        head = before.select(F.col("slot").alias("head"), "lang", F.col("phrase").alias("begin"), "heads")
        tail = before.select(F.col("slot").alias("tail"), "tails")
        last = single.select(F.col("slot").alias("last"), F.col("phrase").alias("end"))
        named = slots.rows.select("slot", "a", F.shiftright("key", 32).alias("head"), F.col("other").alias("tail"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("last"))
        level = stored(
            named.join(head, "head").join(tail, "tail").join(last, "last").select("slot", "lang", F.concat_ws(" ", "begin", "end").alias("phrase"), "a", F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"), "head", "tail"),
            "phrases",
        )
        levels.append(level)
        if k < longest:
            seq = stored(rewritten(seq, slots, sizes.run), "sequences")
    if not levels:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    whole = None
    for k, level in enumerate(levels, 2):
        if k - 1 < len(levels):  # the words of a phrase always stand in the same longer one if they do in one that is a word longer
            up = levels[k - 1]
            parts = F.array(F.struct(F.col("head").alias("slot"), F.element_at("heads", k).alias("own")), F.struct(F.col("tail").alias("slot"), F.element_at("tails", k).alias("own")))
            inside = up.select("a", F.explode(parts).alias("p")).where("a >= p.own").select("p.slot").distinct()
            level = level.join(inside, "slot", "left_anti")
        kept = level.select("lang", "phrase", "a", "heads", "tails", F.lit(k).alias("k"))
        whole = kept if whole is None else whole.union(kept)
    big = "decimal(19,0)"
    cuts = "transform(sequence(1, k - 1), j -> struct((1000 * cast(a as {0}) * cast(n as {0})) div (cast(heads[j - 1] as {0}) * cast(tails[k - j - 1] as {0})) as score, j as j))".format(big)
    scored = whole.join(totals, "lang").withColumn("cut", F.array_min(F.expr(cuts)))
    out = scored.select("lang", "phrase", "a", F.expr("heads[cut.j - 1]").alias("l"), F.expr("tails[k - cut.j - 1]").alias("r"), "n", F.col("cut.score").alias("score"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first).select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    found = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("rank", F.col("rank").cast("long"))


OP12_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE a >= 100),
j AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail FROM c, (SELECT unnest(range(1, 5)) AS j) WHERE c.k >= 2 AND j < c.k),
s AS (
  SELECT j.lang, j.k, j.phrase, j.a, h.a AS l, t.a AS r, n.n, j, CAST((1000::HUGEINT * j.a * n.n) // (h.a::HUGEINT * t.a) AS BIGINT) AS score
  FROM j JOIN c h ON h.lang = j.lang AND h.phrase = j.head JOIN c t ON t.lang = j.lang AND t.phrase = j.tail JOIN n ON n.lang = j.lang
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.k > b.k AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b ANTI JOIN i ON i.lang = b.lang AND i.phrase = b.phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
