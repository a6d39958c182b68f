"""Best-fit packing by a configuration linear program over the length histogram.

The histogram has at most `capacity` entries, so planning on the driver is bounded whatever the
corpus holds. The program "as few sequences as possible, each filled by one configuration of
lengths, every length covered as often as it occurs" is solved by multiplicative weights: prices
of lengths fall with their coverage, and a knapsack dynamic program finds the dearest
configuration round each length. Whole copies are taken from the fractional solution; what is
left goes, longest first, where it fits best. The plan (configurations times copies) is never
expanded on the driver: a piece finds its sequence from its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import ship, stored

Config = tuple[tuple[int, int], ...]  # (length, times), lengths falling


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room from 0 to capacity the dearest filling's price and the index of one length in it (-1: nothing)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        k = upto[room]
        best[room] = best[room - 1]
        pick[room] = -2  # leaves one token free
        if k:
            value = best[room - lengths[:k]] + prices[:k]
            i = int(value.argmax())
            if value[i] > best[room]:
                best[room], pick[room] = value[i], i
    return best, pick


def filling(pick: np.ndarray, lengths: np.ndarray, room: int, limit: np.ndarray, have: dict[int, int]) -> dict[int, int]:
    """Trace one filling back, never using a length more often than it occurs."""
    while room > 0:
        i = pick[room]
        if i == -2:
            room -= 1
            continue
        if i < 0:
            break
        if have.get(int(i), 0) >= limit[i]:
            room -= 1
            continue
        have[int(i)] = have.get(int(i), 0) + 1
        room -= int(lengths[i])
    return have


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, step: float = 0.4) -> dict[Config, float]:
    """Multiplicative weights: how many copies of each configuration, as fractions."""
    weights, x = np.ones(len(lengths)), defaultdict(float)
    for r in range(rounds):
        prices = lengths / capacity * weights
        _, pick = knapsack(lengths, prices, capacity)
        cover = np.zeros(len(lengths))
        for i in range(len(lengths) - 1, -1, -1):
            left = counts[i] - cover[i]
            if left <= 0:
                continue
            have = filling(pick, lengths, capacity - int(lengths[i]), counts, {i: 1})
            index, times = np.fromiter(have.keys(), int), np.fromiter(have.values(), int)
            copies = min(left / have[i], float(((counts[index] * 1.5 - cover[index]).clip(0) / times).min()) or left / have[i])
            cover[index] += copies * times
            x[tuple(sorted(((int(lengths[k]), int(v)) for k, v in have.items()), reverse=True))] += copies / rounds
        over = cover / counts
        weights *= np.exp(-step * (over - 1))
        weights /= weights.mean()
    return x


def rounded(x: dict[Config, float], counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Whole copies of the fullest configurations, then the rest longest first into the tightest room."""
    left = dict(counts)
    open_: dict[int, list[tuple[Config, int]]] = defaultdict(list)
    by_fill = sorted(x.items(), key=lambda c: (capacity - sum(a * b for a, b in c[0]), -c[0][0][0], -c[1]))
    least = min(counts)
    for config, copies in by_fill:
        room = capacity - sum(a * b for a, b in config)
        if room >= least:
            break  # a length would still fit: such ones are built below, from what is left
        n = min(int(copies), *(left[a] // b for a, b in config))
        if n > 0:
            for a, b in config:
                left[a] -= n * b
            open_[room].append((config, n))
    rooms = sorted(open_)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                times = min(capacity // length, n)
                config, bins, room = ((length, times),), n // times, capacity - times * length
                n -= bins * times
            else:
                at = rooms[k]
                config, have = open_[at].pop()
                times = min(at // length, max(1, n // have))
                bins = min(have, n // times)
                if bins < have:
                    open_[at].append((config, have - bins))
                if not open_[at]:
                    del open_[at]
                    rooms.pop(k)
                merged = dict(config)
                merged[length] = merged.get(length, 0) + times
                config, room = tuple(sorted(merged.items(), reverse=True)), at - times * length
                n -= bins * times
            if room not in open_:
                insort(rooms, room)
            open_[room].append((config, bins))
    merged: dict[Config, int] = defaultdict(int)
    for group in open_.values():
        for config, n in group:
            merged[config] += n
    return sorted(merged.items(), reverse=True)


def solve(histogram: dict[int, int], capacity: int, rounds: int = 8) -> list[tuple[Config, int]]:
    """Configurations and how often each is used; every occurrence in the histogram is placed exactly once."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(k)] for k in lengths])
    return rounded(fractional(lengths, counts, capacity, rounds), {int(k): int(v) for k, v in histogram.items()}, capacity)


def slots(plan: list[tuple[Config, int]]) -> dict[str, np.ndarray]:
    """For each length, the ranges of ranks and where they go. As many rows as the plan has (configuration, length) pairs."""
    rows, base, seen = [], 0, defaultdict(int)
    for config, copies in plan:
        at = 0
        for length, times in config:
            rows.append((length, seen[length], times, base, at))
            seen[length] += copies * times
            at += length * times
        base += copies
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 48) + table[:, 1], "first": table[:, 1], "times": table[:, 2], "base": table[:, 3], "at": table[:, 4]}


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per piece with its token count and CRC-32, and its rank among the pieces of its length in its task.

    A document is its ids and end_id. Null text is empty text. Only documents over capacity are
    cut; their first piece takes the remainder.
    """
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        encoder = tokens.byte_bpe(vocabulary)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            cols = [[] for _ in range(6)]
            ids = batch.column(0)
            source, which = batch.column(1), []
            for i in range(batch.num_rows):
                encoded = np.append(tokens.byte_ids(encoder, source[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(encoded)
                cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    which.append(i)
                    for c, v in zip(cols, (k, a, b - a, zlib.crc32(encoded[a:b].tobytes()), part, seen[b - a])):
                        c.append(v)
                    seen[b - a] += 1
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, rounds: int = 8, **kw) -> DataFrame:
    """Pack every document into sequences of at most capacity tokens.

    Null or empty text is the one token end_id. Repeated rows are packed as often as they occur.
    An empty table gives an empty result. Other columns, whatever their names, are not carried.
    """
    made = stored(pieces(docs, capacity, end_id, **kw), "pieces")
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = made.sparkSession.sparkContext.broadcast(slots(solve(histogram, capacity, rounds)))
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def place(batches):
        import pyarrow as pa

        t = table.value
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("before").to_numpy() + b.column("rank").to_numpy()
            k = np.searchsorted(t["key"], (length << 48) + rank, "right") - 1
            within = rank - t["first"][k]
            copy, nth = within // t["times"][k], within % t["times"][k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(t["base"][k] + copy), pa.array(t["at"][k] + nth * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = made.schema["doc_id"].dataType.simpleString()
    joined = made.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return joined.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
