"""SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ in 3 bits at most have, of their two 32-bit halves, one that differs in
one bit at most. So each distinct fingerprint is indexed under both halves and under every
variant of a half with one bit deleted; equal keys meet in an equality join and are verified on
all 64 bits. Links of a key are handed on as a forest, never as all pairs.

Where a half's value is crowded, the keys that its fingerprints have are cut further: pairs there
differ in 3 bits at most of the other half, so in one bit at most of one of its quarters, and meet
under that quarter or a variant of it with one bit deleted. What shares a half and a quarter differs
in 16 bits only, so such a group is bounded whatever the corpus holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_left_join, ship, stored
from .components import components

DISTANCE, HALF, QUARTER = 3, 32, 16
CROWDED = 2048  # different fingerprints with one value of a half, from which on its keys are cut further
BROADCAST_KEYS = 200_000  # so many crowded keys at most are broadcast; more are joined by a shuffle
PAIRS_UPTO = 6  # keys with so few fingerprints hand on their links as they are


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the bits of XXH64 (seed 42) over word shingles of the text with A-Z lower-cased, as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[k : k + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            text = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(text[i].as_py(), shingle) for i in range(b.num_rows)], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def deleted(value, bits: int, at):
    """(bit, value without it) for each bit, and (bits, value): a struct column array at key places at(bit)."""
    one = F.expr("bigint(1)")
    return F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda i: at(i) + F.when(i == bits, value).otherwise(value.bitwiseAND(F.bitwise_not(one * F.pow(F.lit(2.0), i).cast("long")))))


def half_keys(half, number: int):
    """Keys of a half: its number, the deleted bit (32: none) and the other bits."""
    return deleted(half, HALF, lambda i: F.lit(number * 64).bitwiseOR(i).cast("long") * F.lit(1 << HALF))


def halves():
    return F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp) for both halves of each fingerprint."""
    high, low = halves()
    return fps.select("fp", F.explode(F.concat(half_keys(high, 0), half_keys(low, 1))).alias("key")).select("key", "fp")


def crowded_keys(fps: DataFrame, crowded: int) -> DataFrame:
    """(key): all keys of the values of halves that more than `crowded` fingerprints have."""
    high, low = halves()
    values = fps.select(F.explode(F.array(F.struct(F.lit(0).alias("number"), high.alias("half")), F.struct(F.lit(1).alias("number"), low.alias("half")))).alias("x")).select("x.*")
    full = values.groupBy("number", "half").agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    return full.select(F.explode(F.when(F.col("number") == 0, half_keys(F.col("half"), 0)).otherwise(half_keys(F.col("half"), 1))).alias("key")).distinct()


def finer_keys(rows: DataFrame) -> DataFrame:
    """(key, sub, fp): crowded (key, fp) under both quarters of the other half, whole and with one bit deleted."""
    other = F.when(F.shiftrightunsigned("key", HALF + 6).bitwiseAND(F.lit(1)) == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", HALF))
    quarters = (F.shiftrightunsigned(other, QUARTER).bitwiseAND(F.lit((1 << QUARTER) - 1)), other.bitwiseAND(F.lit((1 << QUARTER) - 1)))
    subs = F.concat(*(deleted(q, QUARTER, lambda i, k=k: F.lit(k * 64).bitwiseOR(i).cast("long") * F.lit(1 << QUARTER)) for k, q in enumerate(quarters)))
    return rows.select("key", F.explode(subs).alias("sub"), "fp")


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE  # of signed numbers it would count the absolute value's bits


def forest(fps: np.ndarray, sides: np.ndarray | None, block: int = 1024) -> list[tuple[int, int]]:
    """Links within one key that join everything its verified pairs join: at most one per fingerprint.

    sides: only pairs of different sides are looked at (the others meet under the whole half).
    Blocks of pairs are verified at a time, so memory is bounded by the block.
    """
    parent = np.arange(len(fps))  # the smallest member joined so far, kept flat between blocks

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def flatten() -> None:
        nonlocal parent
        while not ((up := parent[parent]) == parent).all():
            parent = up

    left, right = (np.arange(len(fps)),) * 2 if sides is None else (np.flatnonzero(~sides), np.flatnonzero(sides))
    links = []
    for i in range(0, len(left), block):
        for j in range(i if sides is None else 0, len(right), block):
            a, b = left[i : i + block], right[j : j + block]
            if (parent[a] == parent[b[0]]).all() and (parent[b] == parent[b[0]]).all():
                continue  # all joined already: a dense group costs its first blocks only
            x, y = np.nonzero(close(fps[a][:, None], fps[b][None, :]))
            x, y = a[x], b[y]
            while len(x):
                # the first link of each left fingerprint joins; links inside what is joined then fall away
                for k in np.unique(x, return_index=True)[1]:
                    p, q = root(x[k]), root(y[k])
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        links.append((int(fps[x[k]]), int(fps[y[k]])))
                flatten()
                apart = parent[x] != parent[y]
                x, y = x[apart], y[apart]
    return links


def links_of(keys: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links of whole keys; keys are sorted."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(first, len(keys)))
    bit = (keys >> HALF) & 63
    half = np.where((keys >> (HALF + 6)) & 1, fps, fps >> HALF)
    side = np.where(bit < HALF, (half >> np.minimum(bit, HALF - 1)) & 1, 0).astype(bool)
    mixed = (np.maximum.reduceat(side, first) != np.minimum.reduceat(side, first)) | (bit[first] == HALF)
    out = []
    small = np.repeat(mixed & (size > 1) & (size <= PAIRS_UPTO), size)
    of = np.repeat(np.arange(len(first)), size)
    for step in range(1, PAIRS_UPTO):
        i = np.flatnonzero(small[:-step] & (of[:-step] == of[step:]) & ((side[:-step] != side[step:]) | (bit[:-step] == HALF))) if len(keys) > step else np.zeros(0, np.int64)
        i = i[close(fps[i], fps[i + step])]
        out.append((fps[i], fps[i + step]))
    for k in np.flatnonzero(mixed & (size > PAIRS_UPTO)):
        s = slice(first[k], first[k] + size[k])
        found = forest(fps[s], None if bit[first[k]] == HALF else side[s])
        if found:
            out.append(tuple(np.array(x, np.int64) for x in zip(*found)))
    return out


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(u, v): links between different fingerprints that join whatever lies within 3 bits of each other. fps: a stored table of column fp."""
    ship(fps.sparkSession)

    def run(batches):
        """Rows come sorted by key, or by key and sub: one group after the other."""
        import pyarrow as pa

        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        kept = None

        def found(columns):
            *keys, values = columns
            if len(keys) == 2:  # groups of crowded keys, numbered; all their pairs are looked at
                new = np.append(True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]))
                keys = [(np.int64(HALF) << np.int64(HALF)) + (np.cumsum(new) - 1) % (1 << HALF)]
            for u, v in links_of(keys[0], values) if len(values) else []:
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            if kept is not None:
                columns = [np.append(a, c) for a, c in zip(kept, columns)]
            if not len(columns[0]):
                continue
            last = np.ones(len(columns[0]), bool)
            for c in columns[:-1]:
                last &= c == c[-1]
            cut = len(last) - int((~last)[::-1].argmax()) if not last.all() else 0
            kept = [c[cut:] for c in columns]
            yield from found([c[:cut] for c in columns])
        if kept is not None:
            yield from found(kept)

    rows = variants(fps)
    crowd = stored(crowded_keys(fps, crowded), "crowded")
    n = crowd.count()
    if not n:
        return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")
    marked = crowd.withColumn("crowd", F.lit(True))
    rows = rows.join(F.broadcast(marked) if n <= BROADCAST_KEYS else marked.hint("shuffle_merge"), "key", "left")
    plain = rows.where("crowd is null").select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")
    finer = finer_keys(rows.where("crowd").select("key", "fp")).repartition("key", "sub").sortWithinPartitions("key", "sub", "fp").mapInArrow(run, "u long, v long")
    return plain.union(finer)


def simhash(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any
    other; a text of fewer words than a shingle is one shingle. Repeated rows are in one component.
    Null ids are carried but are never a component's id unless nothing else is. An empty table
    gives an empty result; other columns are not carried.
    """
    made = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = stored(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(distinct.select("fp")))
    # these grow with the fingerprints: shuffles, whatever their files' size looks like
    both = distinct.join(joined.hint("shuffle_merge"), distinct["fp"] == joined["node"])
    of = both.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = joined.join(of.hint("shuffle_merge"), "component").select(F.col("node").alias("fp"), "component_id")
    all_ = distinct.join(moved.hint("shuffle_merge"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return salted_left_join(made, all_, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash(spark.read.parquet(f"{sf_dir}/documents.parquet"))
