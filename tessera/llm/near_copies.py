"""Near copies by verified similarity: SimHash links and bands of minimum hashes propose, exact sets of shingles decide.

The similarity of two texts is that of their sets of word shingles (shared over all). Texts whose
SimHash fingerprints are joined by links of 3 bits or fewer (operator 8: deletion-variant
signatures) are candidates, and so are texts that share the minima of a band, which finds the pairs
whose fingerprints differ in more bits: 24 bands of 5 minima miss a pair at similarity 0.8 with
probability 7e-5. Clusters of candidates are cut into blocks of bounded number and bytes, and every
pair of blocks of a cluster meets in a group of its own, so that all pairs of a cluster are compared
exactly, however many and however long its texts are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, flat, mix, salted_left_join, ship, slices, stored, window_hash, word_hashes, words_of
from .components import components
from .simhash import fingerprint, links as simhash_links

BANDS, ROWS = 24, 5
BASE = 0xD6E8FEB86659FD93
FACTORS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 512  # texts of a block, about
BLOCK_BYTES = 8_000_000  # of their shingles' hashes, about; a longer text is a block of its own
assert SPACE[0x20]


def shingles(texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of all texts, A-Z lower-cased, and where each text's begin; a text of fewer words is one shingle."""
    data, ends = flat(texts)
    data = LOWER[data]
    starts, stops, first = words_of(data, ends)
    words, sizes = word_hashes(data, starts, stops), np.diff(first)
    hashes = window_hash(words, shingle, BASE)
    count = np.where(sizes > 0, np.maximum(sizes - shingle + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(begin[-1], np.uint64)
    full = sizes >= shingle
    index = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    whole = np.repeat(full, count)
    out[whole] = hashes[index[whole]]
    for k in np.flatnonzero(~full & (sizes > 0)):
        own = words[first[k] : first[k + 1]]
        out[begin[k]] = window_hash(own, len(own), BASE)[0] + np.uint64(len(own))
    return mix(out), begin


def band_keys(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(texts with shingles, bands): a hash of each band's minima."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    at = begin[:-1][np.diff(begin) > 0]
    keys = np.zeros((len(at), BANDS), np.uint64)
    for k, factor in enumerate(FACTORS):
        if len(at):
            least = np.minimum.reduceat(mixed32(low, factor), at)
            keys[:, k // ROWS] = mix(keys[:, k // ROWS] * np.uint64(BASE) + least + np.uint64(k + 1))
    return keys


def mixed32(values: np.ndarray, factor: np.uint32) -> np.ndarray:
    x = values * factor
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x


def linked(sets: list[np.ndarray], similarity: float, columns: int = 2048) -> list[tuple[int, int]]:
    """Links of a forest that joins all pairs of sets with at least that similarity: each set with the first one it is joined to."""
    size = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order].astype(np.int32)
    first = np.append(True, values[1:] != values[:-1])[: len(values)]
    alone = first & np.append(first[1:], True)[: len(values)]
    of, at = of[~alone], np.cumsum(first[~alone]) - 1
    n_shared = int(at[-1]) + 1 if len(at) else 0
    del values, order, first, alone
    both = np.zeros((len(sets),) * 2, np.float32)
    for lo in range(0, n_shared, columns):
        part = slice(*np.searchsorted(at, [lo, lo + columns]))
        has = np.zeros((len(sets), columns), np.float32)
        has[of[part], at[part] - lo] = 1
        both += has @ has.T
    both = both.astype(np.float64)
    u, v = np.nonzero(np.triu(both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6, 1))
    label = np.arange(len(sets))
    while len(u):
        least, before = np.minimum(label[u], label[v]), label.copy()
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if (label == before).all():
            break
    return [(int(label[k]), int(k)) for k in np.flatnonzero(label != np.arange(len(sets)))]


def simhash_groups(made: DataFrame) -> DataFrame:
    """(node, key): for each text the group of fingerprints that links of 3 bits or fewer join it to. made: a stored table with (node, fp)."""
    own = stored(made.select("node", "fp").distinct(), "fingerprints")
    joined = components(simhash_links(stored(own.select("fp").distinct(), "distinct-fingerprints")))
    of = joined.select(F.col("node").alias("fp"), "component")
    return salted_left_join(own, of, "fp", 4).select("node", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key"))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash) of the documents that stay: of all that links of at least `similarity` join, the one with the smallest id.

    text_hash is xxhash64 of the text, so repeated ids with other texts are documents of their own.
    Texts without words are copies of each other. Rows without an id are not looked at.
    """
    ship(docs.sparkSession)
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def sketch(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            for part in slices(b, 2, 256):
                hashes, begin = shingles(part.column(2), shingle)
                keys = band_keys(hashes, begin).view(np.int64)
                own = [np.unique(hashes[x:y]) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())]
                nodes = [xxhash.xxh64_intdigest(x.tobytes()) for x in own]
                sizes = np.where(np.diff(begin) > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array([len(x) for x in own], pa.int64()), lists, pa.array([fingerprint(x.as_py()) for x in part.column(2)], pa.int64())], names=["doc_id", "text_hash", "node", "size", "keys", "fp"])

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            for part in slices(b, 1, 256):
                hashes, begin = shingles(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique(hashes[x:y]).tobytes() for x, y in zip(begin[:-1], begin[1:])], pa.binary())], names=["node", "shingles"])

    def compare(table):
        import pyarrow as pa

        nodes = table.column("node").to_pylist()
        found = linked([np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")], similarity) if len(nodes) > 1 else []
        return pa.table({"u": pa.array([nodes[a] for a, _ in found], pa.int64()), "v": pa.array([nodes[b] for _, b in found], pa.int64())})

    made = stored(named.mapInArrow(sketch, "doc_id long, text_hash long, node long, size long, keys array<long>, fp long"), "sketches")
    distinct = stored(made.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.max("size").alias("size"), F.first("keys").alias("keys")), "distinct")
    keyed = distinct.select("node", F.explode("keys").alias("key")).union(simhash_groups(made))
    least = keyed.groupBy("key").agg(F.min("node").alias("m"), F.count("*").alias("n")).where("n > 1").select("key", "m")
    found = components(salted_left_join(keyed, least, "key", 4).where("m <> node").select(F.col("node").alias("u"), F.col("m").alias("v")))
    clusters = stored(found.join(distinct.select("node", "size").hint("shuffle_merge"), "node"), "clusters")
    many = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES))
    blocks = clusters.groupBy("component").agg(F.least(F.count("*"), many).cast("int").alias("blocks"))
    members = salted_left_join(clusters, blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "component", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    asked = distinct.join(clusters, "node", "left_semi").select("node", "least.doc_id", "least.text_hash")
    texts = named.join(asked, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"])
    held = stored(texts.mapInArrow(sets, "node long, shingles binary"), "sets")
    links = units.join(held, "node").groupBy("component", "a", "b").applyInArrow(compare, "u long, v long")
    joined = components(links)
    of = distinct.join(joined, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("least").alias("least"))
    return of.select("least.doc_id", "least.text_hash")
