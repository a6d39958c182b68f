"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship  # noqa: F401 - for the operators


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) a temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(f"file://{at}")
        at = f"file://{at}"
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read again, and its path: lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def few_files(df: DataFrame) -> DataFrame:
    """A table of few rows behind a shuffle, in no more partitions than there are cores.

    Else each shuffle partition becomes a file, and on a local file system an executor starts
    a process for each file and checksum that it makes, which shares the executor's memory at first.
    """
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch, text: int, rows: int = 512, mb: float = 2):
    """An Arrow batch in slices of at most `rows` rows and about `mb` MB of the text column; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    limit = int(mb * 1e6)
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = int(ends[at - 1]) if at else 0
        to = min(max(int(np.searchsorted(ends, base + limit, "right")), at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def filtered(docs: DataFrame, run) -> DataFrame:
    """docs.mapInArrow(run) that keeps the columns, whatever their names: Spark finds none with a dot in it there."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; null ids count as the text 'null'."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def salted_left_join(left: DataFrame, right: DataFrame, key: str | list[str], salts: int = 16) -> DataFrame:
    """left outer equi-join where one key may hold a third of left; right has one row a key and is repeated per salt. Both grow with the input: a shuffle.

    The salt is a hash of the row, so a task that runs again sends the same rows to the same places.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("shuffle_merge")
    return left.join(right, [*([key] if isinstance(key, str) else key), "_salt"], "left").drop("_salt")


# ---- numpy helpers that run inside tasks -------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

K1, K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h *= K1
    h ^= h >> np.uint64(33)
    h *= K2
    h ^= h >> np.uint64(33)
    return h


def powers(base: int, n: int) -> list[int]:
    out = [1]
    for _ in range(n):
        out.append(out[-1] * base & 0xFFFFFFFFFFFFFFFF)
    return out


def window_hash(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of all k consecutive values of h, composed from windows of doubling length."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = powers(base, k)
    out, done, level, width = None, 0, h, 1
    rest = k
    while rest:
        if rest & 1:
            part = level[done : done + n]
            out = part.copy() if out is None else out * np.uint64(p[width]) + part
            done += width
        rest >>= 1
        if rest:
            level = level[: len(level) - width] * np.uint64(p[width]) + level[width:]
            width *= 2
    return out


def flat(texts, order=None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array behind one another, and where each begins and ends. Null: empty."""
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary())
    if order is not None:
        texts = texts.take(pa.array(order))
    if texts.null_count:
        texts = texts.fill_null(b"")
    bufs = texts.buffers()
    ends = np.frombuffer(bufs[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and len(texts) else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def words_of(data: np.ndarray, ends: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ (or other bytes `between` words) and, for each document, the number of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    ink = ~between[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    inner = ends[1:-1]
    inner = inner[inner < n]
    first[inner] = ink[inner]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    before = inner[inner > 0] - 1
    last[before] = ink[before]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


BYTE_BASE = 0x9E3779B97F4A7C15


def power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, block: int = 1 << 20, base: int = BYTE_BASE) -> np.ndarray:
    """64-bit hashes of words: polynomial in the bytes, then mixed with the length. Another odd base gives independent hashes."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    i = 0
    back = pow(base, -1, 1 << 64)
    table = power_table(base, 0)
    inverse = table
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + block, "right")))
        a, b = int(starts[i]), int(stops[j - 1])
        if b - a + 1 > len(table):
            table, inverse = power_table(base, b - a + 1), power_table(back, b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * table[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, stops[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * K2
        i = j
    return mix(out)


def planes(values: np.ndarray) -> bytes:
    """Differences of sorted 64-bit values, byte plane by byte plane, so that Spark's shuffle compression finds the zeros."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(payload: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(payload, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64)
