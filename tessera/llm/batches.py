"""Whole texts dealt into batches of bounded size, and the removal of byte ranges from them.

Every step that needs the texts groups the same deal, so Spark shuffles the texts once and reads
that exchange again (ReuseExchange) in the later steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, total_bytes

NO_ID = np.iinfo(np.int64).max


def dealt(docs: DataFrame, batch_mb: float, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(batch, doc_id, text), the columns to carry as c0, c1, ..., and the number of bytes.

    Rows go by a hash of their place in the table, so rows that are all alike spread out too. A
    table scan gives the same places whenever a task runs again; the steps that use the deal raise
    if it ever changed between them.
    """
    n = total_bytes(docs, text_col)
    batches = max(1, int(n / (batch_mb * 1e6)) + 1)
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.octet_length(text_col)), F.lit(batches)).cast("int")
    return docs.select(key.alias("batch"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry))), n


class Batch:
    """The texts of a batch behind one another, in an order that does not depend on how they arrived."""

    def __init__(self, table):
        ids = table.column("doc_id")
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        if len(ids) > 1 and (np.diff(ids[order]) == 0).any():
            texts = table.column("text").to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] is not None, texts[i] or "")))
        self.table, self.order = table, order
        self.ids, self.null = ids[order], self.null[order]
        self.data, self.ends = flat(table.column("text"), order)

    def __len__(self) -> int:
        return len(self.ids)

    def id_array(self):
        import pyarrow as pa

        return pa.array(self.ids, mask=self.null)

    def carried(self) -> dict:
        """The carried columns, in the batch's order."""
        return {c: self.table.column(c).take(self.order) for c in self.table.column_names if c[0] == "c"}

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The number in the batch of the document that holds each byte position."""
        return np.searchsorted(self.ends, positions, "right") - 1


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """True for each of n places inside a range [start, stop)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, stops, -1)
    return np.cumsum(step[:n], out=step[:n]) > 0


def sha256(data) -> str:
    return hashlib.sha256(data).hexdigest()


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(payload: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8), count=n).astype(bool)


def parts_of(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the buckets, which are ranges of 64-bit hashes, begins in sorted hashes; one more entry at the end."""
    width = (1 << 64) // buckets + 1
    edges = np.array([k * width for k in range(buckets) if k * width < 1 << 64], np.uint64)
    cuts = np.searchsorted(sorted_hashes, edges)
    return np.append(cuts, [len(sorted_hashes)] * (buckets + 1 - len(cuts)))
