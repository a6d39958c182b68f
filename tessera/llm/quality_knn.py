"""Quality classifier: votes of the nearest labelled neighbours in latent-semantic space.

Terms are hashed words, hashed word shapes (runs of letter case, digits and each symbol), and
marks for a word that repeats the one before it, a word inside a repeated stretch, and the size of
the text. A bounded sample of labelled rows gives inverse document frequencies, the latent space
(singular vectors of its term matrix) and the labelled vectors; these go to every task. Each
document is compared with all labelled vectors, block by block, by exact cosine products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, flat, held_out, mix, ship, slices, window_hash, word_hashes, words_of

WORDS, SHAPES, MARKS = 512, 256, 24
TERMS = WORDS + SHAPES + MARKS
SHARES = (0.4, 1.0, 1.0)  # weight of each kind of terms

#: Byte classes of word shapes: lower case and bytes of other characters, upper case, digits, and every other byte for itself.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[ord("A") : ord("Z") + 1] = ord("A")
CLASS[ord("a") : ord("z") + 1] = ord("a")
CLASS[ord("0") : ord("9") + 1] = ord("0")
CLASS[128:] = ord("a")


def term_counts(texts) -> np.ndarray:
    """Counts of terms, (texts, TERMS)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, ends = flat(texts.cast(pa.large_string()))
    n = len(ends) - 1
    out = np.zeros((n, TERMS), np.float32)
    starts, stops, first = words_of(data, ends)
    sizes = np.diff(first)
    out[np.arange(n), WORDS + SHAPES + 8 + np.minimum(np.log2(sizes + 1).astype(int), MARKS - 9)] = 1
    if not len(starts):
        return out
    doc = np.repeat(np.arange(n), sizes)
    classes = CLASS[data]
    keep = np.append(True, classes[1:] != classes[:-1])
    keep[starts] = True
    before = np.cumsum(keep, dtype=np.int32 if len(keep) < 1 << 31 else np.int64)
    shapes = word_hashes(classes[keep], before[starts] - 1, before[stops - 1])
    lower, lower_ends = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    a, z, _ = words_of(lower, lower_ends)
    words = word_hashes(lower, a, z)
    marks = np.zeros(len(words), np.int64)
    same = np.append(False, (words[1:] == words[:-1]) & (doc[1:] == doc[:-1]))
    stretch = window_hash(words, 5, 0x9E3779B97F4A7C15)
    if len(stretch):
        inside = doc[4:] == doc[:-4]
        key = mix(stretch ^ (doc[: len(stretch)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        key = key[inside]
        order = np.argsort(key, kind="stable")
        values = key[order]
        twice = np.zeros(len(key), bool)
        equal = values[1:] == values[:-1]
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        marks[np.flatnonzero(inside)[twice]] = 1
    marks[same] = 2
    for terms, at in (((words % np.uint64(WORDS)).astype(np.int64), 0), ((shapes % np.uint64(SHAPES)).astype(np.int64), WORDS), (marks, WORDS + SHAPES)):
        width = WORDS if at == 0 else SHAPES if at == WORDS else 8
        out[:, at : at + width] += np.bincount(doc * width + terms, minlength=n * width).reshape(n, width)
    return out


@dataclass
class Space:
    """Frozen: term weights, latent directions, labelled vectors of unit length, their labels."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.weights) @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, k: int) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest; all that are as near as the k-th vote too."""
        near = self.project(counts) @ self.vectors.T
        k = min(k, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k][:, None]
        votes = np.where(near >= least - 1e-5, np.maximum(near, 1e-6), 0)
        return np.clip((votes @ self.labels) / votes.sum(axis=1), 0, 1)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of term shares, kind by kind, times term weights, each kind of unit length times its share."""
    out = np.zeros_like(counts)
    at = 0
    for width, share in zip((WORDS, SHAPES, MARKS), SHARES):
        x = np.sqrt(counts[:, at : at + width]) * weights[at : at + width]
        out[:, at : at + width] = share * x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        at += width
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4096, dimensions: int = 48, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space | None:
    """Learn from about max_rows labelled ids (picked by a hash) that are not held out; whole texts.

    Of rows that share an id, the one with the least hash of its text is learned from; of labels, the least.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("label").alias("label"))
    n = known.count()
    if not n:
        return None
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, max_rows / n) * (1 << 30)))  # about max_rows ids

    def run(batches):
        import pyarrow as pa

        for b in (x for batch in batches for x in slices(batch, 2, 256)):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in term_counts(b.column(2))], pa.binary())], names=["doc_id", "label", "terms"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = d.join(F.broadcast(sample), "doc_id")
    one = asked.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
    got = one.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(run, "doc_id long, label int, terms binary").toArrow()
    if not got.num_rows:
        return None
    counts = np.stack([np.frombuffer(x.as_py(), np.float32) for x in got.column("terms")])
    y = got.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*counts.T[:8], got.column("doc_id").to_numpy()))
    counts, y = counts[order], (y[order] > 0).astype(np.float64)
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.5
    x = weighted(counts, weights.astype(np.float32))
    _, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
    directions = np.ascontiguousarray(vectors[:, ::-1][:, :dimensions]).astype(np.float32)
    space = Space(weights.astype(np.float32), directions, np.zeros((0, dimensions), np.float32), y)
    space.vectors = space.project(counts)
    return space


def classify(docs: DataFrame, space: Space | None, k: int = 15, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null text is empty; an empty text has a vector of its own (size 0, no words) and is scored like
    any other. Without any labelled row every score is 0.5. Repeated rows get equal scores. Other
    columns are not carried.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(space)

    def run(batches):
        import pyarrow as pa

        s = sent.value
        for batch in batches:
            for b in slices(batch, 2, 256):
                score = s.score(term_counts(b.column(2)), k) if s is not None else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score.astype(np.float64)), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, space: Space | None, k: int = 15, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least threshold."""
    spark = docs.sparkSession
    ship(spark)
    sent, place = spark.sparkContext.broadcast(space), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        s = sent.value
        for batch in batches:
            for b in slices(batch, place, 256):
                yield b.filter(pa.array(s.score(term_counts(b.column(place)), k) >= threshold)) if s is not None else b

    return filtered(docs, run)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
