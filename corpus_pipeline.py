"""Training-data pipeline over the documents table: quality, near copies, repeated passages, benchmark text, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, near_copies, packing, quality_knn, suffix_dedup
from tessera.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labelled rows among docs."""
    return quality_knn.keep_good(docs, quality_knn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word similarity 0.8 or more join, the one with the smallest id stays; of rows with its id and text, one. Rows without an id stay.

    Which of several rows with one id and text stays does not depend on where they lie. Candidates
    are texts that SimHash joins, by operator 8's signatures with deletions; as most pairs of that
    similarity differ in more bits than these index (README, known limits), bands of minimum hashes
    add to them. The exact similarity decides on both.
    """
    keep = near_copies.near_copies(docs)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # in one column, so that no name can clash
    marked = docs.where("doc_id is not null").select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.xxhash64(F.to_json(F.struct(row.alias("x")))).alias("row_hash"), whole.alias("r"))
    met = marked.join(keep.select("doc_id", "text_hash").hint("shuffle_merge"), ["doc_id", "text_hash"], "left_semi")
    first = met.groupBy("doc_id", "text_hash").agg(F.min_by("r", "row_hash").alias("r"))
    return first.select(*(F.col(f"r.`{c}`") for c in docs.columns)).union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte strings that a document with a smaller id has too are cut out; documents of which nothing is left go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix_dedup.suffix_dedup(docs, keep_text=True, carry=others)
    left = cut.where("n_removed = 0 or n_removed < n_bytes")
    if "n_chars" in others:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified overlap with the benchmark go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_text),
    ("best_fit_packing", pack),
]

#: The second stage takes its candidates from SimHash, and more from bands of minimum hashes (see near_duplicates).
#: SQL cannot express the stages; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
