"""Exact token-length histogram and what suffix sums over it answer for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import few_files, ship, stored


def lengths(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document: its encoded length. Null and empty text: 0."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        encoder = tokens.byte_bpe(vocabulary)
        for batch in batches:
            text = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens.byte_ids(encoder, text[i].as_py() or "")) for i in range(batch.num_rows)], pa.int64())], names=["length"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "length long")


def limits(histogram: DataFrame, bucket: int = 128) -> DataFrame:
    """histogram(length, n_docs) to one row per length taken as a context limit.

    Suffix sums go in two steps, over buckets of lengths and within each, so that no task holds
    the whole histogram. Columns: context (the limit), n_docs of that length, n_tokens of those,
    docs_over and tokens_over (longer documents), docs_within, truncated_total (tokens kept if
    every document is cut there), lost_tokens, quantile (share of documents within the limit),
    total_docs, total_tokens. Between two rows the truncated total is linear, so the table answers every limit.
    """
    h = histogram.select(F.col("length").alias("context"), "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / bucket).alias("bucket"))
    per = h.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    longer = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("bucket", *(F.coalesce(F.sum(c).over(longer), F.lit(0)).alias(f"{c}_after") for c in ("d", "t")), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("context")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(per, "bucket").select(
        "context", "n_docs", "n_tokens", "total_docs", "total_tokens",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_after")).alias("docs_over"),
        (F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("t_after")).alias("tokens_over"),
    )
    out = few_files(out).withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_over") + F.col("context") * F.col("docs_over"))
    return out.select(
        "context", "n_docs", "n_tokens", "docs_over", "tokens_over", (F.col("total_docs") - F.col("docs_over")).alias("docs_within"), "truncated_total",
        (F.col("total_tokens") - F.col("truncated_total")).alias("lost_tokens"), ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"), "total_docs", "total_tokens",
    )


def at_limits(table: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers for any context limits, column context of asked, from a table of token_counts.

    Each limit takes the row of the longest length that it holds (as-of by a range sort, so neither
    side is broadcast or gathered) and adds what longer documents keep beyond that length. Limits
    below the shortest length give no documents within. Null and repeated limits: null limits are
    left out, repeated ones are answered once. Without documents there are no rows.
    """
    docs, total = table.agg(F.max("total_docs"), F.max("total_tokens")).first()
    known = table.select("context", F.struct(F.col("context").alias("length"), "docs_over", "truncated_total").alias("row"), F.lit(0).alias("q"))
    wanted = asked.select(F.col("context").cast("long").alias("context")).where("context is not null").distinct().select("context", F.lit(None).cast(known.schema["row"].dataType).alias("row"), F.lit(1).alias("q"))
    parts = table.sparkSession.sparkContext.defaultParallelism
    laid = stored(known.unionByName(wanted).repartitionByRange(parts, "context").sortWithinPartitions("context", "q").withColumn("part", F.spark_partition_id()), "limits")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = laid.groupBy("part").agg(F.max("row").alias("last")).select("part", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("part").orderBy("context", "q").rowsBetween(Window.unboundedPreceding, 0)
    met = laid.withColumn("met", F.max("row").over(inside)).where("q = 1").join(F.broadcast(carried), "part", "left").select("context", F.coalesce("met", "carried").alias("m"))
    n, t = F.lit(docs).cast("long"), F.lit(total).cast("long")
    over = F.coalesce("m.docs_over", n)
    kept = F.coalesce(F.col("m.truncated_total") + (F.col("context") - F.col("m.length")) * F.col("m.docs_over"), F.greatest("context", F.lit(0)) * n)
    return met.where(n.isNotNull()).select("context", over.alias("docs_over"), (n - over).alias("docs_within"), kept.alias("truncated_total"), (t - kept).alias("lost_tokens"), ((n - over) / n).alias("quantile"))


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Histogram of encoded lengths with answers for every context limit.

    Null text counts as empty, length 0; repeated rows count each; an empty table gives no rows;
    other columns do not matter.
    """
    counted = lengths(docs, text_col, vocabulary).groupBy("length").agg(F.count("*").alias("n_docs"))
    return limits(stored(few_files(counted), "histogram"))  # else both steps of the suffix sums would encode all texts


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
