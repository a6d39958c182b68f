"""Incremental index: new state point files arrive as a stream and are merged into the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.canon import canonical_json
from ..sources.workspace import JOB_ID, Layout, update_index


def statepoint_stream(spark: SparkSession, root: str, layout: Layout = Layout()) -> DataFrame:
    """(job_id, sp_json, seen) of state point files as they appear; damaged files are left out."""
    files = spark.readStream.format("text").option("wholetext", "true").load(f"{root}/{layout.workspace}/*/{layout.statepoint}")
    found = files.select(F.regexp_extract(F.col("_metadata.file_path"), JOB_ID, 1).alias("job_id"), canonical_json("value").alias("sp_json"), F.col("_metadata.file_modification_time").alias("seen"))
    return found.where((F.col("job_id") != "") & (F.md5("sp_json") == F.col("job_id")))


def refresh(spark: SparkSession, root: str, index: str, checkpoint: str, layout: Layout = Layout(), once: bool = True) -> StreamingQuery:
    """Bring the index up to date whenever state point or document files appear. Replayed batches change nothing.

    Each batch goes by the times and lengths of all files, so documents that were only edited come
    along with the next batch; update_index does the same at any time.
    """

    def merge(batch: DataFrame, number: int) -> None:
        update_index(spark, root, index, layout)

    names = f"{{{layout.statepoint},{layout.document}}}"
    files = spark.readStream.format("text").option("wholetext", "true").load(f"{root}/{layout.workspace}/*/{names}")
    writer = files.select(F.col("_metadata.file_path")).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def changes_per_window(jobs: DataFrame, length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, n_jobs): new jobs per window of time of a stream with column seen."""
    return jobs.withWatermark("seen", late).groupBy(F.window("seen", length)).agg(F.count("*").alias("n_jobs"))
