"""What lets readers pass over most of an index.

Rows are sorted by id across files, and a small table tells the range of ids of each file. Keys that
many jobs have get typed columns beside the VARIANT ones, with statistics and Bloom filters, so
comparisons with them skip row groups.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.leaves import written
from ..plans.fields import NUMBERS, IndexFields, VariantFields, variant_tag

ROWS_PER_FILE = 1 << 20
RANGES = "file string, first string, last string"


def key_counts(jobs: DataFrame, column: str) -> DataFrame:
    """(path, tag, n): how many jobs have each key of a VARIANT column, by the value's type.

    Objects are opened level by level in the JVM until none is left, a job for each level. Values
    that are no objects, and nulls, have no keys.
    """
    spark = jobs.sparkSession
    at = jobs.select(F.lit("").alias("above"), F.col(column).alias("v")).where(variant_tag(F.col(column)) == "dict")
    out = None
    while True:
        level = spark.sql("SELECT concat(above, key) AS path, value AS v FROM {at}, LATERAL variant_explode(v)", at=at).withColumn("tag", variant_tag(F.col("v")))
        counts = level.where("tag <> 'dict'").groupBy("path", "tag").agg(F.count("*").alias("n"))
        out = counts if out is None else out.union(counts)
        at = level.where("tag = 'dict'").select(F.concat("path", F.lit(".")).alias("above"), "v")
        if not at.take(1):
            return out


def typed_columns(jobs: DataFrame, most: int) -> list[Column]:
    """Columns of the numbers or texts of the `most` keys that most jobs have, for state points and documents each.

    Names say nothing; the key and kind are in the column's metadata. Values of other types are null.
    """
    out = []
    for ns in ("sp", "doc"):
        kind = F.when(F.col("tag") == "str", "text").otherwise("number")
        counts = key_counts(jobs, ns).where(F.col("tag").isin(*NUMBERS, "str")).groupBy("path", kind.alias("kind")).agg(F.sum("n").alias("n"))
        for r in counts.orderBy(F.desc("n"), "path", "kind").limit(most).collect():
            key = f"{ns}.{r['path']}"
            f = VariantFields().field(key)
            value = f.text if r["kind"] == "text" else f.number + F.lit(0.0)  # Bloom filters tell 0.0 and -0.0 apart
            out.append(value.alias(f"_k{len(out)}", metadata={"key": key, "kind": r["kind"]}))
    return out


def write_laid_out(rows: DataFrame, at: str, most: int = 32, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Rows (job_id, sp, doc, others) as Parquet sorted by id, with typed columns, Bloom filters and ranges of ids."""
    rows = written(rows)
    spark, files = rows.sparkSession, max(1, -(-rows.count() // rows_per_file))
    columns = typed_columns(rows, most)
    laid = rows.select("*", *columns).repartitionByRange(files, "job_id").sortWithinPartitions("job_id")
    writer = laid.write.mode("overwrite").option("parquet.bloom.filter.adaptive.enabled", "true")
    for name in ("job_id", *laid.columns[len(rows.columns) :]):
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(at)
    found = spark.read.parquet(at).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("job_id").alias("first"), F.max("job_id").alias("last"))
    found.coalesce(1).write.mode("overwrite").parquet(f"{at}/_ranges")


def read_laid_out(spark: SparkSession, at: str, ids: Iterable[str] | None = None) -> tuple[DataFrame, IndexFields]:
    """(rows, their fields). ids: ids or beginnings of ids; only files whose range may hold them are read.

    An index without ranges, of a writer that was broken off after the rows, is read whole.
    """
    rows = spark.read.parquet(at)
    fields = IndexFields({(f.metadata["key"], f.metadata["kind"]): f.name for f in rows.schema if "kind" in f.metadata})
    if ids is None:
        return rows, fields
    hit, near = F.lit(False), F.lit(False)
    for i in set(ids):
        hit = hit | F.col("job_id").startswith(i)
        near = near | ((F.substring("first", 1, len(i)) <= i) & (F.col("last") >= i))
    try:
        files = [r[0] for r in spark.read.schema(RANGES).parquet(f"{at}/_ranges").where(near).select("file").collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows.where(hit), fields
    if not files:
        return rows.where("false"), fields
    return spark.read.schema(rows.schema).parquet(*(f"{at}/{f}" for f in files)).where(hit), fields
