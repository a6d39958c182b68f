"""Nearest jobs along each key, all other keys equal."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.leaves import written


def adjacent(df: DataFrame, group: list[str], order: list[str], take: list[str], partitions: int | None = None) -> DataFrame:
    """df with prev_<c> and next_<c> for c in take: the rows before and after in the same group, by order.

    A window would put a whole group into one task. Here rows are sorted across partitions, looked
    at within each, and only the first and last rows of partitions meet.
    """
    keys = [*group, *order]
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    s = written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", *group).orderBy(*order)
    inside = s.withColumns({f"prev_{c}": F.lag(c).over(w) for c in take} | {f"next_{c}": F.lead(c).over(w) for c in take} | {"_first": F.row_number().over(w) == 1, "_last": F.lead(F.lit(1)).over(w).isNull()})
    row = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), *(F.col(c).alias(f"t{i}") for i, c in enumerate(take)))
    ends = s.groupBy("_part").agg(F.min(row).alias("head"), F.max(row).alias("tail"))
    over = Window.orderBy("_part")  # one row per partition
    ends = ends.select("_part", F.lag("tail").over(over).alias("_before"), F.lead("head").over(over).alias("_after"))
    out = inside.join(F.broadcast(ends), "_part", "left")
    same = lambda side: _all(F.col(f"{side}.k{i}").eqNullSafe(F.col(g)) for i, g in enumerate(group))
    for i, c in enumerate(take):
        out = out.withColumn(f"prev_{c}", F.when(F.col("_first") & same("_before"), F.col(f"_before.t{i}")).otherwise(F.col(f"prev_{c}")))
        out = out.withColumn(f"next_{c}", F.when(F.col("_last") & same("_after"), F.col(f"_after.t{i}")).otherwise(F.col(f"next_{c}")))
    return out.drop("_part", "_first", "_last", "_before", "_after")


def _all(tests: Iterable[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def neighbors(leaves: DataFrame, ignore: Iterable[str] = (), keep_constant: bool = False) -> DataFrame:
    """(job_id, path, json, prev_job_id, prev_json, next_job_id, next_json).

    Values are ordered by type name, then by value. Keys with one value in all the project are
    left out unless keep_constant. ignore: keys (or their beginnings) not looked at; what is left
    must still tell the jobs apart, else ValueError.
    """
    ignore = list(ignore)
    if ignore:
        gone = _all_or(F.col("path") == k for k in ignore) | _all_or(F.col("path").startswith(f"{k}.") for k in ignore)
        known = {k: bool(leaves.where((F.col("path") == k) | F.col("path").startswith(f"{k}.")).take(1)) for k in ignore}
        for k in (k for k, there in known.items() if not there):
            warnings.warn(f"ignored key {k!r} does not occur", RuntimeWarning, stacklevel=2)
        kept = leaves.where(~gone)
        whole = kept.groupBy("job_id").agg(F.md5(F.concat_ws("\u0001", F.array_sort(F.collect_list(F.concat_ws("\u0002", "path", "same"))))).alias("shadow"))  # leaves of one job
        twice = whole.groupBy("shadow").agg(F.count("*").alias("n"), F.min("job_id").alias("a"), F.max("job_id").alias("b")).where("n > 1").take(1)
        if twice:
            raise ValueError(f"without the ignored keys {twice[0]['a']} and {twice[0]['b']} are the same")
        others = kept.select("job_id", F.col("path").alias("p2"), F.col("same").alias("s2"))
        rest = kept.select("job_id", "path").join(others, "job_id").where("path <> p2").groupBy("job_id", "path").agg(F.md5(F.concat_ws("\u0001", F.array_sort(F.collect_list(F.concat_ws("\u0002", "p2", "s2"))))).alias("rest"))
        leaves = kept.drop("rest").join(rest, ["job_id", "path"], "left").fillna({"rest": ""})
    if not keep_constant:
        several = leaves.groupBy("path").agg(F.count_distinct("same").alias("n")).where("n > 1").select("path")
        leaves = leaves.join(several, "path", "left_semi")
    out = adjacent(leaves.select("job_id", "path", "rest", "type", "num", "str", "json"), ["path", "rest"], ["type", "num", "str", "json", "job_id"], ["job_id", "json"])
    return out.select("job_id", "path", "json", "prev_job_id", "prev_json", "next_job_id", "next_json")


def _all_or(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
