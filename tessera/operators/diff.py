"""How state points differ."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.leaves import nest


def diff_leaves(leaves: DataFrame, ids: Iterable[str] | None = None) -> DataFrame:
    """(job_id, path, json) of what is not the same in all of the jobs. ids: jobs to compare (default: all in leaves)."""
    if ids is not None:
        leaves = leaves.where(F.col("job_id").isin(*set(ids)))
    n = leaves.select("job_id").distinct().count() if ids is None else len(set(ids))
    common = leaves.groupBy("path", "same").agg(F.count_distinct("job_id").alias("n")).where(F.col("n") == n).select("path", "same")
    return leaves.join(common, ["path", "same"], "left_anti").select("job_id", "path", "json")


def diff_jobs(leaves: DataFrame, *ids: str) -> dict[str, dict]:
    """Nested differences of some jobs; without jobs {}, of one job an empty mapping."""
    out: dict[str, dict] = {i: {} for i in ids}
    for r in diff_leaves(leaves, ids).collect() if len(out) > 1 else []:
        out[r["job_id"]][r["path"]] = json.loads(r["json"])
    return {k: nest(v) for k, v in out.items()}
