"""Linked views: a tree of links named by state points."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.leaves import written
from ..functions.shipping import ship
from ..sources.paths import check_paths


def view_plan(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, action, target): new, update (another target), obsolete or keep; both have (path, target)."""
    both = existing.select("path", F.col("target").alias("old")).join(wanted.select("path", F.col("target").alias("new")), "path", "full_outer")
    action = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "obsolete").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return both.select("path", action.alias("action"), F.coalesce("new", "old").alias("target"))


def dead_branches(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(folder): folders of existing paths that no wanted path uses."""
    heads = lambda d: d.select(F.explode(F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("folder"), "path").where("folder <> path").select("folder").distinct()
    return heads(existing).join(heads(wanted), "folder", "left_anti")


def check_values(leaves: DataFrame) -> None:
    """Raise for keys or text values with a slash, which a view could not tell from folders."""
    found = leaves.where(F.col("path").contains("/") | F.coalesce(F.col("str").contains("/"), F.lit(False))).select("path").take(1)
    if found:
        raise RuntimeError(f"a slash in key or value of {found[0]['path']!r}: a view needs a path of its own")


def wanted_links(paths: DataFrame, workspace: str) -> DataFrame:
    """(path, target) of a view of (job_id, path); paths that several jobs have or that lie in one another raise."""
    check_paths(paths)
    return paths.select(F.when(F.col("path") == "", "job").otherwise(F.concat(F.col("path"), F.lit("/job"))).alias("path"), F.concat(F.lit(f"{workspace.rstrip('/')}/"), F.col("job_id")).alias("target"))


def create_linked_view(paths: DataFrame, workspace: str, prefix: str) -> DataFrame:
    """Make the view below a folder prefix that executors reach too, changing only what differs; returns the plan.

    Tasks take shares of the plan: first they remove links that go, and folders that are empty then,
    after that each new link is made under a temporary name and renamed. A task may run again.
    """
    spark, prefix = paths.sparkSession, os.path.abspath(prefix)
    ship(spark)
    found = [(os.path.relpath(p, prefix), os.path.realpath(p)) for d, dirs, files in os.walk(prefix) for p in (os.path.join(d, n) for n in dirs + files) if os.path.islink(p)]
    plan = written(view_plan(spark.createDataFrame(found, "path string, target string"), wanted_links(paths, os.path.realpath(workspace))).where("action <> 'keep'"))

    def remove(at: str, target: str) -> None:
        if os.path.islink(at):
            os.unlink(at)
        folder = os.path.dirname(at)
        while folder != prefix:
            try:
                os.rmdir(folder)
            except FileNotFoundError:
                pass  # another task's
            except OSError:
                return  # something is in it
            folder = os.path.dirname(folder)

    def make(at: str, target: str) -> None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        new = f"{at}.{uuid.uuid4().hex}.part"
        os.symlink(os.path.relpath(target, os.path.realpath(os.path.dirname(at))), new)
        os.replace(new, at)

    def each(rows: DataFrame, step) -> None:
        def run(batches):
            import pyarrow as pa

            n = 0
            for b in batches:
                for path, target in zip(*(c.to_pylist() for c in b.columns)):
                    step(os.path.join(prefix, path), target)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        rows.select("path", "target").repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, "n long").agg(F.sum("n")).collect()

    each(plan.where("action = 'obsolete'"), remove)
    each(plan.where("action <> 'obsolete'"), make)
    return plan
