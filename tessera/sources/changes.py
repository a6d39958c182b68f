"""Changes of job folders: state points with their files, repair, making jobs. Each is whole or not at all (journal)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DestinationExistsError, JobsCorruptedError, StatepointParsingError
from ..functions.canon import canonical_json
from ..functions.leaves import written
from ..operators.project import Project
from ..operators.rekey import rekey_plan
from .journal import changed, settled, write_texts
from .workspace import Layout, _texts, job_ids, read_project


def _folders(plan: DataFrame, texts: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(steps, files to put beside them) that give the jobs of a plan their new ids and state points."""
    steps = plan.select(F.lit("folder").alias("kind"), "job_id", F.col("new_id").alias("target_id"), F.lit(layout.statepoint).alias("path"), F.lit(False).alias("there"), F.lit(False).alias("fresh"))
    return steps, plan.join(texts, "job_id").select(F.col("new_id").alias("target_id"), F.lit(layout.statepoint).alias("path"), F.col("sp_json").alias("text"))


def rekey_jobs(spark: SparkSession, root: str, statepoints: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Give jobs other state points: (job_id, sp_json). Their folders, with documents and all files, move to the new ids.

    Returns the plan (job_id, new_id, kind) of the jobs that moved. Chains and cycles of ids are
    fine; an id that another job keeps, or that two jobs would get, raises DestinationExistsError
    before anything moves, an unknown job KeyError, a state point that is no JSON object
    StatepointParsingError.
    """
    settled(spark, root, layout)
    new = written(statepoints.select("job_id", canonical_json("sp_json").alias("sp_json")).withColumn("new_id", F.md5("sp_json")))
    bad = new.where("sp_json is null or sp_json not like '{%'").take(1)
    if bad:
        raise StatepointParsingError(f"the state point for {bad[0]['job_id']} is no mapping")
    there = written(job_ids(spark, root, layout))
    lost = new.join(there, "job_id", "left_anti").take(1)
    if lost:
        raise KeyError(lost[0]["job_id"])
    plan = written(rekey_plan(there, new))
    clash = plan.where("kind = 'clash'").take(1)
    if clash:
        raise DestinationExistsError(clash[0]["new_id"])
    if plan.take(1):
        steps, texts = _folders(plan, new.select("job_id", "sp_json"), layout)
        changed(spark, root, steps, lambda journal: write_texts(texts, journal), layout)
    return plan


def update_statepoints(spark: SparkSession, root: str, change: Mapping, filter: Any = None, overwrite: bool = False, layout: Layout = Layout()) -> DataFrame:
    """Set keys of matching jobs' state points, folders and files included; the plan of rekey_jobs. A key with another value there needs overwrite."""
    settled(spark, root, layout)
    return rekey_jobs(spark, root, read_project(spark, root, layout).statepoint_changes(change, filter, overwrite), layout)


def repair_workspace(spark: SparkSession, root: str, index: DataFrame | None = None, ids: Iterable[str] | None = None, layout: Layout = Layout()) -> DataFrame:
    """Mend state points that are missing, damaged or under a wrong id; (job_id, new_id, action).

    index: (job_id, sp_json) as it was once known. Where it knows a job whose file does not hash to
    the id, the file is written anew. Otherwise a readable state point under a wrong id takes the
    folder to its own id. What cannot be mended, or would land on another job, is named in
    JobsCorruptedError once all the others are mended.
    """
    settled(spark, root, layout)
    folders = job_ids(spark, root, layout)
    if ids is not None:
        folders = folders.join(spark.createDataFrame([(i,) for i in ids], "job_id string"), "job_id", "left_semi")
    texts = _texts(spark, root, layout, layout.statepoint).select("job_id", F.lit(True).alias("has_file"), canonical_json("text").alias("own"))
    known = spark.createDataFrame([], "job_id string, known string") if index is None else index.select("job_id", canonical_json("sp_json").alias("known")).where(F.md5("known") == F.col("job_id"))
    rows = folders.join(texts, "job_id", "left").join(known, "job_id", "left")
    readable = F.coalesce(F.col("own").startswith("{"), F.lit(False))
    action = F.when(readable & (F.md5("own") == F.col("job_id")), "keep").when(F.col("known").isNotNull(), "write").when(readable, "rename").otherwise("lost")
    rows = written(rows.withColumn("action", action))
    moves = rows.where("action = 'rename'").select("job_id", F.md5("own").alias("new_id"))
    plan = written(rekey_plan(job_ids(spark, root, layout), moves))
    good = plan.where("kind <> 'clash'")
    steps, files = _folders(good, rows.select("job_id", F.col("own").alias("sp_json")), layout)
    anew = rows.where("action = 'write'")
    steps = steps.union(anew.select(F.lit("file"), F.lit(None).cast("string"), "job_id", F.lit(layout.statepoint), F.coalesce("has_file", F.lit(False)), F.lit(False)))
    files = files.union(anew.select("job_id", F.lit(layout.statepoint), "known"))
    if steps.take(1):
        changed(spark, root, steps, lambda journal: write_texts(files, journal), layout)
    done = rows.join(plan.select("job_id", "new_id", "kind"), "job_id", "left").select("job_id", F.coalesce("new_id", "job_id").alias("new_id"), F.when(F.col("kind") == "clash", "lost").otherwise(F.col("action")).alias("action"))
    lost = [r[0] for r in done.where("action = 'lost'").select("job_id").orderBy("job_id").limit(1000).collect()]  # as many as a message can name
    if lost:
        raise JobsCorruptedError(lost)
    return done.where("action <> 'keep'")


def init_jobs(spark: SparkSession, root: str, project: Project, force: bool = False, validate: bool = True, layout: Layout = Layout()) -> int:
    """Make folders for jobs, and return how many are new. Jobs that are there stay as they are.

    With validate, a job that is there with a damaged state point raises JobsCorruptedError before
    anything is written; with force its state point is written anew.
    """
    settled(spark, root, layout)
    jobs = written(project.jobs.select("job_id", "sp_json", "doc_json"))
    there = job_ids(spark, root, layout).join(jobs, "job_id")
    texts = _texts(spark, root, layout, layout.statepoint).select("job_id", F.lit(True).alias("has_file"), F.md5(canonical_json("text")).alias("own"))
    state = written(there.join(texts, "job_id", "left").select("job_id", "sp_json", "has_file", F.col("own").eqNullSafe(F.col("job_id")).alias("good")))
    damaged = state.where("has_file and not good")
    if validate and not force:
        bad = [r[0] for r in damaged.select("job_id").limit(1000).collect()]
        if bad:
            raise JobsCorruptedError(bad)
    new = jobs.join(state.select("job_id"), "job_id", "left_anti")
    anew = state.where("has_file is null" + (" or not good" if force else ""))
    place = lambda df, name, there, fresh: df.select(F.lit("file").alias("kind"), F.lit(None).cast("string").alias("job_id"), F.col("job_id").alias("target_id"), F.lit(name).alias("path"), there.alias("there"), F.lit(fresh).alias("fresh"))
    no = F.lit(False)
    steps = place(new, layout.statepoint, no, True).union(place(new.where("doc_json is not null"), layout.document, no, True)).union(place(anew, layout.statepoint, F.coalesce("has_file", no), False))
    text = lambda df, name, c: df.where(F.col(c).isNotNull()).select(F.col("job_id").alias("target_id"), F.lit(name).alias("path"), F.col(c).alias("text"))
    files = text(new, layout.statepoint, "sp_json").union(text(new, layout.document, "doc_json")).union(text(anew, layout.statepoint, "sp_json"))
    if steps.take(1):
        changed(spark, root, steps, lambda journal: write_texts(files, journal), layout)
    return new.count()
