"""Export to and import from folders and archives (zip, tar, tar.gz, tar.bz2, tar.xz)."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DestinationExistsError, StatepointParsingError, WorkspaceError
from ..functions.canon import canonical, canonical_json
from ..functions.leaves import working_folder, written
from ..functions.shipping import ship
from ..operators.project import Project
from .members import Member, members, pieces
from .packing import KINDS, tasks_for, write_archive
from .paths import PATH_COLUMNS, automatic_paths, check_paths, parse_columns, template_keys, template_path
from .workspace import Layout, _opened, copy_files, list_files

JOBS_OF_A_PART = 10_000


def export_paths(project: Project, path: str | bool | Callable | None = None) -> DataFrame:
    """(job_id, path). None: from the keys that vary; False: the id; text: a template; a callable: of (job id, state point)."""
    if path is False:
        out = project.jobs.select("job_id", F.col("job_id").alias("path"))
    elif path is None:
        out = automatic_paths(project.leaves(columns=PATH_COLUMNS))
    elif isinstance(path, str):
        keys = template_keys(path)
        wide = project.to_dataframe(flatten=True, sp_prefix="", usecols=lambda c: not c.startswith("doc."))
        columns = {c: f"`{c}`" for c in wide.columns if c != "job_id"}
        auto = None
        if "{{auto" in path:
            wide = wide.join(automatic_paths(project.leaves(columns=PATH_COLUMNS), exclude=keys).withColumnRenamed("path", "_auto"), "job_id")
            auto = F.col("_auto")
        out = wide.select("job_id", template_path(path, columns, auto).alias("path"))
    elif callable(path):

        def run(ids, sps):
            import pyarrow as pa

            return pa.array([str(path(i, json.loads(sp))) for i, sp in zip(ids.to_pylist(), sps.to_pylist())], pa.string())

        import pyarrow as pa

        run.__annotations__ = {"ids": pa.Array, "sps": pa.Array, "return": pa.Array}
        ship(project.jobs.sparkSession)
        out = written(project.jobs.select("job_id", F.arrow_udf(run, T.StringType())("job_id", "sp_json").alias("path")))
    else:
        raise ValueError("path is None, False, text or a callable")
    check_paths(out)
    return out


def export_to(project: Project, target: str, path: str | bool | None = None, layout: Layout = Layout(), files: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """Write every job below its path; returns (job_id, path). files: (job_id, path, content) to go along; root: a
    project folder whose jobs' other files go along.

    A job's path that is there already raises DestinationExistsError before anything is written, as
    does an archive. A folder is written by the executors, which stream files from root to their
    places; each appears under its name once it is whole. An archive is packed in
    parts by the executors, which one step joins.
    """
    at = written(export_paths(project, path))
    jobs = project.jobs.select("job_id", F.explode(F.array(F.struct(F.lit(layout.statepoint).alias("name"), F.encode("sp_json", "UTF-8").alias("content")), F.struct(F.lit(layout.document).alias("name"), F.encode("doc_json", "UTF-8").alias("content")))).alias("f")).select("job_id", "f.*")
    every = jobs if files is None else jobs.union(files.select("job_id", F.col("path").alias("name"), "content"))
    rows = every.where("content is not null").join(at, "job_id").select(F.ltrim(F.concat_ws("/", F.nullif("path", F.lit("")), "name"), F.lit("/")).alias("member"), "content")
    kind = os.path.splitext(target)[1]
    if kind in KINDS:
        local = target.removeprefix("file://")
        if os.path.exists(local):
            raise DestinationExistsError(local)
        blank = rows.select("member", "content", *(F.lit(None).cast(t).alias(c) for c, t in (("job_id", "string"), ("path", "string"), ("length", "long"))))
        if root is not None:
            other = list_files(project.jobs.sparkSession, root, at.select("job_id"), layout).join(at.withColumnRenamed("path", "folder"), "job_id")
            named = F.ltrim(F.concat_ws("/", F.nullif("folder", F.lit("")), "path"), F.lit("/"))
            other = written(other.select(named.alias("member"), F.lit(None).cast("binary").alias("content"), "job_id", "path", "length"))
            blank = blank.union(other.repartition(tasks_for(other)))
        else:
            blank = blank.repartition(max(1, at.count() // JOBS_OF_A_PART))  # small rows: Spark would leave them to few tasks
        write_archive(blank, local, KINDS[kind], root, layout)
        return at
    if kind in (".7z", ".rar", ".Z", ".zst"):
        raise TypeError(f"unknown archive {target}")
    folder = target if "://" in target else f"file://{os.path.abspath(target)}"

    spark = project.jobs.sparkSession
    ship(spark)

    def taken(batches):
        """Paths at which there is something already; an empty folder is nothing."""
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                at = store.get_file_info(f"{base}/{path}".rstrip("/"))
                if at.type == fs.FileType.File or at.type == fs.FileType.Directory and store.get_file_info(fs.FileSelector(at.path)):
                    found.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    there = at.select("path").mapInArrow(taken, "path string").take(1)
    if there:
        raise DestinationExistsError(f"{target}/{there[0][0]}")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        n = 0
        for b in batches:
            for member, content in zip(*(c.to_pylist() for c in b.columns)):
                store.create_dir(os.path.dirname(f"{base}/{member}"), recursive=True)
                with store.open_output_stream(f"{base}/{member}.part", compression=None) as f:
                    f.write(content)
                store.move(f"{base}/{member}.part", f"{base}/{member}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    if root is not None:
        other = list_files(spark, root, at.select("job_id"), layout).join(at.withColumnRenamed("path", "folder"), "job_id")
        copy_files(other.select("job_id", "path", "length", F.col("folder").alias("target_id")), root, folder, layout, into="")
    return at


def _ancestors(df: DataFrame, column: str) -> DataFrame:
    """df with each folder above (and of) column as `above`."""
    return df.withColumn("above", F.explode(F.expr(f"transform(sequence(1, size(split({column}, '/'))), i -> array_join(slice(split({column}, '/'), 1, i), '/'))")))


def job_folders(spark: SparkSession, origin: str, schema: str | Callable[[str], dict | None] | None = None, layout: Layout = Layout()) -> tuple[DataFrame, DataFrame]:
    """((folder, job_id, sp_json, doc_json) of the jobs of an origin, the places of its files). Of contents only state points and documents are read, once."""
    ship(spark)
    named = lambda df: df.withColumns({"folder": F.regexp_replace("path", "/?[^/]*$", ""), "name": F.regexp_extract("path", "([^/]*)$", 1)})
    files = named(written(members(spark, origin, content=False)))
    texts = written(named(members(spark, origin, names=(layout.statepoint, layout.document))).select("folder", "name", canonical_json(F.decode("content", "UTF-8")).alias("json")))
    sp = texts.where(F.col("name") == layout.statepoint).select("folder", F.col("json").alias("sp_json"))
    doc = texts.where(F.col("name") == layout.document).select("folder", F.col("json").alias("doc_json"))
    if callable(schema):
        folders = _ancestors(files.select("folder").distinct(), "folder").select(F.col("above").alias("folder")).distinct()
        from_path = folders.select("folder", _called(schema).alias("path_json")).where("path_json is not null")
    elif schema is not None:
        parsed = parse_columns(schema, F.col("folder"))
        folders = _ancestors(files.select("folder").distinct(), "folder").select(F.col("above").alias("folder")).distinct()
        folders = folders.withColumns({f"f{i}": c for i, c in enumerate(parsed.values())})
        fits = F.lit(True)
        for i in range(len(parsed)):
            fits = fits & F.col(f"f{i}").isNotNull()
        from_path = folders.where(fits).select("folder", _sp_json({k: f"f{i}" for i, k in enumerate(parsed)}).alias("path_json"))
    if schema is not None:
        both = from_path.join(sp, "folder", "left")
        if both.where("sp_json is not null and sp_json <> path_json").take(1):
            raise StatepointParsingError("a path and a state point file disagree")
        sp = both.select("folder", F.col("path_json").alias("sp_json"))
    if sp.where("sp_json is null").take(1):
        raise StatepointParsingError("a state point file cannot be read")
    inner = _ancestors(sp.select("folder"), "folder").where("above <> folder").join(sp.select(F.col("folder").alias("above")), "above", "left_semi").select("folder").distinct()
    jobs = sp.join(inner, "folder", "left_anti").join(doc, "folder", "left").select("folder", F.md5("sp_json").alias("job_id"), "sp_json", "doc_json")
    twice = jobs.groupBy("job_id").agg(F.count("*").alias("n")).where("n > 1").take(1)
    if twice:
        raise StatepointParsingError(f"several folders give job {twice[0][0]}")
    return jobs, files


def import_into(spark: SparkSession, origin: str, root: str, schema: Any = None, layout: Layout = Layout(), sync: bool = False, **kw) -> int:
    """Jobs of an exported folder or archive, with their files, into a project folder; returns how many.

    A job that the project has raises DestinationExistsError before anything is written; with sync
    it is merged by the rules of sync_workspaces, which get the other arguments.
    """
    from ..operators.sync import sync_workspaces
    from .workspace import copy_jobs, job_ids, write_project

    jobs, files = job_folders(spark, origin, schema, layout)
    jobs = written(jobs)
    new = Project.of_canonical(jobs.select("job_id", "sp_json", "doc_json"))
    there = new.jobs.join(job_ids(spark, root, layout), "job_id", "left_semi").select("job_id").take(1)
    if there and not sync:
        raise DestinationExistsError(there[0][0])
    # whole in a folder of its own first, so that a failure leaves the project as it was
    staging = working_folder(spark)
    write_project(new, staging, layout)
    copy_members(placed_files(jobs, files, layout), staging, layout)
    if sync:
        sync_workspaces(spark, staging, root, layout=layout, **kw)
    else:
        copy_jobs(spark, new.jobs, staging, root, layout)
    return len(new)


def _called(schema: Callable[[str], dict | None]):
    """A callable of a folder as canonical JSON; null where it gives None."""

    def run(folders):
        import pyarrow as pa

        found = [schema(f) for f in folders.to_pylist()]
        return pa.array([None if sp is None else canonical(sp) for sp in found], pa.string())

    import pyarrow as pa

    run.__annotations__ = {"folders": pa.Array, "return": pa.Array}
    ship()
    return F.arrow_udf(run, T.StringType())("folder")


def import_from(spark: SparkSession, origin: str, schema: Any = None, layout: Layout = Layout()) -> Project:
    """Jobs of an exported folder or archive.

    State points come from their files; with schema (a path template, or a callable of the folder that
    gives a mapping or None) from paths, and where both
    exist they must agree. What lies inside another job's folder belongs to that job.
    """
    return Project.of_canonical(job_folders(spark, origin, schema, layout)[0].select("job_id", "sp_json", "doc_json"))


def import_files(spark: SparkSession, origin: str, schema: Any = None, layout: Layout = Layout()) -> DataFrame:
    """(job_id, path, content) of the other files of an origin's jobs, paths inside the job's folder."""
    places = placed_files(*job_folders(spark, origin, schema, layout), layout)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            for r, (_, data) in zip(rows, pieces([Member(*(r[c] for c in Member._fields)) for r in rows])):
                yield pa.RecordBatch.from_arrays([pa.array([r["job_id"]]), pa.array([r["inside"]]), pa.array([b"".join(data)], pa.binary())], names=["job_id", "path", "content"])

    return _dealt(places).mapInArrow(run, "job_id string, path string, content binary")


def _dealt(places: DataFrame) -> DataFrame:
    """Places of files dealt to tasks: members of a compressed tar, which can only be read from the beginning, in order to one task."""
    key = F.when(F.col("kind").isin("zip", "tar", "folder"), F.pmod(F.xxhash64("source", "path"), F.lit(1 << 16))).otherwise(-1)
    return places.repartition("source", key).sortWithinPartitions("source", "offset")


def copy_members(places: DataFrame, root: str, layout: Layout = Layout()) -> int:
    """Stream files from where they are into job folders; returns how many. A file appears under its name once it is whole."""

    def run(batches):
        import pyarrow as pa

        store, base = _opened(root)
        n = 0
        for b in batches:
            rows = b.to_pylist()
            for r, (_, data) in zip(rows, pieces([Member(*(r[c] for c in Member._fields)) for r in rows])):
                at = f"{base}/{layout.workspace}/{r['job_id']}/{r['inside']}"
                store.create_dir(os.path.dirname(at), recursive=True)
                size = 0
                with store.open_output_stream(f"{at}.part", compression=None) as f:
                    for piece in data:
                        f.write(piece)
                        size += len(piece)
                if size != r["length"]:
                    raise WorkspaceError(f"{r['path']} has {size} bytes instead of {r['length']}")
                store.move(f"{at}.part", at)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ship(places.sparkSession)
    return _dealt(places).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def placed_files(jobs: DataFrame, files: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The places of an origin's other files with the job each belongs to and its path inside that job's folder."""
    placed = _ancestors(files, "folder").join(jobs.select(F.col("folder").alias("above"), "job_id"), "above")
    inside = F.when(F.col("above") == "", F.col("path")).otherwise(F.expr("substring(path, length(above) + 2)"))
    return placed.select("job_id", inside.alias("inside"), *Member._fields).where(~F.col("inside").isin(layout.statepoint, layout.document))


def _sp_json(columns: dict[str, str]):
    """Nested canonical JSON from columns named by dotted keys."""
    from ..functions.leaves import nest

    keys = list(columns)

    def run(*values):
        import pyarrow as pa

        return pa.array([json.dumps(nest(dict(zip(keys, row))), sort_keys=True) for row in zip(*(v.to_pylist() for v in values))], pa.string())

    return F.arrow_udf(run, T.StringType(), F.ArrowUDFType.SCALAR)(*(F.col(c) for c in columns.values()))
