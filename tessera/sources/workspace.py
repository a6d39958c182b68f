"""Workspaces on disk: one folder per job with a state point file, a document file and other files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DestinationExistsError, DocumentsCorruptedError, JobsCorruptedError, WorkspaceError
from ..functions.canon import canonical_json
from ..functions.leaves import written
from ..functions.shipping import ship
from ..operators.project import Project
from .skipping import ROWS_PER_FILE, read_laid_out, write_laid_out

JOB_ID = r"([0-9a-f]{32})/[^/]*$"
CHUNK = 1 << 22


@dataclass(frozen=True)
class Layout:
    """Names inside a project folder; give another library's names to read its projects."""

    workspace: str = "workspace"
    statepoint: str = "statepoint.json"
    document: str = "document.json"
    index: str = ".tessera/index"


def _texts(spark: SparkSession, root: str, layout: Layout, name: str) -> DataFrame:
    """(job_id, text) of one file per job folder; folders whose names are no ids are passed over."""
    try:
        files = spark.read.option("recursiveFileLookup", "false").text(f"{root}/{layout.workspace}/*/{name}", wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "job_id string, text string")
    found = files.select(F.regexp_extract(F.col("_metadata.file_path"), JOB_ID, 1).alias("job_id"), F.col("value").alias("text"))
    return found.where("job_id <> ''")


def read_project(spark: SparkSession, root: str, layout: Layout = Layout(), validate: bool = True) -> Project:
    """Jobs of a workspace: state points left-joined with documents.

    validate: raise JobsCorruptedError for state points that are damaged or have another id,
    DocumentsCorruptedError for damaged documents. The files are read once then: what was parsed is
    kept as a table in the shared folder.
    """
    sp = _texts(spark, root, layout, layout.statepoint).select("job_id", canonical_json("text").alias("sp_json"))
    doc = _texts(spark, root, layout, layout.document).select("job_id", canonical_json("text").alias("doc_json"), F.lit(True).alias("has_doc"))
    both = sp.join(doc, "job_id", "left")
    if not validate:
        return Project.of_canonical(both.select("job_id", "sp_json", "doc_json"))
    both = written(both)
    wrong = both.select("job_id", (F.col("sp_json").isNull() | (F.md5("sp_json") != F.col("job_id"))).alias("sp"), (F.col("has_doc") & ~F.coalesce(F.col("doc_json").startswith("{"), F.lit(False))).alias("doc"))
    for column, error in (("sp", JobsCorruptedError), ("doc", DocumentsCorruptedError)):
        bad = [r[0] for r in wrong.where(column).select("job_id").limit(1000).collect()]  # as many as a message can name
        if bad:
            raise error(bad)
    return Project.of_canonical(both.select("job_id", "sp_json", "doc_json"))


def _opened(root: str):
    """(store, path) of a project folder, in tasks and on the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")


def job_ids(spark: SparkSession, root: str, layout: Layout = Layout()) -> DataFrame:
    """(job_id) of all job folders, by one listing of the workspace."""
    from pyarrow import fs

    store, base = _opened(root)
    found = store.get_file_info(fs.FileSelector(f"{base}/{layout.workspace}", allow_not_found=True))
    return spark.createDataFrame([(f.base_name,) for f in found if f.type == fs.FileType.Directory and re.fullmatch("[0-9a-f]{32}", f.base_name)], "job_id string")


def list_files(spark: SparkSession, root: str, ids: DataFrame | None = None, layout: Layout = Layout(), digest: bool = False, content: bool = False, every: bool = False) -> DataFrame:
    """(job_id, path, mtime, length, sha256, content) of the files in job folders, hidden ones too.

    Tasks list a folder each. sha256 and content are null unless asked for. every: with the state
    point and document files. A broken link raises WorkspaceError.
    """
    ship(spark)
    own = {layout.statepoint, layout.document}

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        types = {"job_id": pa.string(), "path": pa.string(), "mtime": pa.timestamp("us", "UTC"), "length": pa.int64(), "sha256": pa.string(), "content": pa.binary()}
        store, base = _opened(root)
        for b in batches:
            for job in b.column(0).to_pylist():
                rows = {c: [] for c in types}
                at = f"{base}/{layout.workspace}/{job}"
                links = (os.path.join(d, n) for d, below, names in os.walk(at) for n in (*below, *names)) if isinstance(store, fs.LocalFileSystem) else ()
                lost = next((p for p in links if os.path.islink(p) and not os.path.exists(p)), None)  # listings pass over them
                if lost:
                    raise WorkspaceError(f"a link leads nowhere: {lost}")
                for f in store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
                    name = f.path[len(at) + 1 :]
                    if f.type != fs.FileType.File or (name in own and not every):
                        continue
                    sha = hashlib.sha256() if digest else None
                    data = None
                    if digest or content:
                        with store.open_input_stream(f.path, compression=None) as s:
                            if content:
                                data = s.read()
                                if digest:
                                    sha.update(data)
                            else:
                                while piece := s.read(CHUNK):
                                    sha.update(piece)
                    for c, v in zip(types, (job, name, f.mtime, f.size, sha.hexdigest() if digest else None, data)):
                        rows[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in types.items()], names=list(types))

    ids = job_ids(spark, root, layout) if ids is None else ids
    return ids.select("job_id").mapInArrow(run, "job_id string, path string, mtime timestamp, length long, sha256 string, content binary")


def read_files(spark: SparkSession, root: str, layout: Layout = Layout(), ids: DataFrame | None = None) -> DataFrame:
    """(job_id, path, mtime, length, content) of all other files below job folders."""
    return list_files(spark, root, ids, layout, content=True).drop("sha256")


def copy_files(files: DataFrame, source: str, target: str, layout: Layout = Layout(), into: str | None = None) -> tuple[int, int]:
    """Copy files (job_id, path, length and, where the target's job is another, target_id) between workspaces; (number, bytes).

    into: another folder of the target than its workspace.

    Tasks stream from store to store. A file appears under its name once it is whole; one whose
    length is not the stated one raises WorkspaceError.
    """
    spark = files.sparkSession
    ship(spark)

    def run(batches):
        import pyarrow as pa

        (store, base), (to, home) = _opened(source), _opened(target)
        n = size = 0
        for b in batches:
            for job, path, length, other in zip(*(c.to_pylist() for c in b.columns)):
                at = "/".join(x for x in (home, layout.workspace if into is None else into, other, path) if x)
                to.create_dir(os.path.dirname(at), recursive=True)
                done = 0
                with store.open_input_stream(f"{base}/{layout.workspace}/{job}/{path}", compression=None) as i, to.open_output_stream(f"{at}.part", compression=None) as o:
                    while piece := i.read(CHUNK):
                        o.write(piece)
                        done += len(piece)
                if done != length:
                    raise WorkspaceError(f"{path} of {job} has {done} bytes instead of {length}")
                to.move(f"{at}.part", at)
                n, size = n + 1, size + done
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["n", "size"])

    other = F.col("target_id") if "target_id" in files.columns else F.col("job_id")
    row = files.select("job_id", "path", "length", other.alias("target_id")).mapInArrow(run, "n long, size long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return row[0], row[1]


def copy_jobs(spark: SparkSession, ids: DataFrame, source: str, target: str, layout: Layout = Layout()) -> tuple[int, int]:
    """Copy whole job folders: state points, documents and all other files; (files, bytes).

    A job that the target has raises DestinationExistsError before anything is written. Afterwards
    the target is listed and compared: anything missing raises WorkspaceError.
    """
    ids = ids.select("job_id").distinct()
    there = ids.join(job_ids(spark, target, layout), "job_id", "left_semi").take(1)
    if there:
        raise DestinationExistsError(there[0][0])
    files = list_files(spark, source, ids, layout, every=True)
    copied = copy_files(files, source, target, layout)
    key = ["job_id", "path", "length"]
    lost = files.select(key).exceptAll(list_files(spark, target, ids, layout, every=True).select(key)).take(1)
    if lost:
        raise WorkspaceError(f"{lost[0]['path']} of {lost[0]['job_id']} did not arrive")
    return copied


def remove_jobs(spark: SparkSession, ids: DataFrame, root: str, layout: Layout = Layout()) -> int:
    """Delete job folders with all they hold; returns how many there were."""
    ship(spark)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = _opened(root)
        n = 0
        for b in batches:
            for job in b.column(0).to_pylist():
                if store.get_file_info(f"{base}/{layout.workspace}/{job}").type == fs.FileType.Directory:
                    store.delete_dir(f"{base}/{layout.workspace}/{job}")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return ids.select("job_id").distinct().mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def move_jobs(spark: SparkSession, ids: DataFrame, source: str, target: str, layout: Layout = Layout()) -> tuple[int, int]:
    """copy_jobs, then remove_jobs once all has arrived."""
    ids = written(ids.select("job_id").distinct())  # they may be read from the folders that go
    copied = copy_jobs(spark, ids, source, target, layout)
    remove_jobs(spark, ids, source, layout)
    return copied


def clear_jobs(spark: SparkSession, ids: DataFrame, root: str, layout: Layout = Layout()) -> int:
    """Delete documents, stores and all other files of jobs; state points stay. Returns the number of files."""
    ship(spark)
    gone = list_files(spark, root, ids.select("job_id").distinct(), layout, every=True).where(F.col("path") != layout.statepoint).select("job_id", "path")

    def run(batches):
        import pyarrow as pa

        store, base = _opened(root)
        n = 0
        for b in batches:
            for job, path in zip(*(c.to_pylist() for c in b.columns)):
                store.delete_file(f"{base}/{layout.workspace}/{job}/{path}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return gone.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_project(project: Project, root: str, layout: Layout = Layout()) -> None:
    """Write state points and documents into job folders that executors can reach, task by task."""
    ship(project.jobs.sparkSession)

    def run(batches):
        import pyarrow as pa

        store, base = _opened(root)
        n = 0
        for b in batches:
            for job, sp, doc in zip(*(c.to_pylist() for c in b.columns)):
                at = f"{base}/{layout.workspace}/{job}"
                store.create_dir(at, recursive=True)
                for name, text in ((layout.statepoint, sp), (layout.document, doc)):
                    if text is not None:
                        with store.open_output_stream(f"{at}/{name}.part", compression=None) as f:
                            f.write(text.encode())
                        store.move(f"{at}/{name}.part", f"{at}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    project.jobs.select("job_id", "sp_json", "doc_json").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_files(files: DataFrame, root: str, layout: Layout = Layout()) -> int:
    """Write (job_id, path, content) into job folders that executors can reach; returns how many."""
    ship(files.sparkSession)

    def run(batches):
        import pyarrow as pa

        store, base = _opened(root)
        n = 0
        for b in batches:
            for job, path, content in zip(*(c.to_pylist() for c in b.columns)):
                at = f"{base}/{layout.workspace}/{job}/{path}"
                store.create_dir(os.path.dirname(at), recursive=True)
                with store.open_output_stream(f"{at}.part", compression=None) as f:
                    f.write(content)
                store.move(f"{at}.part", at)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("job_id", "path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# ---- index -----------------------------------------------------------------------------------

STAMPS = ("sp_mtime", "sp_length", "doc_mtime", "doc_length")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of an index: those that their job has marked as done."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{path.rstrip('/')}/v*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)


def _write_version(rows: DataFrame, path: str, keep: int = 2, **layout) -> None:
    """Add a version. It counts once it is whole, so readers see the old or the new one; the last `keep` stay."""
    spark = rows.sparkSession
    known = _versions(spark, path)
    write_laid_out(rows, f"{path.rstrip('/')}/v{(known[-1] if known else 0) + 1:08d}", **layout)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for old in known[: len(known) + 1 - keep]:
        at = hadoop.Path(f"{path.rstrip('/')}/v{old:08d}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_index(project: Project, path: str, most: int = 32, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Canonical state points, documents and their VARIANT forms as Parquet sorted by id, so that filters reach the scan.

    The `most` keys that most jobs have get typed columns with statistics and Bloom filters.
    """
    stamps = [F.col(c) if c in project.jobs.columns else F.lit(None).cast("timestamp" if c.endswith("mtime") else "long").alias(c) for c in STAMPS]
    _write_version(project.jobs.select("job_id", "sp_json", "doc_json", "sp", "doc", *stamps), path, most=most, rows_per_file=rows_per_file)


def read_index(spark: SparkSession, path: str, ids: Iterable[str] | None = None) -> Project:
    """The jobs of the last version. ids: only those with these ids or beginnings of ids, from the files that may hold them."""
    known = _versions(spark, path)
    if not known:
        raise LookupError(f"no index at {path}")
    return Project(*read_laid_out(spark, f"{path.rstrip('/')}/v{known[-1]:08d}", ids))


def index_delta(now: DataFrame, index: DataFrame, compare: tuple[str, ...] = ()) -> DataFrame:
    """(job_id, change): added or removed since the index was written or, where a column to compare differs, changed."""
    mark = lambda df, side: df.select("job_id", *(F.col(c).alias(f"{side}_{c}") for c in compare), F.lit(True).alias(side))
    both = mark(now, "now").join(mark(index, "then"), "job_id", "full_outer")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"now_{c}").eqNullSafe(F.col(f"then_{c}"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(~same, "changed")
    return both.select("job_id", change.alias("change")).where("change is not null")


def _stamps(spark: SparkSession, root: str, layout: Layout) -> DataFrame:
    """(job_id, times and lengths of the state point and document files), from listings alone."""
    files = list_files(spark, root, layout=layout, every=True).where(F.col("path").isin(layout.statepoint, layout.document))
    of = lambda name, c: F.max(F.when(F.col("path") == name, F.col(c)))
    out = files.groupBy("job_id").agg(*(of(name, c).alias(f"{side}_{c}") for side, name in (("sp", layout.statepoint), ("doc", layout.document)) for c in ("mtime", "length")))
    return out.where("sp_mtime is not null")


def _parsed(stamps: DataFrame, root: str, layout: Layout) -> DataFrame:
    """Rows of an index of the jobs in stamps; only their files are read."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = _opened(root)
        for b in batches:
            texts: list[list] = [[], []]
            for job in b.column(0).to_pylist():
                for out, name in zip(texts, (layout.statepoint, layout.document)):
                    at = f"{base}/{layout.workspace}/{job}/{name}"
                    if store.get_file_info(at).type == fs.FileType.File:
                        with store.open_input_stream(at, compression=None) as f:
                            out.append(f.read().decode("utf-8", "replace"))
                    else:
                        out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(t, pa.string()) for t in texts), *b.columns[1:]], names=["job_id", "sp_json", "doc_json", *STAMPS])

    ship(stamps.sparkSession)
    rows = stamps.select("job_id", *STAMPS).mapInArrow(run, "job_id string, sp_json string, doc_json string, sp_mtime timestamp, sp_length long, doc_mtime timestamp, doc_length long")
    rows = rows.withColumns({"sp_json": canonical_json("sp_json"), "doc_json": canonical_json("doc_json")})
    return rows.select("job_id", "sp_json", "doc_json", F.try_parse_json("sp_json").alias("sp"), F.try_parse_json("doc_json").alias("doc"), *STAMPS)


def update_index(spark: SparkSession, root: str, path: str, layout: Layout = Layout()) -> int | None:
    """Bring an index up to date and return its size, or None if nothing has changed.

    Only jobs that are new or whose state point or document file has another time or length are read.
    """
    now = _stamps(spark, root, layout)
    if not _versions(spark, path):
        _write_version(_parsed(now, root, layout), path)
        return len(read_index(spark, path))
    old = read_index(spark, path).jobs
    delta = written(index_delta(now, old, STAMPS))
    if not delta.take(1):
        return None
    read = _parsed(now.join(delta.where("change <> 'removed'"), "job_id", "left_semi"), root, layout)
    _write_version(old.join(delta.select("job_id"), "job_id", "left_anti").select(read.columns).union(read), path)
    return len(read_index(spark, path))
