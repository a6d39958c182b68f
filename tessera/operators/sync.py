"""Synchronisation of two projects as plan tables, then applied."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentSyncConflict, FileSyncConflict, SchemaSyncConflict
from ..functions.canon import canonical, unified
from ..functions.leaves import flatten, nest, written
from ..functions.shipping import ship
from .project import Project
from .schema import ProjectSchema


class DocSync:
    """How documents are merged. NO_SYNC: not at all. COPY: the source's document, where it has one, replaces the destination's.
    UPDATE: each key of the source's document, nested or not, replaces that of the destination as a whole."""

    NO_SYNC = "no_sync"
    COPY = "copy"
    UPDATE = "update"

    class ByKey:
        """Key by key, mappings on both sides one within the other; equal values (1 and 1.0 too) are no difference. keys: regular expression matched from the start, or a callable of the dotted key, for keys whose
        differing value the source gives; other differences stay as they are, or raise if keys is None."""

        def __init__(self, keys: str | Callable[[str], bool] | None = None):
            self.keys = keys


class FileSync:
    """Which of two differing files wins: a column of plan rows, true for the source."""

    @staticmethod
    def always() -> Column:
        return F.lit(True)

    @staticmethod
    def never() -> Column:
        return F.lit(False)

    @staticmethod
    def update() -> Column:
        """The newer file."""
        return F.col("src_mtime") > F.col("dst_mtime")

    @staticmethod
    def ask(function: Callable[[str, str], bool]) -> Column:
        """A Python function of (job_id, path)."""

        def run(jobs, paths):
            import pyarrow as pa

            return pa.array([bool(function(a, b)) for a, b in zip(jobs.to_pylist(), paths.to_pylist())], pa.bool_())

        import pyarrow as pa

        ship()
        run.__annotations__ = {"jobs": pa.Array, "paths": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, T.BooleanType())("job_id", "path")


def job_plan(source: DataFrame, destination: DataFrame, value: list[str] | None = None) -> DataFrame:
    """(job_id, action): clone jobs only the source has, merge or (same values) keep common ones, keep the destination's own.

    value: columns by which common jobs are told to be the same.
    """
    s, d = source.select("job_id", *(F.col(c).alias(f"src_{c}") for c in value or ()), F.lit(True).alias("s")), destination.select("job_id", *(F.col(c).alias(f"dst_{c}") for c in value or ()), F.lit(True).alias("d"))
    same = F.lit(bool(value))
    for c in value or ():
        same = same & F.col(f"src_{c}").eqNullSafe(F.col(f"dst_{c}"))
    action = F.when(F.col("d").isNull(), "clone").when(F.col("s").isNull() | same, "keep").otherwise("merge")
    return s.join(d, "job_id", "full_outer").withColumn("action", action).drop("s", "d")


def document_plan(source: DataFrame, destination: DataFrame, how: Any) -> DataFrame:
    """(job_id, path, src_json, dst_json, json, conflict) for leaves of jobs that both have. json: what is kept.

    A leaf on one side that is a mapping on the other is a conflict too, but for empty mappings,
    which give way to any other.
    """
    both = source.select("job_id", F.col("doc_json").alias("src")).join(destination.select("job_id", F.col("doc_json").alias("dst")), "job_id")

    def run(batches):
        import pyarrow as pa

        names = ("job_id", "path", "src_json", "dst_json", "json", "conflict")
        decide = decisions(how)
        for b in batches:
            rows = [(job, *r) for job, src, dst in zip(*(c.to_pylist() for c in b.columns)) for r in decide(src, dst)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.bool_() if c == "conflict" else pa.string()) for k, c in enumerate(names)], names=list(names))

    ship(source.sparkSession)
    return both.mapInArrow(run, "job_id string, path string, src_json string, dst_json string, json string, conflict boolean")


def _leaves_of(text: str | None) -> dict[str, Any]:
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        value = None
    return flatten(value) if isinstance(value, dict) else {}


def decisions(how: Any) -> Callable[[str | None, str | None], list[tuple]]:
    """A function of the two documents of a job that gives the rows (path, src_json, dst_json, json, conflict) of a document plan."""
    encode = json.JSONEncoder(sort_keys=True).encode
    by_key = isinstance(how, DocSync.ByKey)
    wins = (lambda path: False) if not by_key or how.keys is None else how.keys if callable(how.keys) else re.compile(how.keys).match
    above = lambda path: [path[:k] for k, c in enumerate(path) if c == "."]

    def decide(src: str | None, dst: str | None) -> list[tuple]:
        a, b = _leaves_of(src), _leaves_of(dst)
        if how == DocSync.NO_SYNC or how == DocSync.COPY or how == DocSync.UPDATE:
            tops = {p.split(".", 1)[0] for p in a}
            theirs = lambda p: False if how == DocSync.NO_SYNC else src is not None if how == DocSync.COPY else p.split(".", 1)[0] in tops
            return [(p, x := encode(a[p]) if p in a else None, y := encode(b[p]) if p in b else None, x if theirs(p) else y, False) for p in a | b]
        inside_a, inside_b = ({x for p in side if "." in p for x in above(p)} for side in (a, b))
        # a leaf on one side that is a mapping on the other decides for all that lies at or below it
        shapes = {p: bool(wins(p)) for side, inside in ((a, inside_b), (b, inside_a)) for p, v in side.items() if v != {} and p in inside}
        yields = {p for side, inside in ((a, inside_b), (b, inside_a)) for p, v in side.items() if v == {} and p in inside}
        out = []
        for p in a | b:
            x, y = encode(a[p]) if p in a else None, encode(b[p]) if p in b else None
            roots = [shapes[r] for r in (*above(p), p) if r in shapes] if shapes else []
            same = x is not None and y is not None and (x == y or encode(unified(a[p])) == encode(unified(b[p])))
            # an empty mapping of the source has nothing to say about what the destination holds there
            apart = x is not None and y is not None and not same and x != "{}" and not wins(p)
            if p in yields:
                kept = None
            elif roots:
                kept = x if all(roots) else y
            elif apart or y is not None and (same or x == "{}"):
                kept = y
            else:
                kept = y if x is None else x
            out.append((p, x, y, kept, not all(roots) if roots else apart))
        return out

    return decide


def merged_json(source: Column, destination: Column, how: Any) -> Column:
    """The document of a job of both sides from its two documents. It has none only if neither side that counts has one."""

    def run(sources, destinations):
        import pyarrow as pa

        decide, out = decisions(how), []
        for src, dst in zip(sources.to_pylist(), destinations.to_pylist()):
            some = dst if how == DocSync.NO_SYNC or src is None else src
            out.append(None if some is None else json.dumps(nest({p: json.loads(kept) for p, _, _, kept, _ in decide(src, dst) if kept is not None}), sort_keys=True))
        return pa.array(out, pa.string())

    import pyarrow as pa

    ship()
    run.__annotations__ = {"sources": pa.Array, "destinations": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StringType())(source, destination)


def file_plan(source: DataFrame, destination: DataFrame, strategy: Column | None = None, exclude: Iterable[str] = (), recursive: bool = True, deep: bool = False, size_only: bool = False) -> DataFrame:
    """(job_id, path, action, src_*, dst_*) for files tables (job_id, path, mtime, length, content).

    action: copy (only the source has it, or it wins), keep. Files of one size and time are the
    same unless deep, which compares SHA-256; size_only leaves the time out. Without a strategy a
    difference raises FileSyncConflict. exclude: regular expressions matched from the start of the path.
    """
    def side(df, tag):
        for e in exclude:
            df = df.where(~F.rlike("path", F.lit(f"^(?:{e})")))
        if not recursive:
            df = df.where(~F.col("path").contains("/"))
        sign = (F.coalesce("sha256", F.sha2("content", 256)) if "sha256" in df.columns else F.sha2("content", 256)) if deep else F.concat_ws(":", F.col("length").cast("string"), *([] if size_only else [F.col("mtime").cast("string")]))
        return df.select("job_id", "path", F.col("mtime").alias(f"{tag}_mtime"), F.col("length").alias(f"{tag}_length"), sign.alias(f"{tag}_sign"))

    both = side(source, "src").join(side(destination, "dst"), ["job_id", "path"], "full_outer")
    differ = F.col("src_sign").isNotNull() & F.col("dst_sign").isNotNull() & (F.col("src_sign") != F.col("dst_sign"))
    if strategy is None:
        found = both.where(differ).select("job_id", "path").take(10)
        if found:
            raise FileSyncConflict([f"{r[0]}/{r[1]}" for r in found])
        strategy = F.lit(False)
    return both.withColumn("action", F.when(F.col("dst_sign").isNull() | (differ & strategy), "copy").otherwise("keep")).drop("src_sign", "dst_sign")


def transfer_stats(plan: DataFrame) -> DataFrame:
    """(num_files, volume) of what a file plan copies."""
    return plan.where("action = 'copy'").agg(F.count("*").alias("num_files"), F.coalesce(F.sum("src_length"), F.lit(0)).alias("volume"))


def merge_mapping(source: dict, destination: dict, how: Any) -> dict:
    """One document merged into another by the rules of document_plan (the project's own document)."""
    if how in (DocSync.NO_SYNC, DocSync.COPY):
        return dict(destination)
    if how == DocSync.UPDATE:
        return {**destination, **source}
    wins = (lambda k: False) if how.keys is None else how.keys if callable(how.keys) else re.compile(how.keys).match
    conflicts: list[str] = []

    def merge(a: dict, b: dict, above: str) -> dict:
        out = dict(b)
        for k, v in a.items():
            if isinstance(v, dict) and isinstance(b.get(k), dict):
                out[k] = merge(v, b[k], f"{above}{k}.")
            elif k in b and (b[k] == v or v == {}):
                continue
            elif k not in b or wins(above + k):
                out[k] = v
            else:
                conflicts.append(above + k)
        return out

    merged = merge(source, destination, "")
    if conflicts and isinstance(how, DocSync.ByKey) and how.keys is None:
        raise DocumentSyncConflict(sorted(conflicts))
    return merged


def sync_files(source: DataFrame, destination: DataFrame, root: str, strategy: Column | None = None, **kw) -> DataFrame:
    """Copy what a file plan says into the workspace at root; returns the plan's (num_files, volume)."""
    from ..sources.workspace import write_files

    plan = written(file_plan(source, destination, strategy, **kw))  # as it was before files change
    write_files(source.join(plan.where("action = 'copy'").select("job_id", "path"), ["job_id", "path"], "left_semi"), root)
    return transfer_stats(plan)


@dataclass
class Synced:
    """What a synchronisation did or, on a dry run, would do. files: the plan (job_id, path, action, ...)."""

    project: Project
    files: DataFrame
    num_files: int
    volume: int


def _copied(plan: DataFrame) -> DataFrame:
    return plan.where("action = 'copy'").select("job_id", "path", F.col("src_length").alias("length"))


def sync_workspaces(spark: SparkSession, source: str, destination: str, strategy: Column | None = None, doc_sync: Any = None, selection: Iterable[str] | DataFrame | None = None, exclude: Iterable[str] = (), recursive: bool = True, deep: bool = False, size_only: bool = False, check_schema: bool = True, dry_run: bool = False, layout: Any = None) -> Synced:
    """Bring the jobs of one project folder into another: state points, documents and all other files.

    Jobs that only the source has are cloned whole (excluded files aside), those of both merged:
    documents by doc_sync, differing files by strategy (None: a difference raises FileSyncConflict).
    Every conflict is raised before anything is written, and so are damaged state points and
    documents of either side; dry_run stops there. What is written comes whole or not at all: after
    a run that was broken off, sources.journal.recover() finishes it or undoes it.
    """
    from ..sources.folders import read_document
    from ..sources.journal import settled
    from ..sources.workspace import Layout, list_files, read_project

    layout = layout or Layout()
    if os.path.realpath(source.removeprefix("file://")) == os.path.realpath(destination.removeprefix("file://")):
        raise ValueError("source and destination are one project")
    for root in (source, destination):
        settled(spark, root, layout)
    s, d = (read_project(spark, root, layout) for root in (source, destination))
    if "://" not in source and "://" not in destination:
        s.document, d.document = read_document(source, layout.document), read_document(destination, layout.document)
    if selection is not None and not isinstance(selection, DataFrame):
        selection = spark.createDataFrame([(i,) for i in selection], "job_id string")
    ids = written(s.jobs.select("job_id") if selection is None else s.jobs.select("job_id").join(selection.select("job_id").distinct(), "job_id", "left_semi"))
    merged = sync_projects(s, d, doc_sync, selection, check_schema)
    plan = file_plan(list_files(spark, source, ids, layout, digest=deep), list_files(spark, destination, ids, layout, digest=deep), strategy, exclude, recursive, deep, size_only)
    plan = written(plan)
    n, volume = transfer_stats(plan).first()
    if dry_run:
        return Synced(merged, plan, n, volume)
    own = d.jobs.select("job_id", F.col("doc_json").alias("before"), F.lit(True).alias("own"))
    rows = merged.jobs.join(ids, "job_id", "left_semi").join(own, "job_id", "left").select("job_id", F.when(F.col("own").isNull(), F.col("sp_json")).alias("sp_json"), "before", "doc_json")
    document = canonical(merged.document) if "://" not in destination and merged.document != d.document else None
    _apply(spark, written(rows), plan, source, destination, layout, document)
    return Synced(read_project(spark, destination, layout, validate=False), plan, n, volume)


def _apply(spark: SparkSession, rows: DataFrame, plan: DataFrame, source: str, destination: str, layout: Any, document: str | None = None, source_id: str | None = None) -> None:
    """Write what a synchronisation comes to, as one change. rows: (job_id, sp_json of new jobs, doc_json, the document `before`)."""
    from ..sources import journal as journals
    from ..sources.workspace import copy_files

    no, nothing = F.lit(False), F.lit(None).cast("string")
    step = lambda df, name, there, fresh: df.select(F.lit("file").alias("kind"), nothing.alias("job_id"), F.col("job_id").alias("target_id"), name.alias("path"), there.alias("there"), fresh.alias("fresh"))
    text = lambda df, name, c: df.select(F.col("job_id").alias("target_id"), F.lit(name).alias("path"), F.col(c).alias("text"))
    new, docs = rows.where("sp_json is not null"), rows.where("doc_json is not null and not (doc_json <=> before)")
    copied = plan.where("action = 'copy'")
    fresh = F.col("sp_json").isNotNull()
    steps = step(new, F.lit(layout.statepoint), no, F.lit(True)).union(step(docs, F.lit(layout.document), F.col("before").isNotNull(), fresh)).union(step(copied, F.col("path"), F.col("dst_length").isNotNull(), no))
    texts = text(new, layout.statepoint, "sp_json").union(text(docs, layout.document, "doc_json"))
    if document is not None:
        one = spark.createDataFrame([(layout.document, document)], "path string, text string").withColumn("target_id", nothing)
        had = os.path.exists(f"{destination.removeprefix('file://')}/{layout.document}")
        steps = steps.union(one.select(F.lit("file"), nothing, "target_id", "path", F.lit(had), no))
        texts = texts.union(one.select("target_id", "path", "text"))
    files = _copied(plan)
    if source_id is not None:
        files = files.withColumnsRenamed({"job_id": "target_id"}).withColumn("job_id", F.lit(source_id))

    def stage(journal) -> None:
        copy_files(files, source, destination, layout, into=f"{journal.inside}/new")
        journals.write_texts(texts, journal)

    if steps.take(1):
        journals.changed(spark, destination, steps, stage, layout)


def sync_jobs(spark: SparkSession, source: str, source_id: str, destination: str, destination_id: str, strategy: Column | None = None, doc_sync: Any = None, exclude: Iterable[str] = (), recursive: bool = True, deep: bool = False, size_only: bool = False, dry_run: bool = False, layout: Any = None) -> Synced:
    """Bring the document and files of one job into another, whose id and state point may differ and stay."""
    from ..sources.journal import settled
    from ..sources.workspace import Layout, list_files, read_project

    layout, how = layout or Layout(), DocSync.ByKey() if doc_sync is None else doc_sync
    if (os.path.realpath(source), source_id) == (os.path.realpath(destination), destination_id):
        raise ValueError("source and destination are one job")
    for root in (source, destination):
        settled(spark, root, layout)
    one = lambda root, i: read_project(spark, root, layout).jobs.where(F.col("job_id") == i).select("job_id", "sp_json", "doc_json")
    s, d = one(source, source_id).withColumn("job_id", F.lit(destination_id)), one(destination, destination_id)
    for rows, i in ((s, source_id), (d, destination_id)):
        if not rows.take(1):
            raise KeyError(i)
    docs = document_plan(s, d, how)
    if isinstance(how, DocSync.ByKey) and how.keys is None:
        found = sorted(r[0] for r in docs.where("conflict").select("path").distinct().take(100))
        if found:
            raise DocumentSyncConflict(found)
    both = d.join(s.select("job_id", F.col("doc_json").alias("src_doc")), "job_id")
    merged = written(both.select("job_id", "sp_json", F.col("doc_json").alias("before"), merged_json(F.col("src_doc"), F.col("doc_json"), how).alias("doc_json")))
    ids = lambda i: spark.createDataFrame([(i,)], "job_id string")
    theirs = list_files(spark, source, ids(source_id), layout, digest=deep).withColumn("job_id", F.lit(destination_id))
    plan = written(file_plan(theirs, list_files(spark, destination, ids(destination_id), layout, digest=deep), strategy, exclude, recursive, deep, size_only))
    n, volume = transfer_stats(plan).first()
    if not dry_run:
        _apply(spark, merged.select("job_id", F.lit(None).cast("string").alias("sp_json"), "before", "doc_json"), plan, source, destination, layout, source_id=source_id)
    return Synced(Project.of_canonical(merged.select("job_id", "sp_json", "doc_json")), plan, n, volume)


def sync_projects(source: Project, destination: Project, doc_sync: Any = None, selection: Iterable[str] | DataFrame | None = None, check_schema: bool = True) -> Project:
    """destination with the source's jobs: missing ones cloned, documents of common ones merged. selection: ids to take.

    The schemas must agree (unless one project is empty or check_schema is false). Documents are
    merged key by key by default; a conflict that no strategy decides raises DocumentSyncConflict.
    """
    if source is destination:
        raise ValueError("source and destination are one project")
    how = DocSync.ByKey() if doc_sync is None else doc_sync
    s, d = source.jobs.select("job_id", "sp_json", "doc_json"), destination.jobs.select("job_id", "sp_json", "doc_json")
    if check_schema and s.take(1) and d.take(1):
        a, b = ProjectSchema.detect(source.leaves()), ProjectSchema.detect(destination.leaves())
        if a.difference(b, ignore_values=True).take(1) or b.difference(a, ignore_values=True).take(1):
            raise SchemaSyncConflict(a, b)
    if selection is not None:
        ids = selection if isinstance(selection, DataFrame) else s.sparkSession.createDataFrame([(i,) for i in selection], "job_id string")
        s = s.join(ids.select("job_id").distinct(), "job_id", "left_semi")
    if isinstance(how, DocSync.ByKey) and how.keys is None:
        found = [r[0] for r in document_plan(s, d, how).where("conflict").select("path").distinct().take(100)]
        if found:
            raise DocumentSyncConflict(sorted(found))
    sides = (x.select("job_id", F.struct("sp_json", "doc_json").alias(name)) for x, name in ((s, "src"), (d, "dst")))
    both = next(sides).join(next(sides), "job_id", "full_outer")
    common = F.col("src").isNotNull() & F.col("dst").isNotNull()
    asked = [F.when(common, F.col(f"{x}.doc_json")) for x in ("src", "dst")]
    doc = F.when(common, merged_json(*asked, how)).otherwise(F.coalesce("src.doc_json", "dst.doc_json"))
    jobs = both.select("job_id", F.when(F.col("dst").isNotNull(), F.col("dst.sp_json")).otherwise(F.col("src.sp_json")).alias("sp_json"), doc.alias("doc_json"))
    return Project.of_canonical(jobs, merge_mapping(source.document, destination.document, how))
