"""Changes of a project folder that happen whole or not at all.

A change is a table of steps in a folder below .tessera/journal of the project. What will be new is
put beside that table first. Once all of it is there the change is marked as ready, and tasks move
everything to its place; what it replaces is kept aside until the end. A run that is broken off
before the mark leaves the project as it was. After the mark, recover() finishes the change or
undoes it, and may itself be broken off and run again: each step looks at what is there.

Folders of jobs that get other ids are all lifted out of the workspace before the first is put back,
so chains and cycles of ids need no order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..functions.shipping import ship
from .workspace import Layout, _opened

JOURNAL = ".tessera/journal"
#: kind: file or folder; job_id: the folder's old id; target_id: the job it belongs to after the
#: change (null: the project itself); there: something stands at the place already; fresh: the job is new.
STEPS = "kind string, job_id string, target_id string, path string, there boolean, fresh boolean"


class Journal:
    """One change. new/, old/ and moved/ hold what comes, what goes and folders between two ids."""

    def __init__(self, spark: SparkSession, root: str, layout: Layout, name: str | None = None):
        self.spark, self.root, self.layout = spark, root, layout
        self.name = name or uuid.uuid4().hex
        self.inside = f"{JOURNAL}/{self.name}"

    @property
    def uri(self) -> str:
        return f"{self.root if '://' in self.root else 'file://' + os.path.abspath(self.root)}/{self.inside}"

    def write(self, steps: DataFrame) -> None:
        steps.select("kind", "job_id", "target_id", "path", "there", "fresh").write.parquet(f"{self.uri}/steps")

    def steps(self, kind: str | None = None) -> DataFrame:
        found = self.spark.read.schema(STEPS).parquet(f"{self.uri}/steps")
        return found if kind is None else found.where(F.col("kind") == kind)

    def mark(self, name: str) -> None:
        store, base = _opened(self.root)
        store.open_output_stream(f"{base}/{self.inside}/{name}", compression=None).close()

    def marked(self, name: str) -> bool:
        return _there(*_opened(self.root), f"{self.inside}/{name}")

    def drop(self) -> None:
        store, base = _opened(self.root)
        store.delete_dir(f"{base}/{self.inside}")

    # ---- forth ----------------------------------------------------------------------------

    def apply(self) -> None:
        """Everything to its place."""
        inside, workspace, statepoint = self.inside, self.layout.workspace, self.layout.statepoint

        def lift(move, there, job, target, path, *_):
            if there(f"{workspace}/{job}") and not there(f"{inside}/moved/{target}"):
                move(f"{workspace}/{job}", f"{inside}/moved/{target}")

        def settle(move, there, job, target, path, *_):
            at, new = f"{inside}/moved/{target}", f"{inside}/new/{target}/{statepoint}"
            if not there(at):
                return
            if there(new):
                if there(f"{at}/{statepoint}") and not there(f"{inside}/old/{target}/{statepoint}"):
                    move(f"{at}/{statepoint}", f"{inside}/old/{target}/{statepoint}")
                move(new, f"{at}/{statepoint}")
            move(at, f"{workspace}/{target}")

        def put(move, there, job, target, path, *_):
            new, old = (f"{inside}/{side}/{target or '_project'}/{path}" for side in ("new", "old"))
            at = f"{workspace}/{target}/{path}" if target else path
            if there(new):
                if there(at) and not there(old):
                    move(at, old)
                move(new, at)

        if not self.marked("lifted"):
            self._each("folder", lift)
            self.mark("lifted")
        self._each("folder", settle)
        self._each("file", put)

    # ---- back -----------------------------------------------------------------------------

    def undo(self) -> None:
        """Everything as it was before."""
        inside, workspace, statepoint = self.inside, self.layout.workspace, self.layout.statepoint
        lifted = self.marked("lifted")

        def take(move, there, job, target, path, was, fresh, delete):
            new, old = (f"{inside}/{side}/{target or '_project'}/{path}" for side in ("new", "old"))
            at = f"{workspace}/{target}/{path}" if target else path
            if was:
                if there(old):
                    move(old, at)
            elif there(at) and not there(new):
                delete(at)

        def empty(move, there, job, target, path, was, fresh, delete):
            if fresh and target and there(f"{workspace}/{target}"):
                delete(f"{workspace}/{target}")

        def sink(move, there, job, target, path, *_):
            at = f"{inside}/moved/{target}"
            if lifted and not there(at) and there(f"{workspace}/{target}"):
                move(f"{workspace}/{target}", at)
            if there(f"{inside}/old/{target}/{statepoint}"):
                move(f"{inside}/old/{target}/{statepoint}", f"{at}/{statepoint}")

        def back(move, there, job, target, path, *_):
            if there(f"{inside}/moved/{target}"):
                move(f"{inside}/moved/{target}", f"{workspace}/{job}")

        self.mark("undo")
        self._each("file", take)
        self._each("file", empty)
        if not self.marked("sunk"):
            self._each("folder", sink)
            self.mark("sunk")
        self._each("folder", back)

    def _each(self, kind: str, step: Callable) -> int:
        """Run a step for every row of a kind, in tasks."""
        ship(self.spark)
        root = self.root

        def run(batches):
            import pyarrow as pa
            from pyarrow import fs

            store, base = _opened(root)

            def move(a: str, b: str) -> None:
                store.create_dir(os.path.dirname(f"{base}/{b}"), recursive=True)
                store.move(f"{base}/{a}", f"{base}/{b}")

            def delete(a: str) -> None:
                (store.delete_dir if store.get_file_info(f"{base}/{a}").type == fs.FileType.Directory else store.delete_file)(f"{base}/{a}")

            n = 0
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    step(move, lambda a: _there(store, base, a), *row, delete)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        return self.steps(kind).select("job_id", "target_id", "path", "there", "fresh").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _there(store, base: str, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(f"{base}/{path}").type != fs.FileType.NotFound


def unfinished(spark: SparkSession, root: str, layout: Layout = Layout()) -> list[Journal]:
    """Changes that were broken off, or are under way."""
    from pyarrow import fs

    store, base = _opened(root)
    found = store.get_file_info(fs.FileSelector(f"{base}/{JOURNAL}", allow_not_found=True))
    return [Journal(spark, root, layout, f.base_name) for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.Directory]


def settled(spark: SparkSession, root: str, layout: Layout = Layout()) -> None:
    """WorkspaceError if a change is unfinished: what would be read now is neither the old state nor the new."""
    open_ = unfinished(spark, root, layout)
    if open_:
        raise WorkspaceError(f"{root} has an unfinished change ({open_[0].name}): wait for it, or recover() it")


def changed(spark: SparkSession, root: str, steps: DataFrame, stage: Callable[[Journal], None], layout: Layout = Layout()) -> None:
    """Make a change. stage puts what is new below the journal's new/. An error before the change is ready leaves no trace."""
    settled(spark, root, layout)
    journal = Journal(spark, root, layout)
    try:
        journal.write(steps)
        stage(journal)
    except Exception:
        if _there(*_opened(root), journal.inside):
            journal.drop()
        raise
    journal.mark("ready")
    journal.apply()
    journal.drop()


def recover(spark: SparkSession, root: str, undo: bool = False, layout: Layout = Layout()) -> list[tuple[str, str]]:
    """Finish changes that were broken off, or undo them; (name, outcome) of each.

    Outcomes: dropped (it had not begun to change anything), finished, undone. An undoing that was
    broken off is gone on with, whatever is asked for.
    """
    out = []
    for journal in unfinished(spark, root, layout):
        outcome = "dropped"
        if journal.marked("ready"):
            back = undo or journal.marked("undo")
            (journal.undo if back else journal.apply)()
            outcome = "undone" if back else "finished"
        journal.drop()
        out.append((journal.name, outcome))
    return out


def write_texts(rows: DataFrame, journal: Journal) -> int:
    """Files (target_id, path, text) below the journal's new/, each by a task."""
    ship(rows.sparkSession)
    root, inside = journal.root, journal.inside

    def run(batches):
        import pyarrow as pa

        store, base = _opened(root)
        n = 0
        for b in batches:
            for target, path, text in zip(*(c.to_pylist() for c in b.columns)):
                at = f"{base}/{inside}/new/{target or '_project'}/{path}"
                store.create_dir(os.path.dirname(at), recursive=True)
                with store.open_output_stream(f"{at}.part", compression=None) as f:
                    f.write(text.encode())
                store.move(f"{at}.part", at)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.select("target_id", "path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
