"""Project folders: making, finding and versions. Only paths on the driver; jobs are read by Spark."""

from __future__ import annotations

import contextlib
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

from ..errors import ConfigError, IncompatibleSchemaVersion

CONFIG = ".tessera/config.json"
VERSION = 1


def init_project(path: str | None = None) -> str:
    """Make a project folder (or find that it is one) and return its path."""
    root = Path(path or os.getcwd()).resolve()
    config = root / CONFIG
    if not config.exists():
        config.parent.mkdir(parents=True, exist_ok=True)
        (root / "workspace").mkdir(exist_ok=True)
        config.write_text(json.dumps({"schema_version": VERSION}))
    return get_project(str(root), search=False)


def get_project(path: str | None = None, search: bool = True) -> str:
    """The project folder at path or, with search, above it. Raises LookupError; an older or newer layout raises too."""
    start = Path(path or os.getcwd()).resolve()
    for root in [start, *start.parents] if search else [start]:
        if (root / CONFIG).exists():
            version = read_config(str(root)).get("schema_version")
            if version != VERSION:
                raise IncompatibleSchemaVersion(f"layout {version}, this library has {VERSION}: migrate it")
            return str(root)
    raise LookupError(f"no project at {start}")


def get_job(path: str | None = None) -> tuple[str, str]:
    """(project folder, job id) of a path inside a job's folder."""
    at = str(Path(path or os.getcwd()).resolve())
    found = re.search(r"/([0-9a-f]{32})(?:/|$)", at)
    if not found:
        raise LookupError(f"no job at {at}")
    return get_project(at[: found.start()]), found[1]


def read_config(root: str) -> dict:
    """The user's file ~/.tessera.json, overlaid by the project's."""
    out: dict = {}
    for at in (Path.home() / ".tessera.json", Path(root) / CONFIG):
        if at.exists():
            try:
                out |= json.loads(at.read_text())
            except ValueError as e:
                raise ConfigError(f"{at}: {e}") from e
    return out


def verify_config(root: str) -> list[str]:
    """What is wrong with the configuration: files that cannot be read, keys that mean nothing, values of a wrong type."""
    known, wrong = {"schema_version": int, "workspace_dir": str}, []
    for at in (Path.home() / ".tessera.json", Path(root) / CONFIG):
        if not at.exists():
            continue
        try:
            found = json.loads(at.read_text())
        except ValueError as e:
            wrong.append(f"{at}: {e}")
            continue
        wrong += [f"{at}: unknown key {k!r}" for k in found if k not in known]
        wrong += [f"{at}: {k} must be {t.__name__}" for k, t in known.items() if k in found and type(found[k]) is not t]
    return wrong


def write_config(root: str, key: str, value) -> None:
    at = Path(root) / CONFIG
    now = json.loads(at.read_text()) if at.exists() else {}
    part = at.with_suffix(".part")
    part.write_text(json.dumps(now | {key: value}))
    os.replace(part, at)


def read_document(root: str, name: str = "document.json") -> dict:
    """The project's own document; {} if there is none."""
    at = Path(root) / name
    return json.loads(at.read_text()) if at.exists() else {}


def write_document(root: str, document: dict, name: str = "document.json") -> None:
    at = Path(root) / name
    part = at.with_suffix(".part")
    part.write_text(json.dumps(document, sort_keys=True))
    os.replace(part, at)


def migrate(root: str) -> list[str]:
    """Bring a folder with a workspace to the present layout; returns what was done."""
    done = []
    if not (Path(root) / CONFIG).exists():
        if not (Path(root) / "workspace").is_dir():
            raise LookupError(f"no workspace in {root}")
        (Path(root) / CONFIG).parent.mkdir(parents=True, exist_ok=True)
        done.append("config made")
    if read_config(root).get("schema_version", 0) > VERSION:
        raise IncompatibleSchemaVersion("made by a newer library")
    if read_config(root).get("schema_version") != VERSION:
        write_config(root, "schema_version", VERSION)
        done.append(f"version set to {VERSION}")
    return done


@contextlib.contextmanager
def temporary_project(parent: str | None = None) -> Iterator[str]:
    """A project folder that goes at the end of the block."""
    at = tempfile.mkdtemp(dir=parent)
    try:
        yield init_project(at)
    finally:
        shutil.rmtree(at, ignore_errors=True)
