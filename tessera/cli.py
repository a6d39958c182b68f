"""Command line: each command is one library operation on the project at or above the working folder."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessera").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command")

    def command(name: str, help: str, select: bool = False):
        c = sub.add_parser(name, help=help)
        if select:
            g = c.add_mutually_exclusive_group()
            g.add_argument("-f", "--filter", nargs="+", help="key value pairs or JSON")
            g.add_argument("-j", "--job-id", nargs="+")
        return c

    command("init", "make a project here")
    c = command("job", "id of a state point; -c makes the job")
    c.add_argument("statepoint")
    c.add_argument("-c", "--create", action="store_true")
    c = command("find", "ids of jobs that match")
    c.add_argument("filter", nargs="*")
    c.add_argument("--sp", nargs="*")
    c.add_argument("--doc", nargs="*")
    command("statepoint", "state points", True)
    command("document", "documents", True)
    c = command("schema", "keys, types and values", True)
    c.add_argument("-x", "--exclude-const", action="store_true")
    c.add_argument("-t", "--depth", type=int, default=0)
    c.add_argument("-p", "--precision", type=int)
    c.add_argument("-r", "--max-num-range", type=int, default=5)
    command("diff", "how state points differ", True)
    c = command("neighbors", "nearest jobs along each key", True)
    c.add_argument("--ignore", nargs="*", default=[])
    command("rm", "remove jobs", True)
    command("clear", "remove documents, stores and other files of jobs", True)
    for name in ("move", "clone"):
        c = command(name, f"{name} jobs to another project", True)
        c.add_argument("project")
    c = command("view", "tree of links named by state points", True)
    c.add_argument("prefix", nargs="?", default="view")
    c.add_argument("path", nargs="?")
    c = command("sync", "bring another project's jobs here")
    c.add_argument("source")
    c.add_argument("-s", "--doc-sync", choices=["update", "copy", "no_sync", "by_key"], default="by_key")
    c.add_argument("-k", "--key")
    c.add_argument("--no-schema-check", action="store_true")
    c.add_argument("--file-sync", choices=["always", "never", "update"], help="which of two differing files stays; without it they are a conflict")
    c.add_argument("--exclude", nargs="*", default=[], help="patterns of files to leave out")
    c.add_argument("-j", "--job-id", nargs="+", help="only these jobs")
    c.add_argument("--not-recursive", action="store_true")
    c.add_argument("--deep", action="store_true", help="compare what is in the files")
    c.add_argument("--size-only", action="store_true")
    c.add_argument("-n", "--dry-run", action="store_true")
    c.add_argument("--stats", action="store_true", help="number and bytes of files")
    c = command("export", "write jobs to a folder or archive", True)
    c.add_argument("target")
    c.add_argument("path", nargs="?")
    c = command("import", "read jobs from a folder or archive")
    c.add_argument("origin")
    c.add_argument("schema", nargs="?")
    c.add_argument("--sync", action="store_true", help="merge jobs that are there")
    command("update-index", "bring the index up to date")
    command("check", "look for damaged state points")
    command("migrate", "bring the folder to the present layout")
    c = command("config", "show or set configuration")
    c.add_argument("action", choices=["show", "set", "verify"])
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    return p


def run(a: argparse.Namespace) -> None:
    import os

    from .functions.canon import calc_id
    from .functions.leaves import written
    from .plans.filters import from_tokens, read_token
    from .sources import folders

    if a.command == "init":
        print(folders.init_project())
        return
    if a.command == "migrate":
        print("\n".join(folders.migrate(os.getcwd())) or "nothing to do")
        return
    root = folders.get_project()
    if a.command == "config":
        if a.action == "set":
            folders.write_config(root, a.key, read_token(a.value))
        if a.action == "verify":
            print("\n".join(folders.verify_config(root)) or "ok")
            return
        print(json.dumps(folders.read_config(root), sort_keys=True))
        return
    from .operators import diff, neighbors, project, schema, sync, views
    from .sources import archives, workspace

    layout = workspace.Layout()
    spark = session()
    if a.command == "job":
        sp = json.loads(a.statepoint)
        if a.create:
            workspace.write_project(project.Project.of_statepoints(spark, [sp]), root)
        print(calc_id(sp))
        return
    if a.command == "update-index":
        n = workspace.update_index(spark, root, f"{root}/{layout.index}")
        print("up to date" if n is None else n)
        return
    if a.command == "import":
        print(archives.import_into(spark, a.origin, root, a.schema, sync=a.sync))
        return
    p = workspace.read_project(spark, root, validate=False)
    if a.command == "check":
        p.check()
        print("ok")
        return
    if a.command == "sync":
        how = sync.DocSync.ByKey(a.key) if a.doc_sync == "by_key" else a.doc_sync
        files = None if a.file_sync is None else getattr(sync.FileSync, a.file_sync)()
        done = sync.sync_workspaces(spark, folders.get_project(a.source, search=False), root, files, how, a.job_id, a.exclude, not a.not_recursive, a.deep, a.size_only, not a.no_schema_check, a.dry_run)
        if a.dry_run:
            for r in done.files.where("action = 'copy'").orderBy("job_id", "path").toLocalIterator():
                print(f"{r['job_id']}/{r['path']}")
        if a.stats or a.dry_run:
            print(f"{done.num_files} files, {done.volume} bytes")
        return
    tokens = a.filter or []
    chosen = p.find_jobs({"_id.$in": a.job_id} if getattr(a, "job_id", None) else from_tokens(tokens))
    some = project.Project(chosen.df, p.fields)
    if a.command == "find":
        show = lambda text, keys: json.dumps({k: v for k, v in json.loads(text or "{}").items() if not keys or k in keys}, sort_keys=True)
        for r in chosen.df.select("job_id", "sp_json", "doc_json").orderBy("job_id").toLocalIterator():
            print(r["job_id"], *([show(r["sp_json"], a.sp)] if a.sp is not None else []), *([show(r["doc_json"], a.doc)] if a.doc is not None else []))
    elif a.command in ("statepoint", "document"):
        for r in chosen.df.select("job_id", F_NAMES[a.command]).orderBy("job_id").toLocalIterator():
            print(r[1] or "{}")
    elif a.command == "schema":
        print(schema.ProjectSchema.detect(some.leaves(), exclude_const=a.exclude_const).format(a.depth, a.precision, a.max_num_range))
    elif a.command == "diff":
        for r in diff.diff_leaves(some.leaves()).orderBy("job_id", "path").toLocalIterator():
            print(r["job_id"], f"{r['path']}={r['json']}")
    elif a.command == "neighbors":
        found = neighbors.neighbors(p.leaves(), a.ignore).join(chosen.ids(), "job_id", "left_semi")
        for r in found.orderBy("job_id", "path").toLocalIterator():
            print(r["job_id"], r["path"], r["prev_json"], r["prev_job_id"], r["next_json"], r["next_job_id"])
    elif a.command == "rm":
        workspace.remove_jobs(spark, written(chosen.ids()), root)
    elif a.command in ("move", "clone"):
        n, size = (workspace.move_jobs if a.command == "move" else workspace.copy_jobs)(spark, chosen.ids(), root, folders.get_project(a.project, search=False))
        print(f"{n} files, {size} bytes")
    elif a.command == "clear":
        workspace.clear_jobs(spark, written(chosen.ids()), root)
    elif a.command == "view":
        if a.path is None:
            views.check_values(some.leaves())
        views.create_linked_view(archives.export_paths(some, a.path), f"{root}/{layout.workspace}", a.prefix)
    elif a.command == "export":
        archives.export_to(some, a.target, a.path, root=root)


F_NAMES = {"statepoint": "sp_json", "document": "doc_json"}


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if not a.command:
        p.print_help()
        return 2
    try:
        run(a)
    except Exception as e:  # noqa: BLE001 - the command line's edge
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
