import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.errors import DestinationExistsError, JobsCorruptedError, StatepointParsingError
from tessera.operators.project import Project
from tessera.operators.views import create_linked_view, dead_branches
from tessera.sources.archives import export_paths, export_to, import_files, import_from
from tessera.sources.paths import check_paths, nested_paths, parse_columns
from tessera.sources.workspace import read_files, read_index, read_project, update_index, write_files, write_project
from tessera.streaming.refresh import refresh


@pytest.fixture(scope="module")
def project(spark):
    return Project.of_statepoints(spark, [{"a": i, "b": {"c": i % 2 == 0}, "k": 1} for i in range(6)], [{"d": i} if i % 2 else None for i in range(6)])


def table(p):
    return sorted((r["job_id"], r["sp_json"], r["doc_json"]) for r in p._plain().collect())


def test_workspace_round_trip_and_index(spark, project, tmp_path):
    root, index = str(tmp_path / "p"), str(tmp_path / "index")
    assert table(read_project(spark, root, validate=False)) == []
    write_project(project, root)
    os.makedirs(tmp_path / "p/workspace/not-an-id")
    (tmp_path / f"p/workspace/{project.find_jobs()[0]}/out.txt").write_text("hello")
    assert table(read_project(spark, root)) == table(project)
    assert [(r["path"], r["length"]) for r in read_files(spark, root).select("path", "length").collect()] == [("out.txt", 5)]
    assert update_index(spark, root, index) == 6 and update_index(spark, root, index) is None
    assert len(read_index(spark, index).find_jobs({"a.$lt": 3, "doc.d": 1})) == 1
    extra = Project.of_statepoints(spark, [{"a": 99}])
    write_project(extra, root)
    gone = project.find_jobs()[1]
    os.remove(tmp_path / f"p/workspace/{gone}/statepoint.json")
    assert update_index(spark, root, index) == 6
    spark.catalog.clearCache()
    assert sorted(read_index(spark, index)) == sorted({*project, *extra} - {gone})
    (tmp_path / f"p/workspace/{project.find_jobs()[2]}/statepoint.json").write_text('{"a": 1}')
    with pytest.raises(JobsCorruptedError):
        read_project(spark, root)


def test_an_edited_document_is_found_in_the_index(spark, project, tmp_path):
    root, index = str(tmp_path / "p"), str(tmp_path / "index")
    write_project(project, root)
    assert update_index(spark, root, index) == 6
    job = project.find_jobs({"doc.d": 1})[0]
    with open(tmp_path / f"p/workspace/{job}/document.json", "w") as f:
        f.write('{"d": 222}')
    assert list(read_index(spark, index).find_jobs({"doc.d": 1})) == [job]  # as it was written
    before = read_index(spark, index)
    assert update_index(spark, root, index) == 6 and update_index(spark, root, index) is None
    assert list(read_index(spark, index).find_jobs({"doc.d": 222})) == [job] and len(read_index(spark, index).find_jobs({"doc.d": 1})) == 0
    assert len(before.find_jobs({"doc.d": 1})) == 1  # readers of the version before still have it
    os.remove(tmp_path / f"p/workspace/{job}/document.json")
    assert update_index(spark, root, index) == 6 and len(read_index(spark, index).find_jobs({"doc.d.$exists": True})) == 2
    with pytest.raises(LookupError):
        read_index(spark, str(tmp_path / "none"))


def test_a_link_that_leads_nowhere_is_not_passed_over(spark, project, tmp_path):
    root = str(tmp_path / "p")
    write_project(project, root)
    os.symlink(tmp_path / "gone", tmp_path / f"p/workspace/{project.find_jobs()[0]}/link")
    with pytest.raises(Exception, match="leads nowhere"):
        read_files(spark, root).collect()


def test_jobs_with_other_ids_are_synchronised(spark, tmp_path):
    from tessera.errors import DocumentSyncConflict, FileSyncConflict
    from tessera.operators.sync import DocSync, FileSync, sync_jobs

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    p, q = (Project.of_statepoints(spark, [sp], [doc]) for sp, doc in (({"x": 1}, {"k": 1, "m": 2}), ({"x": 2}, {"k": 5})))
    write_project(p, a)
    write_project(q, b)
    i, j = p.find_jobs()[0], q.find_jobs()[0]
    for root, job, text in ((a, i, "new"), (b, j, "old!")):
        with open(f"{root}/workspace/{job}/f.txt", "w") as f:
            f.write(text)
    with pytest.raises(DocumentSyncConflict):
        sync_jobs(spark, a, i, b, j)
    with pytest.raises(FileSyncConflict):
        sync_jobs(spark, a, i, b, j, doc_sync=DocSync.UPDATE)
    done = sync_jobs(spark, a, i, b, j, FileSync.always(), DocSync.UPDATE, dry_run=True)
    assert (done.num_files, done.volume) == (1, 3) and open(f"{b}/workspace/{j}/f.txt").read() == "old!"
    sync_jobs(spark, a, i, b, j, FileSync.always(), DocSync.UPDATE)
    assert open(f"{b}/workspace/{j}/f.txt").read() == "new" and table(read_project(spark, b)) == [(j, '{"x": 2}', '{"k": 1, "m": 2}')]
    with pytest.raises(KeyError):
        sync_jobs(spark, a, "0" * 32, b, j)
    with pytest.raises(ValueError):
        sync_jobs(spark, a, i, a, i)


def test_paths_and_schemas_by_callables(spark, project, tmp_path):
    target = str(tmp_path / "out")
    export_to(project, target, lambda i, sp: f"n{sp['a']}/{sp['b']['c']}")
    assert sorted(os.listdir(target)) == [f"n{i}" for i in range(6)]
    for d, _, files in os.walk(target):
        if "statepoint.json" in files:
            os.rename(f"{d}/statepoint.json", f"{d}/kept.txt")
    read = lambda folder: {"a": int(folder[1]), "b": {"c": folder.endswith("True")}, "k": 1} if "/" in folder else None
    assert sorted(import_from(spark, target, read)) == sorted(project)
    with pytest.raises(RuntimeError):
        export_paths(project, lambda i, sp: "same")


def test_streaming_refresh(spark, project, tmp_path):
    root, index, at = str(tmp_path / "p"), str(tmp_path / "index"), str(tmp_path / "cp")
    write_project(project, root)
    refresh(spark, root, index, at).awaitTermination()
    assert sorted(read_index(spark, index)) == sorted(project)
    write_project(Project.of_statepoints(spark, [{"a": 50}, {"a": 51}]), root)
    refresh(spark, root, index, at).awaitTermination()
    assert len(read_index(spark, index)) == 8


@pytest.mark.parametrize("kind", ["", ".zip", ".tar", ".tar.gz", ".tar.bz2", ".tar.xz"])
def test_export_and_import(spark, project, tmp_path, kind):
    target = str(tmp_path / f"out{kind}")
    paths = {r["job_id"]: r["path"] for r in export_to(project, target).collect()}
    assert all(p.startswith("b.c/") and "/a/" in p for p in paths.values())
    assert table(import_from(spark, target)) == table(project)
    if kind:
        with pytest.raises(DestinationExistsError):
            export_to(project, target)


def test_paths(spark, project):
    get = lambda p: sorted(r["path"] for r in export_paths(project, p).collect())
    assert get(None) == sorted(f"b.c/{i % 2 == 0}/a/{i}" for i in range(6))
    assert get(False) == sorted(project) and get("x/{a}") == [f"x/{i}" for i in range(6)]
    assert get("x/{a}/{{auto}}") == sorted(f"x/{i}/b.c/{i % 2 == 0}" for i in range(6))
    assert get("{job.id}") == sorted(project) and get("{job.sp.a}_{b.c}") == sorted(f"{i}_{str(i % 2 == 0).lower()}" for i in range(6))
    with pytest.raises(RuntimeError):
        get("const/{k}")
    with pytest.raises(KeyError):
        get("{zz}")
    with pytest.raises(ValueError):
        get(5)
    one = Project.of_statepoints(spark, [{"a": 1}])
    assert [r["path"] for r in export_paths(one).collect()] == [""]
    with pytest.raises(StatepointParsingError):
        export_paths(Project.of_statepoints(spark, [{"k": 1, "a": 1}, {"k": 1}])).collect()


def test_path_checks(spark):
    p = spark.createDataFrame([("1", "a/1"), ("2", "a/1/b"), ("3", "a/10")], "job_id string, path string")
    assert [r[0] for r in nested_paths(p).collect()] == ["a/1/b"]
    with pytest.raises(RuntimeError):
        check_paths(p)
    check_paths(p.where("job_id <> '2'"))


def test_parse_columns(spark):
    df = spark.createDataFrame([("a/1/b/2.5/c/true",), ("a/-3/b/.5/c/0",), ("a/x/b/1/c/1",), ("z",)], "p string")
    cols = parse_columns("a/{a:int}/b/{n.b:float}/c/{c:bool}", F.col("p"))
    assert [tuple(r) for r in df.select(*cols.values()).collect()] == [(1, 2.5, True), (-3, 0.5, False), (None, None, None), (None, None, None)]
    with pytest.raises(ValueError):
        parse_columns("{a:date}", F.col("p"))


def test_import_by_path(spark, tmp_path):
    for i in range(3):
        os.makedirs(tmp_path / f"d/a/{i}/x")
        (tmp_path / f"d/a/{i}/x/data.txt").write_text("1")
    got = import_from(spark, str(tmp_path / "d"), "a/{n.a:int}/{s}")
    assert sorted(r["sp_json"] for r in got.jobs.collect()) == [json.dumps({"n": {"a": i}, "s": "x"}, sort_keys=True) for i in range(3)]
    (tmp_path / "d/a/1/x/statepoint.json").write_text('{"n": {"a": 5}, "s": "x"}')
    with pytest.raises(StatepointParsingError):
        import_from(spark, str(tmp_path / "d"), "a/{n.a:int}/{s}")


@pytest.mark.parametrize("kind", ["", ".zip", ".tar.gz"])
def test_files_go_along_and_inner_folders_belong_to_the_outer_job(spark, project, tmp_path, kind):
    ids = list(project)
    files = spark.createDataFrame([(ids[0], "sub/x.bin", b"\0\1"), (ids[1], "y.txt", b"y"), (ids[1], "deep/statepoint.json", b'{"a": 77}')], "job_id string, path string, content binary")
    target = str(tmp_path / f"out{kind}")
    export_to(project, target, files=files)
    assert table(import_from(spark, target)) == table(project)
    got = {(r["job_id"], r["path"], bytes(r["content"])) for r in import_files(spark, target).collect()}
    assert got == {(r["job_id"], r["path"], bytes(r["content"])) for r in files.collect()}


def test_syncing_files_into_a_workspace(spark, project, tmp_path):
    from tessera.operators.sync import FileSync, sync_files

    for side in "ab":
        write_project(project, str(tmp_path / side))
    i = project.find_jobs()[0]
    write_files(spark.createDataFrame([(i, "d/one", b"1"), (i, "two", b"22")], "job_id string, path string, content binary"), str(tmp_path / "a"))
    write_files(spark.createDataFrame([(i, "two", b"old")], "job_id string, path string, content binary"), str(tmp_path / "b"))
    a, b = (read_files(spark, str(tmp_path / side)) for side in "ab")
    assert tuple(sync_files(a, b, str(tmp_path / "b"), FileSync.never()).first()) == (1, 1)
    assert (tmp_path / f"b/workspace/{i}/d/one").read_bytes() == b"1" and (tmp_path / f"b/workspace/{i}/two").read_bytes() == b"old"


def test_linked_view(spark, project, tmp_path):
    write_project(project, str(tmp_path / "p"))
    view, workspace = str(tmp_path / "view"), str(tmp_path / "p/workspace")
    paths = export_paths(project)
    create_linked_view(paths, workspace, view)
    for r in paths.collect():
        assert os.path.realpath(f"{view}/{r['path']}/job") == os.path.realpath(f"{workspace}/{r['job_id']}")
    less = paths.where("path not like '%/a/1'")
    create_linked_view(less, workspace, view)
    assert not os.path.lexists(f"{view}/b.c/False/a/1") and os.path.lexists(f"{view}/b.c/False/a/3/job")
    assert [r[0] for r in dead_branches(paths.select("path"), less.select("path")).collect()] == []


def test_an_existing_target_is_never_written_over(spark, project, tmp_path):
    target = str(tmp_path / "out")
    os.makedirs(target)
    export_to(project, target, "{a}")
    before = {d: sorted(n) for d, _, n in os.walk(target)}
    with open(f"{target}/3/statepoint.json", "w") as f:
        f.write("mine")
    with pytest.raises(DestinationExistsError):
        export_to(project.find_jobs({"a": 3}).project, target, "{a}")
    assert open(f"{target}/3/statepoint.json").read() == "mine" and before == {d: sorted(n) for d, _, n in os.walk(target)}


@pytest.mark.parametrize("kind", ["", ".zip", ".tar", ".tar.gz", ".tar.bz2", ".tar.xz"])
def test_files_of_a_project_folder_are_streamed_both_ways(spark, project, tmp_path, kind):
    import random
    import tarfile
    import zipfile

    from tessera.sources.archives import import_into

    root, target, back = (str(tmp_path / n) for n in ("p", f"out{kind}", "back"))
    write_project(project, root)
    r = random.Random(1)
    for k, i in enumerate(project):
        os.makedirs(f"{root}/workspace/{i}/deep/er")
        for name, data in (("deep/er/.big", r.randbytes(300_000 * (k % 3))), ("empty", b""), ("é.txt", "é".encode() * 10)):
            with open(f"{root}/workspace/{i}/{name}", "wb") as f:
                f.write(data)
    export_to(project, target, "x/{a}", root=root)
    if kind == ".zip":
        with zipfile.ZipFile(target) as z:
            assert z.testzip() is None and len(z.namelist()) == 6 * 4 + 3
    elif kind:
        with tarfile.open(target) as t:
            assert len(t.getnames()) == 6 * 4 + 3
        os.rename(target, f"{target}.dat")  # what it is, its content says
        target = f"{target}.dat"
    assert import_into(spark, target, back) == 6
    tree = lambda at: {os.path.relpath(f"{d}/{n}", at): open(f"{d}/{n}", "rb").read() for d, _, names in os.walk(f"{at}/workspace") for n in names}
    assert tree(back) == tree(root)
    with pytest.raises(DestinationExistsError):
        import_into(spark, target, back)


def test_members_are_read_by_many_tasks_and_chosen_before_they_are_read(spark, tmp_path):
    import zipfile

    from tessera.sources.members import members

    at = str(tmp_path / "z")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"d{i}/data", os.urandom(100_000))
            z.writestr(f"d{i}/statepoint.json", '{"a": %d}' % i)
            z.writestr(f"d{i}/", "")
    every = members(spark, at, partition_mb=0.5)
    assert every.rdd.getNumPartitions() >= 8 and every.count() == 80
    assert every.where("path = 'd7/statepoint.json'").select(F.decode("content", "UTF-8")).collect() == [('{"a": 7}',)]
    # with the data damaged the chosen ones can still be read: nothing else is
    with zipfile.ZipFile(at) as z:
        spoiled = [(i.header_offset + 40, 90_000) for i in z.infolist() if i.filename.endswith("data")]
    with open(at, "r+b") as f:
        for place, n in spoiled:
            f.seek(place + 100)
            f.write(bytes(n))
    assert sorted(r[0] for r in every.where("path like '%/statepoint.json'").select("path").collect()) == sorted(f"d{i}/statepoint.json" for i in range(40))
    assert members(spark, at, names=("statepoint.json",)).count() == 40 and members(spark, at, content=False).count() == 80
    assert every.where(F.col("path").isin("d1/statepoint.json", "d2/statepoint.json")).count() == 2 and every.where("path like 'd3%' and path like '%json'").count() == 11
    with pytest.raises(Exception, match="CRC|decompress"):
        every.where("path = 'd7/data'").collect()
    with pytest.raises(Exception, match="no known archive"):
        (tmp_path / "odd").write_bytes(b"nothing of the kind")
        members(spark, str(tmp_path / "odd")).count()


def test_ranges_of_a_zip_directory(spark, tmp_path):
    """The directory of a zip is dealt to tasks in stretches; names, places and more than 65535 members are those of zipfile."""
    import io
    import zipfile

    from tessera.sources import members as M

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"a comment"
        for i in range(66_000):
            z.writestr(f"d{i % 7}/né{i}" if i % 5 else f"d/{i}.txt", str(i) * (i % 3))
        z.writestr("folder/", "")
    at = tmp_path / "many.zip"
    at.write_bytes(raw.getvalue())
    reader = M.Reader({"sources": f'["{at}"]', "content": "false"})
    parts = reader.partitions()
    assert len(parts) == 3 and not any(p.members for p in parts)
    assert [m for p in parts for m in map(tuple, reader.read(p))] == list(map(tuple, M.listed(str(at))))
    some = {r["path"]: r["content"] for r in M.members(spark, str(at)).where("path like 'd/%'").collect()}
    assert len(some) == 13_200 and all(v == (k[2:-4] * (int(k[2:-4]) % 3)).encode() for k, v in some.items())


def test_parts_of_a_zip_make_one_directory(spark, tmp_path):
    """A zip of more than 65535 members from several parts is what zipfile expects."""
    import zipfile

    from tessera.sources.packing import write_archive

    at = str(tmp_path / "all.zip")
    rows = spark.range(0, 70_000, 1, 4).selectExpr("concat('a/', id) as member", "cast(cast(id as string) as binary) as content", "cast(null as string) as job_id", "cast(null as string) as path", "cast(null as long) as length")
    assert write_archive(rows, at, "zip") == 70_000
    with zipfile.ZipFile(at) as z:
        assert sorted(z.namelist()) == sorted(f"a/{i}" for i in range(70_000)) and z.testzip() is None
        assert z.read("a/69999") == b"69999" and z.read("a/0") == b"0"
