import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.errors import DestinationExistsError, DocumentsCorruptedError, JobsCorruptedError, StatepointParsingError, WorkspaceError
from tessera.functions.canon import calc_id
from tessera.operators.project import Project
from tessera.operators.rekey import rekey_plan
from tessera.operators.sync import DocSync, FileSync, sync_workspaces
from tessera.sources.changes import init_jobs, rekey_jobs, repair_workspace, update_statepoints
from tessera.sources.journal import Journal, recover, unfinished
from tessera.sources.workspace import read_project, write_project


def state(root):
    """All files of a project folder but the journal's, by path."""
    return {os.path.relpath(f"{d}/{n}", root): open(f"{d}/{n}", "rb").read() for d, _, names in os.walk(root) for n in names if "/journal/" not in f"{d}/"}


def jobs(spark, root, sps, docs=None):
    write_project(Project.of_statepoints(spark, sps, docs), root)
    for sp in sps:
        at = f"{root}/workspace/{calc_id(sp)}"
        os.makedirs(f"{at}/sub")
        for name in ("out.txt", "sub/.hidden"):
            with open(f"{at}/{name}", "w") as f:
                f.write(f"{name} of {sp}")


def moves(spark, pairs):
    return spark.createDataFrame([(calc_id(a), json.dumps(b)) for a, b in pairs], "job_id string, sp_json string")


def holds(root, sp, was):
    """The job of sp has the files of the job that was."""
    at = f"{root}/workspace/{calc_id(sp)}"
    return json.load(open(f"{at}/statepoint.json")) == sp and open(f"{at}/out.txt").read() == f"out.txt of {was}" and open(f"{at}/sub/.hidden").read() == f"sub/.hidden of {was}"


def test_plan_of_ids(spark):
    there = spark.createDataFrame([(x,) for x in "abcdefghijklmnopq"], "job_id string")
    wanted = [*zip("abcd", "bcdZ"), *zip("efg", "fge"), ("h", "h"), ("i", "j"), ("k", "Y"), ("l", "Y"), ("m", "X"), ("n", "o"), ("o", "q"), ("unknown", "W"), ("p", "V"), ("p", "U")]
    got = {(r["job_id"], r["new_id"]): r["kind"] for r in rekey_plan(there, spark.createDataFrame(wanted, "job_id string, new_id string")).collect()}
    want = dict.fromkeys(zip("abc", "bcd"), "chain") | {("d", "Z"): "free", ("m", "X"): "free", ("n", "o"): "chain"} | dict.fromkeys(zip("efg", "fge"), "cycle")
    want |= dict.fromkeys([("i", "j"), ("k", "Y"), ("l", "Y"), ("o", "q"), ("p", "V"), ("p", "U")], "clash")
    assert got == want
    assert rekey_plan(there, spark.createDataFrame([], "job_id string, new_id string")).collect() == []


def test_files_follow_chains_and_cycles(spark, tmp_path):
    root = str(tmp_path)
    a, b, c, d, e, f = ({"x": i} for i in range(6))
    jobs(spark, root, [a, b, c, d, e, f], [{"doc": i} for i in range(6)])
    plan = rekey_jobs(spark, root, moves(spark, [(a, b), (b, c), (c, {"x": 99, "n": {"y": 1}}), (d, e), (e, d), (f, f)]))
    assert sorted(r["kind"] for r in plan.collect()) == ["chain", "chain", "cycle", "cycle", "free"]
    assert holds(root, b, a) and holds(root, c, b) and holds(root, {"x": 99, "n": {"y": 1}}, c) and holds(root, e, d) and holds(root, d, e) and holds(root, f, f)
    assert {json.loads(r["sp_json"])["x"]: json.loads(r["doc_json"])["doc"] for r in read_project(spark, root).jobs.collect()} == {1: 0, 2: 1, 99: 2, 4: 3, 3: 4, 5: 5}
    assert unfinished(spark, root) == [] and len(os.listdir(f"{root}/workspace")) == 6


def test_clashes_raise_before_anything_moves(spark, tmp_path):
    root = str(tmp_path)
    a, b, c = ({"x": i} for i in range(3))
    jobs(spark, root, [a, b, c])
    before = state(root)
    for pairs, error in (([(a, b)], DestinationExistsError), ([(a, {"x": 9}), (b, {"x": 9})], DestinationExistsError), ([(a, {"x": 9}), ({"x": 77}, {"x": 78})], KeyError)):
        with pytest.raises(error):
            rekey_jobs(spark, root, moves(spark, pairs))
    for text in ("{", "[1]", None):
        with pytest.raises(StatepointParsingError):
            rekey_jobs(spark, root, spark.createDataFrame([(calc_id(a), text)], "job_id string, sp_json string"))
    assert state(root) == before and unfinished(spark, root) == []


def test_state_points_are_updated_with_their_files(spark, tmp_path):
    root = str(tmp_path)
    sps = [{"x": i, "y": i % 2} for i in range(4)]
    jobs(spark, root, sps)
    update_statepoints(spark, root, {"z": 1}, {"y": 0})
    assert holds(root, {"x": 0, "y": 0, "z": 1}, sps[0]) and holds(root, {"x": 2, "y": 0, "z": 1}, sps[2]) and holds(root, sps[1], sps[1])
    with pytest.raises(KeyError):
        update_statepoints(spark, root, {"x": 7}, {"x": 0})
    update_statepoints(spark, root, {"x": 7}, {"x": 0}, overwrite=True)
    assert holds(root, {"x": 7, "y": 0, "z": 1}, sps[0])


@pytest.mark.parametrize("at", ["lift", "settle", "file"])
@pytest.mark.parametrize("undo", [False, True])
def test_a_rekeying_that_is_broken_off(spark, tmp_path, monkeypatch, at, undo):
    root = str(tmp_path)
    sps = [{"x": i} for i in range(4)]
    jobs(spark, root, sps)
    before = state(root)
    broken(monkeypatch, at)
    with pytest.raises(KeyboardInterrupt):
        rekey_jobs(spark, root, moves(spark, [(sps[0], sps[1]), (sps[1], sps[2]), (sps[2], sps[0]), (sps[3], {"x": 50})]))
    monkeypatch.undo()
    with pytest.raises(WorkspaceError, match="unfinished"):
        rekey_jobs(spark, root, moves(spark, [(sps[3], {"x": 60})]))
    assert [x for _, x in recover(spark, root, undo)] == ["undone" if undo else "finished"] and recover(spark, root) == []
    if undo:
        assert state(root) == before
    else:
        assert holds(root, sps[1], sps[0]) and holds(root, sps[2], sps[1]) and holds(root, sps[0], sps[2]) and holds(root, {"x": 50}, sps[3])
        assert len(os.listdir(f"{root}/workspace")) == 4


def broken(monkeypatch, at, rows=2):
    """Steps of one kind stop after some rows, as if the driver had been killed."""
    whole, calls = Journal._each, []

    def some(self, kind, step):
        calls.append(kind)
        if step.__name__ == at or at == kind:
            steps = self.steps(kind).orderBy("target_id", "path").limit(rows)
            real = self.steps
            self.steps = lambda k=None: steps if k == kind else real(k)
            whole(self, kind, step)
            raise KeyboardInterrupt
        return whole(self, kind, step)

    monkeypatch.setattr(Journal, "_each", some)


@pytest.fixture
def sides(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    jobs(spark, a, [{"x": i} for i in (0, 1, 2)], [{"k": i, "n": {"s": 1}} for i in (0, 1, 2)])
    jobs(spark, b, [{"x": i} for i in (1, 2, 3)], [{"k": 10}, None, {"k": 3}])
    for i in (1, 2):
        with open(f"{a}/workspace/{calc_id({'x': i})}/out.txt", "w") as f:
            f.write("the source's")
    return a, b


@pytest.mark.parametrize("rows", [0, 1, 3, 5])
@pytest.mark.parametrize("undo", [False, True])
def test_a_synchronisation_that_is_broken_off(spark, sides, tmp_path, monkeypatch, rows, undo):
    import shutil

    a, b = sides
    before = state(b)
    shutil.copytree(b, tmp_path / "c")
    sync_workspaces(spark, a, str(tmp_path / "c"), FileSync.always(), DocSync.UPDATE)
    after = state(tmp_path / "c")
    assert before != after and len(read_project(spark, str(tmp_path / "c"))) == 4
    broken(monkeypatch, "put", rows)
    with pytest.raises(KeyboardInterrupt):
        sync_workspaces(spark, a, b, FileSync.always(), DocSync.UPDATE)
    monkeypatch.undo()
    if undo and rows == 3:  # an undoing that is broken off is gone on with
        broken(monkeypatch, "take", 2)
        with pytest.raises(KeyboardInterrupt):
            recover(spark, b, undo)
        monkeypatch.undo()
    assert [x for _, x in recover(spark, b, undo and rows != 3)] == ["undone" if undo else "finished"]
    assert state(b) == (before if undo else after)


def test_a_synchronisation_that_fails_while_it_prepares_changes_nothing(spark, sides, monkeypatch):
    from tessera.sources import journal

    a, b = sides
    before = state(b)
    monkeypatch.setattr(journal, "write_texts", lambda rows, j: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sync_workspaces(spark, a, b, FileSync.always(), DocSync.UPDATE)
    assert state(b) == before and unfinished(spark, b) == []


@pytest.mark.parametrize("side", [0, 1])
@pytest.mark.parametrize("name,error", [("document.json", DocumentsCorruptedError), ("statepoint.json", JobsCorruptedError)])
def test_damaged_files_raise_before_anything_is_written(spark, sides, side, name, error):
    job = calc_id({"x": 2})
    with open(f"{sides[side]}/workspace/{job}/{name}", "w") as f:
        f.write('{"y": 5, "z": ')
    before = state(sides[1])
    with pytest.raises(error) as e:
        sync_workspaces(spark, *sides, FileSync.always(), DocSync.UPDATE)
    assert e.value.job_ids == [job] and state(sides[1]) == before
    with pytest.raises(error):
        read_project(spark, sides[side])
    assert len(read_project(spark, sides[side], validate=False)) == 3


def test_repair(spark, tmp_path):
    root = str(tmp_path)
    sps = [{"x": i} for i in range(7)]
    jobs(spark, root, sps)
    index = spark.createDataFrame([(calc_id(sp), json.dumps(sp)) for sp in sps[:3]] + [("0" * 32, '{"x": 1}')], "job_id string, sp_json string")
    at = lambda sp: f"{root}/workspace/{calc_id(sp)}/statepoint.json"
    open(at(sps[0]), "w").write('{"x": ')  # known: written anew
    os.remove(at(sps[1]))  # known: written anew
    open(at(sps[3]), "w").write('{"x": 33}')  # under a wrong id: moves
    open(at(sps[4]), "w").write('{"x": 5}')  # would land on another job
    open(at(sps[6]), "w").write("[]")  # lost
    with pytest.raises(JobsCorruptedError) as e:
        repair_workspace(spark, root, index)
    assert sorted(e.value.job_ids) == sorted([calc_id(sps[4]), calc_id(sps[6])])
    assert all(holds(root, sp, sp) for sp in (sps[0], sps[1], sps[2], sps[5])) and holds(root, {"x": 33}, sps[3])
    assert not os.path.exists(f"{root}/workspace/{calc_id(sps[3])}") and unfinished(spark, root) == []
    open(at(sps[2]), "w").write("")
    assert [(r["job_id"], r["action"]) for r in repair_workspace(spark, root, index, [calc_id(sps[2])]).collect()] == [(calc_id(sps[2]), "write")]
    assert repair_workspace(spark, root, index, [calc_id(sps[2])]).collect() == []


def test_init(spark, tmp_path):
    root = str(tmp_path)
    p = Project.of_statepoints(spark, [{"x": i} for i in range(3)], [{"d": 1}, None, None])
    assert init_jobs(spark, root, p) == 3 and init_jobs(spark, root, p) == 0 and len(read_project(spark, root)) == 3
    at = f"{root}/workspace/{calc_id({'x': 0})}"
    open(f"{at}/statepoint.json", "w").write("{")
    open(f"{at}/document.json", "w").write('{"d": 2}')
    more = Project.of_statepoints(spark, [{"x": i} for i in (0, 7)])
    with pytest.raises(JobsCorruptedError):
        init_jobs(spark, root, more)
    assert not os.path.exists(f"{root}/workspace/{calc_id({'x': 7})}")
    assert init_jobs(spark, root, more, validate=False) == 1 and open(f"{at}/statepoint.json").read() == "{"
    assert init_jobs(spark, root, more, force=True) == 0 and json.load(open(f"{at}/statepoint.json")) == {"x": 0} and json.load(open(f"{at}/document.json")) == {"d": 2}


def test_typed_projects_say_what_they_cannot_do(spark):
    t = Project.of_table(spark.range(3).select("id", (F.col("id") * 2).alias("w"), F.when(F.col("id") > 0, F.lit("x")).alias("s")), {"a": "id", "n.b": "w"}, {"s": "s"}, "id")
    for change in (lambda: t.insert(t), lambda: t.update_documents({"k": 1}), lambda: t.update_statepoints({"k": 1}), lambda: t.clear()):
        with pytest.raises(TypeError, match="as_json"):
            change()
    j = t.as_json().update_documents({"k": 1}, {"a": 1})
    assert sorted((r["job_id"], r["sp_json"], r["doc_json"]) for r in j._plain().collect()) == sorted((calc_id({"a": i, "n": {"b": 2 * i}}), json.dumps({"a": i, "n": {"b": 2 * i}}), json.dumps({"s": "x"} | ({"k": 1} if i == 1 else {}), sort_keys=True) if i else "{}") for i in range(3))
