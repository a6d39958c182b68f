import json
import os

import pytest

from tessera import cli
from tessera.errors import IncompatibleSchemaVersion
from tessera.functions.canon import calc_id
from tessera.sources import folders


@pytest.fixture
def here(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init"]) == 0
    for i in range(4):
        assert cli.main(["job", "-c", json.dumps({"a": i, "b": i % 2})]) == 0
    return tmp_path


def out(capsys, *args):
    capsys.readouterr()
    assert cli.main(list(args)) == 0, capsys.readouterr().err
    return capsys.readouterr().out.strip().splitlines()


def test_commands(here, capsys):
    ids = {i: calc_id({"a": i, "b": i % 2}) for i in range(4)}
    assert out(capsys, "job", '{"b": 1, "a": 3}') == [ids[3]]
    assert out(capsys, "find", "a", "0") == [ids[0]]
    assert out(capsys, "find", '{"a.$gt": 2}', "--sp", "a") == [f'{ids[3]} {{"a": 3}}']
    assert sorted(out(capsys, "statepoint", "-f", "b", "1")) == ['{"a": 1, "b": 1}', '{"a": 3, "b": 1}']
    assert out(capsys, "document", "-j", ids[0]) == ["{}"]
    assert out(capsys, "schema") == ["{", " 'a': 'int([0, 1, 2, 3], 4)',", " 'b': 'int([0, 1], 2)',", "}"]
    assert out(capsys, "diff", "-j", ids[0], ids[2]) == sorted([f"{ids[0]} a=0", f"{ids[2]} a=2"])
    assert f"{ids[0]} a None None 2 {ids[2]}" in out(capsys, "neighbors")
    assert out(capsys, "update-index") == ["4"] and out(capsys, "update-index") == ["up to date"] and out(capsys, "check") == ["ok"]
    out(capsys, "export", "exported.zip", "a/{a}")
    out(capsys, "view", "links")
    assert os.path.realpath("links/b/1/a/3/job") == str(here / "workspace" / ids[3])
    out(capsys, "rm", "-f", "a", "3")
    assert len(out(capsys, "find")) == 3
    assert cli.main(["import", "exported.zip"]) == 1 and len(out(capsys, "find")) == 3  # jobs are there
    assert out(capsys, "import", "exported.zip", "--sync") == ["4"] and len(out(capsys, "find")) == 4
    folders.init_project(str(here / "other"))
    out(capsys, "clone", "-f", "b", "1", "--", str(here / "other"))
    os.chdir(here / "other")
    assert len(out(capsys, "find")) == 2
    out(capsys, "sync", str(here), "--no-schema-check")
    assert len(out(capsys, "find")) == 4


def held(root):
    """All files below the workspace of a project, by job and path."""
    at = os.path.join(root, "workspace")
    return {os.path.relpath(os.path.join(d, f), at): open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(at) for f in files}


def test_files_go_along_with_every_command(here, capsys):
    ids = {i: calc_id({"a": i, "b": i % 2}) for i in range(4)}
    for i, j in ids.items():
        os.makedirs(f"workspace/{j}/deep/er")
        for name, data in (("out.bin", b"\0\xff" * i), ("deep/er/x.txt", b"%d" % i), (".hidden", b"h"), ("_under", b"u")):
            with open(f"workspace/{j}/{name}", "wb") as f:
                f.write(data)
    before = held(here)
    assert len(before) == 4 * 5
    of = lambda files, *which: {k: v for k, v in files.items() if k.split("/")[0] in {ids[i] for i in which}}
    other = folders.init_project(str(here / "other"))
    out(capsys, "clone", "-f", "a", "1", "--", other)
    assert held(other) == of(before, 1) and held(here) == before
    assert cli.main(["move", "-f", "a.$lt", "3", "--", other]) == 1 and held(other) == of(before, 1) and held(here) == before  # one is there
    out(capsys, "move", "-f", "a", "2", "--", other)
    assert held(other) == of(before, 1, 2) and held(here) == of(before, 0, 1, 3)
    for target in ("all.zip", "all.tar.gz", "folder"):
        out(capsys, "export", target)
        third = folders.init_project(str(here / f"of-{target}"))
        os.chdir(third)
        assert out(capsys, "import", str(here / target)) == ["3"]
        os.chdir(here)
        assert held(third) == of(before, 0, 1, 3)
    with open(f"other/workspace/{ids[1]}/out.bin", "wb") as f:
        f.write(b"other")
    assert cli.main(["sync", other]) == 1 and held(here) == of(before, 0, 1, 3)  # a conflict: nothing is written
    plan = out(capsys, "sync", other, "--file-sync", "always", "--dry-run")
    assert f"{ids[1]}/out.bin" in plan and f"{ids[2]}/deep/er/x.txt" in plan and held(here) == of(before, 0, 1, 3)
    assert out(capsys, "sync", other, "--file-sync", "never", "--exclude", "deep", "--stats")[-1].startswith("3 files")
    assert held(here) == of(before, 0, 1, 3) | {k: v for k, v in of(before, 2).items() if "deep" not in k}
    out(capsys, "sync", other, "--file-sync", "always")
    assert held(here) == before | {f"{ids[1]}/out.bin": b"other"}
    out(capsys, "clear", "-f", "a", "0")
    assert set(of(held(here), 0)) == {f"{ids[0]}/statepoint.json"}
    out(capsys, "rm", "-f", "a", "0")
    assert of(held(here), 0) == {}


def test_exit_codes(here, capsys):
    assert cli.main([]) == 2
    assert cli.main(["find", '{"a.$foo": 1}']) == 1 and "error" in capsys.readouterr().err
    assert out(capsys, "config", "verify") == ["ok"]
    assert out(capsys, "config", "set", "x", "5") == ['{"schema_version": 1, "x": 5}']
    assert "unknown key 'x'" in out(capsys, "config", "verify")[0]


def test_folders(tmp_path):
    root = folders.init_project(str(tmp_path / "p"))
    assert folders.get_project(f"{root}/workspace") == root
    with pytest.raises(LookupError):
        folders.get_project(str(tmp_path), search=False)
    job = f"{root}/workspace/{'a' * 32}"
    os.makedirs(f"{job}/x")
    assert folders.get_job(f"{job}/x") == (root, "a" * 32)
    folders.write_config(root, "schema_version", 0)
    with pytest.raises(IncompatibleSchemaVersion):
        folders.get_project(root)
    assert folders.migrate(root) and folders.get_project(root) == root and folders.migrate(root) == []
    with folders.temporary_project(str(tmp_path)) as t:
        assert folders.get_project(t) == t
    assert not os.path.exists(t)
