"""Indexes that are read in part."""

import pytest

from tessera.operators.project import Project
from tessera.sources import skipping
from tessera.sources.workspace import read_index, update_index, write_index, write_project


def rows_read(df):
    """(rows that matched, rows that the scan gave)."""
    n = len(df.collect())
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    return n, leaf.metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def mixed(spark):
    """State points whose keys have values of several types, are missing, null, nested or lists."""
    odd = [0.0, -0.0, 1, 1.0, True, False, None, "1", "", "é\"\\", [1, 2], {}, 2**53 + 1, 1e300, -7]
    sps = [{"i": i, "p": {"q": {"r": i % 7, "s": f"t{i % 5}"}}} for i in range(300)]
    sps += [{"i": 1000 + k, "x": v} for k, v in enumerate(odd)] + [{"x": {"y": 3}, "i": -1}, {}]
    docs = [{"done": i % 3 == 0, "note": f"n{i}"} if i % 2 else None for i in range(len(sps))]
    return Project.of_statepoints(spark, sps, docs)


FILTERS = [
    {"i": 17}, {"i.$gte": 1000}, {"i.$in": [3, 4.0, "3", True]}, {"p.q.r": 3}, {"p.q.s": "t2"}, {"p.q.s.$regex": "^t[12]"}, {"x": 0}, {"x": -0.0},
    {"x": 1}, {"x": True}, {"x": None}, {"x": "1"}, {"x": ""}, {"x": 'é"\\'}, {"x": [1, 2]}, {"x": {}}, {"x.y": 3}, {"x.$exists": True}, {"x.$ne": 1},
    {"x.$nin": [0, "1"]}, {"x": 2**53 + 1}, {"x.$gt": 2**53}, {"x.$lt": 0.5}, {"x.$type": "str"}, {"x.$near": 1}, {"doc.done": True}, {"doc.note": "n5"},
    {"$not": {"x": 1}}, {"$or": [{"i": 5}, {"doc.note": "n9"}]}, {"x.$in": [-0.0, "é\"\\"]}, {"nowhere": 1},
]


def test_an_index_finds_what_the_project_finds(spark, mixed, tmp_path):
    path = str(tmp_path / "index")
    write_index(mixed, path, rows_per_file=40)
    index = read_index(spark, path)
    assert len(index) == len(mixed)
    for f in FILTERS:
        assert sorted(r[0] for r in index.find_jobs(f).ids().collect()) == sorted(r[0] for r in mixed.find_jobs(f).ids().collect()), f
    groups = lambda p: sorted(map(tuple, p.groupby("p.q.s").counts().collect()))
    assert groups(index) == groups(mixed)


def test_ids_and_values_read_little(spark, tmp_path):
    p = Project.of_statepoints(spark, [{"i": i, "name": f"job number {i}"} for i in range(2000)])
    path = str(tmp_path / "index")
    write_index(p, path, rows_per_file=100)
    whole = read_index(spark, path)
    assert len(whole.jobs.inputFiles()) == 20
    job = p.find_jobs()[700]
    one = read_index(spark, path, [job])
    assert len(one.jobs.inputFiles()) == 1 and list(one) == [job]
    some = read_index(spark, path, [job[:2], "zz"])
    assert len(some.jobs.inputFiles()) <= 3 and sorted(some) == sorted(j for j in p if j.startswith(job[:2]))
    assert list(read_index(spark, path, ["zz"])) == [] and list(read_index(spark, path, [])) == []
    for f in ({"i": 1234}, {"name": "job number 77"}, {"i.$in": [5]}, {"_id": job}):
        n, read = rows_read(whole.find_jobs(f).df.select("job_id", "sp_json"))
        assert n == 1 and read <= 300, (f, read)  # of 2000
    assert "EqualTo(_k" in whole.find_jobs({"name": "job number 77"}).df._jdf.queryExecution().toString()


def test_keys_are_counted_in_all_depths(spark, mixed):
    found = {(r["path"], r["tag"]): r["n"] for r in skipping.key_counts(mixed.jobs, "sp").collect()}
    want = {}
    for r in mixed.leaves().where("type <> 'dict'").groupBy("path", "type").count().collect():
        want[r["path"], r["type"]] = r["count"]
    assert found == want


def test_the_most_frequent_keys_get_columns(spark, mixed, tmp_path):
    write_index(mixed, str(tmp_path / "i"), most=1)
    assert set(read_index(spark, str(tmp_path / "i")).fields.typed) == {("sp.i", "number"), ("doc.done", "number")}
    write_index(mixed, str(tmp_path / "n"), most=0)
    none = read_index(spark, str(tmp_path / "n"))
    assert not none.fields.typed and len(none.find_jobs({"i": 17})) == 1


def test_updates_keep_columns_and_ranges(spark, tmp_path):
    root, path = str(tmp_path / "p"), str(tmp_path / "index")
    write_project(Project.of_statepoints(spark, [{"a": i} for i in range(4)]), root)
    assert update_index(spark, root, path) == 4
    write_project(Project.of_statepoints(spark, [{"b": "x"}]), root)
    assert update_index(spark, root, path) == 5
    index = read_index(spark, path)
    assert {k for k, _ in index.fields.typed} == {"sp.a", "sp.b"}
    job = list(index.find_jobs({"b": "x"}))[0]
    assert list(read_index(spark, path, [job])) == [job]


def test_an_empty_index(spark, tmp_path):
    write_index(Project.of_statepoints(spark, []), str(tmp_path / "i"))
    assert len(read_index(spark, str(tmp_path / "i"))) == 0 and list(read_index(spark, str(tmp_path / "i"), ["0"])) == []
