import json

import pytest
from pyspark.sql import functions as F

from tessera.errors import DocumentSyncConflict, FileSyncConflict, SchemaSyncConflict
from tessera.functions.canon import calc_id
from tessera.operators.project import Project
from tessera.operators.sync import DocSync, FileSync, file_plan, merge_mapping, sync_projects, transfer_stats


def docs(p):
    return {r["job_id"]: None if r["doc_json"] is None else json.loads(r["doc_json"]) for r in p.jobs.select("job_id", "doc_json").collect()}


@pytest.fixture
def two(spark):
    a = Project.of_statepoints(spark, [{"a": i} for i in (0, 2, 4)], [{"a": i, "nested": {"a": i, "x": 1}} for i in (0, 2, 4)])
    b = Project.of_statepoints(spark, [{"a": i} for i in (0, 3, 4)], [{"a": 7, "own": 1}, {"a": 3}, {"nested": {"y": 2}}])
    return a, b


ID = {i: calc_id({"a": i}) for i in range(5)}


def test_conflict_without_strategy(two):
    with pytest.raises(DocumentSyncConflict) as e:
        sync_projects(*two)
    assert e.value.keys == ["a"]


@pytest.mark.parametrize("how,zero", [
    (DocSync.UPDATE, {"a": 0, "nested": {"a": 0, "x": 1}, "own": 1}), (DocSync.COPY, {"a": 0, "nested": {"a": 0, "x": 1}}), (DocSync.NO_SYNC, {"a": 7, "own": 1}),
    (DocSync.ByKey("a"), {"a": 0, "nested": {"a": 0, "x": 1}, "own": 1}), (DocSync.ByKey("zz"), {"a": 7, "nested": {"a": 0, "x": 1}, "own": 1}), (DocSync.ByKey(lambda k: k == "a"), {"a": 0, "nested": {"a": 0, "x": 1}, "own": 1}),
])
def test_document_strategies(two, how, zero):
    got = docs(sync_projects(*two, doc_sync=how))
    assert set(got) == {ID[0], ID[2], ID[3], ID[4]}
    assert got[ID[0]] == zero and got[ID[3]] == {"a": 3} and got[ID[2]] == {"a": 2, "nested": {"a": 2, "x": 1}}
    if how == DocSync.UPDATE:  # whole keys
        assert got[ID[4]] == {"a": 4, "nested": {"a": 4, "x": 1}}
    elif how not in (DocSync.COPY, DocSync.NO_SYNC):
        assert got[ID[4]] == {"a": 4, "nested": {"a": 4, "x": 1, "y": 2}}


@pytest.mark.parametrize("source,destination,how,result", [
    ({"n": {"a": 3}}, {"n": {"a": 1, "b": 2}, "k": 1}, DocSync.UPDATE, {"n": {"a": 3}, "k": 1}),
    ({"n": 1}, {"n": {"a": {"b": 2}}}, DocSync.UPDATE, {"n": 1}),
    ({"n": {}}, {"n": {"a": 1}, "k": 2}, DocSync.UPDATE, {"n": {}, "k": 2}),
    ({}, {"k": 1}, DocSync.UPDATE, {"k": 1}),
    ({"v": 1.0, "l": [1.0, True], "n": {"x": 2}}, {"v": 1, "l": [1, 1], "n": {"x": 2.0, "y": 3}}, DocSync.ByKey(), {"v": 1, "l": [1, 1], "n": {"x": 2.0, "y": 3}}),
    ({"n": {}}, {"n": {"a": 1}}, DocSync.ByKey(), {"n": {"a": 1}}),
    ({"n": {"a": 1}}, {"n": {}}, DocSync.ByKey(), {"n": {"a": 1}}),
    ({"n": {}}, {"n": 5}, DocSync.ByKey(), {"n": 5}),
    ({}, {"k": 1}, DocSync.COPY, {}),
    (None, {"k": 1}, DocSync.COPY, {"k": 1}),
    ({"k": {"z": 1}}, None, DocSync.COPY, {"k": {"z": 1}}),
    ({}, None, DocSync.UPDATE, {}),
    (None, None, DocSync.ByKey(), None),
    ({"k": 1}, None, DocSync.NO_SYNC, None),
])
def test_documents_as_specified(spark, source, destination, how, result):
    a, b = (Project.of_statepoints(spark, [{"a": 0}], [doc]) for doc in (source, destination))
    assert docs(sync_projects(a, b, how)) == {ID[0]: result}


@pytest.mark.parametrize("source,destination", [({"n": 5}, {"n": {}}), ({"n": {"a": 1}}, {"n": {"a": 2}}), ({"v": 1}, {"v": "1"}), ({"v": [1]}, {"v": [2]})])
def test_differences_raise(spark, source, destination):
    with pytest.raises(DocumentSyncConflict):
        sync_projects(*(Project.of_statepoints(spark, [{"a": 0}], [doc]) for doc in (source, destination)))


def test_mapping_against_scalar_is_a_conflict(spark):
    a = Project.of_statepoints(spark, [{"a": 0}], [{"k": {"x": 1}}])
    b = Project.of_statepoints(spark, [{"a": 0}], [{"k": 5}])
    with pytest.raises(DocumentSyncConflict):
        sync_projects(a, b)
    assert docs(sync_projects(a, b, DocSync.UPDATE))[ID[0]] == {"k": {"x": 1}}
    assert docs(sync_projects(a, b, DocSync.ByKey("zz")))[ID[0]] == {"k": 5}


def test_selection_schema_and_self(spark, two):
    assert set(docs(sync_projects(*two, doc_sync=DocSync.UPDATE, selection=[ID[2]]))) == {ID[0], ID[2], ID[3], ID[4]}
    other = Project.of_statepoints(spark, [{"zz": 1}])
    with pytest.raises(SchemaSyncConflict):
        sync_projects(other, two[1])
    assert len(sync_projects(other, two[1], check_schema=False)) == 4
    with pytest.raises(ValueError):
        sync_projects(two[0], two[0])


def test_project_documents():
    a, b = {"x": 1, "n": {"y": 2, "z": 3}}, {"x": 5, "n": {"y": 2, "w": 4}}
    assert merge_mapping(a, b, DocSync.UPDATE) == {"x": 1, "n": {"y": 2, "z": 3}}
    assert merge_mapping({"x": 1.0, "e": {}}, {"x": 1, "e": 5}, DocSync.ByKey()) == {"x": 1, "e": 5}
    assert merge_mapping(a, b, DocSync.ByKey("n")) == {"x": 5, "n": {"y": 2, "z": 3, "w": 4}} and merge_mapping(a, b, DocSync.NO_SYNC) == b
    with pytest.raises(DocumentSyncConflict):
        merge_mapping(a, b, DocSync.ByKey())


def test_files(spark):
    def files(rows):
        return spark.createDataFrame([(j, p, t, len(c), c.encode()) for j, p, t, c in rows], "job_id string, path string, mtime long, length long, content binary").withColumn("mtime", F.col("mtime").cast("timestamp"))

    src = files([("j", "only", 1, "aa"), ("j", "same", 1, "x"), ("j", "new", 9, "yy"), ("j", "sub/f", 1, "zzz"), ("j", "touched", 5, "q")])
    dst = files([("j", "same", 1, "x"), ("j", "new", 2, "zz"), ("j", "touched", 4, "q"), ("j", "theirs", 1, "t")])
    act = lambda **kw: {r["path"] for r in file_plan(src, dst, **kw).where("action = 'copy'").collect()}
    with pytest.raises(FileSyncConflict):
        file_plan(src, dst)
    assert act(strategy=FileSync.always()) == {"only", "new", "sub/f", "touched"} and act(strategy=FileSync.never()) == {"only", "sub/f"}
    assert act(strategy=FileSync.update()) == {"only", "new", "sub/f", "touched"} and act(strategy=FileSync.always(), deep=True) == {"only", "new", "sub/f"}
    assert act(strategy=FileSync.always(), size_only=True) == {"only", "sub/f"} and act(strategy=FileSync.always(), recursive=False, exclude=["on"]) == {"new", "touched"}
    assert act(strategy=FileSync.ask(lambda j, p: p == "new")) == {"only", "new", "sub/f"}
    assert tuple(transfer_stats(file_plan(src, dst, FileSync.never())).first()) == (2, 5)
