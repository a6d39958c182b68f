import numpy as np
import pandas as pd
import pytest

from tessera.errors import InvalidKeyError, StoreAlreadyOpenError, StoreClosedError
from tessera.operators.stores import Store, StoreManager, array_stats, job_stores, store_names
from tessera.sources.workspace import clear_jobs, copy_jobs


def test_values(spark):
    s = Store(spark, owner="job")
    values = {"i": 7, "big": 10**30, "f": 1.5, "s": "é", "b": True, "n": None, "raw": b"\0x", "m": {"x": 1, "y": {"z": "q"}}, "e": {}, "z": 1 + 2j, "a": np.arange(6, dtype="int32").reshape(2, 3)}
    with s:
        for k, v in values.items():
            s[k] = v
        s["frame"] = pd.DataFrame({"c": [1.0, 2.0]})
        assert s["i"] == 7
    assert s.keys() == sorted([*values, "frame"]) and len(s) == 12
    for k, v in values.items():
        if k == "a":
            assert (s[k] == v).all() and s[k].dtype == v.dtype
        else:
            assert s[k] == v and type(s[k]) is type(v)
    assert s["frame"]["c"].tolist() == [1.0, 2.0]
    with s:
        del s["i"]
        s["m"] = 3
        assert "i" not in s and s.setdefault("new", 4) == 4
        with pytest.raises(KeyError):
            s["i"]
    assert s["m"] == 3 and s["new"] == 4 and "i" not in list(s)
    with s:
        s.clear()
    assert len(s) == 0


@pytest.mark.parametrize("value", [np.array([2**60 + 1, -(2**63)]), np.array([1 + 2j, 3j]), np.array(["é", "longer text"]), np.array([b"a", b"\0b"]), np.zeros((0, 3)), np.array(5.5), np.array([True, False]), np.array([(1, 2.5)], dtype=[("x", "i8"), ("y", "f4")]), np.array(["2020-01-01"], dtype="datetime64[ns]"), np.array([np.nan, np.inf])], ids=str)
def test_arrays_come_back_bit_by_bit(spark, value):
    s = Store(spark)
    with s:
        s["a"] = value
    got = s["a"]
    assert got.dtype == value.dtype and got.shape == value.shape and got.tobytes() == value.tobytes()


def test_stores_of_projects_and_jobs_last_and_go_along(spark, tmp_path):
    a, b, job = str(tmp_path / "a"), str(tmp_path / "b"), "0" * 32
    (tmp_path / f"a/workspace/{job}").mkdir(parents=True)
    stores = StoreManager(spark, a, job)
    assert list(stores) == [] and "first" not in stores
    with stores["first"] as s:
        s["x"], s["m"] = np.arange(3), {"p": 1, "q": {"r": "t"}}
    with stores["first"] as s:
        s["m/q"] = 9
        del s["x"]
    stores["second"] = {"frame": pd.DataFrame({"c": [1, 2], "t": ["u", None]}, index=[5, 6])}
    StoreManager(spark, a)["data"].open()["p"] = 1  # never flushed
    with StoreManager(spark, a)["data"] as s:
        s["p"] = 2
    again = StoreManager(spark, a, job)
    assert list(again) == ["first", "second"] and again["first"]["m"] == {"p": 1, "q": 9} and again["first"].keys() == ["m"]
    assert StoreManager(spark, a)["data"]["p"] == 2
    pd.testing.assert_frame_equal(again["second"]["frame"], pd.DataFrame({"c": [1, 2], "t": ["u", None]}, index=[5, 6]))
    assert sorted((r["store"], r["path"]) for r in job_stores(spark, a).collect()) == [("first", "m/p"), ("first", "m/q"), ("second", "frame")]
    again["first"].compact()
    assert StoreManager(spark, a, job)["first"]["m"] == {"p": 1, "q": 9}
    ids = spark.createDataFrame([(job,)], "job_id string")
    copy_jobs(spark, ids, a, b)
    assert StoreManager(spark, b, job)["first"]["m"] == {"p": 1, "q": 9}
    clear_jobs(spark, ids, a)
    assert list(f for n in StoreManager(spark, a, job) for f in StoreManager(spark, a, job)[n]) == []
    again["second"] = {"only": 1}
    del again["second"]
    assert "second" not in again
    with pytest.raises(TypeError):
        Store(spark)["o"] = np.array([object()])


def test_errors_and_other_owners(spark):
    s = Store(spark, owner="a")
    with pytest.raises(InvalidKeyError):
        s["a.b"] = 1
    s["x"] = 1
    with pytest.raises(StoreClosedError):
        s.flush()
    with s:
        with pytest.raises(StoreAlreadyOpenError):
            s.open()
    other = Store(spark, s.table, owner="b", name="second")
    with other:
        other["x"] = 2
    assert len(Store(spark, other.table, owner="a")) == 1 and [r[0] for r in store_names(other.table, "b").collect()] == ["second"]


def test_array_stats(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0, 4.0])], "k int, v array<float>")
    assert tuple(array_stats(df, "k", "v").first()) == (1, 3, 3.0, -2.0, 4.0)


def test_writers_at_once_lose_nothing(spark, tmp_path):
    import threading

    at = f"file://{tmp_path}/s"
    errors = []

    def work(who):
        try:
            for i in range(4):
                with Store(spark, path=at) as s:
                    s[f"{who}{i}"] = i
                    s["shared"] = f"{who}{i}"
        except BaseException as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    s = Store(spark, path=at)
    assert s.keys() == sorted([f"{w}{i}" for w in "abc" for i in range(4)] + ["shared"]) and s["shared"][1] == "3"
    assert s.commits.numbers() == list(range(1, 13))
    s.compact()
    assert s.keys() == sorted([f"{w}{i}" for w in "abc" for i in range(4)] + ["shared"]) and len(s.commits.snapshot()[1]) == 1


def test_a_writer_that_is_too_late_takes_the_next_number(spark, tmp_path, monkeypatch):
    from tessera.operators.commits import Commits

    at = f"file://{tmp_path}/s"
    a, b = Store(spark, path=at).open(), Store(spark, path=at).open()
    a["k"], b["k"], b["m"] = 1, 2, 3
    create, raced = Commits._create, []

    def slow(self, n, said):
        if not raced:
            raced.append(n)
            b.flush()  # between a's look at the log and its commit
        return create(self, n, said)

    monkeypatch.setattr(Commits, "_create", slow)
    a.flush()
    assert raced == [1] and a.commits.numbers() == [1, 2] and a["k"] == 1 and a["m"] == 3  # a's commit came last
    assert len([n for n in a.commits._list(a.path) if n.startswith("rows-")]) == 2  # what was given up is gone


def test_readers_survive_compactions_and_what_is_not_committed_does_not_count(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    s = Store(spark, path=at)
    with s:
        s["x"], s["y"] = 1, 2
    before = s.table
    s.compact()
    with s:
        s["x"] = 5
    assert sorted(r["path"] for r in before.collect()) == ["x", "y"] and s["x"] == 5 and s["y"] == 2
    s.compact()
    with s:
        del s["y"]
    assert s.keys() == ["x"]
    before.sparkSession.createDataFrame([("", "data", "z", "int", None, None, "1", None, 99)], before.schema).write.parquet(f"{at}/rows-lost")
    assert s.keys() == ["x"]


def test_many_arrays_at_once(spark, tmp_path):
    s = Store(spark, path=f"file://{tmp_path}/s")
    s.write_arrays(spark.createDataFrame([("a", [1.5, 2.5]), ("b", []), ("c", None)], "key string, value array<float>"))
    assert s["a"].dtype == np.float32 and s["a"].tolist() == [1.5, 2.5] and s["b"].shape == (0,) and s["c"] is None
    s.write_arrays(spark.createDataFrame([("a", [7])], "key string, value array<bigint>"))
    assert sorted((r["key"], r["value"]) for r in s.arrays().collect()) == [("a", [7.0]), ("b", [])] and s["a"].dtype == np.int64
    for rows, kind in (([("k.l", [1.0])], "float"), ([(None, [1.0])], "float"), ([("k", ["x"])], "string")):
        with pytest.raises((ValueError, TypeError)):
            s.write_arrays(spark.createDataFrame(rows, f"key string, value array<{kind}>"))
