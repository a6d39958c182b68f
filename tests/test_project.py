import pytest
from pyspark.sql import functions as F

from tessera.errors import DestinationExistsError, JobsCorruptedError
from tessera.functions.canon import calc_id
from tessera.operators.diff import diff_jobs
from tessera.operators.neighbors import neighbors
from tessera.operators.project import Project
from tessera.operators.schema import ProjectSchema


RODS = [{"len": 3 * i, "kind": i % 3, "grade": "abcde"[i % 5]} for i in range(15)]


@pytest.fixture(scope="module")
def rods(spark):
    return Project.of_statepoints(spark, RODS, [{"mass": i / 4, "run": {"oven": i % 2}} for i in range(15)])


def test_cursor(rods):
    jobs = rods.find_jobs({"kind": 1})
    ids = sorted(calc_id(sp) for sp in RODS if sp["kind"] == 1)
    assert len(jobs) == 5 and list(jobs) == ids and ids[0] in jobs and "0" * 32 not in jobs
    assert jobs[1] == ids[1] and jobs[-1] == ids[-1] and jobs[1:4] == ids[1:4] and jobs[-2:] == ids[-2:] and jobs[::2] == ids[::2]
    with pytest.raises(IndexError):
        jobs[5]
    assert jobs == rods.find_jobs({"kind": 1}) and jobs != rods.find_jobs({"kind": 2}) and len(rods) == 15


def test_open_job(rods):
    i = calc_id(RODS[4])
    assert list(rods.open_job(dict(reversed(RODS[4].items())))) == [i] and list(rods.open_job(id=i[:8])) == [i] and i in rods
    assert len(rods.open_job({"len": 99})) == 0
    with pytest.raises(KeyError):
        rods.open_job(id="zz")
    with pytest.raises(LookupError):
        rods.open_job(id="")
    with pytest.raises(ValueError):
        rods.open_job()


def test_groupby(rods):
    assert [(k, g.count()) for k, g in rods.groupby("grade")] == [(x, 3) for x in "abcde"]
    count = {(x, o): sum(i % 5 == "abcde".index(x) and i % 2 == o for i in range(15)) for x in "abcde" for o in (0, 1)}
    assert [(k, g.count()) for k, g in rods.groupby(["doc.run.oven", "grade"])] == sorted(count.items())  # state point keys come first
    assert len(list(rods.groupby())) == 15
    assert [(k, g.count()) for k, g in rods.groupby(lambda sp, doc: sp["len"] > 20)] == [("false", 7), ("true", 8)]
    assert list(rods.groupby("x")) == [] and [(k, g.count()) for k, g in rods.groupby("x", default=-1)] == [(-1, 15)]
    assert {tuple(r) for r in rods.groupby("kind").agg(F.max(F.try_variant_get("sp", "$.len", "int")).alias("m")).select("`sp.kind`.number", "m").collect()} == {(0.0, 36), (1.0, 39), (2.0, 42)}


def test_groupby_merges_equal_numbers(spark):
    p = Project.of_statepoints(spark, [{"a": v} for v in (1, 1.0, True, "1", None, [1])])
    assert sorted((r[0]["kind"], r[1]) for r in p.groupby("a").counts().collect()) == [("NoneType", 1), ("number", 3), ("str", 1), ("tuple", 1)]


def test_to_dataframe(spark):
    p = Project.of_statepoints(spark, [{"a": i, "n": {"x": i / 2}} for i in range(3)] + [{"z": "t"}], [{"d": 1}, None, None, None])
    wide = p.to_dataframe(flatten=True)
    assert set(wide.columns) == {"job_id", "sp.a", "sp.n.x", "sp.z", "doc.d"} and wide.count() == 4
    assert dict(wide.dtypes)["sp.a"] == "bigint" and dict(wide.dtypes)["sp.n.x"] == "double" and dict(wide.dtypes)["sp.z"] == "string"
    assert set(p.to_dataframe().columns) == {"job_id", "sp.a", "sp.n", "sp.z", "doc.d"}
    assert p.to_dataframe(usecols=["sp.a"]).count() == 3 and p.to_dataframe(usecols=lambda c: c.endswith("d")).count() == 1
    assert "s_a" in p.to_dataframe(sp_prefix="s_").columns


def test_min_len_unique_id(spark, rods):
    import os

    ids = sorted(rods)
    want = max(len(os.path.commonprefix([a, b])) for a, b in zip(ids, ids[1:])) + 1
    assert rods.min_len_unique_id() == want
    assert Project.of_statepoints(spark, [{"a": 1}]).min_len_unique_id() == 0


def test_changes(spark, rods):
    one = Project.of_statepoints(spark, [{"a": 100}])
    assert len(rods.insert(one)) == 16 and len(rods.insert(rods)) == 15
    with pytest.raises(DestinationExistsError):
        rods.clone(rods)
    rest, other = rods.move({"kind": 0}, one)
    assert len(rest) == 10 and len(other) == 6
    assert len(rods.remove({"x": 1})) == 15 and len(rods.remove({"kind": 1})) == 10
    changed = rods.update_statepoints({"new": 7}, {"kind": 1})
    assert calc_id({**RODS[4], "new": 7}) in changed and calc_id(RODS[4]) not in changed
    with pytest.raises(KeyError):
        rods.update_statepoints({"kind": 5})
    with pytest.raises(DestinationExistsError):
        Project.of_statepoints(spark, [{"a": 1}, {"a": 2}]).update_statepoints({"a": 2}, overwrite=True)
    assert len(rods.update_documents({"y": 1}, {"kind": 1}).find_jobs({"doc.y": 1, "doc.mass.$exists": True})) == 5
    assert len(rods.clear({"kind": 0}).find_jobs({"doc.mass.$exists": True})) == 10


def test_check_and_repair(spark, rods):
    broken = rods._plain().withColumn("sp_json", F.when(F.col("job_id") == calc_id(RODS[0]), "{").otherwise(F.col("sp_json")))
    renamed = broken.withColumn("job_id", F.when(F.col("job_id") == calc_id(RODS[1]), "f" * 32).otherwise(F.col("job_id")))
    p = Project.of_canonical(renamed)
    with pytest.raises(JobsCorruptedError) as e:
        p.check()
    assert set(e.value.job_ids) == {calc_id(RODS[0]), "f" * 32}
    fixed = p.repair(rods.jobs)
    fixed.check()
    assert sorted(fixed) == sorted(rods)


def tuples(v):
    return tuple(tuples(x) for x in v) if isinstance(v, list) else v


def kinds(sps):
    """Dotted keys to type names to the values seen, taken from the state points one by one."""
    found = {}
    for sp in sps:
        left = list(sp.items())
        while left:
            k, v = left.pop()
            if isinstance(v, dict) and v:
                left += [(f"{k}.{x}", y) for x, y in v.items()]
            else:
                name = {bool: "bool", int: "int", float: "float", str: "str", list: "tuple", dict: "dict", type(None): "NoneType"}[type(v)]
                found.setdefault(k, {}).setdefault(name, set()).add(repr(v))
    return found


def test_schema(spark):
    sps = [{"engine": "rk4", "box": {"edge": 2.5, "walls": {}}, "temp": 300 + 5 * t, "seed": [t, t + 1], "opt": {"tol": 10.0**-t} if t % 3 else "none", "tag": [["p", t % 2]]} for t in range(7)]
    p = Project.of_statepoints(spark, sps)
    s, want = ProjectSchema.detect(p.leaves()), kinds(sps)
    assert set(s) == set(want) and len(s) == len(want) and s.flat_schema() == {k: tuple(sorted(v)) for k, v in sorted(want.items())}
    varying = {k for k, v in want.items() if sum(map(len, v.values())) > 1 or k.startswith("opt")}  # not all jobs have those
    assert set(ProjectSchema.detect(p.leaves(), exclude_const=True)) == varying
    assert s["temp"] == {"int": set(range(300, 335, 5))} and "temp" in s and "zz" not in s
    with pytest.raises(KeyError):
        s["zz"]
    some = ProjectSchema.detect(p.leaves(), subset=list(p)[:3])
    assert len(some["temp"]["int"]) == 3
    assert s.difference(s).count() == 0 and some.difference(s, ignore_values=True).count() == 0 and "temp" in {r[0] for r in some.difference(s).collect()}
    assert {(r["path"], r["type"]): r["n_values"] for r in s.summary().collect()} == {(k, t): len(v) for k, ts in want.items() for t, v in ts.items() if t != "dict"}
    assert repr(s) == f"ProjectSchema(<{len(want)} keys>)" and s._repr_html_().startswith("<pre>")


def test_schema_format(spark):
    """At most five values a key and type, the last two behind dots; deeper levels of a tree are folded."""
    sps = [{"run": r, "grid": {"n": [r, 7]}, "mode": "fast", "x": {"y": {"z": r / 4}}} for r in range(8)]
    s = ProjectSchema.detect(Project.of_statepoints(spark, sps).leaves())
    line = lambda values, kind: f"{kind}([{', '.join([*(str(v) for v in values[:3]), '...', *(str(v) for v in values[-2:])])}], {len(values)})"
    want = {"grid.n": line([(r, 7) for r in range(8)], "tuple"), "mode": "str([fast], 1)", "run": line(list(range(8)), "int"), "x.y.z": line([r / 4 for r in range(8)], "float")}
    assert s.format() == "\n".join(["{", *(f" '{k}': '{want[k]}'," for k in sorted(want)), "}"])
    folded = s.format(depth=2)
    assert "'y': {...}" in folded and f"'run': '{want['run']}'" in folded and "'mode': 'str([fast], 1)'" in folded
    assert "0.2" in s.format(precision=1) and "0.25" not in s.format(precision=1)


def test_diff(spark):
    sps = [{"a": 0, "b": {"c": True, "d": 1}}, {"a": 0, "b": {"c": True, "d": 2}}, {"a": 0.0, "b": {"c": True, "d": 2, "e": []}}]
    p = Project.of_statepoints(spark, sps)
    ids = [calc_id(s) for s in sps]
    assert diff_jobs(p.leaves(), *ids[:2]) == {ids[0]: {"b": {"d": 1}}, ids[1]: {"b": {"d": 2}}}
    assert diff_jobs(p.leaves(), *ids)[ids[2]] == {"b": {"d": 2, "e": []}}
    assert diff_jobs(p.leaves()) == {} and diff_jobs(p.leaves(), ids[0]) == {ids[0]: {}} and diff_jobs(p.leaves(), ids[0], ids[0]) == {ids[0]: {}}


def pairs(found):
    return {(r["job_id"], r["path"]): (r["prev_job_id"], r["next_job_id"]) for r in found.collect()}


def test_neighbors_on_a_grid(spark):
    rows, columns = [-2.5, 0, 40, 41], ["low", "mid", "top"]
    sp = lambda r, c: {"site": {"row": rows[r], "column": columns[c]}, "year": 7}
    i = lambda r, c: calc_id(sp(r, c)) if 0 <= r < 4 and 0 <= c < 3 else None
    p = Project.of_statepoints(spark, [sp(r, c) for r in range(4) for c in range(3)])
    want = {(i(r, c), "site.row"): (i(r - 1, c), i(r + 1, c)) for r in range(4) for c in range(3)}
    want |= {(i(r, c), "site.column"): (i(r, c - 1), i(r, c + 1)) for r in range(4) for c in range(3)}
    assert pairs(neighbors(p.leaves())) == want
    assert len(pairs(neighbors(p.leaves(), keep_constant=True))) == 36


def test_neighbors_ignoring_a_dependent_key(spark):
    sps = {n: {"atoms": n, "volume": n / 0.8} for n in (10, 40, 160, 640)}
    p, i = Project.of_statepoints(spark, sps.values()), {n: calc_id(sp) for n, sp in sps.items()}
    assert all(v == (None, None) for v in pairs(neighbors(p.leaves())).values())
    order = [None, *i.values(), None]
    assert pairs(neighbors(p.leaves(), ignore=["volume"])) == {(order[k], "atoms"): (order[k - 1], order[k + 1]) for k in range(1, 5)}
    with pytest.raises(ValueError):
        neighbors(Project.of_statepoints(spark, [{"u": u, "v": v} for u in (3, 5) for v in "st"]).leaves(), ignore=["v"])
    with pytest.warns(RuntimeWarning):
        neighbors(p.leaves(), ignore=["nothing"])


def test_groups_of_keys_that_a_table_lacks(spark):
    p = Project.of_table(spark.createDataFrame([("1", 5), ("2", None)], "job_id string, x int"), ["x"])
    assert list(p.groupby("zz")) == [] and [(k, g.count()) for k, g in p.groupby("zz", default=7)] == [(7, 2)]


def test_groups_and_filters_tell_large_integers_apart(spark):
    values = [2**53, 2**53 + 1, 2**60, 2**60 + 1, float(2**60), 10**25, -(2**60) - 1, 3]
    for p in (Project.of_statepoints(spark, [{"v": v} for v in values]), Project.of_table(spark.createDataFrame([(str(i), v) for i, v in enumerate(values) if isinstance(v, int) and abs(v) < 1 << 63], "job_id string, v long"), ["v"])):
        known = values if not p.typed else [v for v in values if isinstance(v, int) and abs(v) < 1 << 63]
        assert sorted(k for k, _ in p.groupby("v")) == sorted(set(known))
        for arg in (2**53, 2**53 + 1, 2**60, 2**60 + 1, float(2**60), 3, 2.5, 10**25, float("inf"), -(2**60)):
            for op, test in (("$eq", lambda a, b: a == b), ("$gt", lambda a, b: a > b), ("$gte", lambda a, b: a >= b), ("$lt", lambda a, b: a < b), ("$lte", lambda a, b: a <= b), ("$ne", lambda a, b: a != b)):
                assert len(p.find_jobs({f"v.{op}": arg})) == sum(test(v, arg) for v in known), (p.typed, op, arg)
            assert len(p.find_jobs({"v.$in": [arg, "x"]})) == sum(v == arg for v in known)


def test_patterns_are_pythons(spark):
    texts = ["ab\n", "ab", "a\rb", "a\u2028b", "é1", "x.y", "A-B"]
    p = Project.of_statepoints(spark, [{"t": t} for t in texts])
    import re

    for pattern in ("ab$", "a.b", r"\w\d", r"^\w+$", "[a-z]b", r"x\.y", "(?i)a-b", "a|x", r"\Aab\Z", "(?P<n>a)(?P=n)?b"):
        assert len(p.find_jobs({"t.$regex": pattern})) == sum(bool(re.search(pattern, t)) for t in texts), pattern


def test_neighbors_across_types(spark):
    in_order = {"NoneType": [None], "bool": [False, True], "float": [1.5, 61.25], "int": [-7, 60], "str": ["", "-7", "Zug", "ab"], "tuple": [[0, 5], [2]]}  # by the names of types
    order = [v for group in in_order.values() for v in group]
    p = Project.of_statepoints(spark, [{"setting": v} for v in reversed(order)])
    got = pairs(neighbors(p.leaves()))
    ids = [calc_id({"setting": v}) for v in order]
    for k, j in enumerate(ids):
        assert got[(j, "setting")] == (ids[k - 1] if k else None, ids[k + 1] if k + 1 < len(ids) else None)
