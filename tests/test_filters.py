import itertools
import json
import math
import operator
import random
import re

import pytest

from tessera.operators.project import Project
from tessera.plans.filters import conditions, from_tokens, read_filter, uses_documents


OVENS = [{"temp": 2 * k if k % 3 else k / 2, "site": {"lab": "xyz"[k % 3]}} for k in range(61)]
TEMPS = [sp["temp"] for sp in OVENS]


@pytest.fixture(scope="module")
def ovens(spark):
    p = Project.of_statepoints(spark, OVENS)
    p.jobs.cache()
    return p


EXPRESSIONS = [
    ({"$eq": 14}, lambda t: t == 14), ({"$eq": 1.5}, lambda t: t == 1.5), ({"$ne": 14.0}, lambda t: t != 14), ({"$gt": 30}, lambda t: t > 30), ({"$gte": 28.5}, lambda t: t >= 28.5), ({"$lt": 7.5}, lambda t: t < 7.5), ({"$lte": 7.5}, lambda t: t <= 7.5),
    ({"$in": []}, lambda t: False), ({"$in": [4, 6.0, "x"]}, lambda t: t in (4, 6)), ({"$in": TEMPS}, lambda t: True), ({"$nin": []}, lambda t: True), ({"$nin": [4, 4.5]}, lambda t: t not in (4, 4.5)), ({"$nin": TEMPS}, lambda t: False),
    ({"$near": 50}, lambda t: math.isclose(t, 50)), ({"$near": [50, 0.2]}, lambda t: math.isclose(t, 50, rel_tol=0.2)), ({"$near": [20, 0.0, 3]}, lambda t: math.isclose(t, 20, rel_tol=0, abs_tol=3)), ({"$type": "int"}, lambda t: isinstance(t, int)),
    ({"$type": "float"}, lambda t: isinstance(t, float)), ({"$exists": True}, lambda t: True), ({"$exists": False}, lambda t: False), ({"$where": lambda v: v % 8 == 0}, lambda t: t % 8 == 0), ({"$gt": 11, "$lte": 29}, lambda t: 11 < t <= 29),
    ("warm", lambda t: False), (None, lambda t: False), ({"$regex": "1"}, lambda t: False), ({"$lt": "zz"}, lambda t: False),
]


@pytest.mark.parametrize("k", range(len(EXPRESSIONS)))
def test_expressions(ovens, k):
    expr, fits = EXPRESSIONS[k]
    n = sum(map(fits, TEMPS))
    assert len(ovens.find_jobs({"temp": expr})) == n
    assert len(ovens.find_jobs({"$not": {"temp": expr}})) == len(OVENS) - n


FILTERS = [
    (None, lambda t, lab: True), ({}, lambda t, lab: True), ("temp 14", lambda t, lab: t == 14), ([("temp", 14)], lambda t, lab: t == 14), ({"sp.temp": 14}, lambda t, lab: t == 14), ({"sp": {"site": {"lab": "y"}}}, lambda t, lab: lab == "y"), ({"b": 1}, lambda t, lab: False),
    ({"temp.$lt": 33}, lambda t, lab: t < 33), ({"sp.site.lab.$gte": "y"}, lambda t, lab: lab >= "y"), ({"temp.b": 1}, lambda t, lab: False), ({"$and": [{"temp.$gte": 10}, {"site.lab": "z"}]}, lambda t, lab: t >= 10 and lab == "z"),
    ({"$or": [{"temp": 3}, {"temp": 4.0}, {"site.lab": "x"}]}, lambda t, lab: t in (3, 4) or lab == "x"), ({"$not": {"$not": {"site.lab": "x"}}}, lambda t, lab: lab == "x"), ({"$not": {"doc.x": 1}}, lambda t, lab: True),
    ({"site.lab": "x", "$or": [{"temp.$lt": 9}, {"temp.$gt": 25}]}, lambda t, lab: lab == "x" and (t < 9 or t > 25)), ({"_id": "x"}, lambda t, lab: False),
]


@pytest.mark.parametrize("k", range(len(FILTERS)))
def test_filters(ovens, k):
    f, fits = FILTERS[k]
    assert len(ovens.find_jobs(f)) == sum(fits(sp["temp"], sp["site"]["lab"]) for sp in OVENS)


@pytest.mark.parametrize("f,error", [
    ({"a.$foo": 1}, KeyError), ({"a.$lt.b": 1}, KeyError), ({"a.$lt.$gt": 1}, KeyError), ({"$and": []}, ValueError), ({"$or": {"a": 1}}, ValueError), ({"a.$exists": 1}, ValueError), ({"a.$type": "dict"}, ValueError),
    ({"a.$near": [1, 2, 3, 4]}, ValueError), ({"a.$where": "lambda x: x"}, ValueError), (42, ValueError), ({"a": object()}, TypeError),
])
def test_wrong_filters_raise_before_any_job(ovens, f, error):
    with pytest.raises(error):
        ovens.find_jobs(f)


def test_strict_ordering_raises(spark):
    p = Project.of_statepoints(spark, [{"a": 1}, {"a": "x"}])
    assert len(p.find_jobs({"a.$lt": 5})) == 1
    with pytest.raises(Exception, match="cannot order"):
        len(p.find_jobs({"a.$lt": 5}, strict=True))


@pytest.mark.parametrize("tokens,want", [
    ([], None), (["a"], {"a": {"$exists": True}}), (["a", "!"], {"a": {"$exists": True}}), (["a", "0"], {"a": 0}), (["a", "1.5"], {"a": 1.5}), (["a", "true", "b", "null"], {"a": True, "b": None}),
    (["a", "/x.y/"], {"a": {"$regex": "x.y"}}), (['{"a": 1}'], {"a": 1}), (["a", '{"$lt": 4}'], {"a": {"$lt": 4}}), (["a", "[1, 2]"], {"a": [1, 2]}), (["a", "b", "c"], {"a": "b", "c": {"$exists": True}}),
])
def test_tokens(tokens, want):
    assert from_tokens(tokens) == want


def test_wrong_tokens():
    with pytest.raises(ValueError):
        from_tokens(['{"x": 1}', "2"])
    with pytest.raises(json.JSONDecodeError):
        from_tokens(['{"x": True}'])


def test_reading():
    assert list(conditions({"a.b": {"$lt": 1, "c": 2}, "doc.x": [1]})) == [("sp.a.b", "$lt", 1), ("sp.a.b.c", "$eq", 2), ("doc.x", "$eq", [1])]
    assert uses_documents({"$not": {"doc.a": 1}}) and not uses_documents({"a": 1, "$or": [{"b": 2}]})
    assert read_filter("a 1 b x") == {"a": 1, "b": "x"}


VALUES = [0, 1, 2, 0.0, 1.0, 1.5, -3, True, False, None, "", "1", "abc", "b", [], [1], [1.0], [True], [2, "a"], {"x": 1}, {}, 10**20, 1e20, 2**53 + 1]


def python_match(value, op, arg):
    """What a filter means, in Python: value is there (a missing key never gets here)."""
    mapping = isinstance(value, dict)
    if op == "$eq":
        return (value == arg if value == {} or arg == {} else False) if mapping else value == arg
    if op == "$ne":
        return not python_match(value, "$eq", arg)
    if op in ("$in", "$nin"):
        return any(python_match(value, "$eq", a) for a in arg) == (op == "$in")
    if op == "$type":
        return not mapping and {"int": isinstance(value, int), "float": isinstance(value, float), "bool": isinstance(value, bool), "str": isinstance(value, str), "list": isinstance(value, list), "null": value is None}[arg]
    if op == "$regex":
        return isinstance(value, str) and re.search(arg, value) is not None
    if op == "$near":
        return isinstance(value, (int, float)) and math.isclose(value, arg)
    numbers = isinstance(value, (int, float)) and isinstance(arg, (int, float))
    texts = isinstance(value, str) and isinstance(arg, str)
    if not (numbers or texts):
        return False
    return {"$lt": operator.lt, "$lte": operator.le, "$gt": operator.gt, "$gte": operator.ge}[op](value, arg)


def test_against_python_on_mixed_values(spark):
    p = Project.of_statepoints(spark, [{"a": v, "i": i} for i, v in enumerate(VALUES)] + [{"i": len(VALUES)}])
    p.jobs.cache()
    r = random.Random(3)
    cases = [("$eq", v) for v in VALUES if v != {"x": 1}] + [("$ne", v) for v in (0, 1.0, "1", None, [1])] + [(op, v) for op, v in itertools.product(("$lt", "$lte", "$gt", "$gte"), (1, 0.5, "ab"))]
    cases += [("$type", t) for t in ("int", "float", "bool", "str", "list", "null")] + [("$regex", "^a|1$"), ("$near", 1), ("$in", [1, "abc", None]), ("$nin", [True, [1]]), ("$in", r.sample([0, 1.5, "b", -3], 3))]
    from pyspark.sql import functions as F

    from tessera.plans.filters import compile_filter

    flags = p.jobs.select(F.try_variant_get("sp", "$.i", "int").alias("i"), *(compile_filter({"a": {op: v} if op != "$eq" or v != {} else v}, p.fields).alias(f"c{k}") for k, (op, v) in enumerate(cases))).collect()
    for row in flags:
        for k, (op, arg) in enumerate(cases):
            want = row["i"] < len(VALUES) and python_match(VALUES[row["i"]], op, arg)
            assert row[f"c{k}"] == want, (VALUES[row["i"]] if row["i"] < len(VALUES) else "missing", op, arg)


def test_typed_filters_reach_the_scan(spark):
    from tessera.queries import orders

    plan = orders(spark, "/root/testdata/sf0.001").find_jobs({"priority": "1-URGENT", "price.$gt": 10}).df.select("job_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "GreaterThan(o_totalprice,10.0)" in plan and "o_orderstatus" not in plan.split("ReadSchema")[-1]
