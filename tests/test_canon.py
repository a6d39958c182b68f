import numpy as np
import pytest

from tessera.errors import InvalidKeyError, KeyTypeError
from tessera.functions import canon
from tessera.functions.leaves import flatten, leaves, nest

#: Ids of state points.
GOLDEN = {
    "42b7b4f2921788ea14dac5566e6f06d0": {"a": 1},
    "0ba6c5a46111313f11c41a6642520451": {"b": 1.0},
    "33cf9999de25a715a56339c6c1b28b41": {"d": True},
    "80fa45716dd3b83fa970877489beb42e": {"c": "1.0"},
    "99914b932bd37a50b983c5e7c90ae93b": {},
    "c4af2b26f1fd256d70799ad3ce3bdad0": {"constant": 42, "diff1": 0, "diff2": 1},
}


@pytest.mark.parametrize("want,sp", GOLDEN.items())
def test_golden_ids(want, sp):
    assert canon.calc_id(sp) == want


def test_ids_in_spark(spark):
    import json

    df = spark.createDataFrame([(k, json.dumps(v, separators=(",", ":"))) for k, v in GOLDEN.items()] + [(None, "{"), (None, None)], "want string, sp string")
    assert df.where(~canon.job_id("sp").eqNullSafe(df["want"])).count() == 0


def test_order_lists_and_numbers():
    assert canon.calc_id({"a": 1, "b": [1, 2]}) == canon.calc_id({"b": (1, 2), "a": 1})
    assert len({canon.calc_id({"a": v}) for v in (1, 1.0, True, "1")}) == 4
    assert canon.calc_id({"a": np.int64(1), "b": np.arange(3)}) == canon.calc_id({"a": 1, "b": [0, 1, 2]})


def test_wrong_keys():
    with pytest.raises(KeyTypeError):
        canon.calc_id({1: 2})
    with pytest.raises(InvalidKeyError):
        canon.calc_id({"a.b": 2})


def test_typed_json_is_canonical(spark):
    import json

    from pyspark.sql import functions as F

    df = spark.createDataFrame([("x", 3), ('q"u', -1)], "b string, a int")
    for r in df.select("*", canon.typed_json(a=F.col("a"), b=F.col("b")).alias("j")).collect():
        assert r["j"] == json.dumps({"a": r["a"], "b": r["b"]}, sort_keys=True)


def test_flatten_and_nest():
    v = {"a": 1, "b": {"c": {"d": [1, {"x": 2}]}, "e": {}}, "f": None}
    assert flatten(v) == {"a": 1, "b.c.d": [1, {"x": 2}], "b.e": {}, "f": None}
    assert nest(flatten(v)) == v and flatten({}) == {}


def test_leaves(spark):
    df = spark.createDataFrame([("j", '{"a": 1.0, "b": {"c": true}, "d": [1, 1.0], "e": 123456789012345678901}'), ("k", None), ("l", "[1]"), ("m", "{")], "job_id string, sp_json string")
    rows = {r["path"]: r for r in leaves(df, "sp_json", "sp").collect()}
    assert {p: r["type"] for p, r in rows.items()} == {"a": "float", "b.c": "bool", "d": "tuple", "e": "int"}
    assert rows["a"]["same"] == "1" and rows["b.c"]["same"] == "1" and rows["d"]["same"] == "[1, 1]" and int(rows["e"]["big"]) == 123456789012345678901
