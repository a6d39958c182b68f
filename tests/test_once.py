"""What is made of a table is made once for each row, however many views of it a condition names."""

import re

from pyspark.sql import functions as F

from tessera.functions import canon
from tessera.operators.project import Project

JOBS = [{"a": 1, "b": "x"}, {"a": 2.5}, {"a": True}, {"a": None}, {"a": (1 << 53) + 1}, {"a": "1"}, {"b": "y"}, {"a": 10**20}]


def derived(spark) -> Project:
    rows = spark.createDataFrame([(i, canon.canonical(sp)) for i, sp in enumerate(JOBS)], "i long, t string")
    return Project.of_canonical(rows.select(F.col("i").cast("string").alias("job_id"), F.concat("t", F.lit("")).alias("sp_json"), F.lit(None).cast("string").alias("doc_json")))


def parses(df) -> list[int]:
    """How often each operator of the plan parses JSON."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [len(re.findall("parseJson", line)) for line in plan.splitlines()]


def test_filters_and_groups_parse_once(spark):
    p = derived(spark)
    for f in ({"a": {"$gte": 1, "$lt": 3}}, {"a.$gt": 1 << 53}, {"$or": [{"a.$lt": 2}, {"b": "y"}], "a.$exists": True}, {"$not": {"a.$type": "int"}}):
        assert max(parses(p.find_jobs(f).df.select("job_id"))) == 1, f
    assert max(parses(p.groupby("a").counts())) <= 2  # the key and that it is there


def test_filters_and_groups_find_what_they_found(spark):
    p = derived(spark)
    found = lambda f: sorted(p.find_jobs(f))
    assert found({"a": {"$gte": 1, "$lt": 3}}) == ["0", "1", "2"] and found({"a.$gt": 1 << 53}) == ["4", "7"]
    assert found({"$or": [{"a.$lt": 2}, {"b": "y"}]}) == ["0", "2", "6"] and found({"$not": {"a.$type": "int"}}) == ["1", "3", "5", "6"]
    assert found({"_id": "6", "b": "y"}) == ["6"] and found({"a": 1}) == ["0", "2"] and found({"a.$ne": 1}) == ["1", "3", "4", "5", "7"]
    assert sorted((r["sp.a"]["kind"], r["sp.a"]["text"], r["n_jobs"]) for r in p.groupby("a").counts().collect() if r["sp.a"]["text"]) == [("NoneType", "null", 1), ("number", str(10**20), 1), ("number", str((1 << 53) + 1), 1), ("str", "1", 1)]
