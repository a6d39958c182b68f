"""Documents and paths go through Python once."""

import re

from pyspark.sql import functions as F

from tessera.operators.project import Project
from tessera.operators.sync import DocSync, document_plan, sync_projects
from tessera.sources import paths


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_meet_in_one_join_and_one_pass(spark):
    a, b = (Project.of_canonical(spark.createDataFrame([("1", "{}", x), ("2", "{}", None)], "job_id string, sp_json string, doc_json string")) for x in ('{"n": {"a": 3}}', '{"n": {"a": 1, "b": 2}, "k": 1}'))
    for how in (DocSync.UPDATE, DocSync.COPY, DocSync.NO_SYNC, DocSync.ByKey("n"), DocSync.ByKey(lambda k: False)):
        plan = plan_of(document_plan(a.jobs, b.jobs, how))
        assert len(re.findall("MapInArrow", plan)) == 1 and len(re.findall("Join", plan)) == 1
        plan = plan_of(sync_projects(a, b, how, check_schema=False).jobs.select("job_id", "sp_json", "doc_json"))
        assert len(re.findall("ArrowEvalPython", plan)) == 1 and len(re.findall("Join", plan)) == 1


def test_automatic_paths_make_leaves_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    p = Project.of_statepoints(spark, [{"a": i, "b": i % 2, "c": 1} for i in range(8)])
    for most in (256, 0):  # looked up in each row, or joined
        monkeypatch.setattr(paths, "MOST_KEYS", most)
        made.value = 0
        leaves = p.leaves()
        got = paths.automatic_paths(leaves.mapInArrow(counted, leaves.schema)).select("path").collect()
        assert sorted(r[0] for r in got) == [f"b/{i % 2}/a/{i}" for i in sorted(range(8), key=lambda i: (i % 2, i))]
        assert made.value == 24
