"""Linked views with many links."""

import os

from tessera.operators.views import create_linked_view


def links(view):
    return {os.path.relpath(os.path.join(d, n), view): os.path.basename(os.path.realpath(os.path.join(d, n))) for d, dirs, files in os.walk(view) for n in dirs + files if os.path.islink(os.path.join(d, n))}


def test_tasks_make_change_and_remove_links(spark, tmp_path):
    work, view = tmp_path / "workspace", str(tmp_path / "view")
    ids = [f"{i:032x}" for i in range(1200)]
    for i in ids:
        (work / i).mkdir(parents=True)
    frame = lambda paths: spark.createDataFrame([(i, p) for p, i in paths.items()], "job_id string, path string")
    first = {f"all/k/{k}": i for k, i in enumerate(ids)}  # one folder holds them all
    create_linked_view(frame(first), str(work), view)
    assert links(view) == {f"{p}/job": i for p, i in first.items()}
    # a third stays, a third leads elsewhere, a third goes; others are new
    second = {f"all/k/{k}": i if k < 400 else ids[k + 400] for k, i in enumerate(ids[:800])} | {f"new/{k}/x": ids[k] for k in range(400, 500)}
    plan = create_linked_view(frame(second), str(work), view)
    assert {r[0]: r[1] for r in plan.groupBy("action").count().collect()} == {"update": 400, "obsolete": 400, "new": 100}
    assert links(view) == {f"{p}/job": i for p, i in second.items()}
    assert all(dirs or files for _, dirs, files in os.walk(view)) and not any(n.endswith(".part") for _, dirs, files in os.walk(view) for n in dirs + files)
    assert create_linked_view(frame(second), str(work), view).count() == 0
    create_linked_view(frame(second).where("false"), str(work), view)
    assert os.listdir(view) == []
