"""Schemas: which keys the state points have, with which types and values."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable
from pprint import pformat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.leaves import nest, written


class ProjectSchema:
    """values: one row per different (path, type, json) with num, str, and n_jobs that have it."""

    def __init__(self, values: DataFrame):
        self.values = values

    @classmethod
    def detect(cls, leaves: DataFrame, n_jobs: int | None = None, exclude_const: bool = False, subset: DataFrame | Iterable[str] | None = None) -> ProjectSchema:
        """From leaves of state points; subset: ids to look at. With exclude_const, keys that all jobs have with one value are left out."""
        if subset is not None:
            if not isinstance(subset, DataFrame):
                subset = leaves.sparkSession.createDataFrame([(i,) for i in subset], "job_id string")
            leaves = leaves.join(subset.select("job_id").distinct(), "job_id", "left_semi")
        values = leaves.groupBy("path", "type", "num", "str", "json", "same").agg(F.count_distinct("job_id").alias("n_jobs"))
        if exclude_const:
            n = leaves.select("job_id").distinct().count() if n_jobs is None else n_jobs
            per = values.groupBy("path").agg(F.count_distinct("same").alias("nv"), F.sum("n_jobs").alias("nj"))
            values = values.join(per.where((F.col("nv") > 1) | (F.col("nj") < n)).select("path"), "path", "left_semi")
        return cls(values)

    def summary(self) -> DataFrame:
        """(path, type, n_values)."""
        return self.values.where("type <> 'dict'").groupBy("path", "type").agg(F.count_distinct("json").alias("n_values"))

    def ranges(self, most: int = 5) -> DataFrame:
        """The first and last values of each (path, type), at most `most`, with their place and the number of all.

        Values are sorted across partitions and numbered there; each partition's share of a (path,
        type) is added up, so a key with a value of its own in every job is spread over the cluster.
        """
        v = self.values.where("type <> 'dict'").select("path", "type", "num", "str", "json").distinct()
        flat = F.when(F.col("type") == "tuple", F.try_variant_get(F.try_parse_json("json"), "$", "array<double>"))
        keys = ["path", "type", "num", "str", "flat", "json"]
        n = v.sparkSession.sparkContext.defaultParallelism
        laid = written(v.withColumn("flat", flat).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
        share = laid.groupBy("part", "path", "type").agg(F.count("*").alias("c"))
        before = Window.partitionBy("path", "type").orderBy("part")  # one row per partition
        every = Window.partitionBy("path", "type")
        share = share.select("part", "path", "type", F.coalesce(F.sum("c").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(every).alias("n"))
        within = F.row_number().over(Window.partitionBy("part", "path", "type").orderBy(*keys[2:]))
        out = laid.withColumn("within", within).join(share, ["part", "path", "type"]).withColumn("place", (F.col("within") + F.col("before")).cast("int"))
        return out.where((F.col("n") <= most) | (F.col("place") <= most - 2) | (F.col("place") > F.col("n") - 2)).select("path", "type", "json", "place", "n")

    def flat_schema(self) -> dict[str, tuple[str, ...]]:
        """Keys in order, each with the names of its types in order."""
        found: dict[str, tuple[str, ...]] = {}
        for r in self.values.select("path", "type").distinct().orderBy("path", "type").toLocalIterator():  # one row per key and type
            found[r[0]] = (*found.get(r[0], ()), r[1])
        return found

    def __repr__(self) -> str:
        return f"{type(self).__name__}(<{len(self)} keys>)"

    def _repr_html_(self) -> str:
        return f"<pre>{html.escape(self.format())}</pre>"

    def __len__(self) -> int:
        return self.values.select("path").distinct().count()

    def keys(self) -> list[str]:
        return sorted(r[0] for r in self.values.select("path").distinct().collect())

    def __iter__(self):
        return iter(self.keys())

    def __contains__(self, key: str) -> bool:
        return bool(self.values.where(F.col("path") == key).take(1))

    def __getitem__(self, key: str) -> dict[str, set]:
        found: dict[str, set] = {}
        for r in self.values.where(F.col("path") == key).select("type", "json").distinct().toLocalIterator():
            found.setdefault(r[0], set()).add(_shown(json.loads(r[1])))
        if not found:
            raise KeyError(key)
        return found

    def difference(self, other: ProjectSchema, ignore_values: bool = False) -> DataFrame:
        """(path): keys that other lacks or, unless ignore_values, has with other values."""
        mine, theirs = (s.values.select("path", "type", "same").distinct() for s in (self, other))
        missing = mine.select("path").distinct().join(theirs.select("path").distinct(), "path", "left_anti")
        if ignore_values:
            return missing
        both = mine.join(theirs.select("path").distinct(), "path", "left_semi")
        there = theirs.join(mine.select("path").distinct(), "path", "left_semi")
        return missing.union(both.exceptAll(there).union(there.exceptAll(both)).select("path")).distinct()

    def format(self, depth: int = 0, precision: int | None = None, max_num_range: int = 5) -> str:
        texts: dict[str, dict[str, list]] = {}
        for r in self.ranges(max_num_range).orderBy("path", "type", "place").collect():  # at most max_num_range rows per key and type
            texts.setdefault(r["path"], {}).setdefault(r["type"], []).append((_shown(json.loads(r["json"])), r["n"]))
        show = lambda x: str(round(x, precision)) if precision is not None and isinstance(x, (int, float)) else str(x)
        out = {}
        for path, types in texts.items():
            parts = []
            for kind, values in types.items():
                n = values[0][1]
                shown = [show(v) for v, _ in values]
                if n > max_num_range:
                    shown.insert(max_num_range - 2, "...")
                parts.append(f"{kind}([{', '.join(shown)}], {n})")
            out[path] = ", ".join(parts)
        if depth > 0:
            return pformat(nest(out), depth=depth)
        return "\n".join(["{", *(f" '{k}': '{v}'," for k, v in sorted(out.items())), "}"])

    __str__ = format


def _shown(v):
    return tuple(_shown(x) for x in v) if isinstance(v, list) else v
