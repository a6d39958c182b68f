"""Paths from state points, state points from paths, and checks of sets of paths."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StatepointParsingError
from ..functions.leaves import written

#: What a field of each type looks like in a path.
FIELD_TYPES = {
    "str": r"\w+",
    "int": r"[+-]?[0-9]+",
    "float": r"[+-]?([0-9]*[\.])?[0-9]+",
    "bool": r"\w+",
}
SPARK_TYPES = {"str": "string", "int": "bigint", "float": "double"}
#: What automatic paths need of leaves.
PATH_COLUMNS = ("job_id", "path", "type", "str", "json", "same")
#: So many varying keys at most are looked up in each job's row; more are joined.
MOST_KEYS = 256
FIELD = re.compile(r"\{([.\w]+)(?::([a-z]+))?\}")


def parse_columns(template: str, path: Column) -> dict[str, Column]:
    """Columns for the {key:type} fields of a template, null where the path does not fit it. Type str by default."""
    pattern, keys, at = "", [], 0
    for m in FIELD.finditer(template):
        kind = m[2] or "str"
        if kind not in FIELD_TYPES:
            raise ValueError(f"unknown type {kind!r}")
        pattern += re.escape(template[at : m.start()]) + f"({FIELD_TYPES[kind].replace('(', '(?:')})"
        keys.append((m[1], kind))
        at = m.end()
    pattern = f"^{pattern}{re.escape(template[at:])}$"
    out = {}
    for k, (key, kind) in enumerate(keys, 1):
        text = F.when(path.rlike(pattern), F.regexp_extract(path, pattern, k))
        if kind == "bool":
            out[key] = F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False).when(text.isNotNull(), text != "")
        else:
            out[key] = text.cast(SPARK_TYPES[kind]) if kind == "str" else text.try_cast(SPARK_TYPES[kind])
    return out


def template_path(template: str, columns: Mapping[str, str], auto: Column | None = None, auto_keys: Mapping[str, Column] | None = None) -> Column:
    """A path from a template: {key}, {job.sp.key}, {job.id} and {{auto}} (the automatic path of the keys not named)."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{auto(?::([^}]*))?\}\}|\{([^{}]+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        if m[2] is None:
            if auto is None:
                raise ValueError("no automatic path here")
            parts.append(F.regexp_replace(auto, "/", m[1]) if m[1] else auto)
        else:
            key = m[2].removeprefix("job.sp.").removeprefix("job.statepoint.")
            if key in ("job.id", "job"):
                parts.append(F.col("job_id"))
            elif key in columns:
                parts.append(F.col(columns[key]).cast("string"))
            else:
                raise KeyError(f"unknown key {key!r}")
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def template_keys(template: str) -> list[str]:
    return [m.removeprefix("job.sp.").removeprefix("job.statepoint.") for m in re.findall(r"(?<!\{)\{([^{}]+)\}(?!\})", template)]


def automatic_paths(leaves: DataFrame, n_jobs: int | None = None, exclude: Iterable[str] = (), sep: str = "/") -> DataFrame:
    """(job_id, path): key/value pairs of the keys that vary, those with fewest values first. One job: empty path.

    A job that has none of those keys raises StatepointParsingError; values are shown as Python shows them.
    """
    shown = F.when(F.col("type") == "str", F.col("str")).when(F.col("type") == "bool", F.initcap("json")).when(F.col("type") == "NoneType", "None").otherwise(F.col("json"))
    piece = F.when(F.col("type") != "dict", F.concat_ws(sep, "path", shown))
    # one row a job, stored: leaves are made once, and what follows moves no row of a job again
    jobs = written(leaves.select("job_id", F.struct("path", F.md5("same").alias("value"), piece.alias("piece")).alias("leaf")).groupBy("job_id").agg(F.collect_set("leaf").alias("leaves")))
    n = jobs.count() if n_jobs is None else n_jobs
    if n <= 1:
        return jobs.select("job_id", F.lit("").alias("path"))
    each = jobs.select(F.explode("leaves").alias("leaf")).groupBy("leaf.path", "leaf.value").agg(F.count("*").alias("n"))
    per = each.groupBy("path").agg(F.count("*").alias("nv"), F.sum("n").alias("nj")).where((F.col("nv") > 1) | (F.col("nj") < n))
    per = written(per.where(~F.col("path").isin(*exclude)) if list(exclude) else per)
    if per.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        order = per.agg(F.transform(F.array_sort(F.collect_list(F.struct("nv", "path"))), lambda k: k["path"]).alias("order"))
        place = lambda leaf: F.array_position("order", leaf["path"])
        chosen = F.filter("leaves", lambda leaf: leaf["piece"].isNotNull() & (place(leaf) > 0))
        pieces = F.transform(F.array_sort(F.transform(chosen, lambda leaf: F.struct(place(leaf).alias("at"), leaf["piece"].alias("piece")))), lambda x: x["piece"])
        paths = jobs.crossJoin(F.broadcast(order)).select("job_id", F.when(F.size(pieces) > 0, F.array_join(pieces, sep)).alias("path"))
        lost = paths.where("path is null").select("job_id").take(1)
    else:
        rows = jobs.select("job_id", F.explode("leaves").alias("leaf")).where("leaf.piece is not null").select("job_id", "leaf.path", "leaf.piece")
        paths = rows.join(per, "path").groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nv", "path", "piece"))), lambda e: e.piece), sep).alias("path"))
        lost = jobs.select("job_id").join(paths, "job_id", "left_anti").take(1)
    if lost:
        raise StatepointParsingError(f"no path for job {lost[0][0]}: its keys are in no other job; give a path")
    return paths


def duplicate_paths(paths: DataFrame) -> DataFrame:
    """(path, n) of paths that several jobs have."""
    return paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def nested_paths(paths: DataFrame) -> DataFrame:
    """(path) of jobs that lie inside a path that is another job's: an equi-join on all leading folders."""
    heads = paths.select("path", F.explode(F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("head")).where("head <> path")
    return heads.join(paths.select(F.col("path").alias("head")).distinct(), "head", "left_semi").select("path").distinct()


def check_paths(paths: DataFrame) -> None:
    for what, found in (("several jobs have", duplicate_paths(paths)), ("inside another job's path lies", nested_paths(paths))):
        rows = found.take(1)
        if rows:
            raise RuntimeError(f"{what} path {rows[0]['path']}")
