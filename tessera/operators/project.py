"""Projects of jobs as DataFrames, cursors over them, grouping and export to columns."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DestinationExistsError, JobsCorruptedError
from ..functions import canon
from ..functions.leaves import leaves, nested_json
from ..functions.shipping import ship
from ..plans.fields import NUMBERS, TypedFields, VariantFields
from ..plans.filters import compile_filter, read_filter
from .neighbors import adjacent

JOBS = "job_id string, sp_json string, doc_json string"


class Project:
    """An immutable table of jobs. Changing operations return a new project.

    Variant projects have job_id, sp_json, doc_json and the VARIANT columns sp and doc. Typed
    projects keep a table's own columns under the names of keys; a null is a missing key.
    """

    def __init__(self, jobs: DataFrame, fields: Any, document: Mapping | None = None):
        self.jobs, self.fields, self.document = jobs, fields, dict(document or {})

    # ---- making -------------------------------------------------------------------------

    @classmethod
    def of_json(cls, jobs: DataFrame, document: Mapping | None = None) -> Project:
        """From (job_id, sp_json, doc_json); texts are brought to canonical form."""
        j = jobs.select("job_id", canon.canonical_json("sp_json").alias("sp_json"), canon.canonical_json("doc_json").alias("doc_json"))
        return cls.of_canonical(j, document)

    @classmethod
    def of_canonical(cls, jobs: DataFrame, document: Mapping | None = None) -> Project:
        return cls(jobs.withColumns({"sp": F.try_parse_json("sp_json"), "doc": F.try_parse_json("doc_json")}), VariantFields(), document)

    @classmethod
    def of_statepoints(cls, spark: SparkSession, statepoints: Iterable[Mapping], documents: Iterable[Mapping | None] | None = None) -> Project:
        """From Python mappings; equal state points are one job."""
        rows: dict[str, tuple] = {}
        sps = list(statepoints)
        for sp, doc in zip(sps, documents if documents is not None else [None] * len(sps)):
            rows.setdefault(canon.calc_id(sp), (canon.canonical(sp), None if doc is None else canon.canonical(doc)))
        return cls.of_canonical(spark.createDataFrame([(k, *v) for k, v in rows.items()], JOBS))

    @classmethod
    def of_table(cls, df: DataFrame, sp: Mapping[str, str] | Iterable[str], doc: Mapping[str, str] | Iterable[str] = (), job_id: Column | str | None = None) -> Project:
        """From a typed table: columns named as state point and document keys. Filters push down to its source."""
        named = lambda x: dict(x) if isinstance(x, Mapping) else {c: c for c in x}
        columns = {f"sp.{k}": c for k, c in named(sp).items()} | {f"doc.{k}": c for k, c in named(doc).items()}
        if job_id is not None:
            df = df.withColumn("job_id", F.col(job_id).cast("string") if isinstance(job_id, str) else job_id.cast("string"))
        return cls(df, TypedFields(columns, df.schema, job_id if isinstance(job_id, str) else None))

    @property
    def typed(self) -> bool:
        return isinstance(self.fields, TypedFields)

    # ---- looking --------------------------------------------------------------------------

    def find_jobs(self, filter: Any = None, strict: bool = False) -> JobsCursor:
        return JobsCursor(self, filter, strict)

    def __iter__(self) -> Iterator[str]:
        return iter(self.find_jobs())

    def __len__(self) -> int:
        return self.jobs.select("job_id").count()

    def __contains__(self, job_id: str) -> bool:
        return bool(self.jobs.where(F.col("job_id") == job_id).select("job_id").take(1))

    def open_job(self, statepoint: Mapping | None = None, id: str | None = None) -> JobsCursor:
        """By state point (never fails) or by id or the unique beginning of one."""
        if (statepoint is None) == (id is None):
            raise ValueError("give a state point or an id")
        if statepoint is not None:
            return JobsCursor(self, {"_id": canon.calc_id(statepoint)})
        found = [r[0] for r in self.jobs.where(F.col("job_id").startswith(id)).select("job_id").take(2)]
        if not found:
            raise KeyError(id)
        if len(found) > 1:
            raise LookupError(f"{id} is the beginning of several ids")
        return JobsCursor(self, {"_id": found[0]})

    def leaves(self, ns: str = "sp", columns: tuple[str, ...] | None = None) -> DataFrame:
        return leaves(self.jobs, f"{ns}_json", ns, columns)

    def groupby(self, key: Any = None, default: Any = None) -> Groups:
        return self.find_jobs().groupby(key, default)

    def to_dataframe(self, **kw) -> DataFrame:
        return self.find_jobs().to_dataframe(**kw)

    def suggestions(self, id: str, n: int = 3) -> DataFrame:
        """(job_id, distance) of the ids most like one that is not there."""
        return self.jobs.select("job_id", F.levenshtein("job_id", F.lit(id)).alias("distance")).orderBy("distance", "job_id").limit(n)

    def _repr_html_(self) -> str:
        return self.find_jobs()._repr_html_()

    def id_lengths(self) -> DataFrame:
        """(n): length of the shortest beginning of ids that tells all apart, at most 31.

        In sorted order the longest beginning that two ids share is one that neighbours share.
        """
        near = adjacent(self.jobs.select("job_id"), [], ["job_id"], ["job_id"])
        same = F.expr("aggregate(sequence(1, 31), 0, (n, k) -> if(n = k - 1 and length(prev_job_id) >= k and substring(job_id, k, 1) = substring(prev_job_id, k, 1), k, n))")
        return near.agg(F.coalesce(F.max(F.when(F.col("prev_job_id").isNotNull(), F.least(same, F.lit(30)) + 1)), F.lit(0)).cast("int").alias("n"))

    def min_len_unique_id(self) -> int:
        return self.id_lengths().first()[0]

    # ---- integrity ------------------------------------------------------------------------

    def corrupted(self) -> DataFrame:
        """Ids of jobs whose state point cannot be read or does not hash to the id."""
        made = canon.job_id("sp_json")
        return self.jobs.where(made.isNull() | (made != F.col("job_id"))).select("job_id")

    def check(self) -> None:
        found = [r[0] for r in self.corrupted().limit(1000).collect()]  # as many as a message can name
        if found:
            raise JobsCorruptedError(found)

    def repair(self, index: DataFrame) -> Project:
        """State points that are damaged come from index (job_id, sp_json); jobs under a wrong id get their own."""
        j = self.jobs.select("job_id", "sp_json", canon.canonical_json("sp_json").alias("own"), canon.canonical_json("doc_json").alias("doc_json"))
        j = j.join(index.select("job_id", F.col("sp_json").alias("known")), "job_id", "left")
        damaged = F.col("own").isNull() | ((F.md5("own") != F.col("job_id")) & F.col("known").isNotNull())
        # what is taken from the index is brought to canonical form, and only that
        j = j.select("job_id", F.when(~damaged, F.col("own")).alias("own"), canon.canonical_json(F.when(damaged, F.col("known"))).alias("known"), "doc_json")
        text = F.coalesce("own", "known")
        return Project.of_canonical(j.select(F.coalesce(F.md5(text), F.col("job_id")).alias("job_id"), text.alias("sp_json"), "doc_json").dropDuplicates(["job_id"]), self.document)

    # ---- changing -------------------------------------------------------------------------

    def as_json(self) -> Project:
        """A typed project as one of JSON: null columns are missing keys, ids are those of the state points. Equal state points are one job."""
        if not self.typed:
            return self

        def side(ns: str) -> Column:
            keys = {k.split(".", 1)[1]: F.col(c) for k, c in self.fields.columns.items() if k.startswith(f"{ns}.")}
            text = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":|\}$", "")
            return nested_json(F.array(*(F.struct(F.lit(k).alias("path"), F.when(c.isNotNull(), text(c)).alias("json")) for k, c in keys.items())).cast("array<struct<path:string,json:string>>"))

        rows = self.jobs.select(side("sp").alias("sp_json"), (side("doc") if any(k.startswith("doc.") for k in self.fields.columns) else F.lit(None).cast("string")).alias("doc_json"))
        rows = rows.groupBy("sp_json").agg(F.min("doc_json").alias("doc_json"))
        return Project.of_canonical(rows.select(F.md5("sp_json").alias("job_id"), "sp_json", "doc_json"), self.document)

    def _own_json(self) -> DataFrame:
        """The jobs with sp_json and doc_json, which typed projects do not have."""
        if self.typed:
            raise TypeError("a project of typed columns is read only: change its table, or make a project of JSON from it (as_json)")
        return self.jobs

    def _plain(self) -> DataFrame:
        return self._own_json().select("job_id", "sp_json", "doc_json")

    def insert(self, other: Project) -> Project:
        """Add the jobs that are not there yet."""
        return Project.of_canonical(self._plain().union(other._plain().join(self.jobs.select("job_id"), "job_id", "left_anti")), self.document)

    def clone(self, other: Project) -> Project:
        """Add jobs; none of them may be there."""
        both = other.jobs.join(self.jobs.select("job_id"), "job_id", "left_semi").select("job_id").take(1)
        if both:
            raise DestinationExistsError(both[0][0])
        return self.insert(other)

    def remove(self, filter: Any) -> Project:
        """Without the jobs that match; nothing happens if none does."""
        return Project(self.jobs.where(~compile_filter(filter, self.fields)), self.fields, self.document)

    def move(self, filter: Any, other: Project) -> tuple[Project, Project]:
        """(this without the matching jobs, other with them)."""
        chosen = Project(self.find_jobs(filter).df, self.fields)
        return self.remove(filter), other.clone(chosen)

    def statepoint_changes(self, change: Mapping, filter: Any = None, overwrite: bool = False) -> DataFrame:
        """(job_id, sp_json): the new state points of matching jobs. A key with another value there needs overwrite."""
        chosen = self._own_json().where(compile_filter(filter, self.fields))
        if not overwrite:
            same = compile_filter({"$and": [{"$or": [{k: {"$exists": False}}, {k: v}]} for k, v in change.items()]} if change else {}, self.fields)
            if chosen.where(~same).take(1):
                raise KeyError(f"other values are there: {sorted(change)}")
        return chosen.select("job_id", _changed(F.col("sp_json"), change).alias("sp_json"))

    def update_statepoints(self, change: Mapping, filter: Any = None, overwrite: bool = False) -> Project:
        """Set keys of matching jobs' state points; they get new ids. A key with another value there needs overwrite.

        Only the table changes; sources.changes.update_statepoints does the same to job folders.
        """
        new = self.statepoint_changes(change, filter, overwrite)
        j = self._plain().join(new.select("job_id", F.col("sp_json").alias("new")), "job_id", "left")
        j = j.select(F.coalesce(F.md5("new"), "job_id").alias("job_id"), F.coalesce("new", "sp_json").alias("sp_json"), "doc_json")
        clash = j.groupBy("job_id").agg(F.count("*").alias("n")).where("n > 1").take(1)
        if clash:
            raise DestinationExistsError(clash[0][0])
        return Project.of_canonical(j, self.document)

    def update_documents(self, change: Mapping, filter: Any = None, replace: bool = False) -> Project:
        """Set keys of matching jobs' documents, or replace those documents."""
        hit = compile_filter(filter, self.fields)
        new = F.lit(canon.canonical(change)) if replace else _changed(F.coalesce("doc_json", F.lit("{}")), change)
        return Project.of_canonical(self._own_json().select("job_id", "sp_json", F.when(hit, new).otherwise(F.col("doc_json")).alias("doc_json")), self.document)

    def clear(self, filter: Any = None) -> Project:
        """Empty the documents of matching jobs; state points stay."""
        return self.update_documents({}, filter, replace=True)


def _changed(column: Column, change: Mapping) -> Column:
    text = canon.canonical(change)

    def run(texts):
        import pyarrow as pa

        return pa.array([None if t is None else json.dumps({**json.loads(t), **json.loads(text)}, sort_keys=True) for t in texts.to_pylist()], pa.string())

    import pyarrow as pa

    ship()
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StringType())(column)


class JobsCursor:
    """The jobs that match a filter. Iteration and positions go by job_id."""

    def __init__(self, project: Project, filter: Any = None, strict: bool = False):
        self.project, self.filter, self.strict = project, read_filter(filter), strict
        self.df = project.jobs.where(compile_filter(self.filter, project.fields, strict, sure=False)) if self.filter else project.jobs

    def ids(self) -> DataFrame:
        return self.df.select("job_id")

    def __iter__(self) -> Iterator[str]:
        return (r[0] for r in self.ids().orderBy("job_id").toLocalIterator())

    def __len__(self) -> int:
        return self.ids().count()

    def __contains__(self, job_id: str) -> bool:
        return bool(self.ids().where(F.col("job_id") == job_id).take(1))

    def slice_ids(self, start: int | None = None, stop: int | None = None) -> DataFrame:
        """(job_id) from place start up to place stop, in the order of ids; negative places count from the end."""
        n = None if (start or 0) >= 0 and (stop is None or stop >= 0) else len(self)
        start = (start or 0) if n is None or (start or 0) >= 0 else max(0, n + start)
        stop = stop if n is None or stop is None or stop >= 0 else n + stop
        out = self.ids().orderBy("job_id").offset(start)
        return out if stop is None else out.limit(max(0, stop - start))

    def __getitem__(self, at: int | slice):
        """An id, or for a slice the list of its ids (slice_ids gives them as a table)."""
        ordered = self.ids().orderBy("job_id")
        if isinstance(at, slice):
            return [r[0] for r in itertools.islice(self.slice_ids(at.start, at.stop).toLocalIterator(), None, None, at.step or 1)]
        found = ordered.offset(at).limit(1).collect() if at >= 0 else self.ids().orderBy(F.desc("job_id")).offset(-at - 1).limit(1).collect()
        if not found:
            raise IndexError(at)
        return found[0][0]

    def _repr_html_(self, most: int = 100) -> str:
        """A table of up to 100 jobs, else their number."""
        n = len(self)
        return self.df.select(*(c for c in self.df.columns if c not in ("sp", "doc"))).limit(most).toPandas().to_html() if n <= most else f"{n} jobs"

    def __eq__(self, other) -> bool:
        return isinstance(other, JobsCursor) and self.project is other.project and self.filter == other.filter

    def __hash__(self) -> int:
        return id(self.project) ^ hash(repr(self.filter))

    def groupby(self, key: Any = None, default: Any = None) -> Groups:
        return Groups(self, key, default)

    def to_dataframe(self, sp_prefix: str = "sp.", doc_prefix: str = "doc.", usecols: Iterable[str] | Callable[[str], bool] | None = None, flatten: bool = False) -> DataFrame:
        """One row per job, one column per key. Jobs without any of the chosen columns are left out."""
        p = self.project
        if p.typed:
            names = {(sp_prefix if k.startswith("sp.") else doc_prefix) + k.split(".", 1)[1]: F.col(c) for k, c in p.fields.columns.items()}
        else:
            names = {}
            for ns, prefix in (("sp", sp_prefix), ("doc", doc_prefix)):
                kinds = leaves(self.df, f"{ns}_json", ns, ("path", "type")).groupBy("path").agg(F.collect_set("type").alias("types")).orderBy("path").collect()  # one row per key
                if flatten:
                    for path, types in kinds:
                        names[prefix + path] = self._column(f"{ns}.{path}", set(types))
                else:
                    tops: dict[str, set] = {}
                    for path, types in kinds:
                        tops.setdefault(path.split(".")[0], set()).update(types if "." not in path else ["dict"])
                    for top, types in tops.items():
                        names[prefix + top] = self._column(f"{ns}.{top}", types)
        chosen = [n for n in names if usecols is None or (usecols(n) if callable(usecols) else n in set(usecols))]
        out = self.df.select("job_id", *(names[n].alias(n) for n in chosen))
        some = F.lit(not chosen)
        for n in chosen:
            some = some | F.col(f"`{n}`").isNotNull()
        return out.where(some)

    def _column(self, key: str, types: set[str]) -> Column:
        f = self.project.fields.field(key)
        types = types - {"NoneType"}
        if types <= {"bool"}:
            return f.number.cast("boolean")
        if types <= {"int"}:
            return f.exact.cast("bigint") if types else f.json
        if types <= {"int", "float", "bool"}:
            return f.number
        return f.text if types == {"str"} else f.json


class Groups:
    """Jobs by key. key: a dotted name, several, None (each job) or a callable of (state point, document).

    Without default, jobs that lack a key are left out. Numbers that are equal are one group
    whatever their types. Several keys come as state point keys, then document keys.
    """

    def __init__(self, cursor: JobsCursor, key: Any, default: Any):
        self.cursor, self.default, self.callable = cursor, default, callable(key)
        project = cursor.project
        if self.callable:
            self.keys, self.df = ["key"], cursor.df.withColumn("key", _key_of(key))
            return
        names = [] if key is None else [key] if isinstance(key, str) else list(key)
        names = [k if k.split(".", 1)[0] in ("sp", "doc") else f"sp.{k}" for k in names]
        names.sort(key=lambda k: not k.startswith("sp."))
        self.single = isinstance(key, str) or key is None
        defaults = dict(zip(names, [default] if self.single else default)) if default is not None and names else {}
        df, self.keys = cursor.df, names or ["job_id"]
        for k in names:
            if project.typed:
                value = F.col(project.fields.columns[k]) if k in project.fields.columns else F.lit(None).cast("string" if k not in defaults or isinstance(defaults[k], str) else "double" if isinstance(defaults[k], float) else "bigint")
                value = F.coalesce(value, F.lit(defaults[k])) if k in defaults else value
            else:
                def shown(fields, k=k):
                    f = fields.field(k)
                    # doubles do not tell integers of 2**53 and more apart: their digits do
                    digits = F.when(F.abs(f.number) >= float(1 << 53), F.coalesce(f.exact.cast("string"), F.when(F.abs(f.number) < float(1 << 63), f.number.cast("bigint").cast("string")), f.number.cast("string")))
                    number = F.when(f.tag.isin(*NUMBERS), F.struct(F.lit("number").alias("kind"), f.number.alias("number"), digits.alias("text")))
                    return number.when(f.exists, F.struct(f.tag.alias("kind"), F.lit(None).cast("double").alias("number"), F.coalesce(f.text, f.json).alias("text")))

                value = project.fields.once(shown, [k.split(".", 1)[0]])
                if k in defaults:
                    d = defaults[k]
                    value = F.coalesce(value, F.struct(F.lit("number" if isinstance(d, (bool, int, float)) else "str" if isinstance(d, str) else "tuple").alias("kind"), F.lit(float(d) if isinstance(d, (bool, int, float)) else None).cast("double").alias("number"), F.lit(None if isinstance(d, (bool, int, float)) else d if isinstance(d, str) else json.dumps(d)).cast("string").alias("text")))
            df = df.withColumn(k, value)
            if k not in defaults:
                df = df.where(F.col(f"`{k}`").isNotNull())
        self.df = df

    def agg(self, *exprs: Column) -> DataFrame:
        """Aggregates per group."""
        return self.df.groupBy(*(F.col(f"`{k}`") for k in self.keys)).agg(*exprs)

    def counts(self) -> DataFrame:
        return self.agg(F.count("*").alias("n_jobs"))

    def __iter__(self) -> Iterator[tuple[Any, DataFrame]]:
        """(key, jobs of the group as a DataFrame), ordered by key; keys come one at a time, jobs are not gathered."""
        for row in self.counts().orderBy(*(F.col(f"`{k}`") for k in self.keys)).toLocalIterator():
            values = [row[k] for k in self.keys]
            hit = F.lit(True)
            for k, v in zip(self.keys, values):
                want = v if not isinstance(v, tuple) else F.struct(F.lit(v[0]).alias("kind"), F.lit(v[1]).cast("double").alias("number"), F.lit(v[2]).cast("string").alias("text"))
                hit = hit & F.col(f"`{k}`").eqNullSafe(want)
            shown = [((int(v[2]) if v[2] is not None and v[2].lstrip("-").isdigit() else v[1]) if v[0] == "number" else None if v[0] == "NoneType" else v[2]) if isinstance(v, tuple) else v for v in values]
            yield shown[0] if len(shown) == 1 else tuple(shown), self.df.where(hit)


def _key_of(function: Callable) -> Column:
    """A Python function of (state point, document) as JSON text."""

    def run(sps, docs):
        import pyarrow as pa

        return pa.array([json.dumps(function(json.loads(s), json.loads(d) if d is not None else {}), sort_keys=True) for s, d in zip(sps.to_pylist(), docs.to_pylist())], pa.string())

    import pyarrow as pa

    ship()
    run.__annotations__ = {"sps": pa.Array, "docs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StringType())("sp_json", "doc_json")
