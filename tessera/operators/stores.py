"""Key-value and array stores of projects and jobs: a log of Parquet rows in a folder of the project or job."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidKeyError, StoreAlreadyOpenError, StoreClosedError
from ..functions.leaves import working_folder
from ..functions.shipping import ship
from .commits import Commits, committed

#: kind mark: the key at path was set or deleted in this version, so older rows at or below it do not count.
STORES = "owner string, store string, path string, kind string, dtype string, shape array<int>, text string, bin binary, version long"
FIELDS = ("path", "kind", "dtype", "shape", "text", "bin")
FOLDER = ".stores"


def entries(value: Any, path: str = "") -> list[tuple]:
    """(path, kind, dtype, shape, text, bin) of a value; mappings become one entry per leaf. Arrays keep their bytes, frames their Arrow form."""
    if isinstance(value, Mapping):
        out = []
        for k, v in value.items():
            if "." in k:
                raise InvalidKeyError(k)
            out += entries(v, f"{path}/{k}".lstrip("/"))
        return out or [(path, "group", None, None, None, None)]
    if value is None:
        return [(path, "none", None, None, None, None)]
    if isinstance(value, (bool, int, float)):
        return [(path, type(value).__name__, None, None, repr(value), None)]
    if isinstance(value, complex):
        return [(path, "complex", None, None, repr(value), None)]
    if isinstance(value, str):
        return [(path, "str", None, None, value, None)]
    if isinstance(value, (bytes, bytearray)):
        return [(path, "bytes", None, None, None, bytes(value))]
    if hasattr(value, "to_dict") and hasattr(value, "columns"):
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(value)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return [(path, "frame", None, list(value.shape), None, sink.getvalue().to_pybytes())]
    import numpy as np

    a = np.asarray(value)
    if a.dtype.hasobject:
        raise TypeError(f"arrays of Python objects cannot be stored: {path}")
    kind = "scalar" if isinstance(value, np.generic) else "array"
    return [(path, kind, json.dumps(a.dtype.descr if a.dtype.names else a.dtype.str), list(a.shape), None, a.tobytes())]


def value_of(row: Mapping) -> Any:
    import numpy as np

    kind, text, data = row["kind"], row["text"], None if row["bin"] is None else bytes(row["bin"])
    if kind in ("bool", "int", "float", "complex"):
        return {"bool": lambda t: t == "True", "int": int, "float": float, "complex": complex}[kind](text)
    if kind in ("array", "scalar"):
        said = json.loads(row["dtype"])
        a = np.frombuffer(data, np.dtype([tuple(x) for x in said] if isinstance(said, list) else said)).reshape(row["shape"])
        return a[()] if kind == "scalar" else a.copy()
    if kind == "frame":
        import pyarrow as pa

        return pa.ipc.open_stream(data).read_pandas()
    return {"str": text, "bytes": data}.get(kind)


def visible(rows: DataFrame) -> DataFrame:
    """The rows of a log that no later mark at or above them replaces."""
    marks = rows.where("kind = 'mark'").groupBy("owner", "store", F.col("path").alias("above")).agg(F.max("version").alias("since"))
    own = rows.where("kind <> 'mark'")
    above = F.explode(F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))"))
    gone = own.select("owner", "store", "path", "version", above.alias("above")).join(marks, ["owner", "store", "above"]).where("since > version")
    return own.join(gone.select("owner", "store", "path", "version").distinct(), ["owner", "store", "path", "version"], "left_anti").select(rows.columns)


class Store:
    """One named store of an owner (a job id, or the project).

    Changes gather until flush or the end of a with block; each flush is one commit to the log in the
    store's folder. Several writers may flush at once: the later commit wins key by key, none is lost. table: rows of other stores to begin with.
    """

    def __init__(self, spark: SparkSession, table: DataFrame | None = None, owner: str = "", name: str = "data", path: str | None = None):
        self.spark, self.owner, self.name, self.base = spark, owner, name, table
        self.path = path or working_folder(spark)
        self.commits = Commits(spark, self.path)
        self.puts: dict[str, list[tuple]] = {}
        self.gone: set[str] = set()
        self.opened = False

    def _log(self) -> DataFrame:
        log = self.commits.read(STORES)
        return log if self.base is None else self.base.unionByName(log)

    @property
    def table(self) -> DataFrame:
        """All rows that count, of this store and of those it began with."""
        return visible(self._log())

    def compact(self) -> None:
        """Rewrite the log as the rows that count. Readers that have begun, and other writers, are not disturbed."""
        self.commits.compact(STORES, visible)

    def open(self) -> Store:
        if self.opened:
            raise StoreAlreadyOpenError(self.name)
        self.opened = True
        return self

    def close(self) -> None:
        self.flush()
        self.opened = False

    __enter__ = open

    def __exit__(self, *_) -> None:
        self.close()

    def _mine(self, path: str | None = None) -> Column:
        mine = (F.col("owner") == self.owner) & (F.col("store") == self.name)
        return mine if path is None else mine & ((F.col("path") == path) | F.col("path").startswith(f"{path}/"))

    def __setitem__(self, key: str, value: Any) -> None:
        if "." in key:
            raise InvalidKeyError(key)
        self.puts[key] = entries(value, key)
        self.gone.discard(key)

    def __delitem__(self, key: str) -> None:
        if key not in self:
            raise KeyError(key)
        self.puts.pop(key, None)
        self.gone.add(key)

    def flush(self) -> DataFrame:
        """Upsert what has gathered: rows of changed keys are replaced."""
        if not self.opened and (self.puts or self.gone):
            raise StoreClosedError(self.name)
        changed = sorted({*self.puts, *self.gone})
        if changed:
            least = 0 if self.base is None else self.base.agg(F.max("version")).first()[0] or 0

            def rows(number: int, _) -> DataFrame:
                version = least + number
                out = [(self.owner, self.name, k, "mark", None, None, None, None, version) for k in changed]
                out += [(self.owner, self.name, *e, version) for es in self.puts.values() for e in es]
                return self.spark.createDataFrame(out, STORES).coalesce(1)

            self.commits.commit(rows)
        self.puts, self.gone = {}, set()
        return self.table

    def write_arrays(self, arrays: DataFrame) -> int:
        """Set many keys at once: (key, value), value an array of numbers. Tasks make the rows, the driver sees none; returns the commit."""
        ship(self.spark)
        owner, name = self.owner, self.name
        kind = arrays.schema["value"].dataType.elementType.simpleString()
        dtype = {"tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}.get(kind)
        if dtype is None:
            raise TypeError(f"arrays of {kind} cannot be stored")
        if arrays.where("key like '%.%' or key is null").take(1):
            raise InvalidKeyError("a key holds a dot or is null")

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for b in batches:
                values = [None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.dtype(dtype)) for v in b.column(1)]
                n, text, kinds = b.num_rows, pa.string(), ["none" if v is None else "array" for v in values]
                columns = [pa.array([owner] * n, text), pa.array([name] * n, text), b.column(0), pa.array(kinds, text), pa.array([None if v is None else json.dumps(v.dtype.str) for v in values], text)]
                columns += [pa.array([None if v is None else [len(v)] for v in values], pa.list_(pa.int32())), pa.nulls(n, text), pa.array([None if v is None else v.tobytes() for v in values], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["owner", "store", *FIELDS])

        made = arrays.select(F.col("key").cast("string"), "value").mapInArrow(run, STORES.removesuffix(", version long"))
        least = 0 if self.base is None else self.base.agg(F.max("version")).first()[0] or 0

        def rows(number: int, _) -> DataFrame:
            own = made.withColumn("version", F.lit(least + number).cast("long"))
            marks = own.select("owner", "store", "path", F.lit("mark").alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("dtype", "string"), ("shape", "array<int>"), ("text", "string"), ("bin", "binary"))), "version")
            return own.union(marks)

        return self.commits.commit(rows)

    def arrays(self) -> DataFrame:
        """(key, value) of the arrays of numbers, as doubles, without going through the driver."""
        ship(self.spark)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                rows = b.to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([value_of(r).ravel().astype("f8") for r in rows], pa.list_(pa.float64()))], names=["key", "value"])

        found = visible(self._log().where(self._mine())).where("kind = 'array' and dtype not like '[%' and dtype not like '%U%' and dtype not like '%S%' and dtype not like '%M%'")
        return found.select("path", "kind", "dtype", "shape", "text", "bin").mapInArrow(run, "key string, value array<double>")

    def __getitem__(self, key: str) -> Any:
        if key in self.gone:
            raise KeyError(key)
        rows = [dict(zip(FIELDS, e)) for e in self.puts[key]] if key in self.puts else list({r["path"]: r.asDict() for r in visible(self._log().where(self._mine())).where(self._mine(key)).collect()}.values())  # one key's leaves
        if not rows:
            raise KeyError(key)
        if len(rows) == 1 and rows[0]["path"] == key:
            return {} if rows[0]["kind"] == "group" else value_of(rows[0])
        out: dict = {}
        for r in rows:
            *above, last = r["path"][len(key) + 1 :].split("/")
            at = out
            for k in above:
                at = at.setdefault(k, {})
            at[last] = {} if r["kind"] == "group" else value_of(r)
        return out

    def keys(self) -> list[str]:
        there = {r[0] for r in self.table.where(self._mine()).select(F.substring_index("path", "/", 1)).distinct().collect()}
        return sorted((there - self.gone) | set(self.puts))

    def __iter__(self) -> Iterable[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    def __contains__(self, key: str) -> bool:
        return key in self.puts or (key not in self.gone and bool(self.table.where(self._mine(key)).take(1)))

    def setdefault(self, key: str, value: Any) -> Any:
        if key not in self:
            self[key] = value
        return self[key]

    def clear(self) -> None:
        self.gone |= set(self.keys())
        self.puts = {}


def store_names(table: DataFrame, owner: str) -> DataFrame:
    return table.where(F.col("owner") == owner).select("store").distinct()


class StoreManager(Mapping):
    """The stores of a project, or of one of its jobs, by name. They lie in the project's or job's folder and go where it goes."""

    def __init__(self, spark: SparkSession, root: str, job_id: str = "", workspace: str = "workspace"):
        from ..sources.workspace import _opened

        self.spark, self.owner = spark, job_id
        self.folder = f"{root}/{workspace}/{job_id}/{FOLDER}" if job_id else f"{root}/{FOLDER}"
        self.store, self.base = _opened(self.folder)

    def __getitem__(self, name: str) -> Store:
        """A store; it comes to be with its first value."""
        if "." in name or "/" in name:
            raise InvalidKeyError(name)
        return Store(self.spark, owner=self.owner, name=name, path=f"{self.folder}/{name}" if "://" in self.folder else f"file://{os.path.abspath(self.folder)}/{name}")

    def __setitem__(self, name: str, values: Mapping) -> None:
        """Replace a whole store."""
        if name in self:
            del self[name]
        with self[name] as s:
            for k, v in values.items():
                s[k] = v

    def __delitem__(self, name: str) -> None:
        if name not in self:
            raise KeyError(name)
        self.store.delete_dir(f"{self.base}/{name}")

    def __iter__(self) -> Iterator[str]:
        from pyarrow import fs

        return iter(sorted(f.base_name for f in self.store.get_file_info(fs.FileSelector(self.base, allow_not_found=True)) if f.type == fs.FileType.Directory))

    def __len__(self) -> int:
        return len(list(iter(self)))

    def __contains__(self, name: object) -> bool:
        return name in list(iter(self))


def job_stores(spark: SparkSession, root: str, workspace: str = "workspace") -> DataFrame:
    """The rows of all stores of all jobs of a project as one table, for work across jobs."""
    return visible(committed(spark, f"{root}/{workspace}/*/{FOLDER}/*", STORES))


def array_stats(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, n, total, least, greatest) of array columns, with built-in higher-order functions."""
    v = F.col(values)
    return df.select(key, F.size(v).alias("n"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"), F.array_min(v).alias("least"), F.array_max(v).alias("greatest"))
