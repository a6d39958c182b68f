"""Flattening of JSON documents to one row per leaf, and back."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canon import unified
from .shipping import ship

LEAF = "job_id string, ns string, path string, type string, num double, big decimal(38,0), str string, json string, same string, rest string"


def flatten(value: dict, prefix: str = "") -> dict[str, Any]:
    """Dotted keys to leaves. Mappings are no leaves unless empty; lists are leaves."""
    out: dict[str, Any] = {}
    for k, v in value.items():
        if isinstance(v, dict) and v:
            out.update(flatten(v, f"{prefix}{k}."))
        else:
            out[prefix + k] = v
    return out


def nest(flat: dict[str, Any], delimiter: str = ".") -> dict:
    """The reverse of flatten."""
    out: dict = {}
    for key, value in flat.items():
        *above, last = key.split(delimiter)
        at = out
        for k in above:
            at = at.setdefault(k, {})
        at[last] = value
    return out


TYPES = {type(None): "NoneType", bool: "bool", int: "int", float: "float", str: "str", list: "tuple", dict: "dict"}


def type_name(v: Any) -> str:
    return TYPES[type(v)]


def leaves(jobs: DataFrame, column: str, ns: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row per leaf of a JSON text column. same: JSON with equal numbers alike; rest: the sum of 128-bit hashes of the other leaves.

    Rows whose text is null or no JSON object have no leaves. columns: only those are made (default: all).
    """
    wanted = tuple(c.split()[0] for c in LEAF.split(", ")) if columns is None else columns

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        schema = pa.schema([(c, pa.float64() if c == "num" else pa.decimal128(38, 0) if c == "big" else pa.string()) for c in wanted])
        encode = json.JSONEncoder(sort_keys=True).encode
        text_of = json.encoder.encode_basestring_ascii

        def plain(v) -> str | None:
            """JSON of a value that is alike in both forms; else null."""
            kind = type(v)
            return text_of(v) if kind is str else str(v) if kind is int else "null" if v is None else None

        for b in batches:
            cols: dict[str, list] = {c: [] for c in wanted}
            for job, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    value = json.loads(text) if text is not None else None
                except ValueError:
                    value = None
                if not isinstance(value, dict):
                    continue
                flat = flatten(value)
                own = {k: plain(v) for k, v in flat.items()}
                if "same" in cols or "rest" in cols:
                    same = {k: encode(unified(v)) if own[k] is None else own[k] for k, v in flat.items()}
                    if "same" in cols:
                        cols["same"] += same.values()
                if "rest" in cols:
                    marks = {k: int.from_bytes(hashlib.md5(json.dumps((k, s)).encode()).digest(), "big") for k, s in same.items()}
                    whole = sum(marks.values())
                    cols["rest"] += [f"{whole - marks[k] & (1 << 128) - 1:032x}" for k in flat]
                if "job_id" in cols:
                    cols["job_id"] += [job] * len(flat)
                if "ns" in cols:
                    cols["ns"] += [ns] * len(flat)
                if "path" in cols:
                    cols["path"] += flat
                if "type" in cols:
                    cols["type"] += [type_name(v) for v in flat.values()]
                if "num" in cols:
                    cols["num"] += [float(v) if isinstance(v, (bool, int, float)) and abs(v) < 1e308 else None for v in flat.values()]
                if "big" in cols:
                    cols["big"] += [Decimal(v) if isinstance(v, int) and abs(v) < 10**38 else None for v in flat.values()]
                if "str" in cols:
                    cols["str"] += [v if isinstance(v, str) else None for v in flat.values()]
                if "json" in cols:
                    cols["json"] += [encode(v) if own[k] is None else own[k] for k, v in flat.items()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    ship(jobs.sparkSession)
    kinds = dict(c.split() for c in LEAF.split(", "))
    return jobs.select("job_id", column).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in wanted))


def nested_json(entries: Column) -> Column:
    """Canonical JSON of an array of (path, json) entries."""

    def run(arrays):
        import pyarrow as pa

        return pa.array([None if a is None else json.dumps(nest({e["path"]: json.loads(e["json"]) for e in a if e["json"] is not None}), sort_keys=True) for a in arrays.to_pylist()], pa.string())

    import pyarrow as pa

    run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StringType())(entries)


def working_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = current.get() if current.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/tessera-{os.getpid()}"
    return f"{at.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = working_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
