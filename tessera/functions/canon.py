"""Canonical JSON and the identity of state points."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidKeyError, KeyTypeError
from .shipping import ship


def plain(value: Any) -> Any:
    """Python value with NumPy scalars and arrays turned into numbers and lists."""
    if isinstance(value, Mapping):
        for k in value:
            if not isinstance(k, str):
                raise KeyTypeError(f"keys must be strings: {k!r}")
            if "." in k:
                raise InvalidKeyError(f"keys must not hold a dot: {k!r}")
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist") and hasattr(value, "dtype"):
        return value.tolist()
    return value


def canonical(value: Any) -> str:
    """JSON with sorted keys, as the identity is taken from."""
    return json.dumps(plain(value), sort_keys=True)


def calc_id(statepoint: Mapping) -> str:
    """MD5 of the canonical JSON: key order does not matter, 1, 1.0 and true differ."""
    return hashlib.md5(canonical(statepoint).encode()).hexdigest()


def unified(value: Any) -> Any:
    """Value in which equal numbers of different types look alike: true, 1 and 1.0 are one."""
    if isinstance(value, dict):
        return {k: unified(v) for k, v in value.items()}
    if isinstance(value, list):
        return [unified(v) for v in value]
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def _text_udf(convert):
    """Arrow UDF from JSON text to text; null where the text is no JSON."""

    def run(texts):
        import pyarrow as pa

        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else convert(json.loads(t)))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    import pyarrow as pa

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    ship()
    return F.arrow_udf(run, T.StringType())


def canonical_json(column: Column | str) -> Column:
    """Canonical form of a JSON text column; null where it cannot be parsed. Python prints the numbers, so ids are exact."""
    return _text_udf(json.JSONEncoder(sort_keys=True).encode)(column)


def unified_json(column: Column | str) -> Column:
    """Canonical form with equal numbers made alike, for comparing lists."""
    return _text_udf(lambda v: json.dumps(unified(v), sort_keys=True))(column)


def job_id(column: Column | str) -> Column:
    """Id of a JSON state point column."""
    return F.md5(canonical_json(column))


def typed_json(**columns: Column) -> Column:
    """Canonical JSON of integer and plain string columns without Python: keys sorted, strings escaped by Spark."""
    inside = lambda text: F.rtrim(F.substring(text, 6, (1 << 31) - 1), F.lit("}"))  # noqa: E731 - of {"x":...}: numbers and quoted texts end otherwise
    parts = [F.concat(F.lit(f"{json.dumps(k)}: "), inside(F.to_json(F.struct(columns[k].alias("x"))))) for k in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
