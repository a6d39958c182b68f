"""Filters on state points and documents, compiled to one Spark column.

A filter is a mapping of keys to values or operator expressions, joined by and. Keys are dotted
paths, by default below `sp`; a last component `$op` is an operator too. Logical operators are
$and, $or (lists of filters) and $not (a filter). What is negated is made false instead of null, so
that $not selects rows without the key.
"""

from __future__ import annotations

import json
import math
import re
import warnings
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import plain, unified, unified_json
from ..functions.shipping import ship
from .fields import NUMBERS, Field, VariantFields

OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$regex", "$type", "$where", "$near", "$exists")
LOGICAL = ("$and", "$or", "$not")
TYPES = {"int": ("int", "bool"), "float": ("float",), "bool": ("bool",), "str": ("str",), "list": ("tuple",), "null": ("NoneType",)}


# ---- reading ---------------------------------------------------------------------------------

def read_token(token: str) -> Any:
    """A word as null, true, false, number or text."""
    words = {"true": True, "false": False, "null": None}
    if token in words:
        return words[token]
    if token in ("True", "False", "None", "none"):
        warnings.warn(f"{token} is read as text; JSON has true, false and null", stacklevel=2)
    for kind in (int, float):
        try:
            return kind(token)
        except ValueError:
            pass
    return token


def is_json(text: str) -> bool:
    t = text.strip()
    return t[:1] + t[-1:] in ("{}", "[]")


def token_condition(value: str | None) -> Any:
    """What a word behind a key asks for: nothing or ! that the key exists, /x/ a match, JSON or a plain word that value."""
    if value is None or value == "!":
        return {"$exists": True}
    if re.fullmatch(r"/.*/", value, re.DOTALL) and len(value) > 1:
        return {"$regex": value[1:-1]}
    return json.loads(value) if is_json(value) else read_token(value)


def from_tokens(tokens: list[str]) -> dict | None:
    """A filter from words as typed on a command line: one JSON text, or keys each with its word."""
    words = list(tokens)
    if len(words) == 1 and is_json(words[0]):
        return json.loads(words[0])
    keys = words[::2]
    wrong = next((k for k in keys if is_json(k)), None)
    if wrong is not None:
        raise ValueError(f"JSON cannot be a key: {wrong}")
    return {k: token_condition(words[2 * i + 1] if 2 * i + 1 < len(words) else None) for i, k in enumerate(keys)} or None


def read_filter(given: Any) -> dict:
    """A filter from a mapping, text, tokens' pairs or nothing."""
    if given is None:
        return {}
    if isinstance(given, str):
        return from_tokens(given.split()) or {}
    if isinstance(given, Mapping):
        return dict(given)
    try:
        return dict(given)
    except TypeError:
        raise ValueError(f"not a filter: {given!r}") from None


# ---- conditions ------------------------------------------------------------------------------

def conditions(given: Mapping) -> Iterator[tuple[str, str, Any]]:
    """(namespaced key, operator, argument) of the plain keys, nested mappings flattened. Wrong operators raise KeyError."""
    for key, value in given.items():
        if key not in LOGICAL:
            head = key.split(".", 1)[0]
            yield from _leaf(key if head in ("sp", "doc") else f"sp.{key}", value)


def _leaf(key: str, value: Any) -> Iterator[tuple[str, str, Any]]:
    parts = key.split(".")
    at = [p for p in parts if p.startswith("$")]
    if at:
        if len(at) > 1 or parts[-1] != at[0] or at[0] not in OPERATORS:
            raise KeyError(f"unknown or misplaced operator in {key!r}")
        yield ".".join(parts[:-1]), at[0], value
    elif isinstance(value, Mapping) and value:
        for k, v in value.items():
            yield from _leaf(f"{key}.{k}", v)
    else:
        yield key, "$eq", value


def branches(given: Mapping) -> Iterator[tuple[str, list[Mapping]]]:
    for key in LOGICAL:
        if key not in given:
            continue
        value = given[key]
        if key == "$not":
            yield key, [value]
        elif not isinstance(value, (list, tuple)) or not value:
            raise ValueError(f"{key} takes a list of filters")
        else:
            yield key, list(value)


def uses_documents(given: Mapping) -> bool:
    """Whether any part reads a document, also below $not."""
    return any(k.split(".", 1)[0] == "doc" for k, _, _ in conditions(given)) or any(uses_documents(f) for _, fs in branches(given) for f in fs)


def spaces_of(given: Mapping) -> set[str]:
    """sp and doc, as far as any part reads them."""
    own = {k.split(".", 1)[0] for k, _, _ in conditions(given) if k != "sp._id"}
    return own.union(*(spaces_of(read_filter(f)) for _, fs in branches(given) for f in fs))


def calls_python(given: Mapping) -> bool:
    """Whether any part needs Python in tasks: predicates, lists, some patterns."""
    for _, op, arg in conditions(given):
        if op == "$where" or op in ("$in", "$nin") and not isinstance(arg, str) and any(isinstance(v, (list, tuple)) or hasattr(v, "tolist") for v in arg):
            return True
        if op not in ("$in", "$nin", "$near") and (isinstance(arg, (list, tuple)) or hasattr(arg, "tolist")) or op == "$regex" and not (isinstance(arg, str) and ALIKE.fullmatch(arg)):
            return True
    return any(calls_python(read_filter(f)) for _, fs in branches(given) for f in fs)


# ---- compiling -------------------------------------------------------------------------------

def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _spelled(f: Field, value: str) -> Column:
    """Equality with a text of digits, in the type of the column that is spelled out."""
    return f.spelled == int(value) if re.fullmatch(r"0|-?[1-9][0-9]*", value) and abs(int(value)) < 1 << 63 else F.when(f.exists, False)


def _equal(f: Field, value: Any) -> Column:
    if value is None:
        return f.tag == "NoneType"
    if isinstance(value, (bool, int, float)):
        if value != value:
            return F.lit(False)
        whole = not isinstance(value, float) or value.is_integer()
        if f.whole is not None:
            return f.whole == int(value) if whole and abs(value) < 1 << 63 else F.when(f.exists, False)
        if whole and abs(value) >= 1 << 53:
            same = f.exact == F.lit(str(int(value))).cast("decimal(38,0)") if abs(value) < 10**38 else F.lit(False)
            return same | ((f.tag == "float") & (f.number == float(value))) if float(value) == value else same
        return f.number == float(value) + 0.0  # never -0.0
    if isinstance(value, str):
        return _spelled(f, value) if f.spelled is not None else f.text == value
    if isinstance(value, list):
        return (f.tag == "tuple") & (unified_json(f.json) == json.dumps(unified(value), sort_keys=True))
    if value == {}:
        return (f.tag == "dict") & (f.json == "{}")
    raise ValueError(f"cannot compare with {value!r}")


COMPARE: dict[str, Callable[[Any, Any], Any]] = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def _integers(c: Column, op: str, value: float, least: int, most: int, literal: Callable[[int], Column]) -> Column:
    """An integer column against a number, exactly: the bound is rounded to the integer that asks the same. least, most: of its type."""
    if value != value:
        return F.lit(False)
    below = value == -math.inf or value < least
    if below or value == math.inf or value > most:
        return F.when(c.isNotNull(), F.lit(below == (op in ("$gt", "$gte"))))
    return COMPARE[op](c, literal(math.floor(value) if op in ("$gt", "$lte") else math.ceil(value)))


def _doubles(c: Column, op: str, value: float) -> Column:
    """A double column against a number. NaN, which Spark sorts above all, is kept out by a bound that sources know."""
    near = float(value)
    if near > value:  # an integer that no double is: rounded up, or down
        op = {"$gt": "$gte", "$lte": "$lt"}.get(op, op)
    elif near < value:
        op = {"$gte": "$gt", "$lt": "$lte"}.get(op, op)
    return COMPARE[op](c, near) & (c <= math.inf) if op in ("$gt", "$gte") else COMPARE[op](c, near)


def _numbers(f: Field, op: str, value: float) -> Column:
    if value != value:
        return F.lit(False)
    if f.whole is not None:
        return _integers(f.whole, op, value, -(1 << 63), (1 << 63) - 1, F.lit)
    if abs(value) < 1 << 53:
        return _doubles(f.number, op, value)
    exact = _integers(f.exact, op, value, -(10**38) + 1, 10**38 - 1, lambda v: F.lit(str(v)).cast("decimal(38,0)"))
    return F.when(f.exact.isNotNull(), exact).otherwise(_doubles(f.number, op, min(max(value, -(10**308)), 10**308)))


def _ordered(f: Field, op: str, value: Any, strict: bool) -> Column:
    if isinstance(value, (bool, int, float)):
        fits, test = f.number.isNotNull(), _numbers(f, op, value)
    elif isinstance(value, str):
        fits, test = f.text.isNotNull(), COMPARE[op](f.text, value)
    elif isinstance(value, list):
        fits, test = f.tag == "tuple", (f.tag == "tuple") & _call(lambda v, op=op, value=value: COMPARE[op](v, value), f)
    else:
        fits, test = F.lit(False), F.lit(False)
    if strict:
        return F.when(fits, test).when(f.exists, F.raise_error(F.lit(f"{op} cannot order these types")).cast("boolean")).otherwise(False)
    return test


def _call(function: Callable[[Any], Any], f: Field) -> Column:
    """A Python predicate on the value, Arrow batch by Arrow batch; errors are false."""

    def run(texts, tags):
        import pyarrow as pa

        out = []
        for text, tag in zip(texts.to_pylist(), tags.to_pylist()):
            try:
                value = json.loads(text) if text is not None else None
                out.append(tag is not None and bool(function(float(value) if tag == "float" else value)))
            except Exception:  # noqa: BLE001 - the predicate is the caller's
                out.append(False)
        return pa.array(out, pa.bool_())

    import pyarrow as pa

    ship()
    run.__annotations__ = {"texts": pa.Array, "tags": pa.Array, "return": pa.Array}
    text = F.when(f.tag == "str", F.get(F.split(F.to_json(F.struct(f.text.alias("x"))), r'^\{"x":|\}$'), F.lit(1))).when(f.tag.isin(*NUMBERS), F.regexp_replace(f.json, r'^\{"x":|\}$', "")).otherwise(f.json)
    return F.arrow_udf(run, T.BooleanType())(text, f.tag)


def _one(f: Field, op: str, arg: Any, strict: bool) -> Column:
    if op == "$exists":
        if not isinstance(arg, bool):
            raise ValueError("$exists takes true or false")
        return f.exists if arg else ~f.exists
    if op == "$where":
        if not callable(arg):
            raise ValueError("$where takes a callable; text is not evaluated")
        return f.exists & _call(arg, f)
    if op in ("$eq", "$ne"):
        return _equal(f, arg) if op == "$eq" else f.exists & ~_sure(_equal(f, arg))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return _ordered(f, op, arg, strict)
    if op in ("$in", "$nin"):
        if isinstance(arg, str):
            found = F.instr(F.lit(arg), f.text) > 0
        else:
            found = _member(f, list(arg))
        return found if op == "$in" else f.exists & ~_sure(found)
    if op == "$regex":
        return _matches(f.text, arg)
    if op == "$type":
        if arg not in TYPES:
            raise ValueError(f"unknown type {arg!r}")
        return f.tag.isin(*TYPES[arg])
    if op == "$near":
        args = list(arg) if isinstance(arg, (list, tuple)) else [arg]
        if not 1 <= len(args) <= 3:
            raise ValueError("$near takes a value, and relative and absolute tolerances")
        value, rel, most = (*args, *(1e-9, 0.0)[len(args) - 1 :])
        return (F.abs(f.number - value) <= F.greatest(rel * F.greatest(F.abs(f.number), F.lit(abs(float(value)))), F.lit(float(most))))
    raise KeyError(op)


#: Signs of patterns that Java and Python read alike: plain characters, ., ^, groups, alternatives, counts, ASCII sets and escapes of ASCII classes outside sets.
ALIKE = re.compile(r"(?:[ \w\-,:;/<>=!@%&~'\"#.|^]|\\[.\-+*?()\[\]{}|^$/\\]|\((?:\?:|(?!\?))|\)|[+*?]\??|\{\d+(?:,\d*)?\}|\[\^?[ \w\-.,:;/<>=!@%~'\"#]+\])*", re.ASCII)


def _matches(text: Column, pattern: str) -> Column:
    """Python's re.search. Patterns that Java reads the same way stay in the JVM, others go by Arrow batches."""
    compiled = re.compile(pattern)
    if ALIKE.fullmatch(pattern):
        # Java's point leaves out more line ends than Python's
        return F.rlike(text, F.lit(re.sub(r"(\\.|\[[^\]]*\])|\.", lambda m: m[1] or r"[^\n]", pattern)))

    def run(texts):
        import pyarrow as pa

        return pa.array([None if t is None else compiled.search(t) is not None for t in texts.to_pylist()], pa.bool_())

    import pyarrow as pa

    ship()
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.BooleanType())(text)


def _member(f: Field, values: list) -> Column:
    """Numbers and texts in one test each, the rest one by one."""
    number = lambda v: isinstance(v, (bool, int, float)) and v == v
    if f.whole is not None:
        small = [int(v) for v in values if number(v) and abs(v) < 1 << 63 and int(v) == v]
        rest = [v for v in values if not isinstance(v, (bool, int, float, str))]
    else:
        small = [float(v) + 0.0 for v in values if number(v) and abs(v) < 1 << 53]
        rest = [v for v in values if not isinstance(v, str) and not (number(v) and abs(v) < 1 << 53)]
    texts = [v for v in values if isinstance(v, str)]
    tests = [_equal(f, v) for v in rest]
    if small:
        tests.append((f.whole if f.whole is not None else f.number).isin(*small))
    if texts and f.spelled is not None:
        digits = [int(t) for t in texts if re.fullmatch(r"0|-?[1-9][0-9]*", t) and abs(int(t)) < 1 << 63]
        tests.append(f.spelled.isin(*digits) if digits else F.when(f.exists, False))
    elif texts:
        tests.append(f.text.isin(*texts))
    return reduce(lambda a, b: a | b, tests) if tests else F.when(f.exists, False)


def compile_filter(given: Any, fields, strict: bool = False, sure: bool = True) -> Column:
    """One boolean column. All errors of form are raised here, before any job runs.

    strict: ordering a value of another type raises when a row has one; else such a row does not
    match. sure: false instead of null where nothing can be compared; a plain `where` does not need
    it, and without it simple tests reach the source's statistics.
    """
    f = read_filter(given)
    once = isinstance(fields, VariantFields) and not calls_python(f)

    def test(key: str, op: str, arg: Any, fields: Any) -> Column:
        field = fields.id_field() if key == "sp._id" else fields.field(key)
        return _one(field, op, arg if op == "$where" else json.loads(json.dumps(plain(arg))), strict)

    def combined(op: str, parts: list, fields: Any) -> Column:
        inner = [compile_filter(p, fields, strict, sure=op == "$not") for p in parts]
        return ~inner[0] if op == "$not" else reduce((lambda a, b: a & b) if op == "$and" else (lambda a, b: a | b), inner)

    tests = [test(*c, fields) for c in conditions(f) if c[0] == "sp._id" or not once]
    if once:
        inner = [c for c in conditions(f) if c[0] != "sp._id"]
        deep = list(branches(f))
        if inner or deep:
            tests.append(fields.once(lambda x: reduce(lambda a, b: a & b, [test(*c, x) for c in inner] + [combined(*b, x) for b in deep]), spaces_of(f)))
    else:
        tests += [combined(*b, fields) for b in branches(f)]
    out = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    return _sure(out) if sure else out
