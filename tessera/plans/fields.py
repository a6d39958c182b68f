"""How a key of a state point or document is read from a table.

Two kinds of tables: typed columns (null: the key is missing) and VARIANT columns (a JSON null is
a value). Both give the same views of a key, so one filter compiles to either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("bool", "int", "float")


@dataclass
class Field:
    """tag: bool, int, float, str, tuple, dict or NoneType, null if the key is missing; then its value as number, exact integer and text (null for other types) and JSON.

    whole: a column of an integer type that is the value itself; spelled: one whose digits are the
    text. Comparisons with them reach the source.
    """

    exists: Column
    tag: Column
    number: Column
    exact: Column
    text: Column
    json: Column
    whole: Column | None = None
    spelled: Column | None = None


def missing() -> Field:
    none = F.lit(None)
    return Field(F.lit(False), none.cast("string"), none.cast("double"), none.cast("decimal(38,0)"), none.cast("string"), none.cast("string"))


def id_field() -> Field:
    f = missing()
    f.exists, f.tag, f.text = F.col("job_id").isNotNull(), F.lit("str"), F.col("job_id")
    return f


class TypedFields:
    """columns: dotted keys with their namespace ("sp.a", "doc.b.c") to Spark columns of the frame."""

    def __init__(self, columns: Mapping[str, str], schema: T.StructType, id_column: str | None = None):
        self.columns, self.schema, self.id_column = dict(columns), schema, id_column

    def id_field(self) -> Field:
        """The job's id; where it is the text of an integer column, that column too."""
        f = id_field()
        if self.id_column is not None and isinstance(self.schema[self.id_column].dataType, T.IntegralType):
            f.spelled = F.col(self.id_column)
        return f

    def keys(self) -> list[str]:
        return list(self.columns)

    def field(self, key: str) -> Field:
        if key not in self.columns:
            inside = {k: v for k, v in self.columns.items() if k.startswith(f"{key}.")}
            if not inside:
                return missing()
            some = None
            for k in inside:
                e = self.field(k).exists
                some = e if some is None else some | e
            f = missing()
            f.exists, f.tag = some, F.when(some, "dict")
            return f
        c = F.col(self.columns[key])
        kind = self.schema[self.columns[key]].dataType
        tag = "bool" if isinstance(kind, T.BooleanType) else "int" if isinstance(kind, T.IntegralType) else "float" if isinstance(kind, (T.FractionalType, T.DecimalType)) else "tuple" if isinstance(kind, T.ArrayType) else "dict" if isinstance(kind, (T.MapType, T.StructType)) else "str"
        f = missing()
        f.exists, f.tag = c.isNotNull(), F.when(c.isNotNull(), tag)
        if tag in NUMBERS:
            f.number = c.cast("int").cast("double") if tag == "bool" else c.cast("double")
            f.exact = c.cast("int").cast("decimal(38,0)") if tag == "bool" else c.cast("decimal(38,0)") if tag == "int" else f.exact
            f.whole = c if tag == "int" else None
            f.json = F.to_json(F.struct(c.alias("x")))
        elif tag == "str":
            f.text = c.cast("string")
        if tag in ("tuple", "dict"):
            f.json = F.to_json(c)
        return f


def variant_path(parts: list[str]) -> str:
    quoted = (p.replace("\\", "\\\\").replace('"', '\\"') for p in parts)
    return "$" + "".join(f'["{p}"]' for p in quoted)


#: Names in VARIANT schemas and the Python types of such values in canonical JSON.
TAGS = {"VOID": "NoneType", "BOOLEAN": "bool", "STRING": "str", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "FLOAT": "float", "ARRAY": "tuple", "OBJECT": "dict"}


def variant_tag(v: Column) -> Column:
    """Python type of a value in canonical JSON; null if there is none.

    Integers of over 64 bits are decimals of 19 digits or more; other decimals were written with a
    point. The value is named once, so that generated code stays small.
    """
    name = F.regexp_extract(F.schema_of_variant(v), r"^(DECIMAL\((?:19|[23]\d),0\)|[A-Z]+)", 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv)), F.regexp_replace(name, r"^DECIMAL\(.*", "BIGINT"))


class VariantFields:
    """sp and doc are VARIANT columns parsed from canonical JSON."""

    def __init__(self, sp: str | Column = "sp", doc: str | Column = "doc"):
        self.roots = {"sp": sp, "doc": doc}

    def id_field(self) -> Field:
        return id_field()

    def once(self, build: Callable[[VariantFields], Column], spaces: Iterable[str]) -> Column:
        """build(fields) in which the columns of these spaces are named once.

        A filter that Spark moves below the parsing of its columns parses them wherever it names
        them, and a key's views name them a dozen times.
        """
        spaces = sorted(spaces)
        if not spaces:
            return build(self)
        whole = F.array(F.struct(*(F.col(self.roots[s]).alias(s) for s in spaces)))
        return F.get(F.transform(whole, lambda r: build(BoundFields(r, spaces))), F.lit(0))

    def root(self, space: str) -> Column:
        return F.col(self.roots[space])

    def field(self, key: str) -> Field:
        space, *parts = key.split(".")
        v = F.try_variant_get(self.root(space), variant_path(parts), "variant") if parts else self.root(space)
        tag = variant_tag(v)
        number = F.when(tag == "bool", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(tag.isin("int", "float"), F.try_variant_get(v, "$", "double"))
        exact = F.when(tag == "bool", F.try_variant_get(v, "$", "boolean").cast("int").cast("decimal(38,0)")).when(tag == "int", F.try_variant_get(v, "$", "decimal(38,0)"))
        return Field(v.isNotNull(), tag, number, exact, F.when(tag == "str", F.try_variant_get(v, "$", "string")), F.to_json(v))


class BoundFields(VariantFields):
    """The spaces of a struct that `once` has named. A value, and its type, are taken out once for each view."""

    def __init__(self, row: Column, spaces: Iterable[str]):
        self.row, self.spaces = row, spaces

    def once(self, build: Callable[[VariantFields], Column], spaces: Iterable[str]) -> Column:
        return build(self)

    def root(self, space: str) -> Column:
        return self.row[space]

    def field(self, key: str) -> Field:
        space, *parts = key.split(".")
        v = F.try_variant_get(self.root(space), variant_path(parts), "variant") if parts else self.root(space)
        name = F.schema_of_variant(v)

        def view(make: Callable[[Column, Column], Column]) -> Column:
            return F.get(F.transform(F.array(F.struct(v.alias("v"), name.alias("n"))), lambda x: make(x["v"], x["n"])), F.lit(0))

        whole = lambda n: (n == "BIGINT") | n.rlike(r"^DECIMAL\((?:19|[23]\d),0\)$")
        some = lambda n: n.isin("BIGINT", "DOUBLE", "FLOAT") | n.startswith("DECIMAL")
        truth = lambda x: F.try_variant_get(x, "$", "boolean").cast("int")
        number = view(lambda x, n: F.when(some(n), F.try_variant_get(x, "$", "double")).when(n == "BOOLEAN", truth(x).cast("double")))
        exact = view(lambda x, n: F.when(whole(n), F.try_variant_get(x, "$", "decimal(38,0)")).when(n == "BOOLEAN", truth(x).cast("decimal(38,0)")))
        return Field(v.isNotNull(), variant_tag(v), number, exact, view(lambda x, n: F.when(n == "STRING", F.try_variant_get(x, "$", "string"))), F.to_json(v))


class IndexFields(VariantFields):
    """VARIANT columns of an index beside which some keys' numbers or texts are columns of their own, which comparisons push to the scan."""

    def __init__(self, typed: Mapping[tuple[str, str], str]):
        super().__init__()
        self.typed = dict(typed)

    def once(self, build: Callable[[VariantFields], Column], spaces: Iterable[str]) -> Column:
        return build(self)  # conditions on typed columns reach the scan

    def field(self, key: str) -> Field:
        f = super().field(key)
        if (key, "number") in self.typed:
            f.number = F.col(self.typed[key, "number"])
        if (key, "text") in self.typed:
            f.text = F.col(self.typed[key, "text"])
        return f
