"""Declared table schemas: types, limits and validation.

A schema is a named, versioned, ordered list of typed fields. Columns are ordinary Spark columns; what Spark has no
type for (byte-limited strings, vectors of a fixed length and element type, encryption) is kept in the field and
checked when rows are written.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH, DEFAULT_DEPTH, MAX_ARRAY_DEPTH = 25, 10, 32


class SchemaError(ValueError):
    """A schema that cannot be declared, or data that does not fit one."""


@dataclass(frozen=True)
class FieldType:
    """Base of the field types."""

    def spark(self) -> T.DataType:
        raise NotImplementedError

    def problems(self, value: Column) -> Column:
        """Whether a non-null value breaks a limit that Spark's type does not express."""
        return F.lit(False)

    def depth(self) -> int:
        return 1


@dataclass(frozen=True)
class Primitive(FieldType):
    name: str

    def spark(self) -> T.DataType:
        return _PRIMITIVES[self.name]

    @property
    def numeric(self) -> bool:
        return self.name not in ("STRING", "BOOLEAN", "TIMESTAMP")


_PRIMITIVES: dict[str, T.DataType] = {
    "STRING": T.StringType(), "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT64": T.LongType(),
    "FLOAT16": T.FloatType(), "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampNTZType(),
}
STRING, INT8, INT16, INT32, INT64 = (Primitive(n) for n in ("STRING", "INT8", "INT16", "INT32", "INT64"))
FLOAT16, FLOAT32, FLOAT64, BOOLEAN, TIMESTAMP = (Primitive(n) for n in ("FLOAT16", "FLOAT32", "FLOAT64", "BOOLEAN", "TIMESTAMP"))


@dataclass(frozen=True)
class BoundedString(FieldType):
    """A string of at most ``max_bytes`` bytes of UTF-8."""

    max_bytes: int

    def __post_init__(self) -> None:
        if self.max_bytes < 1:
            raise SchemaError("a bounded string holds at least one byte")

    def spark(self) -> T.DataType:
        return T.StringType()

    def problems(self, value: Column) -> Column:
        return F.octet_length(value) > self.max_bytes


@dataclass(frozen=True)
class ArrayOf(FieldType):
    element: FieldType

    def __post_init__(self) -> None:
        levels, inner = 1, self.element
        while isinstance(inner, ArrayOf):
            levels, inner = levels + 1, inner.element
        if levels > MAX_ARRAY_DEPTH:
            raise SchemaError(f"arrays nest at most {MAX_ARRAY_DEPTH} deep")

    def spark(self) -> T.DataType:
        return T.ArrayType(self.element.spark(), True)

    def problems(self, value: Column) -> Column:
        return F.exists(value, lambda x: F.coalesce(self.element.problems(x), F.lit(False)))

    def depth(self) -> int:
        return self.element.depth()


@dataclass(frozen=True)
class ObjectOf(FieldType):
    fields: tuple[Field, ...]

    def spark(self) -> T.DataType:
        return T.StructType([f.spark() for f in self.fields])

    def problems(self, value: Column) -> Column:
        broken = F.lit(False)
        for f in self.fields:
            broken = broken | F.coalesce(f.type.problems(value.getField(f.name)), F.lit(False))
        return broken

    def depth(self) -> int:
        return 1 + max((f.type.depth() for f in self.fields), default=0)


@dataclass(frozen=True)
class VectorOf(FieldType):
    """A vector of exactly ``dimensions`` finite elements of FLOAT32 or FLOAT16."""

    dimensions: int
    element: Primitive = FLOAT32

    def __post_init__(self) -> None:
        if self.dimensions < 1 or self.element not in (FLOAT16, FLOAT32):
            raise SchemaError("a vector has one or more FLOAT16 or FLOAT32 elements")

    def spark(self) -> T.DataType:
        return T.ArrayType(T.FloatType(), True)

    def problems(self, value: Column) -> Column:
        most = 65504.0 if self.element == FLOAT16 else 3.4028234663852886e38
        bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > most))
        return (F.size(value) != self.dimensions) | bad


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    encryption: str = "NONE"

    def spark(self) -> T.StructField:
        return T.StructField(self.name, self.type.spark(), True, {"encryption": self.encryption})


@dataclass(frozen=True)
class TableSchema:
    """An ordered list of uniquely named fields with a version; fields are only ever added at the end."""

    name: str
    version: int
    fields: tuple[Field, ...] = ()
    max_depth: int = DEFAULT_DEPTH

    def __post_init__(self) -> None:
        if not self.name or not self.name.strip():
            raise SchemaError("a schema needs a name")
        if self.version < 0:
            raise SchemaError("versions begin at 0")
        if not 1 <= self.max_depth <= MAX_DEPTH:
            raise SchemaError(f"objects nest at most {MAX_DEPTH} deep")
        names = [f.name for f in self.fields]
        if any(not n or not n.strip() for n in names):
            raise SchemaError("a field needs a name")
        if len(set(names)) != len(names):
            raise SchemaError(f"repeated field in {names}")
        for f in self.fields:
            if f.type.depth() > self.max_depth:
                raise SchemaError(f"{f.name} nests deeper than {self.max_depth}")

    def with_field(self, name: str, kind: FieldType, encryption: str = "NONE") -> TableSchema:
        return replace(self, fields=(*self.fields, Field(name, kind, encryption)))

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"{self.name} has no field {name}")

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def spark(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])

    def evolved(self, fields: tuple[Field, ...]) -> TableSchema:
        """The next version, with ``fields`` appended."""
        return replace(self, version=self.version + 1, fields=(*self.fields, *fields))

    def read(self, df: DataFrame) -> DataFrame:
        """Rows written under an earlier version as rows of this one: fields added since are null."""
        there = set(df.columns)
        keys = [df["_key"]] if "_key" in there else []
        return df.select(*keys, *[(df[f.name] if f.name in there else F.lit(None)).cast(f.type.spark()).alias(f.name) for f in self.fields])

    def violations(self, df: DataFrame) -> DataFrame:
        """The rows that break a limit, with the names of the fields that do in ``_broken``."""
        broken = F.array(*[F.when(F.coalesce(f.type.problems(F.col(f.name)), F.lit(False)), F.lit(f.name)) for f in self.fields])
        return df.withColumn("_broken", F.filter(broken, lambda x: x.isNotNull())).where(F.size("_broken") > 0)

    def checked(self, df: DataFrame) -> DataFrame:
        """``df`` cast to the schema, every row checked as it is computed: a row over a limit fails the job."""
        df = self.read(df)
        columns = [df[c] for c in df.columns if c == "_key"]
        for f in self.fields:
            ok = ~F.coalesce(f.type.problems(df[f.name]), F.lit(False))
            columns.append(F.when(ok, df[f.name]).otherwise(F.raise_error(F.lit(f"{self.name}.{f.name}: a value breaks the limits of {f.type}")).cast(f.type.spark())).alias(f.name))
        return df.select(*columns)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "version": self.version, "max_depth": self.max_depth, "fields": [_field_out(f) for f in self.fields]})

    @staticmethod
    def from_json(text: str) -> TableSchema:
        d = json.loads(text)
        return TableSchema(d["name"], d["version"], tuple(_field_in(f) for f in d["fields"]), d["max_depth"])


def _type_out(t: FieldType) -> dict:
    if isinstance(t, Primitive):
        return {"kind": t.name}
    if isinstance(t, BoundedString):
        return {"kind": "BOUNDED", "max_bytes": t.max_bytes}
    if isinstance(t, ArrayOf):
        return {"kind": "ARRAY", "element": _type_out(t.element)}
    if isinstance(t, ObjectOf):
        return {"kind": "OBJECT", "fields": [_field_out(f) for f in t.fields]}
    if isinstance(t, VectorOf):
        return {"kind": "VECTOR", "dimensions": t.dimensions, "element": t.element.name}
    raise SchemaError(f"unknown type {t}")


def _type_in(d: dict) -> FieldType:
    kind = d["kind"]
    if kind == "BOUNDED":
        return BoundedString(d["max_bytes"])
    if kind == "ARRAY":
        return ArrayOf(_type_in(d["element"]))
    if kind == "OBJECT":
        return ObjectOf(tuple(_field_in(f) for f in d["fields"]))
    if kind == "VECTOR":
        return VectorOf(d["dimensions"], Primitive(d["element"]))
    return Primitive(kind)


def _field_out(f: Field) -> dict:
    return {"name": f.name, "type": _type_out(f.type), "encryption": f.encryption}


def _field_in(d: dict) -> Field:
    return Field(d["name"], _type_in(d["type"]), d["encryption"])


def of_dataframe(name: str, df: DataFrame, **special: FieldType) -> TableSchema:
    """A schema for existing columns; ``special`` names the types that Spark's do not tell."""
    kinds = {"string": STRING, "tinyint": INT8, "smallint": INT16, "int": INT32, "bigint": INT64, "float": FLOAT32, "double": FLOAT64, "boolean": BOOLEAN, "timestamp": TIMESTAMP, "timestamp_ntz": TIMESTAMP}

    def kind(t: T.DataType) -> FieldType:
        if isinstance(t, T.ArrayType):
            return ArrayOf(kind(t.elementType))
        if isinstance(t, T.StructType):
            return ObjectOf(tuple(Field(f.name, kind(f.dataType)) for f in t.fields))
        if t.simpleString() not in kinds:
            raise SchemaError(f"no field type for {t.simpleString()}")
        return kinds[t.simpleString()]

    return TableSchema(name, 1, tuple(Field(f.name, special.get(f.name) or kind(f.dataType)) for f in df.schema.fields if f.name != "_key"))
