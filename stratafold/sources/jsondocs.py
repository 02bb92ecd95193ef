"""JSON documents and lines of JSON, in and out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.schema import Primitive, TableSchema

MAX_DEPTH, DEPTH_LIMIT = 256, 4096


class JsonError(ValueError):
    pass


def _pairs(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise JsonError("repeated key")
    if any(not k.strip() for k in out):
        raise JsonError("blank key")
    return out


def _constant(name: str) -> None:
    raise JsonError(f"{name} is no JSON")


def _deep(text: str) -> int:
    depth = most = 0
    quoted = escaped = False
    for ch in text:
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "[{":
            depth += 1
            most = max(most, depth)
        elif ch in "]}":
            depth -= 1
    return most


def parse_strict(text: str, max_depth: int = MAX_DEPTH) -> Any:
    """A JSON value; repeated or blank keys, numbers such as NaN, lone surrogates and deep nesting are refused."""
    if not 1 <= max_depth <= DEPTH_LIMIT:
        raise JsonError(f"depths are 1 to {DEPTH_LIMIT}")
    if text.count("[") + text.count("{") > max_depth and _deep(text) > max_depth:
        raise JsonError(f"nested deeper than {max_depth}")
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant)
        json.dumps(value, ensure_ascii=False).encode("utf-8")
    except (json.JSONDecodeError, UnicodeEncodeError, RecursionError) as e:
        raise JsonError(str(e)) from None
    return value


@F.pandas_udf(T.StringType())
def json_problem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What is wrong with each text as strict JSON; null where nothing is, and for null."""

    def problem(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            parse_strict(text)
        except JsonError as e:
            return str(e)
        return None

    for s in batches:
        yield s.map(problem, na_action="ignore").astype(object)


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def documents_from_json(df: DataFrame, column: str, schema: TableSchema, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The fields of a schema from a column of JSON objects, with ``keep`` beside them.

    Absent fields are null, keys that the schema lacks are passed over, and what does not fit a field's type is null;
    ``strict`` makes it an error instead. Timestamps are milliseconds of UTC.
    """
    plain = T.StructType([T.StructField(f.name, T.LongType() if f.type == Primitive("TIMESTAMP") else f.type.spark()) for f in schema.fields])
    row = F.from_json(F.col(column), plain, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("_doc")
    fields = []
    for f in schema.fields:
        value = F.col("_doc").getField(f.name)
        if f.type == Primitive("TIMESTAMP"):
            value = _epoch() + F.make_dt_interval(secs=value.cast("decimal(21,3)") / 1000)
        fields.append(value.alias(f.name))
    return df.select(*keep, row).select(*keep, *fields)


def _writable(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
    if isinstance(kind, T.TimestampNTZType):
        since = value - _epoch()
        days, rest = F.date_part(F.lit("DAY"), since).cast("bigint"), [F.date_part(F.lit(u), since) for u in ("HOUR", "MINUTE", "SECOND")]
        return ((days * 24 + rest[0]) * 60 + rest[1]) * 60_000 + (rest[2] * 1000).cast("bigint")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _writable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_writable(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return value


def documents_to_json(df: DataFrame, schema: TableSchema, pretty: bool = False) -> Column:
    """A column of JSON objects: the fields in the schema's order, nulls written, non-finite numbers as null."""
    row = F.struct(*[_writable(df[f.name], f.type.spark()).alias(f.name) for f in schema.fields])
    return F.to_json(row, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def read_lines(spark: SparkSession, path: str, schema: TableSchema, on_error: str = "FAIL_FAST", strict: bool = True) -> DataFrame:
    """Documents from files of one JSON value a line; blank lines are passed over.

    FAIL_FAST makes a line that is no (strict) JSON object an error, SKIP_ON_ERROR leaves it out.
    """
    if on_error not in ("FAIL_FAST", "SKIP_ON_ERROR"):
        raise ValueError(f"unknown mode {on_error}")
    lines = spark.read.text(path).where(F.trim("value") != "")
    if strict:
        lines = lines.withColumn("_problem", json_problem("value"))
        if on_error == "SKIP_ON_ERROR":
            lines = lines.where(F.col("_problem").isNull())
        else:
            lines = lines.withColumn("value", F.when(F.col("_problem").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no JSON: "), F.col("_problem")))))
    return documents_from_json(lines, "value", schema)


def problem_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, problem) of the lines of files that are no strict JSON; lines are counted from 1 in each file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).where(F.trim("value") != "")
    return lines.select("file", (F.col("line") + 1).alias("line"), json_problem("value").alias("problem")).where(F.col("problem").isNotNull())


def write_lines(df: DataFrame, schema: TableSchema, path: str) -> None:
    """Documents as files of one JSON object a line."""
    df.select(documents_to_json(df, schema).alias("value")).write.text(path)


@F.pandas_udf(T.BooleanType())
def json_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts hold the same JSON value: numbers by value, members in any order. Null where one is null or no JSON."""

    def read(text: str | None):
        return json.loads(text, parse_float=Decimal, parse_int=Decimal, object_pairs_hook=_pairs, parse_constant=_constant)

    def same(x: Any, y: Any) -> bool:
        if isinstance(x, bool) or isinstance(y, bool) or type(x) is not type(y):
            return x is y
        if isinstance(x, dict):
            return x.keys() == y.keys() and all(same(v, y[k]) for k, v in x.items())
        if isinstance(x, list):
            return len(x) == len(y) and all(map(same, x, y))
        return x == y

    def one(x: str | None, y: str | None) -> bool | None:
        try:
            return None if x is None or y is None else same(read(x), read(y))
        except ValueError:
            return None

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def member(column: Column, name: str) -> Column:
    """The value of a key of a JSON object as text; null where it is absent."""
    return F.get_json_object(column, f"$['{name}']")


def keys(column: Column) -> Column:
    """The keys of a JSON object."""
    return F.json_object_keys(column)


#: Kinds of numbers that a JSON value can be read as.
NUMBERS = {"int": "int", "long": "bigint", "double": "double", "decimal": "decimal(38,10)"}


def number_at(column: Column, kind: str, path: str = "$", strict: bool = False) -> Column:
    """The JSON number at a path as int, long, double or decimal. What is no number, has a fraction where whole numbers are wanted or is out of
    range gives null, or with ``strict`` an error; an absent value is null either way."""
    if kind not in NUMBERS:
        raise ValueError(f"unknown kind {kind}")
    value = F.try_parse_json(column)
    at = F.try_variant_get(value, path, "variant")
    exact = F.try_variant_get(value, path, "decimal(38,10)")
    fits = F.schema_of_variant(at).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    if kind in ("int", "long"):
        fits = fits & (exact == F.floor(exact))
    found = F.when(fits, F.try_variant_get(value, path, NUMBERS[kind]))
    wrong = F.schema_of_variant(at) != "VOID"
    return F.when(found.isNull() & wrong, F.raise_error(F.concat(F.lit(f"{path} is no {kind}: "), at.cast("string")))).otherwise(found) if strict else found


def text_at(column: Column, path: str = "$") -> Column:
    """The JSON string at a path; null for values of other kinds."""
    at = F.try_variant_get(F.try_parse_json(column), path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", at.cast("string"))


def boolean_at(column: Column, path: str = "$") -> Column:
    """The JSON boolean at a path; null for values of other kinds."""
    at = F.try_variant_get(F.try_parse_json(column), path, "variant")
    return F.when(F.schema_of_variant(at) == "BOOLEAN", at.cast("boolean"))


def elements_at(column: Column, path: str = "$") -> Column:
    """The elements of the JSON array at a path, each as JSON text; null for values of other kinds."""
    return F.transform(F.try_variant_get(F.try_parse_json(column), path, "array<variant>"), lambda x: F.to_json(x))


def array_size(column: Column, path: str = "$") -> Column:
    """The number of elements of the JSON array at a path; null for values of other kinds."""
    return F.nullif(F.size(elements_at(column, path)), F.lit(-1))


def array_get(column: Column, index: int, path: str = "$") -> Column:
    """An element, counted from 0, of the JSON array at a path as JSON text; null beyond its end and for values of other kinds."""
    return F.get(elements_at(column, path), index)


def array_stream(df: DataFrame, column: str, *keep: str, path: str = "$") -> DataFrame:
    """A row (keep, at, element) for every element of the JSON arrays of a column, in their order."""
    return df.select(*keep, F.posexplode(elements_at(F.col(column), path)).alias("at", "element"))
