"""The predicate tree: eight scalar comparisons, term match, nearest vectors, and the two connectives.

Scalar nodes become one boolean column, which Catalyst pushes down. A nearest-vectors node stands for the set of keys
of the best rows of the whole table, so it is evaluated on its own and enters the tree as membership in that set.
Null never matches, not even ``Ne``. Values and columns of different numeric types compare by value.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.crypto import FieldCipher
from stratafold.functions import text, vector
from stratafold.schema import ArrayOf, BoundedString, FieldType, Primitive, SchemaError, TableSchema, VectorOf


class PredicateError(ValueError):
    """A predicate that does not fit the table."""


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))


@dataclass(frozen=True)
class Comparison(Predicate):
    field: str
    value: Any


class Eq(Comparison):
    pass


class Ne(Comparison):
    pass


class Gt(Comparison):
    pass


class Gte(Comparison):
    pass


class Lt(Comparison):
    pass


class Lte(Comparison):
    pass


@dataclass(frozen=True)
class Between(Predicate):
    """Both ends included."""

    field: str
    low: Any
    high: Any


@dataclass(frozen=True)
class FullTextMatch(Predicate):
    """Rows whose ``field`` has the token ``term``. The term is taken as it is; with ``analyse`` it is tokenised, and all
    of its tokens must occur."""

    field: str
    term: str
    analyse: bool = False


@dataclass(frozen=True)
class VectorNearest(Predicate):
    """The ``top_k`` rows of the table that are most similar to ``query``."""

    field: str
    query: tuple[float, ...]
    top_k: int
    metric: str = "cosine"

    def __post_init__(self) -> None:
        if self.top_k < 1:
            raise PredicateError("top_k begins at 1")


@dataclass(frozen=True)
class _Many(Predicate):
    parts: tuple[Predicate, ...]

    def __post_init__(self) -> None:
        if len(self.parts) < 2:
            raise PredicateError(f"{type(self).__name__} joins two predicates or more")


class And(_Many):
    pass


class Or(_Many):
    pass


@dataclass(frozen=True)
class Not(Predicate):
    """An extension of the lenient SQL dialect; like every node it is false where its field is null."""

    part: Predicate


@dataclass(frozen=True)
class IsNull(Predicate):
    """An extension of the lenient SQL dialect."""

    field: str
    negated: bool = False


_OPERATORS = {Eq: Column.__eq__, Ne: Column.__ne__, Gt: Column.__gt__, Gte: Column.__ge__, Lt: Column.__lt__, Lte: Column.__le__}
_WHOLE = {"INT8": 7, "INT16": 15, "INT32": 31, "INT64": 63}


def fits(kind: FieldType, value: Any) -> bool:
    """Whether a literal may be compared with a field of this type."""
    if isinstance(kind, BoundedString):
        return isinstance(value, str)
    if not isinstance(kind, Primitive):
        return False
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind.name == "STRING":
        return isinstance(value, str)
    if kind.name == "BOOLEAN":
        return isinstance(value, bool)
    if kind.name == "TIMESTAMP":
        return number or isinstance(value, (str, dt.datetime))
    if kind.name in _WHOLE:
        return number and -(1 << _WHOLE[kind.name]) <= value < 1 << _WHOLE[kind.name]
    return number


def literal(kind: FieldType, value: Any) -> Column:
    """A literal for comparison with a field; numbers against a timestamp are milliseconds of UTC."""
    if isinstance(kind, Primitive) and kind.name == "TIMESTAMP":
        if isinstance(value, (int, float)):
            value = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value)
        return F.lit(value).cast("timestamp_ntz")
    return F.lit(value)


def check(p: Predicate, schema: TableSchema) -> None:
    """Raise unless every node names a field that it can be applied to."""
    if isinstance(p, (And, Or)):
        for part in p.parts:
            check(part, schema)
        return
    if isinstance(p, Not):
        check(p.part, schema)
        return
    try:
        kind = schema.field(p.field).type
    except SchemaError as e:
        raise PredicateError(str(e)) from None
    if isinstance(p, IsNull):
        return
    if isinstance(p, FullTextMatch):
        if not (isinstance(kind, BoundedString) or kind == Primitive("STRING")):
            raise PredicateError(f"{p.field} is no text")
    elif isinstance(p, VectorNearest):
        if not isinstance(kind, (VectorOf, ArrayOf)):
            raise PredicateError(f"{p.field} is no vector")
        if isinstance(kind, VectorOf) and len(p.query) != kind.dimensions:
            raise PredicateError(f"{p.field} has {kind.dimensions} dimensions, the query {len(p.query)}")
    else:
        for value in (p.low, p.high) if isinstance(p, Between) else (p.value,):
            if not fits(kind, value):
                raise PredicateError(f"{p.field} is {kind}, which {value!r} cannot be compared with")
        if isinstance(p, Between) and type(p.low) is type(p.high) and p.low > p.high:
            raise PredicateError(f"between {p.low!r} and {p.high!r} is empty")


def nearest_nodes(p: Predicate) -> list[VectorNearest]:
    if isinstance(p, VectorNearest):
        return [p]
    parts = p.parts if isinstance(p, (And, Or)) else [p.part] if isinstance(p, Not) else []
    return list(dict.fromkeys(n for part in parts for n in nearest_nodes(part)))


def leaves(p: Predicate) -> list[Predicate]:
    """The comparisons, matches and nearest sets of a tree, each once."""
    parts = p.parts if isinstance(p, (And, Or)) else [p.part] if isinstance(p, Not) else []
    return list(dict.fromkeys(n for part in parts for n in leaves(part))) if parts else [p]


def on_ciphertext(p: Predicate, cipher: FieldCipher, stored: Column) -> Column | None:
    """A comparison told from ciphertexts; None where the field's scheme does not allow it."""
    if isinstance(p, Eq):
        return cipher.equal(stored, p.value)
    if isinstance(p, Ne):
        same = cipher.equal(stored, p.value)
        return None if same is None else ~same
    if isinstance(p, Between):
        return cipher.between(stored, p.low, p.high)
    if isinstance(p, (Gt, Gte)):
        return cipher.between(stored, low=p.value, open_low=isinstance(p, Gt))
    return cipher.between(stored, high=p.value, open_high=isinstance(p, Lt)) if isinstance(p, (Lt, Lte)) else None


def column(p: Predicate, schema: TableSchema, members: dict[Predicate, Column] | None = None, ciphers: dict[str, tuple[FieldCipher, str]] | None = None) -> Column:
    """The predicate as a boolean column; ``members`` says how membership in each nearest set, and in what an index found, is
    told, ``ciphers`` which fields are compared as ciphertexts and in which columns these are."""
    if isinstance(p, (And, Or)):
        out = column(p.parts[0], schema, members, ciphers)
        for part in p.parts[1:]:
            out = out & column(part, schema, members, ciphers) if isinstance(p, And) else out | column(part, schema, members, ciphers)
        return out
    if isinstance(p, Not):
        return ~column(p.part, schema, members, ciphers)
    if members and p in members:
        return members[p]
    if isinstance(p, VectorNearest):
        raise PredicateError("nearest vectors are a set of rows, no condition on one row")
    if ciphers and p.field in ciphers and (told := on_ciphertext(p, ciphers[p.field][0], F.col(ciphers[p.field][1]))) is not None:
        return told
    if isinstance(p, IsNull):
        return F.col(p.field).isNotNull() if p.negated else F.col(p.field).isNull()
    if isinstance(p, FullTextMatch):
        words = text.tokens(F.col(p.field))
        if not p.analyse:
            return F.array_contains(words, p.term)
        wanted = text.tokens(F.lit(p.term))
        return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, words)) == 0)
    kind = schema.field(p.field).type
    if isinstance(p, Between):
        return F.col(p.field).between(literal(kind, p.low), literal(kind, p.high))
    return _OPERATORS[type(p)](F.col(p.field), literal(kind, p.value))


def nearest_keys(df: DataFrame, p: VectorNearest, key: str) -> DataFrame:
    """Keys of the rows most similar to the query; ties by key, rows without a usable vector left out."""
    return vector.top_k(df, key, p.field, p.query, p.top_k, p.metric).select(key)


def select(df: DataFrame, p: Predicate, schema: TableSchema, key: str = "_key", lookups: dict[Predicate, DataFrame] | None = None, ciphers: dict[str, tuple[FieldCipher, str]] | None = None) -> DataFrame:
    """The rows of ``df`` that match. ``lookups`` has the keys of the rows that some of the leaves select, found by indexes."""
    check(p, schema)
    found = {n: keys for n in leaves(p) if (keys := (lookups or {}).get(n)) is not None}
    found |= {n: nearest_keys(df, n, key) for n in nearest_nodes(p) if n not in found}
    if not found:
        return df.where(column(p, schema, None, ciphers))
    if p in found:
        return df.join(found[p].select(key), key, "left_semi").select(*df.columns)
    marked, members = df, {}
    for i, (node, keys) in enumerate(found.items()):
        mark = f"_found_{i}"
        marked = marked.join(keys.select(key, F.lit(True).alias(mark)), key, "left")
        members[node] = F.coalesce(F.col(mark), F.lit(False))
    return marked.where(column(p, schema, members, ciphers)).select(*df.columns)
