"""Checks a parsed statement against a schema and runs it on a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold import predicate as P
from stratafold.functions import vector
from stratafold.schema import ArrayOf, BoundedString, FieldType, Primitive, SchemaError, TableSchema, VectorOf
from stratafold.sql import parser as S
from stratafold.sql.parser import SqlError

_FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_NODES = {"=": P.Eq, "!=": P.Ne, "<": P.Lt, "<=": P.Lte, ">": P.Gt, ">=": P.Gte}


@dataclass(frozen=True)
class VectorDistance:
    field: str
    parameter: int
    metric: str


@dataclass(frozen=True)
class OrderKey:
    of: str | VectorDistance
    descending: bool


@dataclass(frozen=True)
class SqlQuery:
    """A checked statement. ``Parameter`` nodes stand in the predicate until it is executed."""

    table: str
    projections: tuple[str, ...]
    aliases: dict[str, str]
    columns: tuple[tuple[str, str], ...]
    predicate: P.Predicate | None
    order: tuple[OrderKey, ...]
    limit: int | None
    offset: int | None
    parameters: int
    schema: TableSchema

    @property
    def vector_distance(self) -> VectorDistance | None:
        return next((k.of for k in reversed(self.order) if isinstance(k.of, VectorDistance)), None)


class _Translator:
    def __init__(self, schema: TableSchema, strict: bool):
        self.schema, self.strict = schema, strict

    def field(self, name: S.Name) -> FieldType:
        try:
            return self.schema.field(name.name).type
        except SchemaError as e:
            raise SqlError(str(e), name.at) from None

    def value(self, field: S.Name, operand: Any) -> Any:
        kind = self.field(field)
        if isinstance(operand, S.Parameter):
            return operand
        if not isinstance(operand, S.Literal):
            raise SqlError("a column is compared with a value", field.at)
        if not P.fits(kind, operand.value):
            raise SqlError(f"{field.name} is {kind}, which {operand.value!r} cannot be compared with", field.at)
        return operand.value

    def condition(self, node: Any) -> P.Predicate:
        if isinstance(node, S.Junction):
            return (P.And if node.operator == "AND" else P.Or)(tuple(self.condition(p) for p in node.parts))
        if isinstance(node, S.Compare):
            left, right, operator = node.left, node.right, node.operator
            if not isinstance(left, S.Name):
                left, right, operator = right, left, _FLIPPED[operator]
            if not isinstance(left, S.Name) or isinstance(right, (S.Name, S.Call)):
                raise SqlError("a comparison has one column and one value", node.at)
            return _NODES[operator](left.name, self.value(left, right))
        if isinstance(node, S.Range):
            if not isinstance(node.of, S.Name):
                raise SqlError("BETWEEN is for columns", node.at)
            low, high = self.value(node.of, node.low), self.value(node.of, node.high)
            if not isinstance(low, S.Parameter) and not isinstance(high, S.Parameter) and low > high:
                raise SqlError(f"BETWEEN {low!r} AND {high!r} is empty", node.at)
            return P.Between(node.of.name, low, high)
        if isinstance(node, S.Call):
            if node.name != "MATCH":
                raise SqlError(f"{node.name} is no condition", node.at)
            if len(node.arguments) != 2 or not isinstance(node.arguments[0], S.Name) or not (isinstance(node.arguments[1], S.Parameter) or isinstance(getattr(node.arguments[1], "value", None), str)):
                raise SqlError("MATCH takes a column and a term", node.at)
            name, term = node.arguments
            if not (isinstance(self.field(name), BoundedString) or self.field(name) == Primitive("STRING")):
                raise SqlError(f"MATCH: {name.name} is no text", node.at)
            return P.FullTextMatch(name.name, term if isinstance(term, S.Parameter) else term.value)
        if self.strict:
            raise SqlError(f"{'NOT' if isinstance(node, S.Negation) else 'IS NULL'} is not supported", node.at)
        if isinstance(node, S.Negation):
            return P.Not(self.condition(node.of))
        if not isinstance(node.of, S.Name):
            raise SqlError("IS NULL is for columns", node.at)
        self.field(node.of)
        return P.IsNull(node.of.name, node.negated)

    def key(self, key: S.Key) -> OrderKey:
        if isinstance(key.of, S.Name):
            self.field(key.of)
            return OrderKey(key.of.name, key.descending)
        call = key.of
        if call.name != "VECTOR_DISTANCE":
            raise SqlError(f"{call.name} cannot be ordered by", call.at)
        if len(call.arguments) != 3 or not isinstance(call.arguments[0], S.Name) or not isinstance(call.arguments[1], S.Parameter):
            raise SqlError("VECTOR_DISTANCE takes a column, a parameter and a metric", call.at)
        name, query, metric = call.arguments
        kind = self.field(name)
        element = kind.element if isinstance(kind, (VectorOf, ArrayOf)) else None
        if element not in (Primitive("FLOAT16"), Primitive("FLOAT32")):
            raise SqlError(f"VECTOR_DISTANCE: {name.name} is no vector", call.at)
        if getattr(metric, "value", None) not in vector.METRICS:
            raise SqlError(f"VECTOR_DISTANCE: the metric is one of {', '.join(vector.METRICS)}", call.at)
        return OrderKey(VectorDistance(name.name, query.index, metric.value), key.descending)


def translate(statement: str | S.Select, schema: TableSchema, strict: bool = True) -> SqlQuery:
    """A statement checked against a schema. ``strict`` refuses NOT and IS NULL, as the dialect's origin does."""
    select = S.parse(statement) if isinstance(statement, str) else statement
    t = _Translator(schema, strict)
    for item in select.items:
        t.field(item.of)
    where = t.condition(select.where) if select.where is not None else None
    columns = tuple((i.of.name, i.alias or i.of.name) for i in select.items)
    return SqlQuery(
        select.table, tuple(c for c, _ in columns), {c: a for c, a in columns if a != c}, columns, where,
        tuple(map(t.key, select.order)), select.limit, select.offset, select.parameters, schema,
    )


def _bound(p: Any, values: Sequence[Any]) -> Any:
    """The predicate with parameters replaced by their values."""
    put = lambda v: values[v.index] if isinstance(v, S.Parameter) else v
    if isinstance(p, (P.And, P.Or)):
        return type(p)(tuple(_bound(x, values) for x in p.parts))
    if isinstance(p, P.Not):
        return P.Not(_bound(p.part, values))
    if isinstance(p, P.Comparison):
        return type(p)(p.field, put(p.value))
    if isinstance(p, P.Between):
        return P.Between(p.field, put(p.low), put(p.high))
    if isinstance(p, P.FullTextMatch):
        return P.FullTextMatch(p.field, put(p.term), p.analyse)
    return p


def execute(query: str | SqlQuery, df: DataFrame, schema: TableSchema | None = None, parameters: Sequence[Any] = (), strict: bool = True, key: str = "_key", run: Callable[[P.Predicate], DataFrame] | None = None) -> DataFrame:
    """Run a statement on ``df``; ``run`` is how a table selects rows, with its indexes.

    Sorting comes before the projection, so unselected columns can be ordered by; nulls come last either way. The keys
    apply in the order written, distances among them. Rows that tie are in no defined order.
    """
    if isinstance(query, str):
        if schema is None:
            raise SqlError("a statement needs a schema")
        query = translate(query, schema, strict)
    if len(parameters) != query.parameters:
        raise SqlError(f"{query.parameters} parameters are wanted, {len(parameters)} given")
    if query.predicate is not None:
        bound = _bound(query.predicate, parameters)
        df = run(bound) if run else P.select(df, bound, query.schema, key)
    if query.order:

        def order(k: OrderKey) -> Column:
            of = F.col(k.of) if isinstance(k.of, str) else vector.distance_fixed(F.col(k.of.field), parameters[k.of.parameter], k.of.metric)
            return of.desc_nulls_last() if k.descending else of.asc_nulls_last()

        df = df.orderBy(*map(order, query.order))
    if query.offset:
        df = df.offset(query.offset)
    if query.limit is not None:
        df = df.limit(query.limit)
    return df.select(*[F.col(c).alias(a) for c, a in query.columns]) if query.columns else df
