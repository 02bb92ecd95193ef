"""The fluent query builder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from stratafold import predicate as P
from stratafold.schema import TableSchema


class Clause:
    """A field that waits for its comparison."""

    def __init__(self, query: Query, field: str, join: type | None):
        self._query, self._field, self._join = query, field, join

    def _done(self, p: P.Predicate) -> Query:
        q = self._query
        return Query(q.df, q.schema, q.key, q.run, p if self._join is None or q.tree is None else self._join((q.tree, p)))

    def eq(self, value: Any) -> Query:
        return self._done(P.Eq(self._field, value))

    def ne(self, value: Any) -> Query:
        return self._done(P.Ne(self._field, value))

    def gt(self, value: Any) -> Query:
        return self._done(P.Gt(self._field, value))

    def gte(self, value: Any) -> Query:
        return self._done(P.Gte(self._field, value))

    def lt(self, value: Any) -> Query:
        return self._done(P.Lt(self._field, value))

    def lte(self, value: Any) -> Query:
        return self._done(P.Lte(self._field, value))

    def between(self, low: Any, high: Any) -> Query:
        return self._done(P.Between(self._field, low, high))

    def full_text_match(self, term: str, analyse: bool = False) -> Query:
        return self._done(P.FullTextMatch(self._field, term, analyse))

    def vector_nearest(self, query: Sequence[float], top_k: int, metric: str = "cosine") -> Query:
        return self._done(P.VectorNearest(self._field, tuple(float(x) for x in query), top_k, metric))


class Query:
    """Conditions joined from left to right: ``where(a).eq(1).or_("b").gt(2).and_("c").eq(3)`` is ((a or b) and c).

    Without a condition it selects nothing. Results have no order.
    """

    def __init__(self, df: DataFrame, schema: TableSchema, key: str = "_key", run: Callable[[P.Predicate], DataFrame] | None = None, tree: P.Predicate | None = None):
        """``run`` is how a table selects rows, with its indexes; without it ``df`` is scanned."""
        self.df, self.schema, self.key, self.run, self.tree = df, schema, key, run, tree

    def where(self, field: str) -> Clause:
        if self.tree is not None:
            raise P.PredicateError("where comes first; go on with and_ or or_")
        return Clause(self, field, None)

    def and_(self, field: str) -> Clause:
        return Clause(self, field, P.And)

    def or_(self, field: str) -> Clause:
        return Clause(self, field, P.Or)

    def predicate(self) -> P.Predicate | None:
        return self.tree

    def execute(self) -> DataFrame:
        if self.tree is None:
            return self.df.limit(0)
        return self.run(self.tree) if self.run else P.select(self.df, self.tree, self.schema, self.key)
