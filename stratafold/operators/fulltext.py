"""Inverted indexes: terms of any type to the keys of their rows, and boolean search over analysed text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold import storage
from stratafold.functions import text

MAX_DEPTH = 64


class Search:
    """A node of a boolean full-text query."""

    def __and__(self, other: Search) -> Search:
        return Both(self, other)

    def __or__(self, other: Search) -> Search:
        return Either(self, other)

    def __sub__(self, other: Search) -> Search:
        return Without(self, other)


@dataclass(frozen=True)
class Term(Search):
    field: str
    term: str


@dataclass(frozen=True)
class Both(Search):
    left: Search
    right: Search


@dataclass(frozen=True)
class Either(Search):
    left: Search
    right: Search


@dataclass(frozen=True)
class Without(Search):
    """What the first finds and the second does not."""

    include: Search
    exclude: Search


def _terms(q: Search, depth: int = 1) -> list[Term]:
    if depth > MAX_DEPTH:
        raise ValueError(f"nested deeper than {MAX_DEPTH}")
    if isinstance(q, Term):
        return [q]
    a, b = (q.include, q.exclude) if isinstance(q, Without) else (q.left, q.right)
    return list(dict.fromkeys(_terms(a, depth + 1) + _terms(b, depth + 1)))


class TextIndex:
    """Postings (field, term, key) of analysed text.

    Stop words are taken out before stemming when a text is indexed, and after stemming when a term is asked for, so a term
    whose stem is a stop word finds nothing.
    """

    def __init__(self, postings: DataFrame, key: str, stop: frozenset[str] = frozenset(), stemmed: bool = False):
        self.postings, self.key, self.stop, self.stemmed = postings, key, stop, stemmed

    @staticmethod
    def build(df: DataFrame, key: str, *fields: str, stop: frozenset[str] = frozenset(), stemmed: bool = False) -> TextIndex:
        return TextIndex(text.postings(df, key, *fields, analyser=lambda c: text.analyse(c, stop, stemmed)), key, stop, stemmed)

    def write(self, path: str) -> TextIndex:
        """Store the postings ordered by term, so that a search reads the few row groups that can hold its terms. The key takes
        part in the ranges, so a term of very many rows fills several."""
        n = storage.spread(self.postings, 64 << 20)
        self.postings.repartitionByRange(n, "field", "term", self.key).sortWithinPartitions("field", "term", self.key).write.parquet(path)
        return TextIndex(self.postings.sparkSession.read.parquet(path), self.key, self.stop, self.stemmed)

    def updated(self, removed: DataFrame | None, added: DataFrame | None, *fields: str) -> TextIndex:
        """Postings without those of the keys in ``removed``, with those of the rows in ``added``."""
        out = self.postings
        if removed is not None:
            out = out.join(removed.select(self.key), self.key, "left_anti").select("field", "term", self.key)
        if added is not None:
            out = out.unionByName(TextIndex.build(added, self.key, *fields, stop=self.stop, stemmed=self.stemmed).postings)
        return TextIndex(out, self.key, self.stop, self.stemmed)

    def search(self, query: Search) -> DataFrame:
        """The keys that match. Only postings of the query's terms are read, and they are shuffled once."""
        terms = _terms(query)
        asked = {t: text.stem(t.term) if self.stemmed else t.term for t in terms}
        live = [t for t in terms if asked[t] not in self.stop]
        hit = lambda t: (F.col("field") == t.field) & (F.col("term") == asked[t])
        mark = {t: f"_t{i}" for i, t in enumerate(live)}
        wanted = F.lit(False)
        for t in live:
            wanted = wanted | hit(t)
        flags = [F.max(hit(t)).alias(mark[t]) for t in live] or [F.lit(False).alias("_none")]

        def matches(q: Search) -> Column:
            if isinstance(q, Term):
                return F.col(mark[q]) if q in mark else F.lit(False)
            if isinstance(q, Without):
                return matches(q.include) & ~matches(q.exclude)
            return matches(q.left) & matches(q.right) if isinstance(q, Both) else matches(q.left) | matches(q.right)

        return self.postings.where(wanted).groupBy(self.key).agg(*flags).where(matches(query)).select(self.key)


def term_index(df: DataFrame, key: str, column: str) -> DataFrame:
    """(term, key): the inverted index of a column of numbers, bytes or strings, or of arrays of them; nulls are not indexed."""
    many = df.schema[column].dataType.typeName() == "array"
    term = F.explode(F.array_distinct(column)) if many else F.col(column)
    return df.select(term.alias("term"), key).where(F.col("term").isNotNull()).distinct()


def positions(df: DataFrame, key: str, column: str, analyser: Callable[[Column], Column] = text.tokens) -> DataFrame:
    """(term, key, positions): where each term stands in each text, counted from 1 in rising order."""
    words = df.select(key, F.posexplode(analyser(F.col(column))).alias("at", "term"))
    return words.groupBy("term", key).agg(F.sort_array(F.collect_list(F.col("at") + 1)).alias("positions"))
