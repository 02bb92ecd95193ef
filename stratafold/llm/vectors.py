"""Usable vectors, their cells, and the cutting of crowded cells into chunks; shared by nearest and clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold import storage
from stratafold.llm.polytope import CrossPolytope, units_of

#: Rows of a cell that one comparison block holds.
CHUNK = 2048


def field_dimensions(fields: DataFrame) -> dict[str, int]:
    """Dimensions by field: the catalogue of vector types, a table of one row for each declared field."""
    rows = fields.where("field_name IS NOT NULL AND dimensions > 0").groupBy("field_name").agg(F.max("dimensions").alias("dimensions")).orderBy("field_name").collect()
    return {r.field_name: r.dimensions for r in rows}


def usable(df: DataFrame, dims: dict[str, int], key: str, vector: str, removed: str | None, latest: str, extra: str | None = None, purpose: str = "vectors") -> DataFrame:
    """(id, field_no, extra, vec), written, of the rows whose vector has its field's length and only finite elements.

    Null ids and removed rows are left out. Of several usable rows of an id the latest holds (ties: the greatest vector).
    """
    number = F.lit(None).cast("int")
    fits = F.lit(False)
    for i, (name, n) in enumerate(dims.items()):
        number = F.when(F.col("field_name") == name, F.lit(i)).otherwise(number)
        fits = fits | ((F.col("field_name") == name) & (F.size(vector) == n))
    # nulls are passed over by least and greatest, NaN counts as the greatest
    finite = F.forall(vector, lambda x: x.isNotNull()) & (F.array_max(vector) < F.lit(float("inf"))) & (F.array_min(vector) > F.lit(float("-inf")))
    keep = F.col(key).isNotNull() & F.col(vector).isNotNull() & fits & finite
    if removed:
        keep = keep & ~F.coalesce(F.col(removed), F.lit(False))
    value = F.struct(number.alias("field_no"), (F.col(extra) if extra else F.lit(0)).cast("int").alias("extra"), F.col(vector).cast("array<float>").alias("vec"))
    rows = df.where(keep).select(F.col(key).alias("id"), F.struct(F.col(latest).alias("at"), value.alias("v")).alias("r"))
    # only the rows of repeated ids need to meet; where Spark would broadcast these ids, the others are not shuffled
    scratch = storage.Scratch(df.sparkSession, purpose)
    repeated = scratch.keep(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    last = lambda some: some.groupBy("id").agg(F.max("r").alias("r"))
    if storage.broadcasts(repeated):
        one = rows.join(repeated, "id", "left_anti").select("id", "r").unionByName(last(rows.join(repeated, "id", "left_semi")))
    else:
        one = last(rows)
    return scratch.result(one.select("id", "r.v.*"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass(frozen=True)
class Cells:
    """How vectors are hashed: ``probes`` cells in each of ``tables``, of those at most ``loss`` lower than the first.
    All-zero vectors lie in no direction and so in no cell."""

    dims: tuple[int, ...]
    tables: int
    tail: int
    probes: int = 1
    loss: float = float("inf")

    def hashes(self) -> list[CrossPolytope]:
        return [CrossPolytope(d, self.tables, self.tail) for d in self.dims]

    def _each(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """For every field and table of every batch: its rows, their unit vectors, and row and number of each cell they lie in."""
        hashes = self.hashes()
        widest = max((h.cells for h in hashes), default=1)
        for batch in batches:
            numbers = batch.column("field_no").to_numpy(zero_copy_only=False)
            for no in np.unique(numbers):
                part = batch.take(pa.array(np.flatnonzero(numbers == no)))
                units = units_of(matrix(part.column("vec")))
                some = units.any(axis=1)
                for table in range(self.tables):
                    cells, losses = hashes[no].probe(units, table, self.probes)
                    row, nth = np.nonzero((losses <= self.loss) & some[:, None])
                    yield part, units, row, (int(no) * self.tables + table) * widest + cells[row, nth]

    def placed(self, vectors: DataFrame, with_vector: bool = True) -> DataFrame:
        """(cell, id, extra, vec): a row of (id, field_no, extra, vec) for each of its cells."""
        columns = [("cell", pa.int64()), ("id", pa.int64()), ("extra", pa.int32())] + ([("vec", pa.list_(pa.float32()))] if with_vector else [])
        arrow, each = pa.schema(columns), self._each

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, row, cell in each(batches):
                take = pa.array(row)
                out = [pa.array(cell), *(part.column(c).take(take) for c in arrow.names[1:])]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(out, arrow.types, strict=True)], schema=arrow)

        return vectors.mapInArrow(place, "cell bigint, id bigint, extra int" + (", vec array<float>" if with_vector else ""))

    def sketched(self, vectors: DataFrame) -> DataFrame:
        """(cell, id, sketch): as ``placed``, with the ``sketches`` of the vectors in their place."""
        arrow, each = pa.schema([("cell", pa.int64()), ("id", pa.int64()), ("sketch", pa.binary())]), self._each

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, units, row, cell in each(batches):
                yield pa.RecordBatch.from_arrays([pa.array(cell), part.column("id").take(pa.array(row)), sketch_column(units, row)], schema=arrow)

        return vectors.mapInArrow(place, "cell bigint, id bigint, sketch binary")

    def sizes(self, vectors: DataFrame) -> DataFrame:
        """(cell, n) of the cells that hold rows; every batch is counted before the shuffle."""
        arrow, each = pa.schema([("cell", pa.int64()), ("n", pa.int64())]), self._each

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, _, cell in each(batches):
                own, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], schema=arrow)

        return vectors.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def sketches(units: np.ndarray) -> np.ndarray:
    """A row of bytes for each unit vector: a step and the distance of what is kept from the vector, both in single precision,
    then each coordinate in steps as a signed byte."""
    step = np.maximum(np.abs(units).max(axis=1), np.float32(1e-30)) / np.float32(127)
    whole = np.rint(units / step[:, None]).astype(np.int8)
    kept = whole.astype(np.float64) * step[:, None].astype(np.float64)
    away = np.sqrt(((units.astype(np.float64) - kept) ** 2).sum(axis=1)) * (1 + 1e-6)
    return np.concatenate((np.stack((step, away.astype(np.float32)), axis=1).view(np.uint8), whole.view(np.uint8)), axis=1)


def sketch_column(units: np.ndarray, row: np.ndarray | None = None) -> pa.Array:
    """The ``sketches`` of unit vectors as a column, or of those of the given rows."""
    rows = sketches(units) if row is None else sketches(units)[row]
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def of_sketches(column: pa.ChunkedArray) -> tuple[np.ndarray, float]:
    """The vectors that sketches of equal lengths stand for, and the greatest distance of one from its unit vector."""
    listed = column.combine_chunks()
    listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
    offsets = np.frombuffer(listed.buffers()[1], dtype=np.int32)[listed.offset : listed.offset + len(listed) + 1]
    raw = np.frombuffer(listed.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(len(listed), -1)
    facts = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return raw[:, 8:].view(np.int8).astype(np.float32) * facts[:, :1], float(facts[:, 1].max())


def crowded(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(cell, chunks) of the cells with more than one chunk of rows."""
    return chunked(cells.groupBy("cell").agg(F.count("*").alias("n")), chunk)


def chunked(sizes: DataFrame, chunk: int) -> DataFrame:
    """(cell, chunks) of those of the cells (cell, n) with more than one chunk of rows."""
    return sizes.where(F.col("n") > chunk).select("cell", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))


def chunk_of(identity: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(identity, F.lit(7)), chunks).cast("int")


def grouped(df: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """``df`` shuffled by ``keys`` and ordered, so that mapInArrow sees each group as one run of rows."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def partitions_for(*written: tuple[DataFrame, float], bytes_each: int = 24 << 20) -> int:
    """Partitions for a shuffle that carries each written table so many times."""
    usual = int(written[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, sum(storage.spread(df, bytes_each, 1, times) for df, times in written))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal (integer) ``keys``, which may extend over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if a == b:
                continue
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def table_matrix(table: pa.Table) -> np.ndarray:
    return np.concatenate([matrix(c) for c in table.column("vec").chunks if len(c)])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that row of ``b`` in double precision; 0 where one is all zero."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dot, aa, bb = (a * b).sum(axis=1), (a * a).sum(axis=1), (b * b).sum(axis=1)
    size = np.sqrt(aa) * np.sqrt(bb)
    return np.where(size > 0, dot / np.where(size > 0, size, 1), 0.0)
