"""Cross-polytope hashing of unit vectors.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a vector; its hash is the
nearest of the 2*D signed axes. A cell is one such hash or the concatenation of two, the second one read from the first ``tail``
coordinates only, which sets how fine the cells are. Several independently rotated tables and further probes of
near-by axes make up for the chance of missing a neighbour in one cell.
"""

from __future__ import annotations

import numpy as np

#: Width up to which rotations are kept as matrices.
DENSE = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast orthonormal Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        step *= 2
    return x.reshape(n, d) * np.float32(1 / np.sqrt(d))


def width_of(dimensions: int) -> int:
    """The power of two that vectors are padded to."""
    return 1 << max(1, (dimensions - 1).bit_length())


class CrossPolytope:
    """Hash functions for vectors of one length; equal parameters give equal functions on every machine.

    With ``tail`` 0 a cell is one signed axis.
    """

    def __init__(self, dimensions: int, tables: int, tail: int | None = None, seed: int = 20):
        self.dimensions, self.tables = dimensions, tables
        self.width = width_of(dimensions)
        self.tail = min(self.width if tail is None else tail, self.width)
        random = np.random.default_rng([seed, dimensions])
        self.signs = random.choice(np.array([-1, 1], dtype=np.float32), size=(tables, 2, 3, self.width))
        self.cells = 2 * self.width * max(1, 2 * self.tail)
        self.hashes = (0, 1) if self.tail else (0,)
        # for narrow vectors a pseudo-rotation, carried out once on the unit vectors, is a matrix of which products are faster
        self.matrices = None
        if self.width <= DENSE:
            axes = np.eye(dimensions, dtype=np.float32)
            self.matrices = [[self._transformed(axes, t, w) for w in self.hashes] for t in range(tables)]

    def _transformed(self, units: np.ndarray, table: int, which: int) -> np.ndarray:
        x = np.zeros((len(units), self.width), dtype=np.float32)
        x[:, : self.dimensions] = units
        for sign in self.signs[table, which]:
            x = hadamard(x * sign)
        return x[:, : self.tail] if which else x

    def _rotated(self, units: np.ndarray, table: int, which: int) -> np.ndarray:
        return units @ self.matrices[table][which] if self.matrices else self._transformed(units, table, which)

    def cell(self, units: np.ndarray, table: int) -> np.ndarray:
        """The cell of each row in a table."""
        return self.probe(units, table, 1)[0][:, 0]

    def _axes(self, units: np.ndarray, table: int, which: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``probes`` nearest signed axes of each row, nearest first, and what each lies below the first."""
        x = self._rotated(units, table, which)
        height = np.abs(x)
        near = min(probes, x.shape[1])
        if near == 1:
            best = height.argmax(axis=1)[:, None]
        else:
            best = np.argpartition(-height, near - 1, axis=1)[:, :near] if near < x.shape[1] else np.broadcast_to(np.arange(near), x.shape)
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(height, best, 1), axis=1, kind="stable"), 1)
        top = np.take_along_axis(height, best, 1)
        return 2 * best.astype(np.int64) + (np.take_along_axis(x, best, 1) < 0), top[:, :1] - top

    def probe(self, units: np.ndarray, table: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``probes`` nearest cells of each row, nearest first, and what each loses in height against the first (of two
        hashes the root of the sum of squares)."""
        first, lost = self._axes(units, table, 0, probes)
        if not self.tail:
            return first, lost
        second, more = self._axes(units, table, 1, probes)
        loss = np.sqrt(lost[:, :, None] ** 2 + more[:, None, :] ** 2).reshape(len(units), -1)
        cells = (first[:, :, None] * (2 * self.tail) + second[:, None, :]).reshape(len(units), -1)
        keep = min(probes, loss.shape[1])
        order = np.argsort(loss, axis=1, kind="stable")[:, :keep]
        return np.take_along_axis(cells, order, 1), np.take_along_axis(loss, order, 1)


def units_of(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in single precision; all-zero rows stay zero."""
    wide = vectors.astype(np.float64)
    largest = np.abs(wide).max(axis=1, keepdims=True) if wide.size else np.ones((len(wide), 1))
    wide = wide / np.where(largest == 0, 1, largest)
    norm = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return (wide / np.where(norm == 0, 1, norm)).astype(np.float32)
