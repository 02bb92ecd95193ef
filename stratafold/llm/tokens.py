"""Encoding texts with a public byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern into pieces; each piece is merged over a segment tree whose leaves are
its byte positions and whose nodes hold the leftmost minimum of (rank of the pair that starts there, position). A
merge takes the root, removes the right partner from the linked list of live symbols and updates the three leaves
concerned, each along one path to the root. Pieces that are new to a task are merged together, one tree a row of a
matrix; very long ones one by one. Every piece is merged once as long as a bounded table remembers it.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that the vocabulary's pieces are cut by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that a task remembers, and the characters of text it takes in hand at once.
REMEMBERED = 250_000
SLICE_CHARS = 1 << 20
#: Width from which a piece gets a tree of plain lists.
_WIDE = 128
_NONE = np.int64(2**62)


class Merges:
    """Ranks of the pairs of a vocabulary. Ids of symbols are their ranks; a pair's rank is that of the joined bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.ranks = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], 0)
        first = np.full(256 * 256, -1, dtype=np.int64)
        at = np.full(max(ranks.values()) + 1, -1, dtype=np.int64)
        at[self.byte_ids] = np.arange(256)
        for key, rank in pairs.items():
            left, right = at[key >> 20], at[key & 0xFFFFF]
            if left >= 0 and right >= 0:
                first[left * 256 + right] = rank
        self.of_bytes = first

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has none."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def _merge_rows(merges: Merges, pieces: list[bytes], width: int) -> list[np.ndarray]:
    """Merges pieces of at most ``width`` bytes (a power of two), one segment tree a row."""
    m = len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
    raw = np.zeros((m, width + 2), dtype=np.int64)
    filled = np.arange(width) < lengths[:, None]
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    raw[:, :width][filled] = flat
    leaves = np.full((m, width), _NONE)
    both = np.arange(1, width + 1) < lengths[:, None]
    first = merges.of_bytes[raw[:, :width][both] * 256 + raw[:, 1 : width + 1][both]]
    position = np.broadcast_to(np.arange(width), (m, width))[both]
    leaves[both] = np.where(first >= 0, first * width + position, _NONE)
    symbols = merges.byte_ids[raw]
    tree = np.empty((m, 2 * width), dtype=np.int64)
    tree[:, width:] = leaves
    level = width
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half
    tree[:, 0] = _NONE
    following = np.broadcast_to(np.arange(1, width + 2), (m, width + 1)).copy()
    previous = np.broadcast_to(np.arange(-1, width + 1), (m, width + 2)).copy()
    alive = filled.copy()
    row = np.arange(m)
    while True:
        root = tree[row, 1]
        row = row[root < _NONE]
        if not len(row):
            break
        root = tree[row, 1]
        at, rank = root % width, root // width
        gone = following[row, at]
        after = following[row, gone]
        symbols[row, at] = rank
        following[row, at] = after
        previous[row, after] = at
        alive[row, gone] = False
        before = previous[row, at]
        end = lengths[row]
        right = np.where(after < end, merges.rank(rank, symbols[row, np.minimum(after, width)]), -1)
        tree[row, width + at] = np.where(right >= 0, right * width + at, _NONE)
        tree[row, width + gone] = _NONE
        has = before >= 0
        r, b = row[has], before[has]
        left = merges.rank(symbols[r, b], rank[has])
        tree[r, width + b] = np.where(left >= 0, left * width + b, _NONE)
        rows = np.concatenate((row, row, r))
        node = np.concatenate((width + at, width + gone, width + b)) >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1
    kept = symbols[:, :width][alive].astype(np.int32)
    return np.split(kept, np.cumsum(alive.sum(axis=1))[:-1])


def _merge_one(merges: Merges, piece: bytes) -> np.ndarray:
    """Merges one long piece over a segment tree in flat arrays, which take up to 64 bytes for each of the piece."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    none = 2**62
    pairs = merges.pairs
    ids = merges.byte_ids[np.frombuffer(piece, dtype=np.uint8)].astype(np.int64)
    built = np.full(2 * width, none, dtype=np.int64)
    rank = merges.rank(ids[:-1], ids[1:])
    built[width : width + n - 1] = np.where(rank >= 0, rank * width + np.arange(n - 1), none)
    level = width
    while level > 1:
        half = level // 2
        built[half:level] = np.minimum(built[level : 2 * level : 2], built[level + 1 : 2 * level : 2])
        level = half
    flat = lambda x: array("q", x.astype(np.int64).tobytes())
    tree, symbols, following, previous = flat(built), flat(ids), flat(np.arange(1, n + 1)), flat(np.arange(-1, n))
    del built
    alive = bytearray(b"\1") * n

    def set_leaf(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while tree[1] < none:
        rank, at = divmod(tree[1], width)
        gone = following[at]
        after = following[gone]
        symbols[at] = rank
        following[at] = after
        alive[gone] = 0
        set_leaf(gone, none)
        next_rank = None
        if after < n:
            previous[after] = at
            next_rank = pairs.get(rank << 20 | symbols[after])
        set_leaf(at, none if next_rank is None else next_rank * width + at)
        before = previous[at]
        if before >= 0:
            left = pairs.get(symbols[before] << 20 | rank)
            set_leaf(before, none if left is None else left * width + before)
    return np.array([s for s, a in zip(symbols, alive, strict=True) if a], dtype=np.int32)


def merge_pieces(merges: Merges, pieces: list[bytes]) -> list[np.ndarray]:
    """The ids of each piece."""
    out: list[np.ndarray | None] = [None] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        by_width.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(i)
    for width, which in by_width.items():
        if width > _WIDE:
            for i in which:
                out[i] = _merge_one(merges, pieces[i])
            continue
        step = max(1, (1 << 21) // width)
        for a in range(0, len(which), step):
            part = which[a : a + step]
            for i, ids in zip(part, _merge_rows(merges, [pieces[i] for i in part], width), strict=True):
                out[i] = ids
    return out


class Encoder:
    """Encodes texts; remembers the ids of up to ``remembered`` distinct pieces and then begins anew."""

    def __init__(self, path: str = VOCABULARY, remembered: int = REMEMBERED):
        self.merges = Merges(path)
        self.cut = regex.compile(PATTERN).findall
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.empty(1 << 20, dtype=np.int32)
        self.used = 0
        self.start = np.empty(1 << 16, dtype=np.int64)
        self.length = np.empty(1 << 16, dtype=np.int64)

    def _learn(self, fresh: list[str]) -> None:
        ids = merge_pieces(self.merges, [p.encode("utf-8", "replace") for p in fresh])
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        total, first = int(sizes.sum()), len(self.known)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        while first + len(fresh) > len(self.start):
            self.start = np.concatenate((self.start, np.empty_like(self.start)))
            self.length = np.concatenate((self.length, np.empty_like(self.length)))
        ends = self.used + np.cumsum(sizes)
        self.start[first : first + len(fresh)] = ends - sizes
        self.length[first : first + len(fresh)] = sizes
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        self.used += total
        self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def _pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts in a row, and the number of pieces of each text."""
        cut = [self.cut(t) if t else () for t in texts]
        counts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        if len(self.known) > self.remembered:
            self._forget()
        fresh = set().union(*cut) - self.known.keys() if cut else set()
        if fresh:
            self._learn(list(fresh))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(counts.sum())), counts

    @staticmethod
    def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(values)))
        ends = np.cumsum(counts)
        return upto[ends] - upto[ends - counts]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        which, counts = self._pieces(texts)
        return self._per_text(self.length[which], counts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each text."""
        which, counts = self._pieces(texts)
        sizes = self.length[which]
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(self.start[which] - begin, sizes)
        at += np.arange(len(at))
        return self.pool[at], self._per_text(sizes, counts)


def strings(column: pa.Array) -> list[str | None]:
    """The column as Python strings; bytes that are no UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_CHARS bytes of text; a longer text is a range of its own."""
    sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    part = np.cumsum(sizes) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every text, without special tokens; an empty list for empty and for null texts.

    Strings that spell special tokens are ordinary text. ``vocabulary`` is a file of ranks that every executor can read.
    Rows, keys of null included, stay as many as they are; further columns play no part.
    """
    arrow = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for a, b in _slices(batch.column("text")):
                ids, sizes = encoder.encode(strings(batch.column("text").slice(a, b - a)))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], schema=arrow)

    return documents.select(documents[key].cast("bigint").alias(key), documents[text].cast("string").alias("text")).mapInArrow(run, f"`{key}` bigint, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens): the number of ids of every text; none for empty and null texts."""
    arrow = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for a, b in _slices(batch.column("text")):
                sizes = encoder.count(strings(batch.column("text").slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), pa.array(sizes)], schema=arrow)

    return documents.select(documents[key].cast("bigint").alias(key), documents[text].cast("string").alias("text")).mapInArrow(run, f"`{key}` bigint, n_tokens bigint")
