"""Long exact spans that texts share.

Two operators. ``duplicate_lines`` hashes normalised lines, groups the digests over all texts, keeps the earliest
occurrence and returns the others with their offsets. ``shared_spans`` finds every stretch of at least ``LEAST``
characters that occurs in another text, wherever it begins and ends; its units are cut by content, not by lines:
every window of ``LEAST`` characters belongs to the unit of the least hash of a ``GRAM``-character gram in it, so equal
windows belong to units of equal hash. Only units whose hash occurs in two texts or more go on; within a hash the
windows themselves are compared. A stretch shared by any number of texts costs as many rows as it has occurrences.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold import storage
from stratafold.llm.tokens import _slices, strings

LEAST, GRAM = 100, 32
#: Characters of the units of one hash that are compared inside a task; more are compared through a shuffle by window.
IN_TASK = 4_000_000
#: Copies of one line that one task joins with its first occurrence.
COPIES = 1_000_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, made = 1 << n.bit_length(), []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = made[0], made[1]
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the length of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def window_hashes(codes: np.ndarray, sizes: tuple[int, ...], base: int = _BASES[0]) -> list[np.ndarray]:
    """For each size a hash of every window of so many characters of ``codes``."""
    up, down = _power_tables(len(codes) + 1, base)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)))
    return [_mixed((total[n:] - total[:-n]) * down[: len(total) - n]) if len(codes) >= n else np.empty(0, dtype=np.uint64) for n in sizes]


def _least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    least, have = x, 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    n = len(x) - width + 1
    return np.minimum(least[:n], least[width - have : width - have + n])


def units(texts: list[str], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, hash) of every unit: runs of windows with one least gram hash."""
    codes, lengths = code_points(texts)
    if len(codes) < least:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty
    grams = window_hashes(codes, (gram,))[0]
    low = _least_in_window(grams, least - gram + 1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    begin = np.cumsum(lengths) - lengths
    inside = np.flatnonzero(owner[: len(low)] == owner[least - 1 :])
    if not len(inside):
        return inside, inside, inside, inside
    low, owner = low[inside], owner[inside]
    starts = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]))))
    ends = np.concatenate((starts[1:], [len(low)])) - 1
    text = owner[starts]
    return text, inside[starts] - begin[text], inside[ends] - begin[text], low[starts].view(np.int64)


_ANCHOR = pa.schema([("doc_id", pa.int64()), ("h", pa.int64())])


def _anchors(least: int, gram: int):
    """The distinct unit hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column("text")):
                ids = batch.column("doc_id").slice(a, b - a).to_numpy()
                text, _, _, h = units(strings(batch.column("text").slice(a, b - a)), least, gram)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.concatenate(([True], (text[1:] != text[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.empty(0, dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids[text[new]]), pa.array(h[new])], schema=_ANCHOR)

    return run


_UNIT = "h bigint, doc_id bigint, first bigint, around string"
_UNIT_ARROW = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("around", pa.string())])


def _units_with_text(least: int, gram: int):
    """The units of each text whose hash is among those it is said to share, with their characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column("text")):
                ids = batch.column("doc_id").slice(a, b - a).to_numpy()
                texts = strings(batch.column("text").slice(a, b - a))
                wanted = batch.column("hs").slice(a, b - a)
                of_text = np.repeat(np.arange(b - a), np.diff(wanted.offsets.to_numpy()))
                pair = np.dtype([("t", np.int64), ("h", np.int64)])
                asked = np.empty(len(of_text), dtype=pair)
                asked["t"], asked["h"] = of_text, wanted.flatten().to_numpy()
                text, first, last, h = units(texts, least, gram)
                there = np.empty(len(text), dtype=pair)
                there["t"], there["h"] = text, h
                keep = np.flatnonzero(np.isin(there, asked))
                around = [texts[t][i : j + least] for t, i, j in zip(text[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(ids[text[keep]]), pa.array(first[keep]), pa.array(around, type=pa.string())], schema=_UNIT_ARROW)

    return run


def _windows_of(around: list[str], least: int, bases: tuple[int, ...] = _BASES[:1]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(unit, offset, a hash for each base, place) of every window in the characters of units, and these characters."""
    codes, lengths = code_points(around)
    counts = lengths - least + 1
    unit = np.repeat(np.arange(len(around)), counts)
    offset = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (np.cumsum(lengths) - lengths)[unit] + offset
    return unit, offset, [window_hashes(codes, (least,), b)[0][place] for b in bases], place, codes


_RANGE = "doc_id bigint, span_start bigint, span_end bigint"
_RANGE_ARROW = pa.schema([("doc_id", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64())])


def _as_first(codes: np.ndarray, place: np.ndarray, group: np.ndarray, firsts: np.ndarray, least: int) -> np.ndarray:
    """Group numbers of windows, ordered by group, after those of equal hash were compared with the first of their group character by
    character: whatever differs from it gets groups of its own."""
    windows = np.lib.stride_tricks.sliding_window_view(codes, least)
    other = np.zeros(len(place), dtype=bool)
    for s in range(0, len(place), 1 << 16):
        part = slice(s, s + (1 << 16))
        other[part] = (windows[place[part]] != windows[place[firsts[group[part]]]]).any(axis=1)
    if other.any():
        named: dict[tuple[int, bytes], int] = {}
        group = group.copy()
        for i in np.flatnonzero(other):
            group[i] = named.setdefault((int(group[i]), windows[place[i]].tobytes()), len(firsts) + len(named))
    return group


def _compare(least: int):
    """Compares the windows of complete runs of equal ``h``; returns stretches of shared windows of each unit."""

    def compare(group: pa.Table) -> pa.RecordBatch:
        h, docs, first = (group.column(c).to_numpy() for c in ("h", "doc_id", "first"))
        unit, offset, (w,), place, codes = _windows_of(group.column("around").to_pylist(), least)
        order = np.lexsort((docs[unit], w, h[unit]))
        hu, ws, ds = h[unit][order], w[order], docs[unit][order]
        new = np.concatenate(([True], (hu[1:] != hu[:-1]) | (ws[1:] != ws[:-1])))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((starts, [len(ws)])))
        several = np.flatnonzero(np.repeat(ds[starts] != ds[starts + sizes - 1], sizes))
        # only what several documents seem to have is compared itself
        order, ds, number = order[several], ds[several], np.cumsum(new)[several] - 1
        firsts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else several
        number = np.searchsorted(number[firsts], number)
        exact = _as_first(codes, place[order], number, firsts, least)
        if exact is not number:
            again = np.lexsort((ds, exact))
            order, ds, exact = order[again], ds[again], exact[again]
        starts = np.flatnonzero(np.concatenate(([True], exact[1:] != exact[:-1]))) if len(exact) else several
        sizes = np.diff(np.concatenate((starts, [len(exact)])))
        shared = np.zeros(len(unit), dtype=bool)
        if len(starts):
            shared[order] = np.repeat(ds[starts] != ds[starts + sizes - 1], sizes)
        unit, offset = unit[shared], offset[shared]
        if not len(unit):
            return pa.RecordBatch.from_pylist([], schema=_RANGE_ARROW)
        cut = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (offset[1:] != offset[:-1] + 1))))
        end = np.concatenate((cut[1:], [len(unit)])) - 1
        u = unit[cut]
        return pa.RecordBatch.from_arrays([pa.array(docs[u]), pa.array(first[u] + offset[cut]), pa.array(first[u] + offset[end] + least)], schema=_RANGE_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        chars = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            size = np.cumsum(pc.utf8_length(batch.column("around")).to_numpy(zero_copy_only=False))
            ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
            begin = done = 0
            if held and held[-1].column("h")[-1].as_py() != int(h[0]) and chars >= IN_TASK // 4:
                yield compare(pa.Table.from_batches(held))
                held, chars = [], 0
            for end in ends[:-1]:
                if chars + size[end - 1] - done >= IN_TASK // 4:
                    yield compare(pa.Table.from_batches([*held, batch.slice(begin, end - begin)]))
                    held, chars, begin, done = [], 0, int(end), size[end - 1]
            held.append(batch.slice(begin))
            chars += size[-1] - done
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


_WINDOW = "h bigint, w bigint, w2 bigint, doc_id bigint, start bigint"
_WINDOW_ARROW = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])


def _explode_windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, offset, (w, w2), _, _ = _windows_of(batch.column("around").to_pylist(), least, _BASES)
            h, docs, first = (batch.column(c).to_numpy() for c in ("h", "doc_id", "first"))
            yield pa.RecordBatch.from_arrays([pa.array(h[unit]), pa.array(w.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(docs[unit]), pa.array(first[unit] + offset)], schema=_WINDOW_ARROW)

    return run


def _in_two(df: DataFrame, *keys: str) -> DataFrame:
    """The ``keys`` that occur with two doc_ids or more; partial minima and maxima, so hot keys do not gather."""
    return df.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(*keys)


def _merged(ranges: DataFrame) -> DataFrame:
    """Maximal runs of characters covered by the ranges of each text."""
    before = Window.partitionBy("doc_id").orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, 0)
    begun = ranges.withColumn("new", (F.col("span_start") > F.coalesce(F.max("span_end").over(before), F.lit(-1))).cast("long"))
    return begun.withColumn("run", F.sum("new").over(upto)).groupBy("doc_id", "run").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("run")


def shared_spans(documents: DataFrame, least: int = LEAST, gram: int = GRAM, in_task: int = IN_TASK) -> DataFrame:
    """(doc_id, span_start, span_end): every maximal run of characters of each text that lie in a stretch of ``least`` or
    more that also occurs in a text with another doc_id; offsets in code points, the end exclusive.

    Nothing is normalised, and what a task holds is compared character by character; what a shuffle by window compares, units of
    one hash with more than ``in_task`` characters, by three hashes of 64 bits. Null and shorter texts have no spans, repetition inside a text does not count, and rows
    without a doc_id, which no result could name, are left out. Rows with equal doc_id are one text's.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    scratch = storage.Scratch(documents.sparkSession, "spans")
    anchors = scratch.keep(texts.mapInArrow(_anchors(least, gram), "doc_id bigint, h bigint"), "anchors")
    candidates = anchors.join(_in_two(anchors, "h"), "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    found = texts.join(candidates, "doc_id").mapInArrow(_units_with_text(least, gram), _UNIT)
    found = scratch.keep(found, "units", compression="zstd")
    hot = scratch.keep(found.groupBy("h").agg(F.sum(F.length("around")).alias("n")).where(F.col("n") > in_task).select("h"), "hot")
    some_hot = not hot.isEmpty()
    usual = found.join(hot, "h", "left_anti") if some_hot else found
    n = storage.spread(found, 4 << 20)
    ranges = usual.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_compare(least), _RANGE)
    if some_hot:
        windows = scratch.keep(found.join(hot, "h", "left_semi").mapInArrow(_explode_windows(least), _WINDOW), "windows")
        one = windows.join(_in_two(windows, "h", "w", "w2"), ["h", "w", "w2"], "left_semi")
        ranges = ranges.unionByName(one.select("doc_id", F.col("start").alias("span_start"), (F.col("start") + least).alias("span_end")))
    return scratch.result(_merged(ranges))


def shared_parts(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, chars, shared_chars, share) of every text; share is 0 for texts without characters."""
    shared = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    chars = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))
    both = chars.join(shared, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint"))
    return both.withColumn("share", F.when(F.col("chars") > 0, F.round(F.col("shared_chars") / F.col("chars"), 6)).otherwise(0.0))


_LINE = "doc_id bigint, line_start bigint, line_end bigint, digest binary"
_LINE_ARROW = pa.schema([("doc_id", pa.int64()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("digest", pa.binary())])
_BLANKS = re.compile(r"\s+")


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
                at = 0
                for line in text.split("\n"):
                    plain = _BLANKS.sub(" ", line).strip().lower()
                    if len(plain) >= least:
                        out.append((doc, at, at + len(line), hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest()))
                    at += len(line) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 4, _LINE_ARROW.types, strict=True)], schema=_LINE_ARROW)

    return run


def duplicate_lines(documents: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """(doc_id, line_start, line_end, first_doc_id, first_start) of every line that repeats an earlier one.

    Lines end at newlines; they are compared without case, outer blanks and differences of inner blanks, if ``least`` or
    more characters are left. The earliest occurrence by (doc_id, offset) stays, the others are returned with their
    original offsets. A repetition inside a document counts too. The copies of a line of which there are more than
    ``copies`` are dealt to several tasks.
    """
    scratch = storage.Scratch(documents.sparkSession, "spans-lines")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    lines = scratch.keep(texts.mapInArrow(_lines(least), _LINE), "lines")
    parts = F.ceil(F.col("n") / copies).cast("int")
    first = scratch.keep(lines.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_start")).alias("f")).where("n > 1"), "first")
    hot = scratch.keep(first.where(F.col("n") > copies).select("digest", parts.alias("parts")), "hot")
    lines, first = lines.join(hot, "digest", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "line_start"), "parts"), F.lit(0)).cast("int")), first.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    again = lines.join(first, ["digest", "part"]).where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("line_start") != F.col("f.line_start")))
    return scratch.result(again.select("doc_id", "line_start", "line_end", F.col("f.doc_id").alias("first_doc_id"), F.col("f.line_start").alias("first_start")))


def without_lines(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, text, removed): every text without the lines (doc_id, line_start, line_end), each taken out with the newline after it,
    and how many these were. Texts that lose nothing stay as they are, null ones null."""
    taken = lines.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("line_start", "line_end"))).alias("taken"))
    joined = documents.select("doc_id", "text").join(taken, "doc_id", "left")
    # from the end of what was taken out last up to the next
    kept = F.aggregate(
        "taken", F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at")),
        lambda s, t: F.struct(F.concat(s["text"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (t["line_start"] - s["at"]).cast("int"))).alias("text"), (t["line_end"] + 1).alias("at")),
        lambda s: F.concat(s["text"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.greatest(F.length("text") - s["at"], F.lit(0)).cast("int"))),
    )
    return joined.select("doc_id", F.when(F.col("taken").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("taken"), F.lit(0)).cast("bigint").alias("removed"))
