"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared as UTF-8 bytes after lower-casing (Unicode's simple mapping) and joining runs of
white space to one space. An item is cut into windows of ``WINDOW`` bytes (a shorter item is one window). A window of
m bytes matches a text where some region is within ``edits(m)`` edits of it; one matching window
contaminates the text. An item of fewer than q bytes is no passage to look for inside texts: it matches
a text that is equal to it.

A region within k edits shares at least t = m - q + 1 - k * q of the window's q-grams, and their
diagonals (place in the text less place in the window) differ by at most k. So, for each text:

1. every place whose q-gram is in the benchmark is marked, apart for windows of about the same
   length; only stretches of the longest such region's length with the least such t go on (a lossless filter);
2. there, hits are counted by window in overlapping bands of diagonals, each 2k wide; bands with t hits
   are retained;
3. each retained band is verified by a banded alignment, whose edits are returned.

Two things are broadcast: the filter of step 1 (about 4 bytes of bits for a byte of the benchmark) and the index
of steps 2 and 3 (about 36). A benchmark whose filter is within ``FILTER_BYTES`` needs one scan of the
documents; where its index is above ``INDEX_BYTES``, the texts that the filter lets through are written, and
portions of the index search these. Larger benchmarks take a scan for each filter. Only a
single item can exceed a bound, by itself.

Null and empty texts match nothing; repeated rows give repeated matches; equal matches of an item count
once with their fewest edits; null items are ignored, further columns too. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from floodspark.llm.text import Scratch, runs, written

Q, WINDOW, STEP = 8, 160, 80
FILTER_BYTES, INDEX_BYTES = 64 << 20, 32 << 20
SLICE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[_SPACE] = 32


def edits(m: int) -> int:
    """The edit budget of a window of m bytes: 6 %."""
    return m * 6 // 100


def least_shared(m: int) -> int:
    return m - Q + 1 - edits(m) * Q


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of lower-cased texts (null: empty) and their offsets (one more than texts)."""
    col = pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string()))
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Lower-cased bytes with white space joined, and the source place of each (None: as it was)."""
    b = _FOLD[data]
    space = b == 32
    twice = space[1:] & space[:-1]
    if not twice.any():
        return b, None
    at = np.flatnonzero(np.concatenate([[True], ~twice]))
    return b[at], at


def in_original(text: bytes, low: np.ndarray) -> np.ndarray | None:
    """The place in the text of each byte of its lower-cased form; None where lengths agree."""
    if len(text) == len(low):
        return None
    first = lambda b: (b & 0xC0) != 0x80
    b = np.frombuffer(text, np.uint8)
    return np.flatnonzero(first(b))[np.cumsum(first(low)) - 1]


def grams(b: np.ndarray) -> np.ndarray:
    """The q-gram at each place but the last q - 1, as a number: its 8 bytes."""
    if len(b) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(b) - Q + 1,), "<u8", np.ascontiguousarray(b).data, 0, (1,))


def windows_of(text: str) -> list[bytes]:
    data, _ = lowered(pa.array([text.strip()]))
    b = normal(data)[0].tobytes()
    n = len(b)
    starts = [0] if n <= WINDOW else [*range(0, n - WINDOW, STEP), n - WINDOW]
    return [b[s : s + WINDOW] for s in starts if n]


class Filter:
    """Which q-grams stand in windows, for each class of lengths."""

    def __init__(self, windows: list[bytes]) -> None:
        #: Marks as bits, how far to shift to a mark's place, the least q-grams that a match shares, its longest region.
        self.classes = []
        self.short = {w for w in windows if len(w) < Q}
        by_kind: dict[int, list[bytes]] = {}
        for w in windows:
            if len(w) >= Q:
                by_kind.setdefault(len(w) // 16, []).append(w)
        for own in by_kind.values():
            found = np.unique(np.concatenate([grams(np.frombuffer(w, np.uint8)) for w in own]))
            bits = max(10, (16 * len(found) - 1).bit_length())
            marks = np.zeros(1 << bits, bool)
            marks[(found * _MULTIPLIER) >> np.uint64(64 - bits)] = True
            sizes = {len(w) for w in own}
            need, reach = min(max(1, least_shared(m)) for m in sizes), max(m + edits(m) for m in sizes)
            self.classes.append((np.packbits(marks, bitorder="little"), np.uint64(64 - bits), need, reach))

    def dense(self, g: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """For each class: the marked q-grams, a stretch's length, and where stretches with enough marks start."""
        sums = np.zeros(len(g) + 1, np.int32)
        spread = g * _MULTIPLIER
        for marks, shift, need, reach in self.classes:
            slot = (spread >> shift).astype(np.int64)
            hit, reach = (marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1, min(reach, len(g))
            np.cumsum(hit, dtype=np.int32, out=sums[1:])
            yield hit.view(bool), reach, np.flatnonzero(sums[reach:] - sums[: len(sums) - reach] >= need)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts, of those end to end in data, that a stretch with enough marks touches, or that are as short as an item."""
        b, at = normal(data)
        starts = offsets if at is None else np.searchsorted(at, offsets)
        touched = np.zeros(len(offsets), np.int64)
        if self.short:
            touched[:-1] = np.diff(starts) < Q + 2
            touched[1:] -= touched[:-1].copy()
        g = grams(b)
        for _, reach, dense in self.dense(g) if len(g) else ():
            # A stretch covers reach q-grams and may start in any text before: all from its first to its last are searched.
            first = np.searchsorted(starts, dense, "right") - 1
            last = np.searchsorted(starts, dense + reach + Q - 1, "left")
            np.add.at(touched, np.minimum(first, len(offsets) - 1), 1)
            np.add.at(touched, np.minimum(last, len(offsets) - 1), -1)
        return np.flatnonzero(np.cumsum(touched[:-1]) > 0)


class Index:
    """The windows of items and where each q-gram stands in them."""

    def __init__(self, windows: list[tuple[int, bytes]]) -> None:
        self.windows = [(item, w) for item, w in windows if len(w) >= Q]
        self.short: dict[bytes, list[int]] = {}
        for item, w in windows:
            if len(w) < Q:
                self.short.setdefault(w, []).append(item)
        gs = [grams(np.frombuffer(w, np.uint8)) for _, w in self.windows]
        none = np.zeros(0, np.int32)
        value = np.concatenate([none.astype(np.uint64), *gs])
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.of = np.concatenate([none, *(np.full(len(g), i, np.int32) for i, g in enumerate(gs))])[order]
        self.at = np.concatenate([none, *(np.arange(len(g), dtype=np.int32) for g in gs)])[order]
        self.size = np.array([len(w) for _, w in self.windows], np.int64)
        self.budget = np.array([edits(m) for m in self.size], np.int64)
        self.need = np.array([max(1, least_shared(int(m))) for m in self.size], np.int64)

    def search(self, b: np.ndarray, marks: Filter) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the matches in a normalised text."""
        text = b.tobytes()
        found = [(item, 0, len(b), 0) for item in self.short.get(text.strip(b" "), ())]
        g = grams(b)
        n = len(g)
        if not n or not self.windows:
            return found
        wanted = np.zeros(n, bool)
        for hit, reach, dense in marks.dense(g):
            cover = np.zeros(n + 1, np.int32)
            np.add.at(cover, dense, 1)
            np.add.at(cover, np.minimum(dense + reach, n), -1)
            wanted |= (np.cumsum(cover[:-1]) > 0) & hit
        place = np.flatnonzero(wanted)
        lo, hi = np.searchsorted(self.value, g[place], "left"), np.searchsorted(self.value, g[place], "right")
        many = hi - lo
        keep = many > 0
        place, lo, many = place[keep], lo[keep], many[keep]
        total = int(many.sum())
        if not total:
            return found
        j = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
        window, where = self.of[j].astype(np.int64), np.repeat(place, many)
        diagonal = where - self.at[j] + WINDOW  # not negative
        out = []
        # Bands 2k wide, each starting k after the last: diagonals that differ by at most k share one.
        width = np.maximum(self.budget[window], 1)
        for shift in (0, 1):
            band = diagonal // width - shift
            key = window * (n + 4 * WINDOW) + band + 1
            keys, counts = np.unique(key, return_counts=True)
            out.append((keys, counts))
        keys = np.concatenate([k for k, _ in out])
        counts = np.concatenate([c for _, c in out])
        uniq, back = np.unique(keys, return_inverse=True)
        together = np.bincount(back, counts).astype(np.int64)
        w, band = np.divmod(uniq, n + 4 * WINDOW)
        ok = together >= self.need[w]
        same = set()
        for v, first in zip(w[ok], (band[ok] - 1)):
            item, m, k = self.windows[v][0], int(self.size[v]), int(self.budget[v])
            if item in same:  # nothing is closer than an equal region
                continue
            step = max(k, 1)
            d = int(first) * step - WINDOW
            p = text.find(self.windows[v][1], max(0, d - k), max(0, d + 2 * step + k) + m)
            if p >= 0:
                same.add(item)
                found.append((item, p, p + m, 0))
                continue
            got = align(self.windows[v][1], b, d, d + 2 * step, k)
            if got:
                found.append((item, *got))
        return found


def align(window: bytes, b: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best region for the window, starting at a place from low to high, if within k edits.

    Only diagonals from low - k to high + k are computed; the region may start and end freely on them.
    """
    p = np.frombuffer(window, np.uint8)
    m, first = len(p), low - k
    width = high - low + 2 * k + 1
    padded = np.zeros(m + width + 1, np.int16) - 1
    a, z = max(first, 0), min(first + m + width, len(b))
    if a < z:
        padded[a - first : z - first] = b[a:z]
    cost, begin = np.zeros(width, np.int32), np.arange(width)
    far = np.int32(1 << 20)
    for i in range(m):
        # On diagonal c, row i stands at the text's place first + c + i.
        step = cost + (padded[i : i + width] != p[i])
        begun = begin
        gap = np.append(cost[1:] + 1, far)  # the window's byte is left out
        use = gap < step
        step, begun = np.where(use, gap, step), np.where(use, np.append(begin[1:], 0), begun)
        # the text's byte is left out: from the diagonal before, any number of times
        slope = step - np.arange(width)
        least = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == least, np.arange(width), 0))
        cost, begin = (least + np.arange(width)).astype(np.int32), begun[source]
    c = int(np.argmin(cost))
    if cost[c] > k:
        return None
    return max(0, first + int(begin[c])), min(len(b), first + c + m), int(cost[c])


Windows = list[tuple[int, bytes]]


def _portions(benchmark: DataFrame) -> Iterator[list[Windows]]:
    """The benchmark's windows, filter by filter, each with its indexes' portions; one filter's at a time on the driver."""
    parts: list[Windows] = [[]]
    n_filter = n_index = 0
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    last = None
    for row in items.orderBy("item_id", "text").toLocalIterator():
        new, last = row.item_id != last, row.item_id  # all texts of an item come in one portion
        own = [(row.item_id, w) for w in windows_of(row.text)]
        grams_ = sum(max(len(w) - Q + 1, 1) for _, w in own)
        if new and n_filter and n_filter + 4 * grams_ > FILTER_BYTES:
            yield parts
            parts, n_filter, n_index = [[]], 0, 0
        cost = 16 * grams_ + 300 * len(own)
        if new and n_index and n_index + cost > INDEX_BYTES:
            parts.append([])
            n_index = 0
        parts[-1] += own
        n_filter, n_index = n_filter + 4 * grams_, n_index + cost
    yield parts


def _sliced(batch: pa.RecordBatch, marks: Filter) -> Iterator[tuple[int, np.ndarray]]:
    """The rows (first column id, then text) that a filter lets through, each with its lower-cased bytes."""
    data, offsets = lowered(batch.column("text"))
    for i, j in runs(offsets, SLICE):
        for r in marks.candidates(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
            yield i + int(r), data[offsets[i + r] : offsets[i + r + 1]]


def _best(batch: pa.RecordBatch, marks: Filter, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of each item that a row contains: its best region."""
    texts = batch.column("text")
    for r, low in _sliced(batch, marks):
        b, at = normal(low)
        best: dict[int, tuple[int, int, int]] = {}
        found = index.search(b, marks)
        if found:
            at = np.arange(len(b)) if at is None else at
            back = in_original(texts[r].as_py().encode(), low)
            for item, s, e, cost in found:
                s, e = int(at[min(s, len(at) - 1)]), int(at[max(e - 1, 0)])
                got = (cost, s, e + 1) if back is None else (cost, int(back[s]), int(back[e]) + 1)
                best[item] = min(best.get(item, got), got)
        yield from ((r, item, s, e, cost) for item, (cost, s, e) in best.items())


def _searched(docs: DataFrame, marks, index) -> DataFrame:
    """docs (id, text) to matches; marks and index are broadcast."""
    fields = [StructField(n, LongType()) for n in ("item_id", "start", "end", "edits")]
    schema = StructType([docs.schema[0], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_best(batch, marks.value, index.value))
            columns = list(zip(*rows)) or [()] * 5
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

    return docs.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document and item that it contains: its best region in bytes of the text, and edits."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(id_col, "text")
    portions = _portions(benchmark)
    parts, following = next(portions), next(portions, None)
    if following is None and len(parts) == 1:
        marks, index = sc.broadcast(Filter([w for _, w in parts[0]])), sc.broadcast(Index(parts[0]))
        return _searched(texts, marks, index)
    scratch, out, n = Scratch(docs.sparkSession), None, 0
    while parts is not None:
        marks = sc.broadcast(Filter([w for part in parts for _, w in part]))

        def through(batches: Iterator[pa.RecordBatch], marks=marks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.take(pa.array(sorted({r for r, _ in _sliced(batch, marks.value)}), pa.int64()))

        suspects = scratch.written(texts.mapInArrow(through, texts.schema), "suspects")
        for part in parts:
            index = sc.broadcast(Index(part))
            found = scratch.written(_searched(suspects, marks, index), f"matches-{n}")
            out, n = found if out is None else out.unionByName(found), n + 1
            index.destroy()
        marks.destroy()
        parts, following = following, next(portions, None)
    scratch.drop("suspects")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that contain a benchmark item, whatever their ids."""
    sc = docs.sparkSession.sparkContext
    portions = _portions(benchmark)
    parts = next(portions)
    if len(parts) > 1 or next(portions, None) is not None:
        rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        bad = matches(rows, benchmark, "__row").select("__row").distinct()
        return rows.join(bad, "__row", "left_anti").select(*docs.columns)
    marks, index = sc.broadcast(Filter([w for _, w in parts[0]])), sc.broadcast(Index(parts[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, *_ in _best(batch, marks.value, index.value)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
