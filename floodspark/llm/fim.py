"""Fill-in-middle transformation: a text's units are cut at two ranks, and the parts rearranged under marks.

Units are runs of ASCII letters and single other code points. Each text becomes an indexable skip list:
the lowest lane has a node for each unit, each higher lane an express node for about every fourth of the
lane below, and every node carries two widths, the units and the code points up to the next node of its
lane. A descent adds up widths from the top lane down and so reaches the cut of any rank exactly, after a
few nodes a lane; nothing is counted from the start of the text again.

``transform`` gives the rearranged text, ``restored`` rebuilds the text from it in Spark's own string
functions. Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix,
middle). A text that holds one of the marks stays plain, as do empty ones, null texts among them; so
every other output can be taken apart again: a mark begins with the only ``<`` that it holds, so that no
mark can arise where a part meets the next mark. Numbers drawn for a row depend on its doc_id and the seed alone; a
null id counts as empty text. Repeated rows come out alike, further columns are ignored, an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.text import runs, strings

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 texts, those that are rearranged, and of 100 of these, those with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: One node in four rises a lane.
FANOUT = 4
SLICE = 1 << 22


class SkipList:
    """Lanes over a text's units, each with the widths of its nodes in units and in code points.

    Which nodes rise a lane is decided by a hash of their place, so that lanes need no balancing and equal
    texts have equal lists; the first node stands in all lanes.
    """

    def __init__(self, widths: np.ndarray) -> None:
        """widths: code points of each unit."""
        self.n = len(widths)
        units = np.ones(self.n, np.int64)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # widths in units, in code points; each node's place in the lane below
        hashes, down = np.arange(self.n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(self.n)
        self.lanes.append((units, widths, down))
        while len(units) > FANOUT:
            rises = hashes >> np.uint64(62) == 0
            rises[0] = True
            down = np.flatnonzero(rises)
            units, widths = np.add.reduceat(units, down), np.add.reduceat(widths, down)
            hashes = hashes[down] << np.uint64(2)  # the next two bits decide about the next lane
            self.lanes.append((units, widths, down))

    def reach(self, rank: int) -> int:
        """Code points before the unit of this rank (of all, if rank is the number of units)."""
        if rank >= self.n:
            return int(self.lanes[-1][1].sum())
        node = passed = chars = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            units, widths, down = self.lanes[level]
            while passed + units[node] <= rank:
                passed += int(units[node])
                chars += int(widths[node])
                node += 1
            if level:
                node = int(down[node])
        return chars


def units(text: str) -> np.ndarray:
    """Code points of each unit of a text, in order."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    starts = np.ones(len(points), bool)
    starts[1:] = ~(letter[1:] & letter[:-1])
    return np.diff(np.append(np.flatnonzero(starts), len(points)))


def cut(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and output of one text."""
    widths = units(text)
    n = len(widths)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= REARRANGED:
        return n, "plain", None, None, text
    skips = SkipList(widths)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = skips.reach(a), skips.reach(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) to doc_id, n (units), form, prefix_chars, middle_chars and output."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in runs(strings(batch, "text")[1], SLICE):
                part = batch.slice(i, j - i)
                hs = [c.to_pylist() for c in part.columns[2:6]]
                rows = [cut(t.as_py() or "", *h) for t, *h in zip(part.column(1), *hs)]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text", *drawn).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _between(text: Column, left: str, right: str | None) -> Column:
    """What stands between two marks, or after the one."""
    start = F.instr(text, left) + len(left)
    return F.substr(text, start, F.length(text) if right is None else F.instr(text, right) - start)


def restored(rows: DataFrame) -> DataFrame:
    """rows (form, output) with the text that each was made from."""
    out = F.col("output")
    middle = _between(out, MIDDLE, None)
    psm = F.concat(_between(out, PREFIX, SUFFIX), middle, _between(out, SUFFIX, MIDDLE))
    spm = F.concat(_between(out, PREFIX, MIDDLE), middle, _between(out, SUFFIX, PREFIX))
    return rows.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(out))
