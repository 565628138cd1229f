"""Packing by optimal length buckets.

The global histogram of lengths is exact: its size is the number of distinct lengths, which is below the
square root of twice the sum of all lengths. Dynamic programming over it chooses the ``BUCKETS``
boundaries that minimise padding. Inside each bucket, batches hold as many rows as fit
``token_budget`` tokens once padded to the boundary (one row at least). packed() takes op4's token counts as
lengths, counted once and written; pack() takes any length, and words where none is given.

Lengths are written once with a number for each row. Rows of a bucket are dealt by a hash of that number into groups
of about ``GROUP`` rows, whose count the histogram gives; batches form inside a group, in the order of
its length and id, so no task sees a whole bucket, however often a row repeats, and only a group's last
batch may be partly filled. Null and empty texts have length 0 and are packed in the first bucket;
repeated rows and null ids are packed like others; an empty table gives no rows. The result refers to
texts by id; further columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodspark.llm import tokens
from floodspark.llm.text import SPACE, Scratch

BUCKETS, BUDGET, GROUP = 8, 16384, 4096


def word_count(text: Column) -> Column:
    """Words, as the length of a text where no token count is at hand."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", F.lit(0)).otherwise(F.regexp_count(body, F.lit(SPACE)) + 1)


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The boundaries (of the given sorted, distinct lengths) that minimise padding with at most so many buckets.

    Cells i to j - 1 padded to the last one's length x cost x * (rows[j] - rows[i]) - (total[j] - total[i]).
    The best i for each j is the lowest of lines of slope -rows[i] at x, so that a round is linear.
    """
    n = len(lengths)
    rows = list(accumulate(counts, initial=0))
    total = list(accumulate((c * x for x, c in zip(lengths, counts)), initial=0))
    best: list[int | None] = [0] + [None] * n
    choice = []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [0] + [None] * n
        where, lines, p = [0] * (n + 1), [], 0
        for j, x in enumerate(lengths, 1):
            i = j - 1
            if best[i] is not None:
                at, slope = best[i] + total[i], -rows[i]
                while len(lines) > 1:
                    (s0, a0, _), (s1, a1, _) = lines[-2:]
                    if (at - a0) * (s0 - s1) > (a1 - a0) * (s0 - slope):
                        break
                    lines.pop()
                lines.append((slope, at, i))
            p = min(p, len(lines) - 1)
            while p + 1 < len(lines) and lines[p + 1][0] * x + lines[p + 1][1] < lines[p][0] * x + lines[p][1]:
                p += 1
            slope, at, where[j] = lines[p]
            new[j] = slope * x + at + x * rows[j] - total[j]
        best = new
        choice.append(where)
    out, j = [], n
    for where in reversed(choice):
        if j:
            out.append(lengths[j - 1])
            j = where[j]
    return sorted(set(out))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    length: Column | None = None,
    buckets: int = BUCKETS,
    token_budget: int = BUDGET,
    group: int = GROUP,
) -> DataFrame:
    """id_col, n_words (the length, in whatever unit), boundary (its bucket), batch_id and pad (boundary less length) of each row."""
    length = word_count(F.col("text")) if length is None else length
    scratch = Scratch(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    sized = scratch.written(slim.withColumn("row", F.monotonically_increasing_id()), "lengths")
    cells = sized.groupBy("n").agg(F.count("*").alias("rows")).orderBy("n").collect()
    edges = boundaries([r.n for r in cells], [r.rows for r in cells], buckets)
    if not edges:
        edges = [0]
    held = [sum(r.rows for r in cells if lo < r.n <= hi) for lo, hi in zip([-1, *edges], edges)]
    boundary, groups = F.lit(None).cast("long"), F.lit(1)
    for e, rows in reversed(list(zip(edges, held))):
        boundary = F.when(F.col("n") <= e, F.lit(e).cast("long")).otherwise(boundary)
        groups = F.when(F.col("n") <= e, F.lit(max(1, -(-rows // group)))).otherwise(groups)
    placed = sized.withColumn("boundary", boundary).withColumn("group", F.pmod(F.xxhash64("row"), groups))
    order = Window.partitionBy("boundary", "group").orderBy("n", "id", "row")
    fit = F.greatest(F.floor(F.lit(token_budget) / F.greatest(F.col("boundary"), F.lit(1))), F.lit(1))
    batch = F.floor((F.row_number().over(order) - 1) / fit)
    return placed.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        "boundary",
        F.concat_ws("-", "boundary", "group", batch.cast("string")).alias("batch_id"),
        (F.col("boundary") - F.col("n")).alias("pad"),
    )


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """pack() with the token counts of docs (doc_id, text) as lengths (path: the tokenizer's file)."""
    counts = tokens.count_tokens(docs, path or public_tokenizers.path("byte_bpe_50k.json"))
    return pack(counts, length=F.col("n_tokens"))
