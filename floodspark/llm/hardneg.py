"""Hard negatives: for each anchor and positive, the best rows of other labels inside a window of scores.

Scores are inner products of integer vectors. Every vector is rotated and coded by ``LEVELS`` one-bit
codes: the first holds the signs of the rotated vector, each further one the signs of what the codes
before leave over. Stored with each code is its alignment, the length that the vector has along the
code (for the first one their inner product, then steps that halve), and with the vector its length and the length of what all codes leave over. The
inner product of two coded vectors is then a sum over pairs of codes, alignment * alignment *
(1 - 2 * popcount / bits), and by Cauchy-Schwarz the true score differs from it by at most

    |q coded| * |x left over| + |q left over| * |x|,

which holds for every vector, not merely in probability. Rows whose interval cannot reach an anchor's first
ranks are left out; all others are scored in integers, so the result is exact.

Every anchor meets every vector, in blocks: vectors are dealt by a hash of their id into blocks of at most about
``BLOCK`` rows (of which there are a few even where rows are few), anchors into blocks of at most about ``ANCHORS``, and
each pair of blocks is one cogroup, whose best rows are merged by anchor. The work is thus quadratic, as the
question is, in tasks of one size; labels play no part in the dealing, so that a common one makes no task larger.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of several rows with one
id, the one with the least label and vector counts. Vectors shorter than the longest count as if
filled up with zeros. Ties go to smaller ids. A component whose products could leave 64 bits raises an error.
Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodspark.llm.text import Scratch

#: Signs leave about 0.6 of a vector's length over, each further level half of that; six leave about a twenty-fifth.
LEVELS = 6
BLOCK, ANCHORS = 1 << 15, 1 << 12
#: So many blocks of vectors at least, where rows allow LEAST_ROWS in each.
LEAST_BLOCKS, LEAST_ROWS = 32, 400
#: Anchors whose estimates are held at once.
LOT = 32


def rotation(bits: int, seed: int = 13) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels * words), alignments (rows, levels), and length and left-over length (rows, 2) of vectors x."""
    bits = len(turn)
    left = np.zeros((len(x), bits))
    left[:, : x.shape[1]] = x
    left = left @ turn.T
    size = np.sqrt((left * left).sum(1))
    codes, aligned = [], []
    for level in range(levels):
        signs = left >= 0
        # A place's share of the code: the mean for the vector's signs, then half of what is left over at most, halved each time.
        step = np.abs(left).mean(1) if not level else peak / 2**level
        codes.append(np.packbits(signs, axis=1).view(np.uint64))
        aligned.append(step * np.sqrt(bits))
        left = left - np.where(signs, step[:, None], -step[:, None])
        if not level:
            peak = np.abs(left).max(1)
    return np.concatenate(codes, 1), np.stack(aligned, 1), np.stack([size, np.sqrt((left * left).sum(1))], 1)


class Coded:
    """Rows of a block: ids, labels, integer vectors, codes, alignments and lengths."""

    def __init__(self, rows: pa.Table) -> None:
        get = lambda name: rows.column(name).combine_chunks()
        n = rows.num_rows
        wide = lambda name: get(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.ids, self.labels = get("vec_id").to_numpy(), get("label").to_numpy()
        self.ints, self.aligned, self.sizes = wide("ints"), wide("aligned"), wide("sizes")
        self.codes = wide("codes").view(np.uint64).reshape(n, self.aligned.shape[1], -1)
        # Products of integers below this are exact in doubles.
        self.floats = self.ints.astype(np.float64)

    def of_label(self, label: int) -> Coded:
        """The rows of a label."""
        part, at = Coded.__new__(Coded), np.flatnonzero(self.labels == label)
        for name in ("ids", "labels", "ints", "aligned", "sizes", "codes", "floats"):
            setattr(part, name, getattr(self, name)[at])
        return part

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer inner products of the rows at with q."""
        top = float(np.abs(self.floats[at]).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q)
        if top < 2**53:
            return (self.floats[at] @ q.astype(np.float64)).astype(np.int64)
        if top >= 2**63:
            raise OverflowError("products of components leave 64 bits")
        return self.ints[at] @ q


def intervals(q: Coded, at: slice, x: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and half-widths (anchors, rows) of the scores of the anchors q[at] with all rows of x."""
    bits, levels = 64 * x.codes.shape[2], x.codes.shape[1]
    est = np.zeros((len(q.ids[at]), len(x.ids)))
    for j in range(levels):
        for k in range(levels):
            ones = sum(np.bitwise_count(q.codes[at, j, w][:, None] ^ x.codes[None, :, k, w]).astype(np.float32) for w in range(bits // 64))
            est += q.aligned[at, j][:, None] * (x.aligned[:, k] * (1 - 2 * ones / np.float32(bits)))
    size, left = q.sizes[at, 0][:, None], q.sizes[at, 1][:, None]
    half = (size + left) * x.sizes[:, 1] + left * x.sizes[:, 0]  # |q coded| is at most the sum of both
    return est, half + 1e-6 * (1 + size * x.sizes[:, 0])


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; minus infinity if there are fewer."""
    return -np.inf if len(values) < k else float(np.partition(values, len(values) - k)[len(values) - k])


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def best_positives(q: Coded, x: Coded, k: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, row, score): each anchor's first k rows of its label in this block, itself left out."""
    for label in np.unique(q.labels):
        anchors, same = q.of_label(label), x.of_label(label)
        for i in range(0, len(anchors.ids), LOT):
            at = slice(i, i + LOT)
            est, half = intervals(anchors, at, same)
            for e, h, anchor, vector in zip(est, half, anchors.ids[at], anchors.ints[at]):
                other = same.ids != anchor
                rows = np.flatnonzero(other & (e + h >= _kth((e - h)[other], k)))
                scores = same.scores(rows, vector)
                for r in _first(scores, same.ids[rows], k):
                    yield int(anchor), int(same.ids[rows[r]]), int(scores[r])


def best_negatives(q: Coded, windows: list[list[tuple[int, int, int]]], x: Coded, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, positive, row, score): for each anchor and its (positive, low, high), the first k rows of other labels from low to high."""
    for i in range(0, len(q.ids), LOT):
        at = slice(i, i + LOT)
        est, half = intervals(q, at, x)
        for e, h, anchor, label, vector, mine in zip(est, half, q.ids[at], q.labels[at], q.ints[at], windows[i : i + LOT]):
            other = x.labels != label
            least, most = e - h, e + h
            for positive, low, high in mine:
                sure = other & (least >= low) & (most <= high)
                rows = np.flatnonzero(other & (least <= high) & (most >= max(low, _kth(least[sure], k))))
                scores = x.scores(rows, vector)
                inside = (scores >= low) & (scores <= high)
                rows, scores = rows[inside], scores[inside]
                for r in _first(scores, x.ids[rows], k):
                    yield int(anchor), int(positive), int(x.ids[rows[r]]), int(scores[r])


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vectors (vec_id, label, embedding) to those that take part: vec_id, label (long) and ints (array of long), one row an id."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform("x", lambda v: F.floor(v * scale))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(~odd)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", whole.alias("ints"))).alias("r")).select("vec_id", "r.label", "r.ints")


def _coded(rows: DataFrame, width: int) -> DataFrame:
    turn = rows.sparkSession.sparkContext.broadcast(rotation(-(-max(width, 1) // 64) * 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                n, lists = part.num_rows, part.column(2)
                x = np.zeros((n, max(width, 1)), np.int64)
                x[np.arange(x.shape[1]) < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                codes, aligned, sizes = encode(x.astype(np.float64), turn.value)
                many = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), many(x), many(codes.view(np.int64)), many(aligned), many(sizes)],
                    names=["vec_id", "label", "ints", "codes", "aligned", "sizes"],
                )

    return rows.select("vec_id", "label", "ints").mapInArrow(
        run, "vec_id long, label long, ints array<long>, codes array<long>, aligned array<double>, sizes array<double>"
    )


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of the rows of vectors (vec_id, label, ints) for which is_anchor, a condition on vec_id, holds.

    An anchor's positives are its first rows of the same label. For each, the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score come out: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    vectors = scratch.written(vectors.select("vec_id", "label", "ints"), "vectors")
    width = vectors.agg(F.max(F.size("ints"))).first()[0] or 0
    coded = scratch.written(_coded(vectors, width), "coded")
    scratch.drop("vectors")
    n, n_anchors = coded.agg(F.count("*"), F.count_if(is_anchor)).first()
    blocks = max(1, min(LEAST_BLOCKS, n // LEAST_ROWS), -(-n // BLOCK))
    groups = max(1, -(-n_anchors // ANCHORS))
    place = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    all_ = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = coded.withColumn("block", place(1, blocks)).withColumn("group", all_(groups)).groupBy("group", "block")
    again = spark.read.schema(coded.schema).parquet(scratch.paths["coded"])  # with columns of its own, for the cogroups
    anchors = again.filter(is_anchor).withColumn("group", place(2, groups))

    def positives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(best_positives(Coded(left), Coded(right), positives)) if left.num_rows and right.num_rows else []
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("anchor_id", "positive_id", "positive_score"))})

    def negatives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            windows = [
                # The scores s with low * p <= 100 * s <= high * p.
                [(p["positive_id"], -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in ps]
                for ps in left.column("positives").to_pylist()
            ]
            found = list(best_negatives(Coded(left), windows, Coded(right), negatives))
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("anchor_id", "positive_id", "negative_id", "negative_score"))})

    first = anchors.withColumn("block", all_(blocks)).groupBy("group", "block").cogroup(rows).applyInArrow(
        positives_of, "anchor_id long, positive_id long, positive_score long"
    )
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = scratch.written(first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives).drop("n"), "positives")
    lists = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    found = anchors.join(lists, "vec_id").withColumn("block", all_(blocks)).groupBy("group", "block").cogroup(rows).applyInArrow(
        negatives_of, "anchor_id long, positive_id long, negative_id long, negative_score long"
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    found = ranked.join(chosen, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
    result = scratch.written(found, "negatives")
    scratch.keep_only("negatives")
    return result
