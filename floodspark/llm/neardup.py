"""Near-duplicate detection by min-max hashing, confirmed on the full shingle sets.

1. Every text gets the 64-bit hashes of its k-word shingles and, for each of ``PERMUTATIONS`` hash
   functions, both the least and the greatest value: two unbiased signature entries for one
   evaluation. Bands of ``ROWS`` entries make bucket keys. Texts with equal sets are one class, and
   one row stands for it; sets that are too small to reach the threshold with any other set get no bands.
2. In each bucket with several classes, a member is tried against the bucket's pivot; only its best
   pivot by signature is confirmed. Confirmed links join into components. The pivot is the member with the
   largest buckets, which is the likeliest to be near all others.
3. Members of buckets that still hold several components fall into blocks of about ``BLOCK_BYTES``
   of sets: each two blocks meet in one group, but not two blocks of the bucket's largest
   component. Inside a group, pairs of different components are compared by sizes and signatures.
   Only members of pairs that these allow get their full sets (texts are read again, and a filter of at most
   ``FILTER_BITS`` bits of the members' ids says which to take, so no text is shuffled); then a second pass over the groups
   confirms such pairs exactly, and a union-find leaves out what is connected by then, so a
   group returns at most one link for each of its components, never a list of pairs.

Every two texts in a bucket thus end up in one component, or are compared in their first common
bucket, so no link is lost but by the banding (at 85 % under 3e-10, at 80 % under 5e-8 of the links)
and the signature bound (4.5 standard deviations: 4e-6 of the links at the threshold itself). All
tables between steps are files in the shared folder and are deleted at the end, but for the result.

Null and empty texts have no shingles and link with nothing; shorter texts than k words are one
shingle; equal texts and repeated rows are one class. Rows that share an id are one document: a link
of one is a link of all that have words. Rows with a null id are kept and linked with nothing. Ids
are whole numbers. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm import graph
from floodspark.llm.text import Scratch, mixed, runs, shingle_hashes, strings, word_hashes

PERMUTATIONS, BANDED, ROWS = 128, 64, 4
SLICE = 1 << 18
BLOCK_BYTES = 4 << 20
#: The filter of members' ids takes 64 bits a member, 64 MB at most; with over 2**27 members, texts are joined with them instead.
FILTER_BITS, CHUNK_BITS = 1 << 29, 1 << 19

_rng = np.random.default_rng(64)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BAND = _rng.integers(1, 1 << 63, (2 * BANDED // ROWS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SET = ["n_shingles", "set_a", "set_b"]


def _sliced(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j of a batch (id, text) with their shingles' hashes and each one's row."""
    data, offsets = strings(batch, "text")
    for i, j in runs(offsets, SLICE):
        part, starts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, *shingle_hashes(*word_hashes(part, starts), k, j - i)


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32()),
        pa.array(np.concatenate([np.zeros(0, np.int64), *(v.view(np.int64) for v in values)]), pa.int64()),
    )


def _named(u: np.ndarray) -> tuple[int, np.int64, np.int64]:
    """Size and 128-bit fingerprint of a set of distinct hashes."""
    return len(u), mixed(u).sum().view(np.int64), mixed(u * _A[0]).sum().view(np.int64)


def features(docs: DataFrame, k: int) -> DataFrame:
    """docs (id, text) with set size, a 128-bit fingerprint of the set, signature and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, s, of in _sliced(batch, k):
                m = j - i
                count = np.bincount(of, minlength=m)
                full = np.flatnonzero(count)
                at = np.concatenate([[0], np.cumsum(count)])
                size, a, b = (np.zeros(m, np.int64) for _ in range(3))
                for r in full:
                    size[r], a[r], b[r] = _named(np.unique(s[at[r] : at[r + 1]]))
                low, high = np.zeros((PERMUTATIONS, m), np.uint64), np.zeros((PERMUTATIONS, m), np.uint64)
                if len(full):
                    for p in range(PERMUTATIONS):
                        v = s * _A[p] + _B[p]
                        low[p, full] = np.minimum.reduceat(v, at[full])
                        high[p, full] = np.maximum.reduceat(v, at[full])
                both = np.concatenate([mixed(low[:BANDED]), mixed(high[:BANDED]), mixed(low[BANDED:]), mixed(high[BANDED:])])
                keys = np.stack(
                    [mixed((both[q * ROWS : (q + 1) * ROWS] * w[:, None]).sum(0, dtype=np.uint64) + w[0]) for q, w in enumerate(_BAND)], 1
                )
                four = (both >> np.uint64(60)).astype(np.uint8)
                signs = np.ascontiguousarray((four[0::2] << 4 | four[1::2]).T)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, m),
                        pa.array(size),
                        pa.array(a),
                        pa.array(b),
                        pa.array([x.tobytes() for x in signs], pa.binary()),
                        _lists([x if c else x[:0] for x, c in zip(keys, count)]),
                    ],
                    names=["id", *_SET, "signature", "bands"],
                )

    return docs.mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>")


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """Bits, one set for each of n ids (id); packed in chunks by tasks."""
    n_bits = CHUNK_BITS
    while n_bits < min(64 * n, FILTER_BITS):
        n_bits *= 2

    def pack(rows: pa.Table) -> pa.Table:
        place = rows.column("place").to_numpy()
        bits = np.zeros(CHUNK_BITS, bool)
        bits[place % CHUNK_BITS] = True
        return pa.table({"chunk": pa.array([int(place[0]) // CHUNK_BITS], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    place = F.pmod(F.xxhash64("id"), F.lit(n_bits))
    chunks = ids.select(place.alias("place")).distinct().groupBy(F.floor(F.col("place") / CHUNK_BITS).alias("c")).applyInArrow(pack, "chunk long, bits binary")
    out = np.zeros(n_bits // 8, np.uint8)
    for r in chunks.collect():
        at = r.chunk * CHUNK_BITS // 8
        out[at : at + CHUNK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _passes(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def shingle_sets(docs: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """docs (id, text) whose ids pass the filter, with the distinct shingles' hashes and the set's size and fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(_passes(shared.value, place)))
            for i, j, s, of in _sliced(batch, k) if batch.num_rows else ():
                at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=j - i))])
                sets = [np.unique(s[a:z]) for a, z in zip(at, at[1:])]
                names = [pa.array(c, pa.int64()) for c in zip(*map(_named, sets))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *names, _lists(sets)], names=["id", *_SET, "shingles"])

    place = F.pmod(F.xxhash64("id"), F.lit(8 * len(bits)))
    return docs.select("id", "text", place.alias("place")).mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, shingles array<long>")


def _sets_of(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """shingle_sets() of the texts with these ids (id), and of few others."""
    n = ids.count()
    if 4 * n > FILTER_BITS:
        return shingle_sets(texts.join(ids, "id", "left_semi"), k, np.full(CHUNK_BITS // 8, 255, np.uint8))
    return shingle_sets(texts, k, id_filter(ids, n))


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity from the signatures' half bytes, of which 1 in 16 agrees by chance."""
    d = x ^ y
    same = ((d & 15) == 0).mean(-1) + ((d >> 4) == 0).mean(-1)
    return (same / 2 - 1 / 16) / (1 - 1 / 16)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PERMUTATIONS)


def _may_link(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _least(percent: int) -> float:
    p = percent / 100 * 15 / 16 + 1 / 16  # the share of half bytes that agree
    return percent / 100 - 4.5 * float(np.sqrt(p * (1 - p) / (2 * PERMUTATIONS))) * 16 / 15


def estimated(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the threshold, with their estimate."""
    left = signs.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    right = signs.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    least = _least(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                n, m = x.column("na").to_numpy(), x.column("nb").to_numpy()
                e = _agreement(_matrix(x.column("sa")), _matrix(x.column("sb")))
                ok = pa.array(_may_link(n, m, percent) & (e >= least))
                yield pa.RecordBatch.from_arrays(
                    [x.column("a"), x.column("b"), pa.array(e)], names=["a", "b", "estimate"]
                ).filter(ok)

    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, estimate double")
    )


def confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """Of sets (node, pivot, is_pivot, shingles), the pairs (a, b) of a node and its pivot whose full sets reach the threshold."""
    x = sets.filter("pivot IS NOT NULL").select(F.col("node").alias("a"), F.col("pivot").alias("b"), F.col("shingles").alias("sa"))
    y = sets.filter("is_pivot").select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return x.join(y, "b").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def in_blocks(apart: DataFrame, block_bytes: int) -> DataFrame:
    """apart (bucket, node, component, n_shingles, ...) dealt into groups (bucket, i, j), with each row's block in ``code``.

    A bucket of at most block_bytes is one group. In a larger one, the largest component's blocks come
    before the others' ("rest"); each block of the rest meets every block in the group of both codes.
    """
    bytes_ = F.sum(8 * F.col("n_shingles") + 512)
    parts = apart.groupBy("bucket", "component").agg(bytes_.alias("bytes"))
    shape = parts.groupBy("bucket").agg(F.sum("bytes").alias("all"), F.max(F.struct("bytes", "component")).alias("m")).select(
        "bucket",
        F.col("m.component").alias("main"),
        F.when(F.col("all") <= block_bytes, 0).otherwise(F.ceil(F.col("m.bytes") / block_bytes)).cast("int").alias("n_main"),
        F.when(F.col("all") <= block_bytes, 1).otherwise(F.ceil((F.col("all") - F.col("m.bytes")) / block_bytes)).cast("int").alias("n_rest"),
    )
    of_main = (F.col("component") == F.col("main")) & (F.col("n_main") > 0)
    code = F.when(of_main, F.pmod(F.xxhash64("node"), F.greatest("n_main", F.lit(1)))).otherwise(
        F.col("n_main") + F.pmod(F.xxhash64("node"), "n_rest")
    )
    others = F.sequence(F.when(of_main, F.col("n_main")).otherwise(0), F.col("n_main") + F.col("n_rest") - 1)
    return (
        apart.join(shape, "bucket")
        .select(*apart.columns, code.cast("int").alias("code"), F.explode(others).alias("other"))
        .withColumn("i", F.least("code", "other"))
        .withColumn("j", F.greatest("code", "other"))
        .drop("other")
    )


class _Rows:
    """Rows of groups as arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.bucket, self.i, self.j, self.code, self.component, self.n = (batch.column(c).to_numpy() for c in ("bucket", "i", "j", "code", "component", "n_shingles"))
        self.node = batch.column("node").to_numpy()
        self.signs = _matrix(batch.column("signature"))
        self.bands = batch.column("bands").flatten().to_numpy().reshape(len(self.node), -1)
        if "shingles" in batch.schema.names:
            self.shingles = batch.column("shingles").flatten().to_numpy()
            self.at = np.concatenate([[0], np.cumsum(self.n)])

    def groups(self) -> np.ndarray:
        """Where groups start, and the end."""
        new = (self.bucket[1:] != self.bucket[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(self.node)]])


def _near(x: _Rows, lo: int, hi: int, label: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a group with those of another label (as it is by then) that sizes and signatures allow."""
    n, signs, bands, code = x.n[lo:hi], x.signs[lo:hi], x.bands[lo:hi], x.code[lo:hi]
    i, j, least = x.i[lo], x.j[lo], _least(percent)
    here = int(np.flatnonzero(bands[0] == x.bucket[lo])[0])
    left, right = np.flatnonzero(code == i), np.flatnonzero(code == j)
    for r in left if (label != label[0]).any() else ():
        c = right[right > r] if i == j else right
        c = c[(label[c] != label[r]) & _may_link(n[c], n[r], percent)]
        if len(c):
            c = c[_agreement(signs[c], signs[r]) >= least]
        if len(c):
            c = c[(bands[c] == bands[r]).argmax(1) == here]  # a pair counts in its first common bucket
        if len(c):
            yield r, c


def _links(x: _Rows, lo: int, hi: int, percent: int) -> list[tuple[int, int]]:
    """Links inside one group that connect as much as all its links would."""
    label, n = x.component[lo:hi].copy(), x.n[lo:hi]
    at = x.at[lo : hi + 1] - x.at[lo]
    place, mark, out = None, None, []
    for r, c in _near(x, lo, hi, label, percent):
        if place is None:
            values, place = np.unique(x.shingles[x.at[lo] : x.at[hi]], return_inverse=True)
            mark = np.zeros(len(values), bool)
        own = place[at[r] : at[r + 1]]
        mark[own] = True
        if 4 * len(c) > len(n):
            common = np.add.reduceat(mark[place], at[:-1], dtype=np.int64)[c]
        else:
            common = np.array([np.count_nonzero(mark[place[at[y] : at[y + 1]]]) for y in c])
        mark[own] = False
        for y in c[100 * common >= percent * (n[c] + n[r] - common)]:
            if label[y] != label[r]:
                label[label == label[y]] = label[r]
                out.append((x.node[lo + r], x.node[lo + y]))
    return out


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Rows, list[tuple[int, int]]]]:
    """Sorted batches, each with its complete groups; a group that goes on is carried over to the next batch."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            x = _Rows(batch)
            edges = x.groups()
            yield batch, x, [(lo, hi) for lo, hi in zip(edges, edges[1:-1]) if hi - lo > 1]
            rest = batch.slice(edges[-2])
    if rest is not None and rest.num_rows > 1:
        yield rest, _Rows(rest), [(0, rest.num_rows)]


_GROUP = ["bucket", "i", "j"]


def in_question(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows of in_blocks() that sizes and signatures allow to link with another component of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, groups in _by_group(batches):
            wanted = np.zeros(batch.num_rows, bool)
            for lo, hi in groups:
                for r, c in _near(x, lo, hi, x.component[lo:hi], percent):
                    wanted[lo + r] = True
                    wanted[lo + c] = True
            yield batch.filter(pa.array(wanted))

    return dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, dealt.schema)


def spanning_links(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect, inside each group of rows with their shingles, what all its links do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, groups in _by_group(batches):
            columns = list(zip(*(e for lo, hi in groups for e in _links(x, lo, hi, percent)))) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row for each of docs: id_col, n_shingles, component_id (the least id reachable), kept.

    Links texts whose shingle sets have 100 * intersection >= percent * union.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    facts = scratch.written(features(texts, k).withColumn("node", F.monotonically_increasing_id()), "features")
    some = facts.filter("n_shingles > 0 AND id IS NOT NULL")
    # One row, the node, stands for each class of equal sets.
    classes = scratch.written(some.groupBy(*_SET).agg(F.min(F.struct("id", "node")).alias("m")).select(*_SET, "m.*"), "classes")
    # A set of n shingles reaches n / (n + 1) at most with another set that is not smaller.
    wide = some.filter(F.col("n_shingles") * (100 - percent) >= percent)
    nodes = wide.join(classes.select("node"), "node")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = scratch.written(banded.join(full, "bucket"), "members")
    ids = members.select("node").distinct()
    signs = scratch.written(nodes.select("node", "id", *_SET, "signature", "bands").join(ids, "node"), "signatures")
    labels = signs.select("node", F.col("node").alias("component"))

    def joined(links: DataFrame, labels: DataFrame) -> DataFrame:
        """labels after the links between components."""
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
        ends = links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        new = graph.components(ends, scratch).select(F.col("node").alias("old"), F.col("component").alias("new"))
        return scratch.written(
            labels.join(new, labels["component"] == new["old"], "left").select("node", F.coalesce("new", "component").alias("component")),
            "labels",
        )

    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = members.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot"))
    tries = members.join(pivots, "bucket").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    best = estimated(tries, signs, percent).groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("m"))
    first = scratch.written(best.select(F.col("a").alias("node"), F.col("m.b").alias("pivot")), "first")
    # Full sets carry their pivots, and whether they are one, so that they meet them without being dealt by node before.
    told = first.select(F.col("pivot").alias("node"), F.lit(True).alias("is_pivot")).distinct()
    roles = signs.select("node", "id", *_SET).join(first, "node", "left").join(told, "node", "left")
    raw = _sets_of(texts, signs.select("id"), k).dropDuplicates(["id", *_SET])
    sets = scratch.written(raw.join(roles, ["id", *_SET]).select("node", "pivot", F.coalesce("is_pivot", F.lit(False)).alias("is_pivot"), "shingles"), "sets")
    labels = joined(confirmed(sets, percent), labels)

    now = members.join(labels, "node").select("bucket", "node", "component")
    several = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    apart = now.join(several.select("bucket"), "bucket", "left_semi").join(signs.select("node", "n_shingles"), "node")
    dealt = in_blocks(scratch.written(apart, "apart"), block_bytes)
    signed = dealt.join(signs.select("node", "signature", "bands"), "node")
    open_ = scratch.written(in_question(signed, percent), "in-question")
    links = scratch.written(spanning_links(open_.join(sets.select("node", "shingles"), "node"), percent), "links")
    labels = joined(links, labels)

    # Ids with several sets link the classes of these sets.
    differ = some.groupBy("id").agg(F.min(F.struct(*_SET)).alias("lo"), F.max(F.struct(*_SET)).alias("hi")).filter("lo <> hi").select("id")
    own = labels.withColumnRenamed("node", "member")
    labelled = classes.join(own, classes["node"] == own["member"], "left").select(*_SET, "id", F.coalesce("component", "node").alias("component"))
    labelled = scratch.written(labelled, "labelled")
    twice = some.select("id", *_SET).join(differ, "id", "left_semi").join(labelled.select(*_SET, "component"), _SET)
    same = twice.join(twice.groupBy("id").agg(F.min("component").alias("b")), "id").select(F.col("component").alias("a"), "b")
    merged = graph.components(same, scratch).select(F.col("node").alias("component"), F.col("component").alias("new"))
    labelled = labelled.join(merged, "component", "left").select(*_SET, "id", F.coalesce("new", "component").alias("component"))
    least = labelled.groupBy("component").agg(F.min("id").alias("least"))
    known = labelled.join(least, "component").select(*_SET, "least")
    # Without words, or without an id, a row stands for itself.
    out = facts.join(known, (F.col("id").isNotNull() & (facts["n_shingles"] == known["n_shingles"]) & (facts["set_a"] == known["set_a"]) & (facts["set_b"] == known["set_b"])), "left").select(
        F.col("id").alias(id_col),
        facts["n_shingles"],
        F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("least", "id"), F.lit(True)).alias("kept"),
    )
    out = scratch.written(out, "near-duplicates")
    scratch.keep_only("near-duplicates")
    return out


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id_col is among these distinct ids (id); rows with a null id stay.

    A filter of the ids tells most of the other rows, which pass as they are; only rows that it takes for one of the ids are
    joined with them, so that few texts are shuffled of rows that stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits := id_filter(ids, ids.count()))
    own = F.col(id_col).cast("long")
    placed = docs.select("*", F.pmod(F.xxhash64(own), F.lit(8 * len(bits))).alias("__place"))

    def rows(suspect: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                last = batch.num_columns - 1
                wanted = _passes(shared.value, batch.column(last).to_numpy()) == suspect
                yield batch.select(range(last)).filter(pa.array(wanted))

        return placed.mapInArrow(run, docs.schema)

    listed = ids.select(F.col("id").alias("__near"))
    return rows(False).unionAll(rows(True).join(listed, own == F.col("__near"), "left_anti"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that an earlier id is a near copy of; rows with a null id stay."""
    near = near_duplicates(docs, id_col, "text", k, percent).filter("NOT kept").select(F.col(id_col).alias("id")).distinct()
    return without(docs, near, id_col)
