"""Sharding by extendible hashing, with a byte limit for every shard.

A row's address is the bits of the MD5 of its key, first bits first. The directory starts with one
bucket; only a bucket over the limit splits, on one more bit, until every bucket fits. Bytes are summed
by address prefix in Spark: a level's sums are split only below the oversized buckets, ``STRIDE``
bits at a time, so no level lists more than the buckets that still need a split, times 2**STRIDE.

Rows of one key share an address. Where equal keys alone exceed the limit, no bit can part them: after
``DEPTH`` bits they form overflow pages, numbered from 1. Such rows are written once with a number each, dealt by
it into parts of about ``PART`` limits' bytes, and paged inside their part: rows over half the limit have
a page each, the others share one for each half of the limit in their running sum, so that only a
single row may exceed the limit, and a retried task repeats the same pages.

A null key is the empty string, null and empty texts have no bytes, and an empty table gives no rows.
Further columns pass through; one with a result's name (n_bytes, shard, depth, overflow) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodspark.llm.text import Scratch

DEPTH, STRIDE = 60, 10
LIMIT = 4 << 20
#: Limits' worth of bytes in a part of overflowing rows, and leaves that are broadcast (about 100 bytes each).
PART, BROADCAST_LEAVES = 16, 100_000


def address(key: Column) -> Column:
    """DEPTH bits as a string of 0 and 1."""
    number = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DEPTH // 4), 16, 2)
    return F.lpad(number, DEPTH, "0")


def directory(rows: DataFrame, limit: int, scratch: Scratch, stride: int = STRIDE) -> DataFrame:
    """rows (address, n_bytes) to (shard, depth, shard_bytes): the leaves of the directory."""
    sums = scratch.written(rows.groupBy("address").agg(F.sum("n_bytes").alias("n_bytes")), "addresses")
    leaves, open_ = None, sums.agg(F.lit("").alias("shard"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("shard_bytes"))
    found = open_.filter((F.col("shard_bytes") <= limit)).select("shard", "shard_bytes")
    leaves = scratch.written(found, "leaves")
    open_ = scratch.written(open_.filter(F.col("shard_bytes") > limit), "open")
    at = 0
    while at < DEPTH and not open_.isEmpty():
        to = min(at + stride, DEPTH)
        # All prefixes of up to `to` bits below the open buckets.
        below = sums.join(open_.select(F.col("shard").alias("above")), F.substring("address", 1, at) == F.col("above"))
        cells = below.groupBy(F.substring("address", 1, to).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        each = (
            cells.select("n_bytes", F.explode(F.transform(F.sequence(F.lit(at + 1), F.lit(to)), lambda d: F.substr("cell", F.lit(1), d))).alias("shard"))
            .groupBy("shard")
            .agg(F.sum("n_bytes").alias("shard_bytes"))
        )
        each = scratch.written(each, f"levels-{to}")
        # A leaf: fits, and the bucket above it does not. Leaves that only exist empty are never listed.
        parents = each.filter(F.col("shard_bytes") > limit).select(F.col("shard").alias("above"))
        full = parents.unionByName(open_.select(F.col("shard").alias("above")))
        new = each.filter(F.col("shard_bytes") <= limit).join(
            full, F.expr("substring(shard, 1, length(shard) - 1)") == F.col("above"), "left_semi"
        )
        leaves = leaves.unionByName(new.select("shard", "shard_bytes"))
        open_ = scratch.written(each.filter((F.length("shard") == to) & (F.col("shard_bytes") > limit)), f"open-{to}")
        at = to
    rest = open_.select("shard", "shard_bytes").filter(F.length("shard") == DEPTH)
    return leaves.unionByName(rest).select("shard", F.length("shard").alias("depth"), "shard_bytes")


def assign(docs: DataFrame, key: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, shard (its bits), depth and overflow (0, or a page's number where equal keys overflow)."""
    scratch = Scratch(docs.sparkSession)
    passing = [c for c in docs.columns if c not in ("n_bytes", "shard", "depth", "overflow")]
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(*passing, n_bytes.alias("__bytes"), address(F.col(key)).alias("__address"))
    slim = rows.select(F.col("__address").alias("address"), F.col("__bytes").alias("n_bytes"))
    tree = scratch.written(directory(slim, limit, scratch), "directory")
    scratch.keep_only("directory")
    overflows = (F.col("depth") == DEPTH) & (F.col("shard_bytes") > limit)
    facts = tree.agg(F.min("depth").alias("least"), F.count("*").alias("n"), F.count_if(overflows).alias("over")).first()
    # Leaves hang together below cells as wide as the widest leaf, so each row meets exactly one cell.
    cell = lambda bits: F.substring(bits, 1, facts.least or 0)
    cells = tree.groupBy(cell("shard").alias("__cell")).agg(F.collect_list(F.struct("shard", "depth", "shard_bytes")).alias("__leaves"))
    if facts.n <= BROADCAST_LEAVES:
        cells = F.broadcast(cells)
    leaf = F.filter("__leaves", lambda x: F.startswith(F.col("__address"), x["shard"]))[0]
    found = rows.withColumn("__cell", cell("__address")).join(cells, "__cell").withColumn("__leaf", leaf)
    over = (F.col("__leaf.depth") == DEPTH) & (F.col("__leaf.shard_bytes") > limit)
    made = [F.col("__bytes").alias("n_bytes"), F.col("__leaf.shard").alias("shard"), F.col("__leaf.depth").alias("depth")]
    fits = (found.filter(~over) if facts.over else found).select(*passing, *made, F.lit(0).cast("long").alias("overflow"))
    if not facts.over:
        return fits
    own = found.filter(over).select(*passing, "__bytes", "__leaf", F.monotonically_increasing_id().alias("__row"))
    own = scratch.written(own, "overflow")
    parts = F.ceil(F.col("__leaf.shard_bytes") / (PART * limit))
    large = F.col("__bytes") * 2 > limit
    order = Window.partitionBy("__leaf.shard", "__part", "__large").orderBy("__bytes", "__row")
    before = F.coalesce(F.sum("__bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Even pages are shared, odd ones have a single row.
    page = F.when(F.col("__large"), 2 * F.row_number().over(order) - 1).otherwise(2 * F.floor(before * 2 / limit))
    paged = own.withColumn("__part", F.pmod(F.xxhash64("__row"), parts)).withColumn("__large", large)
    paged = paged.withColumn("overflow", (1 + F.col("__part") + parts * page).cast("long"))
    return fits.unionByName(paged.select(*passing, *made, "overflow"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Writes docs as Parquet, a folder and file for each shard or overflow page."""
    assign(docs, key, text_col, limit).repartition("shard", "overflow").write.partitionBy("shard", "overflow").parquet(path)
