"""Connected components over an edge table, by alternating large-star and small-star rounds.

Rounds shrink the table; once it holds at most ``FEW`` edges (some MB), one task finishes it by union-find, so that small
tables cost no rounds of many stages. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.text import Scratch

FEW = 200_000


def _united(edges: DataFrame) -> DataFrame:
    """Links (v, m) from every node of edges (v, m) to its component's least node, which is left out itself; all in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        v, m = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate([v, m]), return_inverse=True)
        a, b = at[: len(v)], at[len(v) :]
        least = np.arange(len(nodes))
        while True:
            near = np.minimum(least[a], least[b])
            new = least.copy()
            np.minimum.at(new, least[a], near)
            np.minimum.at(new, least[b], near)
            new = new[new]
            if (new == least).all():
                break
            least = new
        far = least < np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[least[far]])], names=["v", "m"])

    return edges.coalesce(1).mapInArrow(run, "v long, m long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) in both directions. Links each neighbour of u (the larger, or u and the smaller) to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = edges.join(least, "u")
    if large:
        near = near.filter("v > u").select("v", "m")
    else:
        near = near.filter("v < u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return near.filter("v <> m").distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node in the edges (a, b): component is the least node reachable.

    Rounds shorten chains until every node links straight to its component's least node, or until few edges are left. Rounds are
    written to the shared folder, so that a lost executor costs one round; a round's table goes once the
    next one stands. Self-links and repeated edges do no harm; an empty table gives no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges"
    )
    while True:
        if now.count() <= FEW:
            now = scratch.written(_united(now), "edges")
            break
        both = now.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            now.select(F.col("m").alias("u"), "v")
        )
        stars = _star(both, large=True)
        both = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            stars.select(F.col("m").alias("u"), "v")
        )
        now = scratch.written(_star(both, large=False), "edges")
        # Done when every node has one link, and none that has one is linked to.
        ends = now.select(F.col("v").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in_")).unionByName(
            now.select(F.col("m").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in_"))
        )
        open_ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in_").alias("in_")).filter(
            "out > 1 OR (out > 0 AND in_ > 0)"
        )
        if open_ends.isEmpty():
            break
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
        now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    )
