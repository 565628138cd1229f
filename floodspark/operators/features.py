"""Which gauge a stretch of river or a lake belongs to when the map is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.functions import geo as G
from floodspark.operators.graph import components
from floodspark.operators.nearby import points_in_polygons, snap_to_lines, within
from floodspark.operators.rivers import gap_bridges, network, segments

LINE_M, LAKE_M, RADIUS_KM = 500.0, 250.0, 40.0


def hosts(gauges: DataFrame, parts: DataFrame, metres: float = LINE_M) -> DataFrame:
    """The nearest line within metres of each gauge (id, lat, lon): id, part_id, name."""
    near = snap_to_lines(gauges, segments(parts), metres)
    best = near.groupBy("id").agg(F.min_by("part_id", F.struct("distance", "part_id")).alias("part_id"))
    return best.join(parts.select("part_id", "name"), "part_id")


def joined_reaches(parts: DataFrame, metres: float = 1000.0) -> DataFrame:
    """part_id, component of named parts: those of one name that touch, or that a gap of at most metres parts, are one reach of water."""
    net = network(parts.filter("name IS NOT NULL"))
    part = F.concat_ws("/", "name", "node")
    ends = net.select("part_id", "name", F.explode(F.array("start_node", "end_node")).alias("node")).withColumn("node", part)
    along = net.select(F.concat_ws("/", "name", "start_node").alias("a"), F.concat_ws("/", "name", "end_node").alias("b"))
    gaps = gap_bridges(parts.filter("name IS NOT NULL"), metres).select(F.concat_ws("/", "name", "a").alias("a"), F.concat_ws("/", "name", "b").alias("b"))
    found = components(along.unionByName(gaps), ends.select("node").distinct())
    return ends.join(found, "node").groupBy("part_id").agg(F.min("component").alias("component"))


def line_gauges(gauges: DataFrame, parts: DataFrame, km: float = RADIUS_KM, connected: bool = False) -> DataFrame:
    """part_id, gauge_id, distance: lines (part_id, name, coords) with the gauge (id, lat, lon) that they belong to.

    A gauge pulls in the line that hosts it and, where that has a name, every line of that name within km; a line
    that several gauges pull in goes to the one nearest to any of its vertices, the smaller id where two are equal.
    With connected, only lines that join the host without a gap over 1 km are pulled in, so that another river of the same
    name is not.
    """
    host = hosts(gauges, parts)
    vertices = parts.select("part_id", "name", F.explode("coords").alias("p")).select(F.col("part_id").alias("id"), "name", "p.lat", "p.lon")
    at = host.join(gauges.select("id", "lat", "lon"), "id").select(F.col("id").alias("rid"), F.col("part_id").alias("host"), "name", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    named = within(vertices, at.filter("name IS NOT NULL"), km, on=("name",)).select(F.col("id").alias("part_id"), F.col("rid").alias("gauge_id"), "host", "distance")
    if connected:
        whole = joined_reaches(parts)
        of = whole.select(F.col("part_id").alias("host"), F.col("component").alias("c"))
        named = named.join(whole, "part_id").join(of, "host").filter("component = c").drop("component", "c")
    # A host's vertices may all lie beyond km, so its distance is taken from all of them.
    own = parts.select("part_id", F.explode("coords").alias("p")).join(at.select(F.col("host").alias("part_id"), F.col("rid").alias("gauge_id"), "rlat", "rlon"), "part_id")
    own = own.select("part_id", "gauge_id", G.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("rlat"), F.col("rlon")).alias("distance"))
    pairs = named.select("part_id", "gauge_id", "distance").unionByName(own).groupBy("part_id", "gauge_id").agg(F.min("distance").alias("distance"))
    return _closest(pairs, "part_id")


def lake_gauges(gauges: DataFrame, lakes: DataFrame, metres: float = LAKE_M) -> DataFrame:
    """lake_id, gauge_id, distance: lakes (lake_id, polys) with the gauge that they belong to.

    A gauge pulls in the nearest lake within metres of its shore, or the one that it stands in; of several gauges,
    a lake goes to the one nearest to any of its vertices.
    """
    rings = lakes.select("lake_id", F.explode("polys").alias("rings")).select("lake_id", F.posexplode("rings").alias("ring", "coords"))
    shores = rings.select(F.xxhash64("lake_id", "ring", "coords").alias("part_id"), "lake_id", "coords")
    near = snap_to_lines(gauges, segments(shores.dropDuplicates(["part_id"])), metres).join(shores.select("part_id", "lake_id"), "part_id").select("id", "lake_id", "distance")
    inside = points_in_polygons(gauges, lakes.select(F.col("lake_id").cast("string").alias("pid"), "polys")).select("id", F.col("pid").cast("long").alias("lake_id"), F.lit(0.0).alias("distance"))
    found = near.unionByName(inside).groupBy("id").agg(F.min_by("lake_id", F.struct("distance", "lake_id")).alias("lake_id"))
    at = found.join(gauges.select("id", "lat", "lon"), "id")
    vertices = shores.select("lake_id", F.explode("coords").alias("p")).join(at, "lake_id")
    pairs = vertices.groupBy("lake_id", F.col("id").alias("gauge_id")).agg(F.min(G.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon"))).alias("distance"))
    return _closest(pairs, "lake_id")


def _closest(pairs: DataFrame, key: str) -> DataFrame:
    best = F.min(F.struct("distance", "gauge_id")).alias("b")
    return pairs.groupBy(key).agg(best).select(key, "b.gauge_id", "b.distance")


def feature_gauges(gauges: DataFrame, parts: DataFrame, lakes: DataFrame, km: float = RADIUS_KM, connected: bool = False) -> DataFrame:
    """kind (line or lake), id, gauge_id and distance (km, to the nearest vertex) of all features that a gauge pulls in."""
    lines = line_gauges(gauges, parts, km, connected).select(F.lit("line").alias("kind"), F.col("part_id").alias("id"), "gauge_id", "distance")
    water = lake_gauges(gauges, lakes).select(F.lit("lake").alias("kind"), F.col("lake_id").alias("id"), "gauge_id", "distance")
    return lines.unionByName(water)
