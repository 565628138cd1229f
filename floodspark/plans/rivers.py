"""Queries on the river network: hundreds of customers make a river, every third river has a creek of another name."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark.functions import geo as G
from floodspark.operators import features as ft
from floodspark.operators import rivers as op
from floodspark.plans import query
from floodspark.sources import adapt as A
from floodspark.sources.adapt import MESSAGES, ZONES

_PER, _LONG, _CREEK = 10, 300, 900  # points of a part, of a river; the number of a creek's part


def _points(spark, sf_dir):
    """part_id, r, k, i, lon, lat: rivers from west to east, about a kilometre a point, with a gap after every fourth part; creeks go north."""
    key = F.col("c_custkey").cast("long")
    c = A.table(spark, sf_dir, "customer").select(F.floor(key / _LONG).alias("r"), (key % _LONG).alias("i"))
    lon = F.lit(-140.0) + F.floor(F.col("r") / 300) * 4 + F.col("i") * 0.0104
    lat = F.lit(-60.0) + F.col("r") % 300 * 0.4 + F.col("i") % 3 * 0.002
    c = c.select("r", "i", F.floor(F.col("i") / _PER).alias("k"), lon.alias("lon"), lat.alias("lat"))
    # A part's last point is the next one's first, but at gaps.
    shared = c.filter((F.col("i") % _PER == 0) & (F.col("i") > 0) & (F.col("k") % 4 != 0)).withColumn("k", F.col("k") - 1)
    mouth = c.filter("i = 50 AND r % 3 = 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(6)).cast("array<bigint>")))
    creek = mouth.select("r", F.col("j").alias("i"), F.lit(_CREEK).cast("long").alias("k"), "lon", (F.col("lat") + F.col("j") * 0.01).alias("lat"))
    return c.unionByName(shared).unionByName(creek).withColumn("part_id", F.col("r") * 100_000 + F.col("k"))


def parts(spark, sf_dir):
    """part_id, feature_id, name, owner, coords: a river and its creek are two features; every fifth river has no name."""
    coords = F.transform(F.sort_array(F.collect_list(F.struct("i", "lon", "lat"))), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    g = _points(spark, sf_dir).groupBy("part_id", "r", "k").agg(coords.alias("coords")).filter(F.size("coords") > 1)
    creek = F.col("k") == _CREEK
    name = F.when(creek, F.format_string("Creek %d", F.col("r"))).when(F.col("r") % 5 != 0, F.format_string("River %d", F.col("r")))
    return g.select("part_id", (F.col("r") + F.when(creek, 1_000_000).otherwise(0)).alias("feature_id"), name.alias("name"), (F.col("r") * 1000 + F.when(creek, _CREEK).otherwise(0)).alias("owner"), "coords")


def staged(spark, sf_dir):
    """id, lat, lon of staged gauges: the first point of every second part of a river."""
    p = parts(spark, sf_dir).filter((F.col("part_id") % 2 == 0) & (F.col("feature_id") < 1_000_000))
    return p.select((F.col("feature_id") * 1000 + F.col("part_id") % 100_000).alias("id"), F.col("coords")[0]["lat"].alias("lat"), F.col("coords")[0]["lon"].alias("lon"))


_LENGTH = f"sqrt(pow((lat1 - lat) * {G.DEGREE_LAT_M}::DOUBLE, 2) + pow((lon1 - lon) * {G.DEGREE_LON_M}::DOUBLE * cos(radians((lat + lat1) / 2)), 2))"
_PARTS = f"""c AS (SELECT c_custkey::BIGINT // {_LONG} AS r, c_custkey::BIGINT % {_LONG} AS i FROM customer),
  k AS (SELECT *, i // {_PER} AS k, -140.0::DOUBLE + r // 300 * 4 + i * 0.0104::DOUBLE AS lon, -60.0::DOUBLE + r % 300 * 0.4::DOUBLE + i % 3 * 0.002::DOUBLE AS lat FROM c),
  p AS (SELECT r, i, k, lon, lat FROM k UNION ALL SELECT r, i, k - 1, lon, lat FROM k WHERE i % {_PER} = 0 AND i > 0 AND k % 4 <> 0
    UNION ALL SELECT r, j, {_CREEK}, lon, lat + j * 0.01::DOUBLE FROM k, (SELECT unnest(range(0, 7)) AS j) WHERE i = 50 AND r % 3 = 0),
  pt AS (SELECT *, r * 100000 + k AS part_id, r + CASE WHEN k = {_CREEK} THEN 1000000 ELSE 0 END AS feature_id, r * 1000 + CASE WHEN k = {_CREEK} THEN {_CREEK} ELSE 0 END AS owner,
    CASE WHEN k = {_CREEK} THEN 'Creek ' || r WHEN r % 5 <> 0 THEN 'River ' || r END AS name, round(lon * 1e5)::BIGINT || ',' || round(lat * 1e5)::BIGINT AS node FROM p QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
  s AS (SELECT *, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM pt WINDOW w AS (PARTITION BY part_id ORDER BY i)),
  net AS (SELECT part_id, feature_id, owner, name, sum({_LENGTH}) AS len_m, first(node ORDER BY i) AS start_node, last(node ORDER BY i) AS end_node FROM s GROUP BY ALL)"""


@query(f"WITH {_PARTS} SELECT part_id, feature_id, start_node, end_node, round(len_m, 3) AS len_m FROM net")
def river_network(spark, sf_dir):
    return op.network(parts(spark, sf_dir)).select("part_id", "feature_id", "start_node", "end_node", F.round("len_m", 3).alias("len_m"))


@query(f"WITH {_PARTS} SELECT node, count(*) AS degree FROM (SELECT start_node AS node FROM net UNION ALL SELECT end_node FROM net WHERE end_node <> start_node) GROUP BY 1")
def river_degrees(spark, sf_dir):
    return op.degrees(op.network(parts(spark, sf_dir)))


@query(f"WITH {_PARTS} SELECT owner, round(sum(len_m) / 1000, 3) AS km FROM net GROUP BY 1")
def river_length_by_owner(spark, sf_dir):
    p = parts(spark, sf_dir)
    x = op.segments(p).join(p.select("part_id", "owner"), "part_id")
    return x.groupBy("owner").agg(F.round(F.sum("length_m") / 1000, 3).alias("km"))


_BRIDGES = f"""ends AS (SELECT part_id, name, node, lat, lon FROM pt QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY i) = 1 OR row_number() OVER (PARTITION BY part_id ORDER BY i DESC) = 1),
  loose AS (SELECT * FROM ends WHERE node IN (SELECT node FROM ends GROUP BY 1 HAVING count(DISTINCT part_id) = 1)),
  near AS (SELECT a.node AS id, b.node AS rid, coalesce(a.name, b.name) AS name, sqrt(pow((b.lat - a.lat) * {G.DEGREE_LAT_M}::DOUBLE, 2) + pow((b.lon - a.lon) * {G.DEGREE_LON_M}::DOUBLE * cos(radians(a.lat)), 2)) AS d
    FROM loose a JOIN loose b ON a.part_id <> b.part_id AND (a.name IS NULL OR b.name IS NULL OR a.name = b.name) AND abs(a.lat - b.lat) < 0.02),
  best AS (SELECT id, rid, d, name FROM near WHERE d < 1000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, rid) = 1),
  bridges AS (SELECT least(id, rid) AS a, greatest(id, rid) AS b, min(d) AS distance, min(name) AS name FROM best GROUP BY 1, 2)"""


@query(f"WITH {_PARTS}, {_BRIDGES} SELECT a, b, round(distance, 3) AS distance, name FROM bridges")
def network_gap_bridge(spark, sf_dir):
    return op.gap_bridges(parts(spark, sf_dir)).withColumn("distance", F.round("distance", 3))


_SNAP = f"""sg AS (SELECT *, row_number() OVER w AS seq, coalesce(sum(m) OVER (PARTITION BY part_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m
    FROM (SELECT *, {_LENGTH} AS m FROM s WHERE lon1 IS NOT NULL) WINDOW w AS (PARTITION BY part_id ORDER BY i)),
  st AS (SELECT r * 1000 + k AS id, first(lat ORDER BY i) AS plat, first(lon ORDER BY i) AS plon FROM pt WHERE part_id % 2 = 0 AND k <> {_CREEK} GROUP BY r, k),
  o AS (SELECT id, part_id, seq, start_m, m, (lon - plon) * kx AS ax, (lat - plat) * k0 AS ay, (lon1 - lon) * kx AS bx, (lat1 - lat) * k0 AS by_
    FROM (SELECT *, {G.DEGREE_LAT_M}::DOUBLE AS k0, {G.DEGREE_LON_M}::DOUBLE * cos(radians(plat)) AS kx FROM st JOIN sg ON abs(lat - plat) < 0.1 AND abs(lon - plon) < 0.1)),
  u AS (SELECT *, CASE WHEN bx * bx + by_ * by_ = 0 THEN 0 ELSE least(1.0, greatest(0.0, -(ax * bx + ay * by_) / (bx * bx + by_ * by_))) END AS t FROM o),
  snap AS (SELECT id, part_id, distance, along FROM (SELECT *, sqrt(pow(ax + t * bx, 2) + pow(ay + t * by_, 2)) AS distance, start_m + t * m AS along FROM u)
    WHERE distance <= 750 QUALIFY row_number() OVER (PARTITION BY id, part_id ORDER BY distance, seq) = 1)"""


@query(f"WITH {_PARTS}, {_SNAP} SELECT id, part_id, round(distance, 3) + 0.0::DOUBLE AS distance, round(along, 1) + 0.0::DOUBLE AS along FROM snap")
def gauge_line_snap(spark, sf_dir):
    x = op.snap_to_lines(staged(spark, sf_dir), op.segments(parts(spark, sf_dir)))
    return x.select("id", "part_id", (F.round("distance", 3) + 0.0).alias("distance"), (F.round("along", 1) + 0.0).alias("along"))


_CANDIDATES = """sn AS (SELECT snap.*, name FROM snap JOIN net USING (part_id)),
  rv AS (SELECT id, coalesce(min(distance) FILTER (WHERE name IS NOT NULL), min(distance)) AS reference, arg_min(name, (distance, part_id)) FILTER (WHERE name IS NOT NULL) AS river FROM sn GROUP BY 1),
  cand AS (SELECT id, part_id, river, along FROM sn JOIN rv USING (id) WHERE distance <= reference + 150 AND (name IS NULL OR river IS NULL OR name = river))"""


@query(f"WITH {_PARTS}, {_SNAP}, {_CANDIDATES} SELECT id, part_id, river, round(along, 1) + 0.0::DOUBLE AS along FROM cand")
def river_candidates(spark, sf_dir):
    return op.candidates(staged(spark, sf_dir), parts(spark, sf_dir)).select("id", "part_id", "river", (F.round("along", 1) + 0.0).alias("along"))


#: Rivers and creeks have no circles, so walks that never turn on the way they came by end.
_WALKED = """ways AS (SELECT part_id AS way, start_node AS a, end_node AS b, len_m AS m, name FROM net UNION ALL SELECT part_id, end_node, start_node, len_m, name FROM net
    UNION ALL SELECT -row_number() OVER (ORDER BY a), a, b, distance, name FROM bridges UNION ALL SELECT -row_number() OVER (ORDER BY a), b, a, distance, name FROM bridges),
  starts AS (SELECT id, river, start_node AS node, along AS metres, part_id AS way FROM cand JOIN net USING (part_id) UNION ALL SELECT id, river, end_node, len_m - along, part_id FROM cand JOIN net USING (part_id)),
  walks AS (SELECT * FROM starts WHERE metres <= 40000
    UNION ALL SELECT w.id, w.river, e.b, w.metres + e.m, e.way FROM walks w JOIN ways e ON e.a = w.node AND e.way <> w.way AND (w.river IS NULL OR e.name IS NULL OR e.name = w.river) WHERE w.metres + e.m <= 40000)"""


@query(f"WITH RECURSIVE {_PARTS}, {_BRIDGES}, {_SNAP}, {_CANDIDATES}, {_WALKED} SELECT id, node, any_value(river) AS river, round(min(metres), 2) + 0.0::DOUBLE AS metres FROM walks GROUP BY 1, 2")
def river_distances(spark, sf_dir):
    p, g = parts(spark, sf_dir), staged(spark, sf_dir)
    x = op.distances(op.candidates(g, p), op.network(p), op.gap_bridges(p), op.part_boxes(g, op.segments(p)))
    return x.select("id", "node", "river", (F.round("metres", 2) + 0.0).alias("metres"))


@query()
def river_owner_cut(spark, sf_dir):
    """Tests hold the cut against a walk on random named networks."""
    return op.segmentation(parts(spark, sf_dir), staged(spark, sf_dir))[0]


@query()
def river_regroup(spark, sf_dir):
    p = parts(spark, sf_dir)
    x = op.regroup(op.segmentation(p, staged(spark, sf_dir))[0], p)
    return x.withColumn("points", F.aggregate("coords", F.lit(0), lambda n, c: n + F.size(c))).drop("coords")


@query()
def segment_stats(spark, sf_dir):
    """Rivers and creeks are line features, parts of the star schema lakes."""
    p = parts(spark, sf_dir)
    pieces, cands = op.segmentation(p, staged(spark, sf_dir))
    lakes = A.table(spark, sf_dir, "part").select((F.col("p_partkey") + 10_000_000).alias("feature_id"), F.lit("Polygon").alias("kind"))
    features = p.select("feature_id", F.lit("MultiLineString").alias("kind")).distinct().unionByName(lakes)
    return op.segment_stats(features, p, pieces, cands)


@query()
def staged_neighbor(spark, sf_dir):
    """The staged gauge whose stretch, after segmentation, lies under the second point of every other part."""
    p, own = parts(spark, sf_dir), staged(spark, sf_dir)
    middle = p.filter(F.col("part_id") % 2 == 1).select(F.col("part_id").alias("id"), F.col("coords")[1]["lat"].alias("lat"), F.col("coords")[1]["lon"].alias("lon"))
    lines = op.piece_lines(op.segmentation(p, own)[0], p).select((F.col("part_id") * 100 + F.col("piece")).alias("part_id"), "owner", "coords")
    return op.staged_neighbor(middle, own.select(F.col("id").alias("owner"), F.col("lat").alias("olat"), F.col("lon").alias("olon")), lines)


def _lakes(spark, sf_dir):
    """A square lake a little east of every second staged gauge."""
    k = F.col("id") % 1000
    west = F.col("lon") + 0.002 + k % 8 * 0.0005
    corner = lambda x, y: F.struct((west + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    ring = F.array(*[corner(x, y) for x, y in ((0.0, -0.005), (0.01, -0.005), (0.01, 0.005), (0.0, 0.005), (0.0, -0.005))])
    return staged(spark, sf_dir).filter(k % 4 == 0).select(F.col("id").alias("lake_id"), F.array(F.array(ring)).alias("polys"))


def _sphere(lat: str, lon: str) -> str:
    return f"2 * {G.EARTH_KM}::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(plat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(plat)) * pow(sin(radians(plon - {lon}) / 2), 2))))"


@query(f"""WITH {_PARTS}, {_SNAP}, host AS (SELECT id, part_id, name FROM snap JOIN net USING (part_id) WHERE distance <= 500 QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, part_id) = 1),
  v AS (SELECT pt.part_id, st.id, {_sphere('lat', 'lon')} AS d, pt.part_id = host.part_id AS own FROM host JOIN st USING (id) JOIN pt ON pt.part_id = host.part_id OR pt.name = host.name),
  l AS (SELECT part_id, id, min(d) AS d FROM v WHERE own OR d <= 40 GROUP BY 1, 2),
  w AS (SELECT id, plat, plon, plon + 0.002::DOUBLE + id % 1000 % 8 * 0.0005::DOUBLE AS west FROM st WHERE id % 1000 % 4 = 0),
  a AS (SELECT id, {_sphere('plat - 0.005::DOUBLE', 'west')} AS d1, {_sphere('plat + 0.005::DOUBLE', 'west')} AS d2 FROM w WHERE (west - plon) * {G.DEGREE_LON_M}::DOUBLE * cos(radians(plat)) <= 250)
  SELECT 'line' AS kind, part_id AS id, id AS gauge_id, round(d, 6) AS distance FROM l QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY d, l.id) = 1
  UNION ALL SELECT 'lake', id, id, round(least(d1, d2), 6) FROM a""")
def feature_gauge_assignment(spark, sf_dir):
    """Rivers of many parts with several gauges each, and lakes near some."""
    x = ft.feature_gauges(staged(spark, sf_dir), parts(spark, sf_dir), _lakes(spark, sf_dir))
    return x.withColumn("distance", F.round("distance", 6))


@query(f"""WITH RECURSIVE {_PARTS}, r AS (SELECT part_id, i, lon, lat, row_number() OVER w AS j, count(*) OVER (PARTITION BY part_id) AS n, first_value(lon) OVER w AS flon, first_value(lat) OVER w AS flat, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS nlon, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS nlat FROM pt WINDOW w AS (PARTITION BY part_id ORDER BY i))
  SELECT part_id, round(sum(lon * nlat - nlon * lat) / 2, 6) + 0.0::DOUBLE AS area, min(lon) AS west, max(lat) AS north FROM r WHERE n > 2 GROUP BY part_id""")
def ring_area(spark, sf_dir):
    ring = op.closed_ring(F.col("coords"))
    x = parts(spark, sf_dir).select("part_id", ring.alias("ring")).filter("ring IS NOT NULL")
    b = op.bounds(F.col("ring"))
    return x.select("part_id", (F.round(op.ring_area(F.col("ring")), 6) + 0.0).alias("area"), b["west"].alias("west"), b["north"].alias("north"))


@query(f"""WITH {MESSAGES} SELECT key, CASE WHEN key % 4 = 3 THEN NULL ELSE 1 END AS polygons, CASE WHEN key % 4 = 3 THEN NULL WHEN key % 4 = 1 THEN 2 ELSE 1 END AS rings, CASE WHEN key % 4 = 3 THEN NULL ELSE 5 END AS points FROM (SELECT id AS key FROM messages)""")
def simplify_geometry(spark, sf_dir):
    """Squares of many points, with a hole, with one that is a sliver, and slivers themselves: what is left are their corners."""
    k = F.col("id")
    x, y = F.floor(k / 100) % 100 * 1.0, k % 50 * 1.0

    def square(west, south, w):
        """Twelve points a side."""
        f = lambda i: i % 12 / 12.0 * w
        east = lambda i: F.when(i < 12, f(i)).when(i < 24, w).when(i < 36, w - f(i)).otherwise(0.0)
        north = lambda i: F.when(i < 12, 0.0).when(i < 24, f(i)).when(i < 36, w).when(i < 48, w - f(i)).otherwise(0.0)
        return F.transform(F.sequence(F.lit(0), F.lit(48)), lambda i: F.struct((west + east(i)).alias("lon"), (south + north(i)).alias("lat")))

    whole, hole, sliver = square(x, y, 0.5), square(x + 0.1, y + 0.1, 0.2), square(x + 0.1, y + 0.1, 0.001)
    polys = F.when(k % 4 == 0, F.array(F.array(whole))).when(k % 4 == 1, F.array(F.array(whole, hole))).when(k % 4 == 2, F.array(F.array(whole, sliver), F.array(sliver))).otherwise(F.array(F.array(sliver)))
    out = op.simplify(A.messages(spark, sf_dir).select(k.alias("key"), polys.alias("polys")))
    p = F.col("polys")
    has = lambda v: F.when(p.isNotNull(), v)
    return out.select("key", has(F.size(p)).alias("polygons"), has(F.size(p[0])).alias("rings"), has(F.size(p[0][0])).alias("points"))


@query(f"WITH {ZONES} SELECT code, CASE WHEN has_shape THEN round(x + 0.5, 6) END AS lon, CASE WHEN has_shape THEN round(y + 1.0, 6) END AS lat, CASE WHEN has_shape THEN format('https://forecast.weather.gov/MapClick.php?lat={{:.4f}}&lon={{:.4f}}', y + 1.0, x + 0.5) ELSE 'https://www.weather.gov/ewx/' END AS link FROM zones")
def representative_point(spark, sf_dir):
    """Each zone's hole lies around its centroid, so the point is in the first stretch beside it."""
    z = A.zones(spark, sf_dir)
    p = op.representative_point(F.col("polys"))
    return z.select("code", F.round(p["lon"], 6).alias("lon"), F.round(p["lat"], 6).alias("lat"), op.map_link(F.col("polys"), F.lit("KEWX")).alias("link"))
