"""Queries on where things are: neighbours, cameras, places, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark.functions import geo as G
from floodspark.functions import status as S
from floodspark.operators import cameras as cam
from floodspark.operators import details as de
from floodspark.operators import nearby as op
from floodspark.operators import search as se
from floodspark.plans import query
from floodspark.plans.status import _RANK, current, status_sql
from floodspark.sources import adapt as A
from floodspark.sources.adapt import CAMERAS, GAUGES, NOW, PLACES, POINTS


def _km(a, b, r=G.EARTH_KM, la="lat", lo="lon"):
    return f"2 * {r} * asin(least(1.0, sqrt(pow(sin((radians({b}.{la}) - radians({a}.{la})) / 2), 2) + cos(radians({a}.{la})) * cos(radians({b}.{la})) * pow(sin(radians({b}.{lo} - {a}.{lo}) / 2), 2))))"


def _ranked(spark, sf_dir):
    return current(spark, sf_dir).select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), S.rank(F.col("display")).alias("rank"))


_NEAR = f""", {POINTS}, pairs AS (SELECT p.id, d.id AS rid, {_RANK} AS rank, {_km('p', 'd')} AS distance FROM points p, displayed d),
  hit AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC, distance, rid) AS place, count(*) OVER (PARTITION BY id) AS total FROM pairs WHERE distance <= 40),
  far AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, rid) AS place FROM pairs WHERE id NOT IN (SELECT id FROM hit))
  SELECT id, place::INTEGER AS place, rid, floor(distance * 1000)::BIGINT AS metres, total, false AS beyond_radius FROM hit WHERE place <= 100
  UNION ALL SELECT id, place::INTEGER, rid, floor(distance * 1000)::BIGINT, 5, true FROM far WHERE place <= 5"""


@query(status_sql("SELECT * FROM (SELECT 1)").replace(" SELECT * FROM (SELECT 1)", "") + _NEAR)
def nearby_gauges(spark, sf_dir):
    x = op.nearby_gauges(A.points(spark, sf_dir), _ranked(spark, sf_dir))
    return x.select("id", "place", "rid", F.floor(F.col("distance") * 1000).alias("metres"), "total", "beyond_radius")


@query(f"WITH {POINTS} SELECT p.id, floor({_km('p', 'c')} * 1000)::BIGINT AS metres, floor({_km('p', 'c', G.EARTH_M)})::BIGINT AS metres2, floor({_km('p', 'c')} / 1.609344)::BIGINT AS miles FROM points p, (SELECT 30.0::DOUBLE AS lat, -97.0::DOUBLE AS lon) c")
def haversine(spark, sf_dir):
    at = (F.col("lat"), F.col("lon"), F.lit(30.0), F.lit(-97.0))
    km = G.haversine_km(*at)
    return A.points(spark, sf_dir).select("id", F.floor(km * 1000).alias("metres"), F.floor(G.haversine_m(*at)).alias("metres2"), F.floor(S.km_to_miles(km)).alias("miles"))


@query(f"""WITH {POINTS} SELECT id, floor((lon + 180) / 360 * 256 * 1024)::BIGINT AS px, floor((0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 256 * 1024)::BIGINT AS py, floor((lon + 180) / 360 * 1024)::INTEGER AS tx, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 1024)::INTEGER AS ty FROM (SELECT *, sin(radians(lat)) AS s FROM points)""")
def web_mercator(spark, sf_dir):
    x, y = G.web_mercator_px(F.col("lat"), F.col("lon"), 10)
    tx, ty = G.tile_xy(F.col("lat"), F.col("lon"), 10)
    return A.points(spark, sf_dir).select("id", F.floor(x).alias("px"), F.floor(y).alias("py"), tx.alias("tx"), ty.alias("ty"))


_SUN = """WITH base AS (SELECT event_id, epoch_ms(ts)::DOUBLE / 86400000::DOUBLE - 10957.5::DOUBLE AS d, 30.0::DOUBLE AS lat, -97.0::DOUBLE AS lon FROM events),
 a AS (SELECT *, radians(357.529::DOUBLE + 0.98560028::DOUBLE * d) AS g, 280.459::DOUBLE + 0.98564736::DOUBLE * d AS q, radians(23.439::DOUBLE - 0.00000036::DOUBLE * d) AS tilt FROM base),
 b AS (SELECT *, radians(q + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS l FROM a),
 c AS (SELECT *, atan2(cos(tilt) * sin(l), cos(l)) AS ra, asin(sin(tilt) * sin(l)) AS dec FROM b),
 e AS (SELECT *, radians((18.697374558::DOUBLE + 24.06570982441908::DOUBLE * d) * 15::DOUBLE + lon) - ra AS h FROM c)
 SELECT event_id, round(degrees(asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(h))), 1) + 0.0::DOUBLE AS elevation FROM e"""


@query(_SUN)
def sun_elevation(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.select("event_id", (F.round(G.sun_elevation_deg(F.col("ts"), F.lit(30.0), F.lit(-97.0)), 1) + 0.0).alias("elevation"))


@query(f"WITH {CAMERAS} SELECT id FROM cameras WHERE state = 'TX' AND NOT hidden")
def camera_filter(spark, sf_dir):
    return cam.camera_filter(A.cameras(spark, sf_dir)).select("id")


_CAM_STATUS = f"CASE WHEN age <= 10800 THEN 'fresh' WHEN age <= 86400 THEN 'stale' ELSE 'offline' END"


@query(f"WITH {CAMERAS} SELECT id, age, {_CAM_STATUS} AS status FROM (SELECT *, date_diff('second', photo_at, TIMESTAMP '{NOW}') AS age FROM cameras)")
def camera_status(spark, sf_dir):
    at = F.col("photo_at")
    return A.cameras(spark, sf_dir).select("id", cam.photo_age(at, A.now()).alias("age"), cam.camera_status(at, A.now()).alias("status"))


_AGED = f"(SELECT *, {_CAM_STATUS} AS status FROM (SELECT *, date_diff('second', photo_at, TIMESTAMP '{NOW}') AS age FROM cameras))"


@query(f"WITH {CAMERAS} SELECT id, status, status <> 'offline' AS shown FROM {_AGED}")
def camera_partition(spark, sf_dir):
    return cam.camera_partition(A.cameras(spark, sf_dir), A.now()).select("id", "status", "shown")


@query(f"WITH {CAMERAS} SELECT count(*) FILTER (WHERE status <> 'offline') AS shown, count(*) FILTER (WHERE status = 'offline') AS offline FROM {_AGED}")
def camera_counts(spark, sf_dir):
    x = cam.camera_partition(A.cameras(spark, sf_dir), A.now())
    return x.agg(F.count_if("shown").alias("shown"), F.count_if(~F.col("shown")).alias("offline"))


@query(f"""WITH {GAUGES}, {CAMERAS}, s AS (SELECT c.id, g.id AS gauge_id, {_km('c', 'g', G.EARTH_M)} AS d FROM cameras c JOIN gauges g ON g.site = c.site), f AS (SELECT id, gauge_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, gauge_id DESC) AS r FROM s WHERE d <= 3000) WHERE r = 1),
  t AS (SELECT c.id, g.id AS gauge_id, {_km('c', 'g', G.EARTH_M)} AS d FROM cameras c, gauges g WHERE g.site IS NULL AND c.id NOT IN (SELECT id FROM f)), u AS (SELECT id, gauge_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, gauge_id DESC) AS r FROM t WHERE d <= 30) WHERE r = 1)
  SELECT c.id, coalesce(f.gauge_id, u.gauge_id) AS gauge_id FROM cameras c LEFT JOIN f ON f.id = c.id LEFT JOIN u ON u.id = c.id""")
def camera_gauge_link(spark, sf_dir):
    return cam.link_gauges(A.cameras(spark, sf_dir), A.gauges(spark, sf_dir))


@query(f"WITH {CAMERAS} SELECT id, rid, row_number() OVER (PARTITION BY id ORDER BY d, rid)::INTEGER AS place FROM (SELECT a.id, b.id AS rid, {_km('a', 'b', G.EARTH_M)} AS d FROM cameras a, cameras b WHERE a.id <> b.id) WHERE d <= 150")
def cameras_near(spark, sf_dir):
    return cam.cameras_near(A.cameras(spark, sf_dir))


@query(f"WITH {PLACES} SELECT lower(name) AS key, count(*) AS n FROM places GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark, sf_dir):
    return se.repeated_names(A.places(spark, sf_dir))


@query(f"""WITH {PLACES}, m AS (SELECT p.id, q.name AS landmark, q.id AS rid, {_km('p', 'q')} AS d FROM places p, places q WHERE q.population >= 10000 AND p.name <> q.name AND lower(p.name) IN (SELECT lower(name) FROM places GROUP BY 1 HAVING count(*) > 1))
  SELECT id, landmark, floor(d / 1.609344 + 0.5)::INTEGER AS miles FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS r FROM m) WHERE r = 1""")
def place_hint(spark, sf_dir):
    return se.place_hint(A.places(spark, sf_dir))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END::BIGINT AS population FROM part")
def place_population_join(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    known = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("population"))
    return se.place_population(p.select(F.col("p_partkey").alias("id")), known)


@query(f"WITH {PLACES} SELECT id, row_number() OVER (ORDER BY coalesce(population, 0) DESC, name, id) AS place FROM places ORDER BY place LIMIT 50")
def places_ranked(spark, sf_dir):
    from pyspark.sql.window import Window

    p = A.places(spark, sf_dir).select("id", F.coalesce("population", F.lit(0)).alias("population"), "name")
    order = [F.col("population").desc(), "name", "id"]
    return p.orderBy(*order).limit(50).select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("SELECT p_partkey AS id, lower(p_name) AS key, regexp_replace(p_name || ' ' || p_partkey, '[0-9]+$', '') || lpad(p_partkey::VARCHAR, 12, '0') AS sort_key FROM part")
def name_sort_key(spark, sf_dir):
    n = F.col("p_name")
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), se.normalize_text(n).alias("key"), se.name_sort_key(F.concat_ws(" ", n, F.col("p_partkey").cast("string"))).alias("sort_key"))


_Q = """CASE WHEN p_partkey % 60 = 0 THEN 'pt' || p_partkey WHEN p_partkey % 40 = 0 THEN p_name ELSE substr(split_part(p_name, ' ', 2), 1, 3) || ' ' || split_part(p_name, ' ', 1) END"""


@query(f"""WITH names AS (SELECT p_partkey AS doc_id, p_size, lower(p_name) AS key, list_concat(string_split(lower(p_name), ' '), ['pt' || p_partkey]) AS tokens FROM part),
  qw AS (SELECT query_id, len(words) AS n, unnest(words) AS word, unnest(range(0, len(words))) AS w FROM (SELECT p_partkey AS query_id, string_split(lower({_Q}), ' ') AS words FROM part WHERE p_partkey % 20 = 0)),
  dt AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS pos FROM names),
  h AS (SELECT query_id, n, doc_id, w, max(CASE WHEN word = token THEN 100 ELSE 60 END) AS points, arg_max(pos, (CASE WHEN word = token THEN 100 ELSE 60 END, -pos)) AS pos FROM qw JOIN dt ON starts_with(token, word) GROUP BY 1, 2, 3, 4),
  s AS (SELECT query_id, doc_id, floor(sum(points) / n + CASE WHEN n > 1 AND max(pos - w) = min(pos - w) THEN 25 ELSE 0 END + CASE WHEN min(pos) FILTER (WHERE w = 0) = 0 THEN 15 ELSE 0 END + 0.5)::INTEGER AS score FROM h GROUP BY query_id, n, doc_id HAVING count(*) = n)
  SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_size DESC, len(tokens), key, doc_id)::INTEGER AS place, count(*) OVER (PARTITION BY query_id) AS total FROM s JOIN names USING (doc_id)) WHERE place <= 30""")
def gauge_search(spark, sf_dir):
    """Queries are made from the names and codes of every twentieth row, against all rows."""
    p = A.table(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_name")
    code = F.concat(F.lit("PT"), k.cast("string"))
    part = lambda i: F.split_part(n, F.lit(" "), F.lit(i))
    typed = F.when(k % 60 == 0, code).when(k % 40 == 0, n).otherwise(F.concat_ws(" ", F.substring(part(2), 1, 3), part(1)))
    queries = p.filter(k % 20 == 0).select(k.alias("query_id"), typed.alias("query"))
    return se.search(queries, p.select(k.alias("doc_id"), n.alias("name"), F.col("p_size").alias("rank"), code.alias("code")))


@query(f"""WITH {PLACES}, {GAUGES}, pairs AS (SELECT p.id, g.id AS rid, {_km('p', 'g')} AS distance FROM places p, gauges g), hit AS (SELECT id, count(*) AS n, min(distance) AS d FROM pairs WHERE distance <= 40 GROUP BY 1)
  SELECT id, n, floor(d * 1000)::BIGINT AS metres, false AS beyond FROM hit
  UNION ALL SELECT id, 5, floor(min(distance) * 1000)::BIGINT, true FROM pairs WHERE id NOT IN (SELECT id FROM hit) GROUP BY 1""")
def gauges_near_place(spark, sf_dir):
    g = A.gauges(spark, sf_dir).select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), F.lit(0).alias("rank"))
    x = de.gauges_near_place(A.places(spark, sf_dir), g)
    return x.groupBy("id").agg(F.first("total").alias("n"), F.floor(F.min("distance") * 1000).alias("metres"), F.first("beyond_radius").alias("beyond"))


@query("""SELECT doc_id, regexp_replace(regexp_replace('Town of ' || source || ' city', '^(Town|City|Village) of ', ''), ' (city|town|village|CDP)$', '') AS name, trim(regexp_replace(lower(strip_accents(regexp_replace(lang || ' ' || source, '[''’ʼ`]', '', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""")
def display_place_name(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("Town of "), "source", F.lit(" city"))
    return d.select("doc_id", se.display_place_name(name).alias("name"), se.normalize_text(F.concat_ws(" ", "lang", "source")).alias("key"))


@query("""SELECT doc_id, trim(regexp_replace(lower(strip_accents(regexp_replace(text, '[''’ʼ`]', '', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""")
def normalize_text(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", se.normalize_text(F.col("text")).alias("key"))


@query("""WITH x AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN NULL ELSE c_custkey % 190 - 95.0 END AS lat, CASE c_custkey % 11 WHEN 4 THEN '-Infinity'::DOUBLE WHEN 5 THEN NULL ELSE c_custkey % 370 - 185.0 END AS lon FROM customer)
  SELECT id, lat, lon FROM x WHERE isfinite(lat) AND isfinite(lon) AND abs(lat) <= 90 AND abs(lon) <= 180""")
def valid_positions(spark, sf_dir):
    """Positions that are missing, no numbers, endless or off the globe go; poles and 180 degrees stay."""
    k, num = F.col("c_custkey"), lambda x: F.lit(float(x))
    lat = F.when(k % 7 == 1, num("nan")).when(k % 7 == 2, num("inf")).when(k % 7 != 3, k % 190 - 95.0)
    lon = F.when(k % 11 == 4, num("-inf")).when(k % 11 != 5, k % 370 - 185.0)
    x = A.table(spark, sf_dir, "customer").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"))
    return x.filter(G.valid_position(F.col("lat"), F.col("lon")))
