"""Queries on feed readers: bodies are made from the tables as the feeds would send them, then read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from floodspark.operators import alerts as al
from floodspark.operators.kept import shared_folder
from floodspark.plans import ORACLES, query
from floodspark.sources import adapt as A
from floodspark.sources import feeds
from floodspark.sources.adapt import CAMERAS, GAUGES, MESSAGES, ZONES

_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


#: Rows of a body, at most, where ids are numbers in a row.
_BODY = 1000


def _bodies(rows, item, key=None, by=None):
    """One body for about a thousand rows by their number: a JSON array of items in order, or an object that holds it; number counts bodies."""
    number = F.floor((F.col(rows.columns[0]) if by is None else by) / _BODY)
    order = F.col(rows.columns[0]) if by is None else by
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("item")))), lambda x: x["item"])
    return rows.groupBy(number.alias("number")).agg(F.to_json(listed if key is None else F.struct(listed.alias(key))).alias("body"))


def _feed(spark, sf_dir):
    g = A.gauges(spark, sf_dir)
    i = F.col("id")
    seen = F.struct(F.when(i % 6 == 0, F.lit(-999.0)).otherwise(i * 1.5).alias("primary"), F.when(i % 2 == 0, "ft").otherwise(" ").alias("primaryUnit"), F.lit("minor").alias("floodCategory"), F.lit("2024-01-05T06:00:00Z").alias("validTime"))
    item = F.struct(
        F.when(i % 50 != 49, F.concat(F.lit("G"), i.cast("string"))).alias("lid"), "name", F.struct(F.when(i % 10 == 0, "OK").otherwise("TX").alias("abbreviation")).alias("state"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.struct(F.col("unit").alias("stageUnits")).alias("flood"), F.struct(seen.alias("observed")).alias("status"),
    )
    return _bodies(g, item, "gauges")


@query(f"WITH {GAUGES} SELECT 'G' || id AS gauge_id, name, lat, lon, CASE WHEN id % 6 = 0 THEN -999.0 ELSE id * 1.5 END::DOUBLE AS v, CASE WHEN id % 2 = 0 THEN 'ft' ELSE unit END AS unit, TIMESTAMP '2024-01-05 06:00:00' AS t FROM gauges WHERE id % 10 <> 0 AND id % 50 <> 49")
def src_gauge_feed(spark, sf_dir):
    return feeds.gauge_feed(_feed(spark, sf_dir)).select("gauge_id", "name", "lat", "lon", "v", F.col("feed_unit").alias("unit"), "t")


@query(f"WITH {GAUGES} SELECT 'G' || id AS lid, name, lat AS latitude, lon AS longitude FROM gauges WHERE id % 10 <> 0 AND id % 50 <> 49")
def src_slim_list(spark, sf_dir):
    return feeds.slim_list(feeds.gauge_feed(_feed(spark, sf_dir)))


@query("SELECT 'S' || user_id AS site, date_trunc('second', ts) AS t, CASE WHEN event_id % 9 <> 0 THEN event_id / 4.0 END AS v FROM events")
def src_usgs_iv(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    i = F.col("event_id")
    value = F.struct(F.date_format("ts", _ISO).alias("dateTime"), F.when(i % 9 == 0, "Ice").otherwise((i / 4.0).cast("string")).alias("value"))
    one = e.groupBy("user_id").agg(F.collect_list(value).alias("vs"))
    series = F.struct(
        F.struct(F.array(F.struct(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("value"))).alias("siteCode")).alias("sourceInfo"), F.array(F.struct(F.col("vs").alias("value"))).alias("values")
    )
    body = F.to_json(F.struct(F.struct(F.collect_list(series).alias("timeSeries")).alias("value")))
    files = one.groupBy(F.floor(F.col("user_id") / 20)).agg(body.alias("body"))
    return feeds.site_values(files).select("site", "t", "v")


@query("SELECT 'G' || user_id AS gauge_id, CASE WHEN event_id % 8 <> 0 THEN date_trunc('second', ts) END AS t, event_id / 4.0 AS v, CASE WHEN user_id % 3 <> 0 THEN TIMESTAMP '2024-01-01 06:00:00' END AS issued_at, 'ft' AS unit FROM events")
def src_series(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    i = F.col("event_id")
    point = F.struct(F.when(i % 8 == 0, "0001-01-01T00:00:00Z").otherwise(F.date_format("ts", _ISO)).alias("validTime"), (i / 4.0).alias("primary"))
    issued = F.when(F.col("user_id") % 3 == 0, "0001-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00-06:00")
    body = F.to_json(F.struct(F.first(issued).alias("issuedTime"), F.lit("ft").alias("primaryUnits"), F.collect_list(point).alias("data")))
    files = e.groupBy(F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("gauge_id")).agg(body.alias("body"))
    return feeds.series(files).select("gauge_id", "t", "v", "issued_at", "unit")


@query("SELECT 'S' || user_id AS site, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 5 <> 0 THEN event_id / 4.0 END AS stage FROM events")
def src_peak_rdb(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    i = F.col("event_id")
    line = F.concat(F.lit("USGS\t"), F.date_format("ts", "yyyy-MM-dd"), F.lit("\t"), F.when(i % 5 == 0, "").otherwise((i / 4.0).cast("string")))
    head = F.array(F.lit("# made from events"), F.lit("agency\tpeak_dt\tgage_ht"), F.lit("5s\t10d\t8s"))
    files = e.groupBy(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("site")).agg(F.array_join(F.concat(head, F.collect_list(line)), "\n").alias("body"))
    return feeds.peaks(files).select("site", "date", "stage")


def _alert_bodies(spark, sf_dir):
    """The messages as a feed sends them: lists of VTEC that begin with other text, zones where codes lack, shapes of three kinds."""
    m = A.messages(spark, sf_dir)
    k = F.col("id")
    iso = lambda c: F.date_format(c, _ISO)
    ring = F.transform(F.col("polys")[0][0], lambda p: F.array(p["lon"], p["lat"]))
    text = lambda kind, inner: F.concat(F.lit('{"type":"' + kind + '",'), inner, F.lit("}"))
    coords = F.to_json(F.array(ring))
    one = text("Polygon", F.concat(F.lit('"coordinates":'), coords))
    shape = (
        F.when(F.col("polys").isNull(), F.when(k % 5 == 0, F.lit('{"type":"Point","coordinates":[1,2]}')).otherwise("null"))
        .when(k % 3 == 0, one)
        .when(k % 3 == 1, text("MultiPolygon", F.concat(F.lit('"coordinates":['), coords, F.lit("]"))))
        .otherwise(text("GeometryCollection", F.concat(F.lit('"geometries":[{"type":"Point","coordinates":[1,2]},'), one, F.lit("]"))))
    )
    params = F.struct(F.when(F.col("vtec").isNotNull(), F.array(F.lit("none"), F.col("vtec"))).alias("VTEC"), F.when(F.col("catastrophic"), F.array(F.lit("catastrophic"))).alias("flashFloodDamageThreat"), F.array(F.col("headline")).alias("NWSheadline"))
    zones = F.transform("ugc", lambda c: F.concat(F.lit("https://api/zones/county/"), c))
    p = F.struct(
        F.col("cap_id").alias("id"), "event", "status", F.col("message_type").alias("messageType"), F.when(k % 9 != 0, iso("sent")).alias("sent"), iso("sent").alias("effective"), iso("ends").alias("ends"), iso("expires").alias("expires"),
        F.when(k % 2 == 0, F.struct(F.col("ugc").alias("UGC"))).alias("geocode"), zones.alias("affectedZones"), F.col("area_desc").alias("areaDesc"), F.when(k % 4 != 0, F.col("headline")).alias("headline"), "instruction", params.alias("parameters"),
    )
    feature = F.concat(F.lit('{"geometry":'), shape, F.lit(',"properties":'), F.to_json(p), F.lit("}"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("o"), feature.alias("f")))), lambda x: x["f"])
    return m.groupBy(F.floor(k / _BODY).alias("number")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("body"))


def _read_messages(spark, sf_dir):
    return feeds.alert_messages(feeds.alert_feed(_alert_bodies(spark, sf_dir)), A.now())


@query(f"WITH {MESSAGES} SELECT cap_id, vtec, event, status, message_type, sent, ends, expires, array_to_string(ugc, ',') AS ugc, array_to_string(areas, '; ') AS area_desc, catastrophic, 'Headline ' || id AS headline, own_x AS west, own_y AS south FROM messages")
def src_alert_feed(spark, sf_dir):
    """Bodies of about a thousand features each, to messages."""
    x = _read_messages(spark, sf_dir)
    low = lambda c: F.round(F.array_min(F.transform(F.col("polys")[0][0], lambda p: p[c])), 9)
    return x.select("cap_id", "vtec", "event", "status", "message_type", "sent", "ends", "expires", F.array_join("ugc", ",").alias("ugc"), "area_desc", "catastrophic", "headline", low("lon").alias("west"), low("lat").alias("south"))


@query(ORACLES["alert_event_merge"].replace("SELECT key, id, event", "SELECT key, 'urn:' || id AS cap_id, event"))
def alert_feed_events(spark, sf_dir):
    """From bodies to events: read, filter, cancel, merge."""
    m = _read_messages(spark, sf_dir)
    x = al.merge_events(al.without_cancelled(m, A.now())).join(m.select("id", "cap_id"), "id")
    return x.select("key", "cap_id", "event", "level", "headline", "instruction", "sent", "expires", "ends", "n", F.array_join("ugc", ",").alias("ugc"), "area_desc", F.col("own_polys").isNotNull().alias("shaped"))


_KINDS = """b AS (SELECT o_orderkey AS id, CASE o_orderkey % 12
    WHEN 0 THEN '{"alerts":[{"id":"a' || o_orderkey || '","event":"Flood Watch","ugc":[]}],"updatedAt":"2024-01-01T00:00:00Z","ok":true}' WHEN 1 THEN '{"alerts":[],"updatedAt":null,"ok":false}'
    WHEN 2 THEN '{"alerts":[{"id":5,"event":"x","ugc":[]}],"updatedAt":null,"ok":true}' WHEN 3 THEN '{"alerts":[null],"updatedAt":null,"ok":true}' WHEN 4 THEN '{"alerts":[],"ok":true}'
    WHEN 5 THEN '{"gauges":{"A' || o_orderkey || '":{}},"updatedAt":"now"}' WHEN 6 THEN '{"gauges":{},"updatedAt":7}' WHEN 7 THEN '[{"lid":"A"}]' WHEN 8 THEN '{"gauges":[]}'
    WHEN 9 THEN '<html>502</html>' WHEN 10 THEN '{"alerts":[' ELSE '"text"' END AS body FROM orders)"""


@query(f"""WITH {_KINDS}, j AS (SELECT id, CASE WHEN json_valid(body) THEN body END AS j FROM b), t AS (SELECT id, j, json_type(j) AS top, json_type(j, '$.gauges') AS g, json_type(j, '$.updatedAt') AS u FROM j),
  k AS (SELECT id, j, CASE WHEN json_type(j, '$.alerts') = 'ARRAY' AND u IN ('VARCHAR', 'NULL') AND json_type(j, '$.ok') = 'BOOLEAN'
      AND len(list_filter(json_extract(j, '$.alerts[*]'), lambda a: NOT coalesce(json_type(a, '$.id') = 'VARCHAR' AND json_type(a, '$.event') = 'VARCHAR' AND json_type(a, '$.ugc') = 'ARRAY', false))) = 0 THEN 'alerts'
    WHEN g = 'OBJECT' AND u = 'VARCHAR' THEN 'processed' WHEN top = 'ARRAY' OR g = 'ARRAY' THEN 'list' END AS kind FROM t)
  SELECT id, kind, CASE WHEN j IS NULL THEN 'no JSON' WHEN kind IS NULL THEN 'another shape' END AS reason FROM k""")
def json_shapes(spark, sf_dir):
    """Good, broken and foreign bodies."""
    k = F.col("o_orderkey")
    name = k.cast("string")
    bodies = [
        F.concat(F.lit('{"alerts":[{"id":"a'), name, F.lit('","event":"Flood Watch","ugc":[]}],"updatedAt":"2024-01-01T00:00:00Z","ok":true}')), F.lit('{"alerts":[],"updatedAt":null,"ok":false}'),
        F.lit('{"alerts":[{"id":5,"event":"x","ugc":[]}],"updatedAt":null,"ok":true}'), F.lit('{"alerts":[null],"updatedAt":null,"ok":true}'), F.lit('{"alerts":[],"ok":true}'),
        F.concat(F.lit('{"gauges":{"A'), name, F.lit('":{}},"updatedAt":"now"}')), F.lit('{"gauges":{},"updatedAt":7}'), F.lit('[{"lid":"A"}]'), F.lit('{"gauges":[]}'), F.lit("<html>502</html>"), F.lit('{"alerts":['), F.lit('"text"'),
    ]
    x = A.table(spark, sf_dir, "orders").select(k.alias("id"), F.get(F.array(*bodies), (k % 12).cast("int")).alias("body"))
    return feeds.body_kinds(x).select("id", "kind", "reason")


@query(f"WITH {ZONES} SELECT code, CASE WHEN has_shape THEN 1 END AS polygons, CASE WHEN has_shape THEN 2 END AS rings, CASE WHEN has_shape THEN round(x, 6) END AS west FROM zones")
def src_zones(spark, sf_dir):
    """Zones as polygons, as many polygons, as a collection with a point, and as a collection in a collection."""
    z = A.zones(spark, sf_dir)
    coords = F.to_json(F.transform(F.col("polys")[0], lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))))
    n = F.substring("code", 4, 3).cast("int") % 4
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":'), coords, F.lit("}"))
    shape = (
        F.when(F.col("polys").isNull(), F.lit('{"type":"Point","coordinates":[1,2]}'))
        .when(n == 0, polygon)
        .when(n == 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), coords, F.lit("]}")))
        .when(n == 2, F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},'), polygon, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection","geometries":['), polygon, F.lit("]}]}")))
    )
    body = F.concat(F.lit('{"properties":{"id":"'), "code", F.lit('"},"geometry":'), shape, F.lit("}"))
    x = feeds.zones(z.select(body.alias("body")))
    p = F.col("polys")
    return x.select("code", F.when(p.isNotNull(), F.size(p)).alias("polygons"), F.when(p.isNotNull(), F.size(p[0])).alias("rings"), F.round(p[0][0][0]["lon"], 6).alias("west"))


@query(f"WITH {CAMERAS} SELECT id, CASE WHEN n % 2 = 0 THEN lpad(n::VARCHAR, 8, '0') END AS site, lat, lon, state, hidden, CASE WHEN photo_at IS NOT NULL THEN date_trunc('second', photo_at) END AS photo_at FROM cameras")
def src_cameras(spark, sf_dir):
    c, n = A.cameras(spark, sf_dir), F.col("n")
    item = F.struct(
        F.col("id").alias("camId"), F.when(n % 2 == 0, F.lpad(n.cast("string"), 8, "0")).otherwise("n/a").alias("nwisId"), F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lng"),
        F.col("state").alias("stateAbrv"), F.col("hidden").alias("hideCam"), F.date_format("photo_at", _ISO).alias("newestImageDT"),
    )
    return feeds.cameras(_bodies(c, item, by=n)).select("id", "site", "lat", "lon", "state", "hidden", "photo_at")


@query("SELECT 'Lake ' || p_partkey AS name, 'G' || p_partkey % 9 AS gauge FROM part")
def src_overrides(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("Lake "), k), F.concat(F.lit("G"), (F.col("p_partkey") % 9).cast("string")))))
    files = A.table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / _BODY)).agg(F.to_json(F.struct(pairs.alias("byName"))).alias("body"))
    return feeds.overrides(files)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS type, 'G' || user_id AS gauge FROM events")
def src_track_raw(spark, sf_dir):
    """Days with an even number of events come as one array, the others event by event."""
    e = A.table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    item = F.struct(F.col("event_type").alias("type"), F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("gaugeId"))
    single = e.filter("event_id % 3 = 0").select("day", F.to_json(item).alias("body"))
    several = e.filter("event_id % 3 <> 0").groupBy("day").agg(F.to_json(F.collect_list(item)).alias("body"))
    files = single.unionByName(several).withColumn("path", F.concat(F.lit("track/"), "day", F.lit("/x.json")))
    return feeds.track_events(files).select("day", "type", F.col("gaugeId").alias("gauge"))


@query("SELECT p_partkey AS feature, CASE WHEN p_partkey % 2 = 0 THEN 'LineString' ELSE 'MultiPolygon' END AS kind, p_name AS name, 4 AS points FROM part")
def src_waterways(spark, sf_dir):
    p = F.col("p_partkey")
    at = lambda dx, dy: F.array(p * 1.0 + dx, p * 1.0 + dy)
    line = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 0))
    coords = F.when(p % 2 == 0, F.to_json(line)).otherwise(F.to_json(F.array(F.array(line))))
    feature = F.concat(
        F.lit('{"properties":{"nhdId":"'), p.cast("string"), F.lit('","name":"'), "p_name", F.lit('"},"geometry":{"type":"'), F.when(p % 2 == 0, "LineString").otherwise("MultiPolygon"), F.lit('","coordinates":'), coords, F.lit("}}")
    )
    files = A.table(spark, sf_dir, "part").groupBy(F.floor(p / _BODY)).agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("body"))
    x = feeds.waterways(files)
    return x.select(F.col("properties.nhdId").cast("long").alias("feature"), "kind", F.col("properties.name").alias("name"), F.size("coords").alias("points"))


@query("SELECT lpad(p_partkey::VARCHAR, 7, '0') AS id, p_name AS name, round(25.8 + p_partkey * 3571 % 10800 / 1000.0, 3)::DOUBLE AS lat, CASE WHEN p_partkey % 9 <> 0 THEN round(-106.6 + p_partkey * 7879 % 13100 / 1000.0, 3)::DOUBLE END AS lon FROM part")
def src_gazetteer(spark, sf_dir):
    """A padded table of places, written as the census writes it and read again."""
    p = F.col("p_partkey")
    lat, lon = 25.8 + (p * 3571 % 10800) / 1000.0, -106.6 + (p * 7879 % 13100) / 1000.0
    line = F.concat(F.lpad(p.cast("string"), 7, "0"), F.lit("|"), "p_name", F.lit("  |"), F.format_string("%+.3f", lat), F.lit("|"), F.when(p % 9 == 0, "none").otherwise(F.format_string("%+.3f", lon)), F.lit("   "))
    to = f"{shared_folder(spark)}/gazetteer-{uuid.uuid4().hex}"
    A.table(spark, sf_dir, "part").select(line.alias("GEOID|NAME|INTPTLAT|INTPTLONG      ")).write.option("header", True).option("quote", "").option("ignoreTrailingWhiteSpace", False).option("sep", "\t").csv(to)
    return feeds.gazetteer(spark, to)
