"""The library's entities, derived from the star-schema and event tables by arithmetic alone.

Each has its SQL beside it, for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-30 12:00:00"


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, lat, lon, site, thresholds, unit: thresholds are null, of sentinels, or partly given."""
    i = F.col("id")
    miss = F.lit(-9999.0)
    level = lambda base: F.when(i % 3 == 0, miss).otherwise(base + i % 40)
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("id"))
        .distinct()
        .select(
            "id",
            F.format_string("Gauge %d", i).alias("name"),
            (25.8 + (i * 7919 % 10800) / 1000.0).alias("lat"),
            (-106.6 + (i * 104729 % 13100) / 1000.0).alias("lon"),
            F.when(i % 5 != 0, i - i % 2).alias("site"),
            F.when(
                i % 7 != 0,
                F.struct(
                    F.when(i % 3 == 1, level(F.lit(60.0))).otherwise(F.when(i % 3 == 0, miss)).alias("action"),
                    level(F.lit(120.0)).alias("minor"),
                    level(F.lit(200.0)).alias("moderate"),
                    level(F.lit(300.0)).alias("major"),
                ),
            ).alias("thresholds"),
            F.when(i % 4 != 3, F.lit("ft")).otherwise(F.lit("m")).alias("unit"),
        )
    )


GAUGES = """gauges AS (
  SELECT id, 'Gauge ' || id AS name, 25.8 + (id * 7919 % 10800) / 1000.0::DOUBLE AS lat, -106.6 + (id * 104729 % 13100) / 1000.0::DOUBLE AS lon,
    CASE WHEN id % 5 <> 0 THEN id - id % 2 END AS site, id % 7 <> 0 AS known,
    CASE WHEN id % 7 <> 0 AND id % 3 = 1 THEN 60.0 + id % 40 END::DOUBLE AS action,
    CASE WHEN id % 7 <> 0 AND id % 3 <> 0 THEN 120.0 + id % 40 END::DOUBLE AS minor,
    CASE WHEN id % 7 <> 0 AND id % 3 <> 0 THEN 200.0 + id % 40 END::DOUBLE AS moderate,
    CASE WHEN id % 7 <> 0 AND id % 3 <> 0 THEN 300.0 + id % 40 END::DOUBLE AS major,
    CASE WHEN id % 4 <> 3 THEN 'ft' ELSE 'm' END AS unit
  FROM (SELECT DISTINCT user_id AS id FROM events)
)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gauge_id, pos, t, v: every fiftieth value is the sentinel -999."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("gauge_id"),
        F.col("event_id").alias("pos"),
        F.col("ts").alias("t"),
        F.when(F.col("event_id") % 50 == 0, F.lit(-999.0)).otherwise(F.col("value")).alias("v"),
    )


READINGS = """readings AS (
  SELECT user_id AS gauge_id, event_id AS pos, ts AS t, CASE WHEN event_id % 50 = 0 THEN -999.0 ELSE value END::DOUBLE AS v FROM events
)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gauge_id, pos, t, v of the points issued: events of type signup."""
    return readings(spark, sf_dir).join(
        table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("pos")), "pos", "left_semi"
    )


FORECASTS = """forecasts AS (
  SELECT user_id AS gauge_id, event_id AS pos, ts AS t, CASE WHEN event_id % 50 = 0 THEN -999.0 ELSE value END::DOUBLE AS v FROM events WHERE event_type = 'signup'
)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, gauge_id, visitor, referrer_url, at of usage events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_type") == "view", "pageview").when(F.col("event_type") == "click", "gauge_open").otherwise(F.col("event_type")).alias("type"),
        F.get_json_object("props", "$.k").alias("gauge_id"),
        F.col("user_id").alias("user"),
        F.col("ts").alias("at"),
    )


VISITS = """visits AS (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'pageview' WHEN 'click' THEN 'gauge_open' ELSE event_type END AS type,
    json_extract_string(props, '$.k') AS gauge_id, user_id AS "user", ts AS at FROM events
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon of places where users are."""
    i = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        i.alias("id"),
        (25.8 + (i * 6151 % 10800) / 1000.0).alias("lat"),
        (-106.6 + (i * 15485863 % 13100) / 1000.0).alias("lon"),
    )


POINTS = """points AS (
  SELECT c_custkey AS id, 25.8 + (c_custkey * 6151 % 10800) / 1000.0::DOUBLE AS lat, -106.6 + (c_custkey * 15485863 % 13100) / 1000.0::DOUBLE AS lon FROM customer
)"""


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, site, state, hidden, lat, lon, photo_at: most stand near a gauge's place."""
    i = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.format_string("CAM_%d", i).alias("id"),
        i.alias("n"),
        F.when(i % 4 != 0, i % 150 - (i % 150) % 2).alias("site"),
        F.when(i % 9 == 0, "OK").otherwise("TX").alias("state"),
        (i % 13 == 0).alias("hidden"),
        (25.8 + ((i - i % 2) % 150 * 7919 % 10800) / 1000.0 + (i % 5) * 0.0001).alias("lat"),
        (-106.6 + ((i - i % 2) % 150 * 104729 % 13100) / 1000.0 + (i % 3) * 0.0001).alias("lon"),
        F.when(i % 10 != 0, F.timestamp_add("MINUTE", -(i * 37 % 3000).cast("int"), F.lit(NOW).cast("timestamp_ntz"))).alias("photo_at"),
    )


CAMERAS = f"""cameras AS (
  SELECT 'CAM_' || s_suppkey AS id, s_suppkey AS n, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 150 - (s_suppkey % 150) % 2 END AS site,
    CASE WHEN s_suppkey % 9 = 0 THEN 'OK' ELSE 'TX' END AS state, s_suppkey % 13 = 0 AS hidden,
    25.8 + ((s_suppkey - s_suppkey % 2) % 150 * 7919 % 10800) / 1000.0::DOUBLE + (s_suppkey % 5) * 0.0001::DOUBLE AS lat,
    -106.6 + ((s_suppkey - s_suppkey % 2) % 150 * 104729 % 13100) / 1000.0::DOUBLE + (s_suppkey % 3) * 0.0001::DOUBLE AS lon,
    CASE WHEN s_suppkey % 10 <> 0 THEN TIMESTAMP '{NOW}' - to_minutes(s_suppkey * 37 % 3000) END AS photo_at
  FROM supplier
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(table(spark, sf_dir, "orders"))


def messages_of(orders: DataFrame) -> DataFrame:
    """Alert messages, one from each order, in the order of id; some have no VTEC, some a shape of their own."""
    k = F.col("o_orderkey")
    etn = F.lpad((k % 2000).cast("string"), 4, "0")
    action = F.when(k % 11 == 0, "CAN").when(k % 5 == 0, "CON").when(k % 17 == 0, "UPG").otherwise("NEW")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    sent = F.timestamp_add("MINUTE", (k * 7 % 43200).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    code = lambda j: F.format_string("%s%03d", F.when(k % 43 == 0, "OKC").otherwise("TXC"), (k + j) % 25)
    area = lambda j: F.format_string("Area %d", (k + j) % 25)
    x, y = -106.6 + (k % 50) * 0.25, 25.8 + (k % 40) * 0.25
    ring = F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y))])
    return orders.select(
        k.alias("id"),
        F.concat(F.lit("urn:"), k.cast("string")).alias("cap_id"),
        F.when(
            k % 31 != 0,
            F.concat(F.when(k % 23 == 0, "/T.").otherwise("/O."), action, F.lit(".K"), pick(("EWX", "FWD", "HGX"), k % 3), F.when(k % 2 == 0, ".FF.W.").otherwise(".FA.Y."), etn, F.lit(".240101T0000Z-240131T0000Z/")),
        ).alias("vtec"),
        pick(("Flash Flood Warning", "Flood Watch", "Flood Advisory", "Flood Statement", "Wind Advisory", "Flash Flood Statement"), k % 6).alias("event"),
        F.when(k % 19 == 0, "Test").when(k % 3 == 0, "Actual").alias("status"),
        F.when(k % 13 == 0, "Cancel").when(k % 37 == 0, "Ack").when(k % 2 == 0, "Update").alias("message_type"),
        sent.alias("sent"),
        F.when(k % 4 == 0, F.timestamp_add("HOUR", (k % 700).cast("int"), sent)).alias("ends"),
        F.when(k % 6 != 0, F.timestamp_add("HOUR", (k % 500).cast("int"), sent)).alias("expires"),
        F.array(code(0), code(7)).alias("ugc"),
        F.concat(area(0), F.lit("; "), area(7)).alias("area_desc"),
        F.when(k % 41 == 0, F.array(F.array(ring))).alias("polys"),
        (k % 29 == 0).alias("catastrophic"),
        F.format_string("Headline %d", k).alias("headline"),
        F.when(k % 3 == 0, F.format_string("Move to higher ground, %d", k)).alias("instruction"),
    )


MESSAGES = """messages AS (
  SELECT k AS id, 'urn:' || k AS cap_id,
    CASE WHEN k % 31 <> 0 THEN (CASE WHEN k % 23 = 0 THEN '/T.' ELSE '/O.' END) || (CASE WHEN k % 11 = 0 THEN 'CAN' WHEN k % 5 = 0 THEN 'CON' WHEN k % 17 = 0 THEN 'UPG' ELSE 'NEW' END)
      || '.K' || ['EWX', 'FWD', 'HGX'][k % 3 + 1] || (CASE WHEN k % 2 = 0 THEN '.FF.W.' ELSE '.FA.Y.' END) || lpad((k % 2000)::VARCHAR, 4, '0') || '.240101T0000Z-240131T0000Z/' END AS vtec,
    ['Flash Flood Warning', 'Flood Watch', 'Flood Advisory', 'Flood Statement', 'Wind Advisory', 'Flash Flood Statement'][k % 6 + 1] AS event,
    CASE WHEN k % 19 = 0 THEN 'Test' WHEN k % 3 = 0 THEN 'Actual' END AS status,
    CASE WHEN k % 13 = 0 THEN 'Cancel' WHEN k % 37 = 0 THEN 'Ack' WHEN k % 2 = 0 THEN 'Update' END AS message_type, sent,
    CASE WHEN k % 4 = 0 THEN sent + to_hours(k % 700) END AS ends,
    CASE WHEN k % 6 <> 0 THEN sent + to_hours(k % 500) END AS expires,
    [(CASE WHEN k % 43 = 0 THEN 'OKC' ELSE 'TXC' END) || lpad((k % 25)::VARCHAR, 3, '0'), (CASE WHEN k % 43 = 0 THEN 'OKC' ELSE 'TXC' END) || lpad(((k + 7) % 25)::VARCHAR, 3, '0')] AS ugc,
    ['Area ' || k % 25, 'Area ' || (k + 7) % 25] AS areas,
    CASE WHEN k % 41 = 0 THEN -106.6 + (k % 50) * 0.25::DOUBLE END AS own_x, CASE WHEN k % 41 = 0 THEN 25.8 + (k % 40) * 0.25::DOUBLE END AS own_y,
    k % 29 = 0 AS catastrophic
  FROM (SELECT o_orderkey AS k, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 7 % 43200) AS sent FROM orders)
)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code and polygons (outer ring and a hole) of each zone; every seventh has no shape."""
    i = F.col("n_nationkey").cast("long")
    x, y = -106.6 + (i % 5) * 2.6, 25.8 + F.floor(i / 5) * 2.1
    ring = lambda x0, y0, x1, y1: F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    polys = F.array(F.array(ring(x, y, x + 2.5, y + 2.0), ring(x + 1.0, y + 0.75, x + 1.5, y + 1.25)))
    return table(spark, sf_dir, "nation").select(
        F.format_string("TXC%03d", i).alias("code"), F.when(i % 7 != 6, polys).alias("polys")
    )


ZONES = """zones AS (
  SELECT 'TXC' || lpad(n_nationkey::VARCHAR, 3, '0') AS code, n_nationkey % 7 <> 6 AS has_shape,
    -106.6 + (n_nationkey % 5) * 2.6::DOUBLE AS x, 25.8 + floor(n_nationkey / 5.0) * 2.1::DOUBLE AS y FROM nation
)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, lat, lon, population; names repeat."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("id"),
        F.initcap(F.substring_index("p_name", " ", 1)).alias("name"),
        (25.8 + (p * 3571 % 10800) / 1000.0).alias("lat"),
        (-106.6 + (p * 7879 % 13100) / 1000.0).alias("lon"),
        F.when(p % 8 != 0, (F.col("p_size") * 700).cast("long")).alias("population"),
    )


PLACES = """places AS (
  SELECT p_partkey AS id, upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS name, 25.8 + (p_partkey * 3571 % 10800) / 1000.0::DOUBLE AS lat,
    -106.6 + (p_partkey * 7879 % 13100) / 1000.0::DOUBLE AS lon, CASE WHEN p_partkey % 8 <> 0 THEN (p_size * 700)::BIGINT END AS population
  FROM (SELECT *, split_part(p_name, ' ', 1) AS w FROM part)
)"""
