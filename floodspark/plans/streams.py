"""Queries that run a stream over the events table until its input is done."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark.functions import alerts as C
from floodspark.operators import alerts as al
from floodspark.plans import query
from floodspark.sources import adapt as A
from floodspark.sources.adapt import MESSAGES
from floodspark.streaming import streams as st

_CLOSED = "(SELECT strftime(max(ts) - INTERVAL 1 DAY, '%Y-%m-%d') FROM events)"


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'view') AS pageviews, count(*) FILTER (WHERE event_type = 'click') AS opens FROM events GROUP BY 1 HAVING strftime(ts, '%Y-%m-%d') < {_CLOSED}")
def stream_day_rollup(spark, sf_dir):
    """Days that the watermark has closed."""
    return st.run(st.day_counts(st.events(spark, sf_dir)))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1 HAVING strftime(ts, '%Y-%m-%d') < {_CLOSED}")
def stream_day_visitors(spark, sf_dir):
    return st.run(st.day_rollup(st.events(spark, sf_dir)))


@query("SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY 1")
def stream_latest(spark, sf_dir):
    return st.latest(st.events(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_DAYS = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'view') AS pageviews, count(*) FILTER (WHERE event_type = 'click') AS opens FROM events GROUP BY 1"


@query(_DAYS)
def stream_late_day(spark, sf_dir):
    """A rollup that lacks the events of one type is repaired by the late ones."""
    raw = A.table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    early = raw.filter("event_type <> 'click'").groupBy("day").agg(*st.counts_of_day())
    late = st.events(spark, sf_dir).filter("event_type = 'click'")
    return st.late_days(late, early, raw, "9999-12-31")


@query("SELECT user_id AS visitor, ts AS at, pos::INTEGER AS pos, CASE pos WHEN 0 THEN event_type ELSE 'pageview' END AS type, event_id + pos AS gauge_id FROM events, (SELECT unnest(range(0, 20)) AS pos) WHERE pos < event_id % 25")
def stream_visit_batches(spark, sf_dir):
    i = F.col("event_id")
    none = F.array().cast("array<struct<type:string,gauge_id:bigint>>")
    several = F.transform(F.sequence(F.lit(0).cast("long"), i % 25 - 1), lambda k: F.struct(F.when(k == 0, F.col("event_type")).otherwise("pageview").alias("type"), (i + k).alias("gauge_id")))
    batches = st.events(spark, sf_dir).select(F.col("user_id").alias("visitor"), F.col("ts").cast("timestamp_ntz").alias("at"), F.when(i % 25 > 0, several).otherwise(none).alias("events"))
    return st.run(st.visit_batches(batches))


_KEY = "coalesce(substr(vtec, 8, 4) || '.' || substr(vtec, 13, 2) || '.' || substr(vtec, 16, 1) || '.' || substr(vtec, 18, 4), cap_id)"


_OPENS = f"""gone AS (SELECT {_KEY} AS key, max(sent) AS cancelled FROM messages WHERE vtec NOT LIKE '/T.%' AND (substr(vtec, 4, 3) = 'CAN' OR message_type = 'Cancel') GROUP BY 1),
  o AS (SELECT m.*, {_KEY} AS key FROM messages m WHERE event LIKE '%Flood%' AND coalesce(status, 'Actual') = 'Actual' AND coalesce(message_type, '') NOT IN ('Cancel', 'Ack', 'Error') AND (vtec IS NULL OR vtec NOT LIKE '/T.%' AND substr(vtec, 4, 3) NOT IN ('CAN', 'UPG'))),
  x AS (SELECT o.*, coalesce(ends, expires) AS until, (SELECT max(sent) FROM messages) AS mark FROM o LEFT JOIN gone USING (key) WHERE cancelled IS NULL OR sent > cancelled),
  parts AS (SELECT key, sent, id, i, ugc[i] AS code, areas[i] AS area FROM x, (SELECT unnest([1, 2]) AS i) WHERE until IS NULL OR until > mark)"""


@query(f"""WITH {MESSAGES}, {_OPENS},
  c AS (SELECT key, string_agg(code, ',' ORDER BY sent DESC, id, i) AS ugc FROM (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY key, code ORDER BY sent DESC, id, i) = 1) GROUP BY 1),
  a AS (SELECT key, string_agg(area, '; ' ORDER BY sent DESC, id, i) AS area_desc FROM (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY key, area ORDER BY sent DESC, id, i) = 1) GROUP BY 1),
  live AS (SELECT key, arg_max(id, (sent, -id)) AS id, max(sent) AS sent, max(ends) AS ends, max(expires) AS expires, count(*) AS n FROM x WHERE until IS NULL OR until > mark GROUP BY 1)
  SELECT key, 'open' AS state, id, 'Headline ' || id AS headline, sent, ends, expires, n, ugc, area_desc FROM live JOIN c USING (key) JOIN a USING (key)
  UNION ALL SELECT DISTINCT key, 'over', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM x WHERE key NOT IN (SELECT key FROM live)""")
def stream_alert_events(spark, sf_dir):
    """What is known of each event once event time has passed all messages."""
    always = F.lit("1970-01-01").cast("timestamp_ntz")
    x = al.with_roles(A.messages_of(st.table(spark, sf_dir, "orders")), always).withColumn("level", C.alert_level(F.col("event"), F.col("catastrophic")))
    at = [F.col(c).cast("timestamp").alias(c) for c in ("sent", "ends", "expires")]
    shape = F.to_json("polys").alias("shape")
    e = st.last_versions(st.run(st.alert_events(x.select("key", "id", *at, "event", "level", "ugc", "area_desc", "headline", "instruction", shape, "opens", "cancels"))))
    open_ = F.col("state") == "open"
    kept = [F.when(open_, F.col(c).cast("timestamp_ntz") if c in ("sent", "ends", "expires") else F.array_join(c, ",") if c == "ugc" else F.col(c)).alias(c) for c in ("id", "headline", "sent", "ends", "expires", "n", "ugc", "area_desc")]
    return e.select("key", "state", *kept)


_H = "(floor(epoch_us(ts) / 1000000.0) / 3600.0 - 473352.0)"


@query(f"""WITH w AS (SELECT user_id, value, ts, {_H} AS h, unnest([0, 1, 2, 3]) AS k FROM events WHERE value > -100),
  e AS (SELECT *, to_timestamp((floor(epoch(ts) / 43200) + 1 + k) * 43200) AT TIME ZONE 'UTC' AS until FROM w),
  g AS (SELECT user_id AS gauge_id, until, regr_slope(value, h) AS slope, count(*) AS n, max(floor(epoch_us(ts) / 1000000.0)) - min(floor(epoch_us(ts) / 1000000.0)) AS span FROM e GROUP BY 1, 2)
  SELECT gauge_id, until, n, CASE WHEN n >= 4 AND span >= 5400 THEN floor(slope * 100 + 0.5) / 100 END AS rate, CASE WHEN n < 4 OR span < 5400 THEN NULL WHEN abs(slope) < 0.05 THEN 'steady' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction
  FROM g WHERE until <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_trend(spark, sf_dir):
    """Windows of 48 hours (readings are hours apart here) that the watermark has closed, every 12 hours."""
    return st.run(st.trends(st.events(spark, sf_dir), "48 hours", "12 hours")).withColumn("until", F.col("until").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT *, floor(epoch_us(ts) / 1000000.0)::BIGINT AS s FROM events WHERE value > -100 AND user_id % 4 <> 3),
  r AS (SELECT user_id AS gauge_id, event_id, s, count(*) OVER w >= 4 AND s - min(s) OVER w >= 5400 AND coalesce(regr_slope(value, s / 3600.0 - 473352.0) OVER w >= 1, false) AS flag FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW)),
  p AS (SELECT *, lag(flag) OVER w AS was, lag(s) OVER w AS before, lead(s) OVER w AS next FROM r WINDOW w AS (PARTITION BY gauge_id ORDER BY s, event_id)),
  m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM e)
  SELECT gauge_id, 'open' AS state, make_timestamp(s * 1000000) AS at, event_id FROM p WHERE flag AND (was IS NULL OR NOT was OR s - before >= 86400)
  UNION ALL SELECT gauge_id, 'clear', make_timestamp(s * 1000000), event_id FROM p WHERE NOT flag AND was AND s - before < 86400
  UNION ALL SELECT gauge_id, 'clear', make_timestamp((s + 86400) * 1000000), NULL FROM p, m WHERE flag AND (next - s >= 86400 OR next IS NULL AND make_timestamp((s + 86400) * 1000000) <= mark)""")
def stream_rapid_rise(spark, sf_dir):
    """Readings are hours apart here, so slopes are over 48 hours, and a day without one clears the flag."""
    e = st.events(spark, sf_dir).withColumn("unit", F.when(F.col("user_id") % 4 == 3, "m").otherwise(" FT"))
    return st.run(st.rapid_rise(e, hours=48, silence_minutes=1440)).select("gauge_id", "state", F.col("at").cast("timestamp_ntz").alias("at"), "event_id")


@query("""WITH l AS (SELECT user_id AS gauge_id, date_trunc('millisecond', max(ts)) AS last FROM events GROUP BY 1), m AS (SELECT date_trunc('millisecond', max(ts)) AS mark FROM events)
  SELECT gauge_id, last, 'old' AS state FROM l, m WHERE last + INTERVAL 90 MINUTE <= mark UNION ALL SELECT gauge_id, last, 'no data' FROM l, m WHERE last + INTERVAL 6 HOUR <= mark""")
def stream_staleness(spark, sf_dir):
    return st.run(st.silent(st.events(spark, sf_dir))).withColumn("last", F.col("last").cast("timestamp_ntz"))
