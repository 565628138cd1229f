"""Queries on usage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from floodspark.operators import analytics as op
from floodspark.operators.kept import shared_folder
from floodspark.plans import query
from floodspark.sources import adapt as A
from floodspark.sources import tracks as tr
from floodspark.sources.adapt import VISITS

_SALT = "day-salt"
_HASHED = f"""hashed AS (SELECT *, substr(sha256('{_SALT}' || strftime("at", '%Y-%m-%d') || '|' || "user" || '|'), 1, 16) AS visitor FROM visits)"""
_CLEAN = """clean AS (SELECT event_id, type, visitor, "at", CASE WHEN type = 'gauge_open' THEN substr(gauge_id, 1, 32) END AS gauge_id, CASE event_id % 5 WHEN 0 THEN 'app:ios' WHEN 1 THEN 'app:android' ELSE 'host' || event_id % 7 END AS referrer
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) AS n FROM hashed) WHERE n <= 50 AND type IN ('pageview', 'gauge_open'))"""


def _clean(spark, sf_dir):
    e = F.col("event_id")
    salt = F.concat(F.lit(_SALT), F.date_format("at", "yyyy-MM-dd"))
    v = A.visits(spark, sf_dir).select(
        "event_id", "type", "gauge_id", "at", F.floor(e / 64).alias("batch"),
        op.visitor_hash(salt, F.col("user").cast("string"), F.lit(None).cast("string")).alias("visitor"),
        F.when(e % 5 == 0, "ios").when(e % 5 == 1, "android").otherwise("web").alias("platform"),
        F.concat(F.lit("host"), e % 7).alias("referrer"),
    )
    return op.track_clean(v)


@query(f"WITH {VISITS}, {_HASHED}, {_CLEAN} SELECT * FROM clean")
def track_clean(spark, sf_dir):
    return _clean(spark, sf_dir)


_DAYS = """days AS (SELECT strftime("at", '%Y-%m-%d') AS day, count(*) FILTER (WHERE type = 'pageview') AS pageviews, count(*) FILTER (WHERE type = 'gauge_open') AS opens, count(DISTINCT visitor) AS visitors FROM clean GROUP BY 1)"""


@query(f"WITH {VISITS}, {_HASHED}, {_CLEAN}, {_DAYS} SELECT * FROM days")
def day_aggregate(spark, sf_dir):
    return op.day_aggregate(_clean(spark, sf_dir))


@query(f"WITH {VISITS}, {_HASHED}, {_CLEAN}, {_DAYS} SELECT count(*) AS days, sum(pageviews)::BIGINT AS pageviews, sum(opens)::BIGINT AS opens, sum(visitors)::BIGINT AS visitors FROM days")
def analytics_totals(spark, sf_dir):
    return op.totals(op.day_aggregate(_clean(spark, sf_dir)))


@query(f"WITH {VISITS}, {_HASHED}, {_CLEAN}, {_DAYS} SELECT day, pageviews, CASE WHEN day < '2024-01-20' THEN 0 ELSE opens END AS opens, visitors FROM days")
def analytics_rollup_merge(spark, sf_dir):
    days = op.day_aggregate(_clean(spark, sf_dir))
    return op.rollup_merge(days.withColumn("opens", F.lit(0).cast("long")), days.filter("day >= '2024-01-20'"))


@query(f"""WITH {VISITS}, {_HASHED}, {_CLEAN} SELECT strftime("at", '%Y-%m-%d') AS day, gauge_id, count(*) AS n FROM clean WHERE gauge_id IS NOT NULL GROUP BY 1, 2""")
def day_gauge_opens(spark, sf_dir):
    return op.keyed_counts(_clean(spark, sf_dir), "gauge_id")


@query(f"WITH {VISITS}, {_HASHED}, {_CLEAN} SELECT gauge_id, count(*) AS n FROM clean WHERE gauge_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, gauge_id LIMIT 8")
def top_gauges(spark, sf_dir):
    return op.top(op.keyed_counts(_clean(spark, sf_dir), "gauge_id"), "gauge_id", 8)


@query(f"WITH {VISITS}, {_HASHED}, {_CLEAN} SELECT referrer, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, referrer LIMIT 6")
def top_referrers(spark, sf_dir):
    return op.top(op.keyed_counts(_clean(spark, sf_dir), "referrer"), "referrer", 6)


@query(f"WITH {VISITS}, {_HASHED}, {_CLEAN}, {_DAYS} SELECT * FROM days ORDER BY day DESC LIMIT 7")
def last_days(spark, sf_dir):
    return op.day_aggregate(_clean(spark, sf_dir)).orderBy(F.col("day").desc()).limit(7)


@query(f"""WITH {VISITS}, {_HASHED}, {_CLEAN}, t AS (SELECT 'gauge_opens' AS kind, gauge_id AS key, count(*) AS n FROM clean WHERE gauge_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'referrers', referrer, count(*) FROM clean GROUP BY 2)
  SELECT kind, key, n FROM t""")
def analytics_maps(spark, sf_dir):
    """Maps of opens and referrers, of stored days and of days that are counted live, merged and spread again."""
    c = _clean(spark, sf_dir)
    each = lambda kind, key: c.filter(F.col(key).isNotNull()).groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), F.lit(kind).alias("kind"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    days = tr.days_of(each("gauge", "gauge_id").unionByName(each("referrer", "referrer")))
    both = op.rollup_merge(days.withColumn("pageviews", F.lit(0).cast("long")), days.filter("day >= '2024-01-20'"))
    total = tr.totals(both)
    return total.select(F.lit("gauge_opens").alias("kind"), F.explode("gauge_opens").alias("key", "n")).unionByName(total.select(F.lit("referrers").alias("kind"), F.explode("referrers").alias("key", "n")))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'view') AS pageviews, count(DISTINCT user_id) AS visitors, (SELECT count(*) FROM events e WHERE e.event_type = 'click' AND strftime(e.ts, '%Y-%m-%d') = strftime(o.ts, '%Y-%m-%d')) AS opens FROM events o GROUP BY ALL")
def track_compaction(spark, sf_dir):
    """Raw files of all days, written as the site writes them; those before the last days are compacted and deleted, then all days are read."""
    e = A.table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kind = F.when(F.col("event_type") == "view", "pageview").when(F.col("event_type") == "click", "gauge_open").otherwise(F.col("event_type"))
    item = F.struct(kind.alias("type"), F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("gaugeId"), F.col("user_id").cast("string").alias("visitor"))
    # A file holds one event, or here one line: what a task writes of a day.
    bodies = e.groupBy("day", F.floor(F.col("event_id") / 1000)).agg(F.to_json(F.collect_list(item)).alias("value")).select("day", "value")
    to = f"{shared_folder(spark)}/tracks-{uuid.uuid4().hex}"
    bodies.repartition("day").write.partitionBy("day").option("maxRecordsPerFile", 1).text(f"{to}/landed")
    raw, store = f"{to}/raw", f"{to}/store"
    tr.move_days(spark, f"{to}/landed", raw)
    tr.compact(spark, raw, store, "2024-01-20")
    d = tr.day_rows(spark, raw, store)
    return d.select("day", "pageviews", "visitors", F.aggregate(F.map_values("gauge_opens"), F.lit(0).cast("long"), lambda s, n: s + n).alias("opens"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages")
def referrer_host(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", op.referrer_host(F.col("url")).alias("host"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id || '.1.1.1' WHEN event_id % 3 = 1 THEN '10.0.0.' || user_id ELSE 'unknown' END AS ip FROM events")
def client_ip(spark, sf_dir):
    e = F.col("event_id")
    u = F.col("user_id").cast("string")
    forwarded = F.when(e % 3 == 0, F.concat(F.lit(" "), u, F.lit(".1.1.1, 9.9.9.9")))
    real = F.when(e % 3 == 1, F.concat(F.lit("10.0.0."), u)).otherwise("")
    return A.table(spark, sf_dir, "events").select("event_id", op.client_ip(forwarded, real).alias("ip"))


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def salt_retention(spark, sf_dir):
    salts = A.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return op.retained_salts(salts, F.lit("2024-01-20"))
