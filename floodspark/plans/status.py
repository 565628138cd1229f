"""Queries on the current status of gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.functions import status as S
from floodspark.operators import status as op
from floodspark.operators.details import sort_items
from floodspark.plans import query
from floodspark.sources import adapt as A
from floodspark.sources.adapt import GAUGES, NOW, READINGS

_LATEST = f"""latest AS (
  SELECT gauge_id, t, v FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY t DESC, pos) AS r FROM readings
    WHERE v > -999 AND t <= TIMESTAMP '{NOW}' AND t >= TIMESTAMP '{NOW}' - INTERVAL HOURS HOUR) WHERE r = 1
)"""
_CATEGORY = """CASE WHEN v IS NULL OR NOT (v > -100) OR coalesce(action, minor, moderate, major) IS NULL THEN 'not_defined'
    WHEN v >= major THEN 'major' WHEN v >= moderate THEN 'moderate' WHEN v >= minor THEN 'minor' WHEN v >= action THEN 'action' ELSE 'no_flooding' END"""
_STATUS = f"""status AS (
  SELECT g.*, l.t, l.v, {_CATEGORY} AS category FROM gauges g LEFT JOIN latest l ON l.gauge_id = g.id
), shown AS (
  SELECT *, CASE WHEN category IN ('not_defined', 'no_flooding') AND v IS NOT NULL AND known AND coalesce(action, minor, moderate, major) IS NULL THEN 'no_stages' ELSE category END AS c0 FROM status
), displayed AS (
  SELECT *, CASE WHEN c0 IN ('no_flooding', 'no_stages') AND (t IS NULL OR date_diff('second', t, TIMESTAMP '{NOW}') > 21600) THEN 'not_defined' ELSE c0 END AS display,
    v IS NOT NULL AND (t IS NULL OR date_diff('second', t, TIMESTAMP '{NOW}') > 5400) AS old FROM shown
)"""


def current(spark: SparkSession, sf_dir: str, hours: int = 24) -> DataFrame:
    """id, lat, lon, name, thresholds, t, v, category, display, old of every gauge."""
    latest = op.latest_reading(A.readings(spark, sf_dir), A.now(), hours)
    t = S.sanitize_thresholds(F.col("thresholds"))
    rows = A.gauges(spark, sf_dir).withColumn("thresholds", t).join(latest.withColumnRenamed("gauge_id", "id"), "id", "left")
    category = S.categorize_by_stage(F.col("v"), F.col("thresholds"))
    return rows.withColumn("category", category).select(
        "*",
        S.display_category(F.col("category"), F.col("v"), F.col("thresholds"), F.col("t"), A.now()).alias("display"),
        S.is_old_reading(F.col("v"), F.col("t"), A.now()).alias("old"),
    )


def status_sql(body: str, hours: int = 24) -> str:
    return f"WITH {GAUGES}, {READINGS}, {_LATEST.replace('HOURS', str(hours))}, {_STATUS} {body}"


@query(status_sql("SELECT c AS category, count(d.id) AS n, count(d.id) FILTER (WHERE old) AS n_old FROM (SELECT unnest(['not_defined', 'no_stages', 'no_flooding', 'action', 'minor', 'moderate', 'major']) AS c) LEFT JOIN displayed d ON d.display = c GROUP BY c"))
def category_counts(spark, sf_dir):
    return op.category_counts(current(spark, sf_dir).select(F.col("display").alias("category"), "old"))


@query(f"WITH {READINGS}, {_LATEST.replace('HOURS', '2')} SELECT * FROM latest")
def latest_reading(spark, sf_dir):
    return op.latest_reading(A.readings(spark, sf_dir), A.now())


@query(status_sql("SELECT id, category, display, CASE WHEN display NOT IN ('not_defined', 'no_stages', 'no_flooding', 'action', 'minor', 'moderate', 'major') OR display = 'no_flooding' AND v IS NULL THEN 'not_defined' ELSE display END AS list, old FROM displayed"))
def display_category(spark, sf_dir):
    c = current(spark, sf_dir)
    return c.select("id", "category", "display", S.list_category(F.col("category"), F.col("v"), F.col("thresholds"), F.col("t"), A.now()).alias("list"), "old")


@query(f"WITH {READINGS} SELECT pos, v > -100 AS valid, CASE WHEN v > -100 THEN v END AS stage FROM readings")
def valid_stage(spark, sf_dir):
    v = F.col("v")
    return A.readings(spark, sf_dir).select("pos", S.valid_stage(v).alias("valid"), S.clean_stage(v).alias("stage"))


@query(f"WITH {GAUGES} SELECT id, known, action, minor, moderate, major, coalesce(action, minor, moderate, major) IS NOT NULL AS usable FROM gauges")
def sanitize_thresholds(spark, sf_dir):
    t = S.sanitize_thresholds(F.col("thresholds"))
    return A.gauges(spark, sf_dir).select("id", F.col("thresholds").isNotNull().alias("known"), *[t[k].alias(k) for k in reversed(S.LEVELS)], S.has_valid_thresholds(F.col("thresholds")).alias("usable"))


@query(f"WITH {GAUGES}, {READINGS} SELECT pos, {_CATEGORY} AS category FROM readings r JOIN gauges g ON g.id = r.gauge_id")
def categorize_by_stage(spark, sf_dir):
    r, g = A.readings(spark, sf_dir), A.gauges(spark, sf_dir)
    return r.join(g, r["gauge_id"] == g["id"]).select("pos", S.categorize_by_stage(F.col("v"), F.col("thresholds")).alias("category"))


_FEED = """feed AS (
  SELECT gauge_id, pos, t, v, CASE pos % 6 WHEN 0 THEN 'out_of_service' WHEN 1 THEN 'minor' WHEN 2 THEN 'obs_not_current' ELSE NULL END AS feed_category,
    CASE WHEN pos % 3 = 0 THEN 'ft' END AS feed_unit FROM readings
)"""


def _feed(spark, sf_dir):
    p = F.col("pos")
    return A.readings(spark, sf_dir).select(
        "gauge_id", "pos", "t", "v",
        F.when(p % 6 == 0, "out_of_service").when(p % 6 == 1, "minor").when(p % 6 == 2, "obs_not_current").alias("feed_category"),
        F.when(p % 3 == 0, "ft").alias("feed_unit"),
    )


@query(f"WITH {READINGS}, {_FEED} SELECT pos, CASE WHEN feed_category = 'minor' THEN 'minor' ELSE 'not_defined' END AS category FROM feed")
def normalize_category(spark, sf_dir):
    return _feed(spark, sf_dir).select("pos", S.normalize_category(F.col("feed_category")).alias("category"))


@query(f"WITH {GAUGES}, {READINGS}, {_FEED} SELECT pos, CASE WHEN feed_category = 'minor' THEN 'minor' ELSE {_CATEGORY} END AS category FROM feed f JOIN gauges g ON g.id = f.gauge_id")
def resolve_category(spark, sf_dir):
    f, g = _feed(spark, sf_dir), A.gauges(spark, sf_dir)
    return f.join(g, f["gauge_id"] == g["id"]).select("pos", S.resolve_category(F.col("feed_category"), F.col("v"), F.col("thresholds")).alias("category"))


_LAST = f"last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY pos DESC) AS r FROM feed) WHERE r = 1)"


@query(f"WITH {GAUGES}, {READINGS}, {_FEED}, {_LAST} SELECT l.gauge_id, l.pos, l.v, g.name, g.site FROM last l LEFT JOIN gauges g ON g.id = l.gauge_id")
def feed_meta_join(spark, sf_dir):
    return op.feed_meta_join(_feed(spark, sf_dir), A.gauges(spark, sf_dir)).select("gauge_id", "pos", "v", "name", "site")


@query(f"""WITH {GAUGES}, {READINGS}, {_FEED}, {_LAST} SELECT gauge_id, CASE WHEN feed_category = 'minor' THEN 'minor' ELSE {_CATEGORY} END AS category,
  CASE WHEN v > -100 THEN v END AS observed_stage, CASE WHEN v > -100 THEN t END AS observed_at, coalesce(feed_unit, unit) AS unit, CASE WHEN v > -100 THEN 'nws' END AS source
  FROM last l LEFT JOIN gauges g ON g.id = l.gauge_id""")
def gauge_status_row(spark, sf_dir):
    return op.gauge_status_rows(op.feed_meta_join(_feed(spark, sf_dir), A.gauges(spark, sf_dir))).drop("thresholds")


@query(f"WITH {GAUGES}, {READINGS} SELECT g.id AS gauge_id, g.site, pos, t, v FROM readings r JOIN gauges g ON g.site = r.gauge_id")
def usgs_fanout_join(spark, sf_dir):
    return op.usgs_fanout(A.readings(spark, sf_dir), A.gauges(spark, sf_dir))


@query(f"""WITH {GAUGES}, {READINGS}, {_LATEST.replace('HOURS', '2')} SELECT id, coalesce(v, id % 90 + 0.5::DOUBLE) AS stage,
  CASE WHEN v IS NOT NULL THEN t ELSE TIMESTAMP '2024-01-01' END AS "at", CASE WHEN v IS NOT NULL THEN 'live' ELSE 'built' END AS source FROM gauges LEFT JOIN latest ON gauge_id = id""")
def usgs_fallback(spark, sf_dir):
    latest = op.latest_reading(A.readings(spark, sf_dir), A.now())
    return op.with_fallback(A.gauges(spark, sf_dir), latest, F.col("id") % 90 + F.lit(0.5), F.lit("2024-01-01").cast("timestamp_ntz"))


@query(f"WITH {GAUGES} SELECT id, id % 90 + 0.5::DOUBLE AS stage, TIMESTAMP '2024-01-01' AS \"at\", 'built' AS source FROM gauges")
def meta_fallback(spark, sf_dir):
    none = A.readings(spark, sf_dir).filter(F.lit(False)).select("gauge_id", "t", "v")
    return op.with_fallback(A.gauges(spark, sf_dir), none, F.col("id") % 90 + F.lit(0.5), F.lit("2024-01-01").cast("timestamp_ntz"))


_SNAPSHOTS = "snaps AS (SELECT gauge_id, ['stored', 'live', 'metadata'][pos % 3 + 1] AS source, t AS snapshot_at, v, pos FROM readings)"


def _snapshots(spark, sf_dir):
    return A.readings(spark, sf_dir).select(
        "gauge_id", F.element_at(F.array(*map(F.lit, ("stored", "live", "metadata"))), (F.col("pos") % 3 + 1).cast("int")).alias("source"), F.col("t").alias("snapshot_at"), "v", "pos"
    ).filter(F.col("t") <= A.now())


@query(f"""WITH {READINGS}, {_SNAPSHOTS} SELECT gauge_id, source, snapshot_at, v FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY
  CASE WHEN source = 'stored' AND date_diff('second', snapshot_at, TIMESTAMP '{NOW}') < 5400 THEN 2 WHEN source <> 'metadata' THEN 1 ELSE 0 END DESC, snapshot_at DESC, source = 'stored' DESC) AS r
  FROM snaps WHERE snapshot_at <= TIMESTAMP '{NOW}') WHERE r = 1""")
def snapshot_priority(spark, sf_dir):
    return op.snapshot_priority(_snapshots(spark, sf_dir), A.now())


@query(f"WITH {READINGS} SELECT date_trunc('hour', t) AS snapshot_at, count(*) AS n FROM readings GROUP BY 1")
def usable_snapshot(spark, sf_dir):
    return op.usable_snapshots(A.readings(spark, sf_dir).select(F.date_trunc("hour", "t").cast("timestamp_ntz").alias("snapshot_at")))


@query(f"""WITH {GAUGES}, {READINGS}, {_FEED} SELECT pos, CASE WHEN v > -100 THEN v END AS v, CASE WHEN NOT v > -100 THEN 'not_defined' WHEN pos % 2 = 0 AND coalesce(action, minor, moderate, major) IS NULL THEN 'not_defined'
  WHEN pos % 2 = 0 THEN 'no_flooding' ELSE 'minor' END AS category FROM feed f JOIN gauges g ON g.id = f.gauge_id""")
def repair_status(spark, sf_dir):
    f, g = _feed(spark, sf_dir), A.gauges(spark, sf_dir)
    rows = f.join(g, f["gauge_id"] == g["id"]).withColumn("category", F.when(F.col("pos") % 2 == 0, "no_flooding").otherwise("minor"))
    return op.repair(rows, distrust_normal=True).select("pos", "v", "category")


@query(f"WITH {GAUGES} SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE id * 1.0::DOUBLE END AS v, CASE WHEN id % 4 = 0 OR coalesce(action, minor, moderate, major) IS NULL THEN 'not_defined' ELSE 'no_flooding' END AS category FROM gauges")
def repair_meta(spark, sf_dir):
    i = F.col("id")
    rows = A.gauges(spark, sf_dir).withColumn("v", F.when(i % 4 == 0, F.lit(-999.0)).otherwise(i * 1.0)).withColumn("category", F.lit("no_flooding"))
    return op.repair(rows, distrust_normal=True).select("id", "v", "category")


@query(f"WITH {READINGS} SELECT pos, date_diff('second', t, TIMESTAMP '{NOW}') AS age, greatest(date_diff('second', t, TIMESTAMP '{NOW}'), 0) AS shown FROM (SELECT pos, date_trunc('second', t) AS t FROM readings)")
def reading_age(spark, sf_dir):
    r = A.readings(spark, sf_dir)
    return r.select("pos", S.age_seconds(F.col("t"), A.now()).alias("age"), S.reading_age(F.col("t"), A.now()).alias("shown"))


@query(f"""WITH {READINGS} SELECT pos, to_timestamp(floor((epoch_ms(t) + 150000) / 300000.0) * 300)::TIMESTAMP AS nearest5, to_timestamp(floor(epoch_ms(t) / 300000.0) * 300)::TIMESTAMP AS last5,
  greatest(0, least(1152, floor((floor(epoch_ms(t) / 1000.0) - epoch(TIMESTAMP '2024-01-10')) / 900.0 + 0.5)))::INTEGER AS step FROM readings""")
def time_bucket(spark, sf_dir):
    t = F.col("t")
    return A.readings(spark, sf_dir).select(
        "pos", S.time_bucket(t, 5).cast("timestamp_ntz").alias("nearest5"), S.time_bucket(t, 5, nearest=False).cast("timestamp_ntz").alias("last5"),
        S.timeline_step(t, F.lit("2024-01-10").cast("timestamp_ntz"), 1152).alias("step"),
    )


@query(f"""WITH {READINGS}, reads AS (SELECT gauge_id % 10 AS feed, pos, t, pos % 4 = 0 AS ok, pos AS n FROM readings), g AS (
  SELECT *, last_value(CASE WHEN ok THEN t END IGNORE NULLS) OVER w AS gt, last_value(CASE WHEN ok THEN n END IGNORE NULLS) OVER w AS gn FROM reads WINDOW w AS (PARTITION BY feed ORDER BY t, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), u AS (SELECT *, coalesce(epoch(date_trunc('second', t)) - epoch(date_trunc('second', gt)) < 21600, false) AS usable FROM g)
SELECT feed, pos, t, CASE WHEN usable THEN gn END AS n, usable AND NOT ok AS stale, NOT usable AS error FROM u""")
def last_good_read(spark, sf_dir):
    r = A.readings(spark, sf_dir).select((F.col("gauge_id") % 10).alias("feed"), "pos", "t", (F.col("pos") % 4 == 0).alias("ok"), F.col("pos").alias("n"))
    return op.last_good_read(r)


_AGE = "CASE WHEN {0} IS NULL THEN NULL WHEN floor({0} / 60.0 + 0.5) < 90 THEN floor({0} / 60.0 + 0.5)::BIGINT || ' minute' || CASE WHEN floor({0} / 60.0 + 0.5) = 1 THEN '' ELSE 's' END WHEN floor({0} / 3600.0 + 0.5) < 36 THEN floor({0} / 3600.0 + 0.5)::BIGINT || ' hour' || CASE WHEN floor({0} / 3600.0 + 0.5) = 1 THEN '' ELSE 's' END ELSE floor({0} / 86400.0 + 0.5)::BIGINT || ' day' || CASE WHEN floor({0} / 86400.0 + 0.5) = 1 THEN '' ELSE 's' END END"
_TWO = "regexp_replace(regexp_replace(format('{:.2f}', v), '0+$', ''), '\\.$', '')"
_AGED = f"SELECT *, date_diff('second', date_trunc('second', t), TIMESTAMP '{NOW}') AS s FROM displayed"


@query(status_sql(f"SELECT id, {_TWO} AS stage, {_AGE.format('s')} AS age, CASE WHEN s < 60 THEN 'just now' ELSE {_AGE.format('s')} || ' ago' END AS ago, CASE WHEN NOT old THEN '' WHEN s IS NULL THEN ' · reading time unknown' ELSE ' · reading ' || {_AGE.format('s')} || ' old' END AS note FROM ({_AGED})"))
def format_status(spark, sf_dir):
    c = current(spark, sf_dir)
    age = S.age_seconds(F.col("t"), A.now())
    note = S.old_reading_note(F.col("v"), F.col("t"), A.now())
    return c.select("id", S.format_stage(F.col("v")).alias("stage"), S.format_age(age).alias("age"), S.ago_text(age).alias("ago"), note.alias("note"))


_LABEL = "CASE {0} WHEN 'no_stages' THEN 'No flood stages' WHEN 'no_flooding' THEN 'Normal' WHEN 'action' THEN 'Action' WHEN 'minor' THEN 'Minor flood' WHEN 'moderate' THEN 'Moderate flood' WHEN 'major' THEN 'Major flood' ELSE 'No data' END"


@query(status_sql(f"""SELECT id, array_to_string(list_filter([CASE WHEN v IS NOT NULL THEN {_TWO} || ' ' || unit END,
    CASE WHEN c = 'not_defined' THEN CASE WHEN v IS NULL THEN 'No current reading' WHEN s IS NULL OR s > 21600 THEN 'No recent reading' ELSE 'Flood stages not defined' END ELSE {_LABEL.format('c')} || CASE WHEN c = 'no_flooding' AND coalesce(action, minor, moderate, major) IS NULL THEN ' (no flood stages defined)' ELSE '' END END,
    CASE WHEN v IS NULL THEN CASE WHEN c <> 'not_defined' THEN 'Stage unavailable!' END WHEN s IS NULL THEN 'Reading time unknown!' WHEN s > 5400 THEN 'Reading is ' || {_AGE.format('s')} || ' old!' WHEN s < 60 THEN 'just now' ELSE {_AGE.format('s')} || ' ago' END], lambda x: x IS NOT NULL), ' · ') AS words
  FROM (SELECT *, CASE WHEN display = 'no_flooding' AND v IS NULL THEN 'not_defined' ELSE display END AS c FROM ({_AGED}))"""))
def describe_item(spark, sf_dir):
    c = current(spark, sf_dir)
    listed = S.list_category(F.col("category"), F.col("v"), F.col("thresholds"), F.col("t"), A.now())
    words = S.describe_item(listed, F.col("v"), F.col("unit"), F.col("thresholds"), F.col("t"), A.now())
    marked = F.transform(words, lambda w: F.concat(w["text"], F.when(w["warn"], "!").otherwise("")))
    return c.select("id", F.array_join(marked, " · ").alias("words"))


@query(f"""SELECT event_id AS id, CASE WHEN km / 1.609344 < 0.1 THEN '<0.1 mi' WHEN km / 1.609344 < 10 THEN format('{{:.1f}}', km / 1.609344) || ' mi' ELSE format('{{:,}}', floor(km / 1.609344 + 0.5)::BIGINT) || ' mi' END AS miles,
  CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN h < 24 THEN h || ' h' || CASE WHEN m % 60 = 0 THEN '' ELSE ' ' || m % 60 || ' min' END || ' ago' WHEN d < 2 THEN '1 d' || CASE WHEN h % 24 = 0 THEN '' ELSE ' ' || h % 24 || ' h' END || ' ago' WHEN d < 365 THEN d || ' days ago' ELSE 'over a year ago' END AS photo,
  CASE WHEN abs(s) < 60 THEN 'just now' WHEN s < 0 THEN 'in ' || {_AGE.format('(-s)')} ELSE {_AGE.format('s')} || ' ago' END AS relative
  FROM (SELECT *, s // 60 AS m, s // 3600 AS h, s // 86400 AS d, (event_id * 37 % 50000) / 16.0 AS km FROM (SELECT event_id, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31') AS s FROM events))""")
def format_texts(spark, sf_dir):
    ref = F.lit("2024-01-31").cast("timestamp_ntz")
    age = F.unix_seconds(ref.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return A.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), S.format_miles(F.col("event_id") * 37 % 50000 / 16.0).alias("miles"), S.format_photo_age(age).alias("photo"), S.relative_time(F.col("ts"), ref).alias("relative")
    )


_RANK = "list_position(['not_defined', 'no_stages', 'no_flooding', 'action', 'minor', 'moderate', 'major'], display) - 1"


@query(status_sql(f"SELECT id, row_number() OVER (PARTITION BY unit ORDER BY {_RANK} DESC, id)::INTEGER AS place FROM displayed"))
def sort_status(spark, sf_dir):
    """Within each unit; names sort by their numbers' values, as ids do."""
    c = current(spark, sf_dir).withColumn("rank", S.rank(F.col("display")))
    return sort_items(c, "status", ["unit"]).select("id", "place")


@query(status_sql("SELECT count(*) AS n, bit_xor(('0x' || substr(md5(id || '@' || format('{:.5f}', lat) || ',' || format('{:.5f}', lon)), 1, 15))::BIGINT) AS signature FROM gauges WHERE coalesce(action, minor, moderate, major) IS NOT NULL"))
def staged_signature(spark, sf_dir):
    g = A.gauges(spark, sf_dir).filter(S.has_valid_thresholds(F.col("thresholds")))
    part = F.md5(F.format_string("%d@%.5f,%.5f", "id", "lat", "lon").cast("binary"))
    return g.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(part, 1, 15), 16, 10).cast("long")).alias("signature"))
