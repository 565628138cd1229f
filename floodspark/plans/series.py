"""Queries on stage series."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark.functions import status as S
from floodspark.operators import series as op
from floodspark.operators.status import latest_reading
from floodspark.plans import query
from floodspark.sources import adapt as A
from floodspark.sources.adapt import FORECASTS, GAUGES, NOW, READINGS

FORECAST_NOW = "2024-01-20 00:00:00"
_FROM, _TO = "2024-01-28 00:00:00", "2024-01-30 00:00:00"


def _ts(x):
    return F.lit(x).cast("timestamp_ntz")


_WANTED = f"wanted AS (SELECT id AS gauge_id, unnest(generate_series(TIMESTAMP '{_FROM}', TIMESTAMP '{_TO}', INTERVAL 15 MINUTE)) AS target FROM gauges)"


def _wanted(spark, sf_dir, start=_FROM, end=_TO, minutes=15):
    return op.targets(A.gauges(spark, sf_dir), _ts(start), _ts(end), minutes)


_ASOF = """asof_ AS (SELECT gauge_id, target, t, v FROM (SELECT w.*, r.t, r.v, row_number() OVER (PARTITION BY w.gauge_id, w.target ORDER BY abs(epoch_us(r.t) - epoch_us(w.target)), r.pos) AS k
  FROM wanted w LEFT JOIN readings r ON r.gauge_id = w.gauge_id AND r.v > -999 AND abs(epoch_us(r.t) - epoch_us(w.target)) <= 1800000000) WHERE k = 1)"""


@query(f"WITH {GAUGES}, {READINGS}, {_WANTED}, {_ASOF} SELECT * FROM asof_")
def history_asof(spark, sf_dir):
    return op.history_asof(A.readings(spark, sf_dir), _wanted(spark, sf_dir))


_INTERPOLATE = """ended AS (SELECT gauge_id, t, arg_min(v, pos) AS v FROM forecasts WHERE v > -100 GROUP BY gauge_id, t), found AS (
  SELECT w.gauge_id, w.target, (SELECT max(t) FROM ended e WHERE e.gauge_id = w.gauge_id AND e.t <= w.target) AS pt, (SELECT min(t) FROM ended e WHERE e.gauge_id = w.gauge_id AND e.t >= w.target) AS nt FROM wanted w
), both_ AS (SELECT f.*, p.v AS pv, n.v AS nv, epoch_us(target) / 1e6 AS x, epoch_us(pt) / 1e6 AS px, epoch_us(nt) / 1e6 AS nx FROM found f LEFT JOIN ended p ON p.gauge_id = f.gauge_id AND p.t = pt LEFT JOIN ended n ON n.gauge_id = f.gauge_id AND n.t = nt)"""


@query(f"""WITH {GAUGES}, {FORECASTS}, {_WANTED}, {_INTERPOLATE} SELECT gauge_id, target, round(CASE WHEN pt = target THEN pv WHEN nt IS NULL THEN NULL WHEN pt IS NULL THEN CASE WHEN nx - x <= 21600 THEN nv END
  ELSE pv + (x - px) / (nx - px) * (nv - pv) END, 6) AS v FROM both_""")
def forecast_interpolate(spark, sf_dir):
    got = op.forecast_interpolate(A.forecasts(spark, sf_dir), _wanted(spark, sf_dir))
    return got.withColumn("v", F.round("v", 6))


@query(f"""WITH {GAUGES}, {READINGS}, {FORECASTS}, wanted AS (SELECT id AS gauge_id, unnest(generate_series(TIMESTAMP '2024-01-14', TIMESTAMP '2024-01-26', INTERVAL 15 MINUTE)) AS target FROM gauges), {_ASOF}, {_INTERPOLATE}
  SELECT gauge_id, target, v, 'observed' AS kind FROM asof_ WHERE target <= TIMESTAMP '{FORECAST_NOW}'
  UNION ALL SELECT gauge_id, target, round(CASE WHEN pt = target THEN pv WHEN nt IS NULL THEN NULL WHEN pt IS NULL THEN CASE WHEN nx - x <= 21600 THEN nv END ELSE pv + (x - px) / (nx - px) * (nv - pv) END, 6), 'forecast' FROM both_ WHERE target > TIMESTAMP '{FORECAST_NOW}'""")
def timeline_frames(spark, sf_dir):
    w = _wanted(spark, sf_dir, "2024-01-14 00:00:00", "2024-01-26 00:00:00")
    past, ahead = w.filter(F.col("target") <= _ts(FORECAST_NOW)), w.filter(F.col("target") > _ts(FORECAST_NOW))
    seen = op.history_asof(A.readings(spark, sf_dir), past).select("gauge_id", "target", "v", F.lit("observed").alias("kind"))
    told = op.forecast_interpolate(A.forecasts(spark, sf_dir), ahead).select("gauge_id", "target", F.round("v", 6).alias("v"), F.lit("forecast").alias("kind"))
    return seen.unionByName(told)


@query(f"WITH {READINGS} SELECT pos, t BETWEEN TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND TIMESTAMP '{NOW}' + INTERVAL 1 MINUTE AS history, t BETWEEN TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE AND TIMESTAMP '{NOW}' + INTERVAL 5 DAY AS forecast FROM readings")
def timeline_range(spark, sf_dir):
    t = F.col("t")
    within = lambda a, b: t.between(A.now() + F.expr(f"INTERVAL {a}"), A.now() + F.expr(f"INTERVAL {b}"))
    return A.readings(spark, sf_dir).select("pos", within("-7 DAY", "1 MINUTE").alias("history"), within("-5 MINUTE", "5 DAY").alias("forecast"))


@query(f"WITH {READINGS} SELECT gauge_id, date_trunc('hour', t) AS t, arg_max(v, pos) AS v FROM readings GROUP BY 1, 2")
def series_dedupe(spark, sf_dir):
    r = A.readings(spark, sf_dir).withColumn("t", F.date_trunc("hour", "t").cast("timestamp_ntz"))
    return op.series_dedupe(r)


_CREST = f"crests AS (SELECT gauge_id, t, v FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY v DESC, t) AS r FROM forecasts WHERE v > -100 AND t >= TIMESTAMP '{FORECAST_NOW}') WHERE r = 1)"


@query(f"WITH {FORECASTS}, {_CREST} SELECT * FROM crests")
def forecast_crest(spark, sf_dir):
    return op.forecast_crest(A.forecasts(spark, sf_dir), _ts(FORECAST_NOW))


_CATEGORY_OF = "CASE WHEN coalesce(action, minor, moderate, major) IS NULL THEN 'not_defined' WHEN {0} >= major THEN 'major' WHEN {0} >= moderate THEN 'moderate' WHEN {0} >= minor THEN 'minor' WHEN {0} >= action THEN 'action' ELSE 'no_flooding' END"
_LISTED = f"""raw AS (SELECT user_id AS gauge_id, arg_max(event_id, event_id) AS pos, arg_max(CASE WHEN event_id % 4 = 0 THEN -999.0 ELSE value END, event_id)::DOUBLE AS stage,
    arg_max(CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END, event_id) AS t0 FROM events GROUP BY 1), listed AS (
  SELECT g.id AS gauge_id, CASE WHEN stage > -100 AND pos % 7 <> 0 THEN stage END AS stage, CASE WHEN stage > -100 AND pos % 7 <> 0 THEN (SELECT ts FROM events e WHERE e.event_id = pos) END AS t,
    CASE WHEN stage > -100 AND pos % 7 <> 0 THEN CASE WHEN pos % 5 = 0 THEN 'minor' ELSE {_CATEGORY_OF.format('stage')} END END AS category FROM gauges g JOIN raw ON raw.gauge_id = g.id)"""


def _listed(spark, sf_dir):
    """Gauges with a list row's forecast: each gauge's last event, with sentinels."""
    e, i = A.table(spark, sf_dir, "events"), F.col("pos")
    last = e.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("pos"), F.max_by("value", "event_id").alias("value"), F.max_by("ts", "event_id").alias("ts"))
    raw = F.struct(
        F.when(i % 4 == 0, F.lit(-999.0)).otherwise(F.col("value")).alias("primary"),
        F.lit(" ").alias("primaryUnit"),
        F.when(i % 5 == 0, "Minor").otherwise("fcst_not_current").alias("floodCategory"),
        F.when(i % 7 != 0, F.col("ts")).otherwise(F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("validTime"),
    )
    x = A.gauges(spark, sf_dir).join(last, "id")
    return x.withColumn("forecast", op.extract_forecast(raw, F.col("thresholds")))


@query(f"WITH {GAUGES}, {_LISTED} SELECT gauge_id, stage, t, category FROM listed")
def extract_forecast(spark, sf_dir):
    return _listed(spark, sf_dir).select(F.col("id").alias("gauge_id"), "forecast.stage", "forecast.t", "forecast.category")


@query(f"""WITH {GAUGES}, {FORECASTS}, {_CREST}, {_LISTED}, d AS (SELECT gauge_id, count(*) AS n, min(t) AS issued_at FROM forecasts GROUP BY 1),
  x AS (SELECT g.*, g.id % 9 <> 0 AS ended, g.id % 9 <> 0 AND g.id % 4 <> 0 AS answered, CASE WHEN g.id % 10 = 1 THEN 0 ELSE coalesce(d.n, 0) END AS n, d.issued_at, c.v AS cv, c.t AS ct, l.stage, l.t, l.category AS lc FROM gauges g LEFT JOIN d ON d.gauge_id = id LEFT JOIN crests c ON c.gauge_id = id LEFT JOIN listed l ON l.gauge_id = id),
  y AS (SELECT *, CASE WHEN answered THEN CASE WHEN n = 0 THEN 'none' WHEN cv IS NULL THEN 'expired' ELSE 'crest' END WHEN t >= TIMESTAMP '{FORECAST_NOW}' THEN 'crest' WHEN ended THEN 'unavailable' ELSE 'loading' END AS view FROM x)
  SELECT id AS gauge_id, view, CASE WHEN view = 'crest' THEN CASE WHEN answered THEN cv ELSE stage END END AS v, CASE WHEN view = 'crest' THEN CASE WHEN answered THEN ct ELSE t END END AS t, CASE WHEN view = 'crest' THEN unit END AS unit,
    CASE WHEN view = 'crest' THEN CASE WHEN answered THEN {_CATEGORY_OF.format('cv')} ELSE lc END END AS category, CASE WHEN answered AND view <> 'none' THEN issued_at END AS issued_at,
    coalesce(view = 'crest' AND answered AND TIMESTAMP '{FORECAST_NOW}' - issued_at > INTERVAL 1 DAY, false) AS stale FROM y""")
def forecast_view(spark, sf_dir):
    f, now, i = A.forecasts(spark, sf_dir), _ts(FORECAST_NOW), F.col("id")
    told = f.groupBy(F.col("gauge_id").alias("id")).agg(F.count("*").alias("n"), F.min("t").alias("issued_at"))
    details = A.gauges(spark, sf_dir).filter(i % 9 != 0).join(told, "id", "left").select(
        i.alias("gauge_id"), (i % 4 != 0).alias("has_forecast"), F.when(i % 10 == 1, 0).otherwise(F.coalesce("n", F.lit(0))).alias("n_points"), F.lit(None).cast("string").alias("unit"), "issued_at"
    )
    return op.forecast_view(_listed(spark, sf_dir), details, op.forecast_crest(f, now), now)


_TREND_NOW = "2024-01-30 12:00:00"
_WIDE = 48  # hours: readings stand some five hours apart


@query(f"""WITH {READINGS}, valid AS (SELECT * FROM readings WHERE v > -100 AND t <= TIMESTAMP '{_TREND_NOW}'), m AS (SELECT gauge_id, max(t) AS last FROM valid GROUP BY 1),
  n AS (SELECT v.*, last, (epoch_us(t) - epoch_us(last)) / 3600e6 AS h FROM valid v JOIN m USING (gauge_id)), f AS (SELECT gauge_id, regr_slope(v, h) AS slope, count(*) AS n, -min(h) * 3600 AS span, first(last) AS last FROM n WHERE h >= -{_WIDE} GROUP BY 1),
  u AS (SELECT *, n >= 4 AND span >= 5400 AND epoch_us(TIMESTAMP '{_TREND_NOW}') - epoch_us(last) <= 43200e6 AS ok FROM f)
  SELECT gauge_id, CASE WHEN ok THEN floor(slope * 100 + 0.5) / 100 END AS rate, CASE WHEN NOT ok THEN NULL WHEN abs(slope) < 0.05 THEN 'steady' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction FROM u""")
def trend(spark, sf_dir):
    return op.trend(A.readings(spark, sf_dir), _ts(_TREND_NOW), hours=_WIDE, old_minutes=720)


_REPLAY = f"""replay AS (SELECT gauge_id, pos, t, v, CASE WHEN n >= 4 AND span >= 5400 THEN floor(slope * 100 + 0.5) / 100 END AS rate, CASE WHEN n < 4 OR span < 5400 THEN NULL WHEN abs(slope) < 0.05 THEN 'steady' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction
  FROM (SELECT *, regr_slope(v, (s - 1704067200) / 3600.0) OVER w AS slope, count(*) OVER w AS n, s - min(s) OVER w AS span
    FROM (SELECT *, floor(epoch_us(t) / 1000000.0)::BIGINT AS s FROM readings WHERE v > -100) WINDOW w AS (PARTITION BY gauge_id ORDER BY s RANGE BETWEEN {_WIDE * 3600} PRECEDING AND CURRENT ROW)))"""


@query(f"WITH {READINGS}, {_REPLAY} SELECT * FROM replay")
def trend_replay(spark, sf_dir):
    return op.trend_replay(A.readings(spark, sf_dir), hours=_WIDE)


@query(f"""WITH {READINGS}, {_REPLAY}, f AS (SELECT *, coalesce(direction = 'rising' AND rate >= 1, false) AS flag FROM replay), n AS (SELECT *, CASE WHEN flag AND NOT coalesce(lag(flag) OVER w, false) THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY gauge_id ORDER BY t, pos)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY gauge_id ORDER BY t, pos) AS run FROM n) SELECT gauge_id, arg_min(t, pos) AS t, arg_min(v, pos) AS v, count(*) AS n FROM r WHERE flag GROUP BY gauge_id, run""")
def rise_onsets(spark, sf_dir):
    return op.rise_onsets(op.trend_replay(A.readings(spark, sf_dir), hours=_WIDE))


@query(f"""WITH {READINGS}, {_REPLAY}, {GAUGES} SELECT pos FROM replay r JOIN gauges g ON g.id = r.gauge_id WHERE direction = 'rising' AND rate >= 1 AND unit = 'ft'""")
def rising_quickly(spark, sf_dir):
    r = op.trend_replay(A.readings(spark, sf_dir), hours=_WIDE)
    feet = A.gauges(spark, sf_dir).filter(F.coalesce(F.lower("unit") == "ft", F.lit(True))).select(F.col("id").alias("gauge_id"))
    return r.filter((F.col("direction") == "rising") & (F.col("rate") >= 1)).join(feet, "gauge_id", "left_semi").select("pos")


@query(f"""WITH {READINGS}, a AS (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY t, pos) AS i, count(*) OVER (PARTITION BY gauge_id) AS n, min(t) OVER (PARTITION BY gauge_id) AS t0, max(t) OVER (PARTITION BY gauge_id) AS t1 FROM readings),
  b AS (SELECT *, least(floor((epoch_us(t) / 1e6 - epoch_us(t0) / 1e6) / greatest(epoch_us(t1) / 1e6 - epoch_us(t0) / 1e6, 1e-6) * 28), 27) AS bucket, row_number() OVER (PARTITION BY gauge_id ORDER BY v DESC, i) AS hi, row_number() OVER (PARTITION BY gauge_id ORDER BY v, i) AS lo FROM a),
  c AS (SELECT *, lead(bucket) OVER (PARTITION BY gauge_id ORDER BY i) AS nb FROM b) SELECT gauge_id, pos, t, v FROM c WHERE n <= 32 OR i = 1 OR i = n OR hi = 1 OR lo = 1 OR nb <> bucket""")
def downsample(spark, sf_dir):
    return op.downsample(A.readings(spark, sf_dir), most=32)


@query(f"""WITH {READINGS}, p AS (SELECT gauge_id AS site, CASE WHEN pos % 3 = 0 THEN strftime(t, '%Y-%m') ELSE strftime(t, '%Y-%m-%d') END AS date, max(v) AS stage FROM readings WHERE v > -100 GROUP BY 1, 2)
  SELECT *, place = 1 AS is_record FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY stage DESC, date)::INTEGER AS place FROM p) WHERE place <= 8""")
def peak_records(spark, sf_dir):
    date = F.when(F.col("pos") % 3 == 0, F.date_format("t", "yyyy-MM")).otherwise(F.date_format("t", "yyyy-MM-dd"))
    return op.peak_records(A.readings(spark, sf_dir).select(F.col("gauge_id").alias("site"), date.alias("date"), F.col("v").alias("stage")))


@query(f"""WITH {READINGS}, c AS (SELECT gauge_id, strftime(t, '%Y-%m-%d') AS date, floor(v / 10) * 10 AS stage, min(pos) AS pos, arg_min(t, pos) AS t FROM readings WHERE v > -100 AND pos % 7 <> 0 GROUP BY 1, 2, 3)
  SELECT gauge_id, 'recent' AS kind, place, date, stage FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY t DESC, pos)::INTEGER AS place FROM c) WHERE place <= 5
  UNION ALL SELECT gauge_id, 'historic', place, date, stage FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY stage DESC, t DESC, pos)::INTEGER AS place FROM c) WHERE place <= 5""")
def crests_topn(spark, sf_dir):
    r = A.readings(spark, sf_dir).filter("v > -100")
    return op.crests_topn(r.select("gauge_id", "pos", F.date_format("t", "yyyy-MM-dd").alias("date"), "t", (F.floor(F.col("v") / 10) * 10.0).alias("stage"), (F.col("pos") % 7 == 0).alias("old_datum")))


@query(f"""WITH {GAUGES}, {READINGS}, {FORECASTS}, p AS (SELECT gauge_id, v FROM readings WHERE v > -100 AND t <= TIMESTAMP '{FORECAST_NOW}' UNION ALL SELECT gauge_id, v FROM forecasts WHERE v > -100 AND t >= TIMESTAMP '{FORECAST_NOW}' - INTERVAL 2 HOUR),
  r AS (SELECT gauge_id, min(v) AS lo, max(v) AS hi, greatest(max(v) - min(v), 1.0) AS span FROM p GROUP BY 1), x AS (SELECT r.*, list_min(list_filter([action, minor, moderate, major], lambda a: a > hi)) AS next FROM r JOIN gauges ON id = gauge_id),
  y AS (SELECT *, CASE WHEN next - lo <= 4 * span THEN next ELSE greatest(hi, lo + span) END AS top FROM x) SELECT gauge_id, round(lo - 0.06 * (top - lo), 6) AS low, round(top + 0.06 * (top - lo), 6) AS high FROM y""")
def hydrograph_domain(spark, sf_dir):
    seen = A.readings(spark, sf_dir).filter(F.col("t") <= _ts(FORECAST_NOW))
    x = op.hydrograph_domain(seen, A.forecasts(spark, sf_dir), A.gauges(spark, sf_dir), _ts(FORECAST_NOW))
    return x.select("gauge_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {GAUGES}, {READINGS}, {FORECASTS}, {_CREST}, i AS (SELECT id AS gauge_id, unnest([10.0, 60.0, 120.0, 250.0, 400.0])::DOUBLE AS stage FROM gauges),
  l AS (SELECT gauge_id, arg_max(v, (t, -pos)) AS now_v, max(t) >= TIMESTAMP '{FORECAST_NOW}' - INTERVAL 90 MINUTE AS fresh FROM readings WHERE v > -999 AND t <= TIMESTAMP '{FORECAST_NOW}' AND t >= TIMESTAMP '{FORECAST_NOW}' - INTERVAL 2 HOUR GROUP BY 1)
  SELECT i.gauge_id, stage, CASE WHEN fresh AND stage <= now_v THEN 'now' WHEN stage <= c.v THEN 'forecast' END AS mark FROM i LEFT JOIN l USING (gauge_id) LEFT JOIN crests c USING (gauge_id)""")
def impact_mark(spark, sf_dir):
    impacts = A.gauges(spark, sf_dir).select(F.col("id").alias("gauge_id"), F.explode(F.array(*map(F.lit, (10.0, 60.0, 120.0, 250.0, 400.0)))).alias("stage"))
    now = _ts(FORECAST_NOW)
    latest = latest_reading(A.readings(spark, sf_dir), now).select("gauge_id", F.col("v").alias("now_v"), (F.col("t") >= now - F.expr("INTERVAL 90 MINUTE")).alias("fresh"))
    return op.impact_mark(impacts, latest, op.forecast_crest(A.forecasts(spark, sf_dir), now))
