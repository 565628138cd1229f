"""Time series of stages: lookups in time, trends, crests, records and down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodspark.functions import status as S


def seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / 1e6


def targets(gauges: DataFrame, start: Column, end: Column, minutes: int = 15) -> DataFrame:
    """gauge_id and every target time of a grid, lazily exploded."""
    grid = F.sequence(start, end, F.make_dt_interval(mins=F.lit(minutes)))
    return gauges.select(F.col("id").alias("gauge_id"), F.explode(grid).alias("target"))


def history_asof(readings: DataFrame, wanted: DataFrame, minutes: int = 30) -> DataFrame:
    """wanted (gauge_id, target) with t and v of the reading nearest in time within minutes, the first of equally near.

    Buckets as long as the tolerance turn the lookup into an equi-join: a target meets the readings
    of its bucket and the two beside it. Targets may come from a grid that Spark takes for as small as
    the gauges it is made of, so both joins are merges: nothing is broadcast.
    """
    step = minutes * 60_000_000
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    valid = readings.filter(S.finite_above(F.col("v"), S.LOWEST_SITE_VALUE))
    own = F.floor(micros(F.col("t")) / step)
    around = valid.select("gauge_id", "pos", "t", "v", F.explode(F.array(own - 1, own, own + 1)).alias("bucket"))
    placed = wanted.withColumn("bucket", F.floor(micros(F.col("target")) / step))
    off = F.abs(micros(F.col("t")) - micros(F.col("target")))
    near = (
        placed.join(around.hint("merge"), ["gauge_id", "bucket"])
        .filter(off <= step)
        .groupBy("gauge_id", "target")
        .agg(F.min_by(F.struct("t", "v"), F.struct(off, "pos")).alias("r"))
    )
    return wanted.join(near.hint("merge"), ["gauge_id", "target"], "left").select("gauge_id", "target", "r.t", "r.v")


def forecast_interpolate(points: DataFrame, wanted: DataFrame, lead_hours: int = 6) -> DataFrame:
    """wanted (gauge_id, target) with v between the points around it; up to lead_hours before the first, its value; after the last, null.

    Targets are interleaved with the points and look back and ahead in one window per gauge: no range join.
    """
    pts = points.filter(S.valid_stage(F.col("v"))).groupBy("gauge_id", "t").agg(F.min_by("v", "pos").alias("v"))
    both = pts.select("gauge_id", F.col("t").alias("at"), "v", F.lit(0).alias("kind")).unionByName(
        wanted.select("gauge_id", F.col("target").alias("at"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind"))
    )
    order = Window.partitionBy("gauge_id").orderBy("at", "kind")
    back = Window.partitionBy("gauge_id").orderBy(F.col("at").desc(), F.col("kind").desc())
    point = F.when(F.col("kind") == 0, F.struct("at", "v"))
    x = both.select(
        "gauge_id", "at", "kind",
        F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("p"),
        # Looking ahead is looking back in the opposite order: a frame that only grows.
        F.last(point, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
    ).filter("kind = 1")
    part = (seconds(F.col("at")) - seconds(F.col("p.at"))) / (seconds(F.col("n.at")) - seconds(F.col("p.at")))
    v = (
        F.when(F.col("p.at") == F.col("at"), F.col("p.v"))
        .when(F.col("n").isNull(), F.lit(None))
        .when(F.col("p").isNull(), F.when(seconds(F.col("n.at")) - seconds(F.col("at")) <= lead_hours * 3600, F.col("n.v")))
        .otherwise(F.col("p.v") + part * (F.col("n.v") - F.col("p.v")))
    )
    return x.select("gauge_id", F.col("at").alias("target"), v.alias("v"))


def series_dedupe(points: DataFrame) -> DataFrame:
    """One value for each gauge and time: the last row's."""
    return points.groupBy("gauge_id", "t").agg(F.max_by("v", "pos").alias("v"))


def forecast_crest(points: DataFrame, now: Column) -> DataFrame:
    """The highest value from now on, the earliest of equal ones: gauge_id, t, v."""
    ahead = points.filter(S.valid_stage(F.col("v")) & (F.col("t") >= now))
    return ahead.groupBy("gauge_id").agg(F.max_by(F.struct("t", "v"), F.struct("v", -seconds(F.col("t")))).alias("c")).select("gauge_id", "c.t", "c.v")


STEADY_RATE, TREND_POINTS, TREND_SPAN = 0.05, 4, 5400


def _direction(slope: Column, n: Column, span: Column, fresh: Column | None = None) -> tuple[Column, Column]:
    usable = (n >= TREND_POINTS) & (span >= TREND_SPAN)
    if fresh is not None:
        usable = usable & fresh
    rate = F.when(usable, S.half_up(slope, 2))
    return rate, F.when(rate.isNull(), None).when(F.abs(slope) < STEADY_RATE, "steady").when(slope > 0, "rising").otherwise("falling")


def trend(readings: DataFrame, now: Column, hours: int = 3, old_minutes: int = 90) -> DataFrame:
    """Least-squares slope (per hour) over each gauge's newest hours: gauge_id, rate, direction; null if too old, few or short."""
    valid = readings.filter(S.valid_stage(F.col("v")) & (F.col("t") <= now))
    newest = valid.groupBy("gauge_id").agg(F.max("t").alias("last"))
    near = valid.join(newest, "gauge_id").withColumn("h", (seconds(F.col("t")) - seconds(F.col("last"))) / 3600).filter(F.col("h") >= -hours)
    fit = near.groupBy("gauge_id").agg(
        F.regr_slope("v", "h").alias("slope"), F.count("*").alias("n"), (-F.min("h") * 3600).alias("span"), F.first("last").alias("last")
    )
    fresh = seconds(now) - seconds(F.col("last")) <= old_minutes * 60
    rate, direction = _direction(F.col("slope"), F.col("n"), F.col("span"), fresh)
    return fit.select("gauge_id", rate.alias("rate"), direction.alias("direction"))


def trend_replay(readings: DataFrame, hours: int = 3, chunk_days: int = 30) -> DataFrame:
    """trend() as it was at every reading: gauge_id, pos, t, v, rate, direction.

    Windows are as long as chunk_days, however long a gauge's history is: readings of the last hours of a chunk stand before the
    next one's too, where they only count in its slopes.
    """
    origin = F.lit("2024-01-01").cast("timestamp_ntz")
    valid = readings.filter(S.valid_stage(F.col("v"))).withColumn("s", F.unix_seconds(F.col("t").cast("timestamp")))
    length = max(chunk_days * 86_400, 2 * hours * 3600)
    own = F.floor(F.col("s") / length)
    next_ = F.when((own + 1) * length - F.col("s") <= hours * 3600, own + 1)
    valid = valid.withColumn("own", own).withColumn("chunk", F.explode(F.array_compact(F.array(own, next_))))
    w = Window.partitionBy("gauge_id", "chunk").orderBy("s").rangeBetween(-hours * 3600, 0)
    h = (F.col("s") - F.unix_seconds(origin.cast("timestamp"))) / 3600.0
    x = valid.withColumn("h", h).select(
        "gauge_id", "pos", "t", "v", (F.col("own") == F.col("chunk")).alias("mine"), F.regr_slope("v", "h").over(w).alias("slope"), F.count("*").over(w).alias("n"), (F.col("s") - F.min("s").over(w)).alias("span")
    )
    rate, direction = _direction(F.col("slope"), F.col("n"), F.col("span"))
    return x.filter("mine").select("gauge_id", "pos", "t", "v", rate.alias("rate"), direction.alias("direction"))


def rise_onsets(replay: DataFrame, least_rate: float = 1.0) -> DataFrame:
    """The first flagged reading of each run of flagged ones: gauge_id, t, v, n (flags in the run)."""
    w = Window.partitionBy("gauge_id").orderBy("t", "pos")
    flag = F.coalesce((F.col("direction") == "rising") & (F.col("rate") >= least_rate), F.lit(False))
    x = replay.withColumn("flag", flag).withColumn("new", (F.col("flag") & ~F.coalesce(F.lag("flag").over(w), F.lit(False))).cast("int"))
    runs = x.withColumn("run", F.sum("new").over(w)).filter("flag")
    first = F.min_by(F.struct("t", "v"), F.struct("t", "pos"))
    return runs.groupBy("gauge_id", "run").agg(first.alias("f"), F.count("*").alias("n")).select("gauge_id", "f.t", "f.v", "n")


def downsample(points: DataFrame, most: int = 96) -> DataFrame:
    """At most so many points of each gauge: first, last, first highest, first lowest, and the last of each of most - 4 equal spans."""
    all_ = Window.partitionBy("gauge_id")
    order = all_.orderBy("t", "pos")
    x = points.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(all_))
    x = x.withColumn("t0", F.min("t").over(all_)).withColumn("t1", F.max("t").over(all_))
    x = x.withColumn("hi", F.max(F.struct("v", -F.col("i"))).over(all_)).withColumn("lo", F.min(F.struct("v", "i")).over(all_))
    span = F.greatest(seconds(F.col("t1")) - seconds(F.col("t0")), F.lit(1e-6))
    bucket = F.least(F.floor((seconds(F.col("t")) - seconds(F.col("t0"))) / span * (most - 4)), F.lit(most - 5))
    x = x.withColumn("bucket", bucket)
    x = x.withColumn("next", F.lead("bucket").over(order))
    keep = (
        (F.col("n") <= most) | (F.col("i") == 1) | (F.col("i") == F.col("n")) | (F.col("i") == -F.col("hi")["col2"]) | (F.col("i") == F.col("lo")["i"])
        | (F.col("next") != F.col("bucket"))
    )
    return x.filter(keep).select("gauge_id", "pos", "t", "v")


def peak_records(peaks: DataFrame, most: int = 8) -> DataFrame:
    """peaks (site, date, stage): the highest of each date, the top of them, the first marked as record."""
    best = peaks.filter(S.valid_stage(F.col("stage"))).groupBy("site", "date").agg(F.max("stage").alias("stage"))
    w = Window.partitionBy("site").orderBy(F.col("stage").desc(), "date")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).withColumn("is_record", F.col("place") == 1)


def crests_topn(crests: DataFrame, most: int = 5) -> DataFrame:
    """crests (gauge_id, pos, date, t, stage, old_datum): the most recent and the highest of each gauge since 1800, with kind and place."""
    ok = crests.filter(~F.col("old_datum") & S.valid_stage(F.col("stage")) & (F.col("t") > F.lit("1800-01-01").cast("timestamp_ntz")))
    once = ok.groupBy("gauge_id", "date", "stage").agg(F.min_by("t", "pos").alias("t"), F.min("pos").alias("pos"))
    recent = Window.partitionBy("gauge_id").orderBy(F.col("t").desc(), "pos")
    high = Window.partitionBy("gauge_id").orderBy(F.col("stage").desc(), F.col("t").desc(), "pos")
    pick = lambda w, kind: once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).withColumn("kind", F.lit(kind))
    return pick(recent, "recent").unionByName(pick(high, "historic")).select("gauge_id", "kind", "place", "date", "stage")


def hydrograph_domain(observed: DataFrame, forecast: DataFrame, meta: DataFrame, now: Column) -> DataFrame:
    """The stage range that a plot needs: data range of one at least, the next threshold if near, padded by 6 %."""
    pts = observed.select("gauge_id", "v").unionByName(forecast.filter(F.col("t") >= now - F.make_interval(hours=F.lit(2))).select("gauge_id", "v"))
    r = pts.filter(S.valid_stage(F.col("v"))).groupBy("gauge_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))
    t = S.sanitize_thresholds(F.col("thresholds"))
    above = F.array_min(F.filter(F.array(*[t[k] for k in S.LEVELS]), lambda x: x > F.col("hi")))
    x = r.join(meta.select(F.col("id").alias("gauge_id"), "thresholds"), "gauge_id").select("gauge_id", "lo", "hi", span.alias("span"), above.alias("next"))
    top = F.when(F.col("next") - F.col("lo") <= 4 * F.col("span"), F.col("next")).otherwise(F.greatest(F.col("hi"), F.col("lo") + F.col("span")))
    return x.select("gauge_id", (F.col("lo") - 0.06 * (top - F.col("lo"))).alias("low"), (top + 0.06 * (top - F.col("lo"))).alias("high"))


def impact_mark(impacts: DataFrame, current: DataFrame, crests: DataFrame) -> DataFrame:
    """impacts (gauge_id, stage) that are reached now, or will be by the forecast crest."""
    x = impacts.join(current, "gauge_id", "left").join(crests.select("gauge_id", F.col("v").alias("crest")), "gauge_id", "left")
    mark = F.when(F.col("fresh") & (F.col("stage") <= F.col("now_v")), "now").when(F.col("stage") <= F.col("crest"), "forecast")
    return x.select("gauge_id", "stage", mark.alias("mark"))


def extract_forecast(raw: Column, thresholds: Column) -> Column:
    """A list row's forecast (primary, primaryUnit, floodCategory, validTime) as stage, unit, t and category; null where stage or time is a sentinel."""
    stage, t = S.clean_stage(raw["primary"]), S.clean_time(raw["validTime"])
    unit = F.when(F.trim(raw["primaryUnit"]) != "", raw["primaryUnit"])
    category = S.resolve_category(raw["floodCategory"], stage, thresholds)
    return F.when(stage.isNotNull() & t.isNotNull(), F.struct(stage.alias("stage"), unit.alias("unit"), t.alias("t"), category.alias("category")))


def forecast_view(gauges: DataFrame, details: DataFrame, crests: DataFrame, now: Column, stale_hours: int = 24) -> DataFrame:
    """gauges (id, unit, thresholds, forecast) to what is said of each one's forecast: view, v, t, unit, category, issued_at, stale.

    details has a row for each gauge whose detail was answered or failed: gauge_id, has_forecast, n_points, unit, issued_at.
    An answered series beats the list's forecast: none without points, expired when all are past, else its
    crest. Otherwise the list's forecast is the crest while it is ahead; without it, unavailable where the
    detail failed or lacks the series, and loading where it is not there yet.
    """
    g = gauges.select(F.col("id").alias("gauge_id"), F.col("unit").alias("gauge_unit"), "thresholds", F.col("forecast").alias("f"))
    d = details.select("gauge_id", F.col("has_forecast").alias("answered"), "n_points", F.col("unit").alias("detail_unit"), "issued_at", F.lit(True).alias("ended"))
    x = g.join(d, "gauge_id", "left").join(crests.select("gauge_id", F.col("t").alias("crest_t"), F.col("v").alias("crest_v")), "gauge_id", "left")
    series = F.coalesce("answered", F.lit(False))
    listed = F.coalesce(F.col("f.t") >= now, F.lit(False))
    view = (
        F.when(series, F.when(F.col("n_points") == 0, "none").when(F.col("crest_v").isNull(), "expired").otherwise("crest"))
        .when(listed, "crest")
        .when(F.col("ended"), "unavailable")
        .otherwise("loading")
    )
    crest = view == "crest"
    pick = lambda of_series, of_list: F.when(crest, F.when(series, of_series).otherwise(of_list))
    known = F.when(F.col("thresholds").isNotNull(), S.categorize_by_stage(F.col("crest_v"), F.col("thresholds"))).otherwise("not_defined")
    stale = crest & series & (seconds(now) - seconds(F.col("issued_at")) > stale_hours * 3600)
    return x.select(
        "gauge_id",
        view.alias("view"),
        pick(F.col("crest_v"), F.col("f.stage")).alias("v"),
        pick(F.col("crest_t"), F.col("f.t")).alias("t"),
        pick(F.coalesce("detail_unit", "gauge_unit"), F.coalesce("f.unit", "gauge_unit")).alias("unit"),
        pick(known, F.col("f.category")).alias("category"),
        F.when(series & (view != "none"), F.col("issued_at")).alias("issued_at"),
        F.coalesce(stale, F.lit(False)).alias("stale"),
    )
