"""From feeds to the current status of every gauge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.functions import status as S


def latest_reading(readings: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """The newest valid value of each gauge in the last hours; the first of equal times. gauge_id, t, v."""
    recent = readings.filter(
        S.finite_above(F.col("v"), S.LOWEST_SITE_VALUE) & (F.col("t") <= now) & (F.col("t") >= now - F.make_interval(hours=F.lit(hours)))
    )
    return recent.groupBy("gauge_id").agg(F.max_by(F.struct("t", "v"), F.struct("t", -F.col("pos"))).alias("r")).select("gauge_id", "r.t", "r.v")


def last_of_each(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Of rows with equal keys, the last by position; a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("r")).select(key, "r.*")


def feed_meta_join(feed: DataFrame, meta: DataFrame) -> DataFrame:
    """feed (gauge_id, pos, ...) with the metadata of its gauge, the last row of a gauge only."""
    return last_of_each(feed, "gauge_id", "pos").join(meta.withColumnRenamed("id", "gauge_id"), "gauge_id", "left")


def gauge_status_rows(joined: DataFrame) -> DataFrame:
    """Status of a joined feed row: category, stage, time (null without a stage), unit, source."""
    stage = S.clean_stage(F.col("v"))
    t = S.sanitize_thresholds(F.col("thresholds"))
    return joined.select(
        "gauge_id",
        S.resolve_category(F.col("feed_category"), stage, t).alias("category"),
        stage.alias("observed_stage"),
        F.when(stage.isNotNull(), S.clean_time(F.col("t"))).alias("observed_at"),
        F.coalesce("feed_unit", "unit").alias("unit"),
        t.alias("thresholds"),
        F.when(stage.isNotNull(), F.lit("nws")).alias("source"),
    )


def usgs_fanout(readings: DataFrame, meta: DataFrame) -> DataFrame:
    """Readings of a site (as gauge_id) to every gauge that names it."""
    sites = meta.filter("site IS NOT NULL").select(F.col("id").alias("to"), "site")
    return readings.join(sites, readings["gauge_id"] == sites["site"]).select(F.col("to").alias("gauge_id"), "site", "pos", "t", "v")


def with_fallback(meta: DataFrame, latest: DataFrame, built_stage: Column, built_at: Column) -> DataFrame:
    """Every gauge with its live reading, else with what its metadata was built with."""
    live = latest.select(F.col("gauge_id").alias("id"), F.col("t").alias("lt"), F.col("v").alias("lv"))
    return meta.join(live, "id", "left").select(
        "id",
        F.coalesce("lv", built_stage).alias("stage"),
        F.when(F.col("lv").isNotNull(), F.col("lt")).otherwise(built_at).alias("at"),
        F.when(F.col("lv").isNotNull(), F.lit("live")).otherwise("built").alias("source"),
    )


def snapshot_priority(rows: DataFrame, now: Column, fresh_minutes: int = 90) -> DataFrame:
    """rows (gauge_id, source in stored, live, metadata, snapshot_at, v): a fresh stored row, else the newest of live and stored, else metadata."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("snapshot_at").cast("timestamp"))
    order = (
        F.when((F.col("source") == "stored") & (age < fresh_minutes * 60), 2)
        .when(F.col("source") != "metadata", 1)
        .otherwise(0)
    )
    best = F.max_by(F.struct("source", "snapshot_at", "v"), F.struct(order, "snapshot_at", (F.col("source") == "stored").cast("int")))
    return rows.groupBy("gauge_id").agg(best.alias("r")).select("gauge_id", "r.*")


def category_counts(rows: DataFrame) -> DataFrame:
    """rows (category, old) to n and n_old of every category, zeros included."""
    names = rows.sparkSession.createDataFrame([(c,) for c in S.CATEGORIES], "category string")
    counted = rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if("old").alias("n_old"))
    return F.broadcast(names).join(counted, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_old", F.lit(0)).alias("n_old")
    )


def repair(rows: DataFrame, distrust_normal: bool) -> DataFrame:
    """Stored statuses again under today's rules: no stage or, if distrusted, no thresholds makes quiet categories unknown."""
    stage = S.clean_stage(F.col("v"))
    quiet = (F.col("category") == "no_flooding") & (~S.has_valid_thresholds(F.col("thresholds")) if distrust_normal else F.lit(False))
    return rows.withColumn("category", F.when(stage.isNull() | quiet, F.lit("not_defined")).otherwise(F.col("category"))).withColumn("v", stage)


def usable_snapshots(rows: DataFrame) -> DataFrame:
    """Snapshots after 1970 with a gauge at least: snapshot_at, n."""
    return rows.filter(S.clean_time(F.col("snapshot_at")).isNotNull()).groupBy("snapshot_at").agg(F.count("*").alias("n"))


def last_good_read(reads: DataFrame, hours: int = 6) -> DataFrame:
    """reads (feed, pos, t, ok, n): for each failed read the newest good one before it, unless older than hours; stale and error tell.

    A copy that is not too old lies in the same stretch of so many hours or in the one before, so windows are as long as a
    stretch, and each stretch hands its last good read on to the next.
    """
    from pyspark.sql.window import Window

    stretch = F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / (hours * 3600))
    x = reads.withColumn("__s", stretch)
    w = Window.partitionBy("feed", "__s").orderBy("t", "pos").rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(F.when(F.col("ok"), F.struct("t", "n")), ignorenulls=True).over(w)
    ends = x.filter("ok").groupBy("feed", (F.col("__s") + 1).alias("__s")).agg(F.max_by(F.struct("t", "n"), F.struct("t", "pos")).alias("before"))
    x = x.withColumn("here", here).join(ends, ["feed", "__s"], "left").withColumn("g", F.coalesce("here", "before"))
    age = F.unix_seconds(F.col("t").cast("timestamp")) - F.unix_seconds(F.col("g.t").cast("timestamp"))
    usable = F.coalesce(age < hours * 3600, F.lit(False))
    return x.select(
        "feed", "pos", "t",
        F.when(usable, F.col("g.n")).alias("n"),
        (usable & ~F.col("ok")).alias("stale"),
        (~usable).alias("error"),
    )
