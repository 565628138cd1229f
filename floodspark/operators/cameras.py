"""Cameras: cleaning, freshness, links to gauges and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodspark.functions import geo as G
from floodspark.operators.nearby import within

# The shape of camera ids.
CAMERA_ID = r"^[A-Za-z0-9_]{3,120}$"


def camera_filter(cameras: DataFrame, state: str = "TX") -> DataFrame:
    return cameras.filter(
        (F.col("state") == state) & ~F.coalesce("hidden", F.lit(False)) & F.col("id").rlike(CAMERA_ID) & G.valid_position(F.col("lat"), F.col("lon"))
    )


def photo_age(photo_at: Column, now: Column) -> Column:
    """Seconds, never below 0; null for photos before 2000 or over a day ahead."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(photo_at.cast("timestamp"))
    return F.when((photo_at >= F.lit("2000-01-01").cast("timestamp_ntz")) & (age >= -86400), F.greatest(age, F.lit(0)))


def camera_status(photo_at: Column, now: Column) -> Column:
    age = photo_age(photo_at, now)
    return F.when(age <= 3 * 3600, "fresh").when(age <= 24 * 3600, "stale").otherwise("offline")


def camera_partition(cameras: DataFrame, now: Column) -> DataFrame:
    """cameras with status, and shown: whether a map draws them."""
    x = cameras.withColumn("status", camera_status(F.col("photo_at"), now))
    return x.withColumn("shown", F.col("status") != "offline")


def link_gauges(cameras: DataFrame, gauges: DataFrame) -> DataFrame:
    """Each camera's gauge: the nearest of its site within 3 km, else the nearest gauge without a site within 30 m; the later of equals."""
    g = gauges.select(F.col("id").alias("gauge_id"), F.col("site").alias("gsite"), F.col("lat").alias("glat"), F.col("lon").alias("glon"))
    order = lambda d: F.struct(d, -F.col("gauge_id"))
    by_site = cameras.join(g, F.col("site") == F.col("gsite")).withColumn("d", G.haversine_m(F.col("lat"), F.col("lon"), F.col("glat"), F.col("glon")))
    first = by_site.filter("d <= 3000").groupBy("id").agg(F.min_by("gauge_id", order(F.col("d"))).alias("gauge_id"))
    rest = cameras.join(first, "id", "left_anti")
    free = gauges.filter("site IS NULL").select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    close = within(rest.select("id", "lat", "lon"), free, 0.03, metres=True)
    second = close.groupBy("id").agg(F.min_by("rid", F.struct("distance", -F.col("rid"))).alias("gauge_id"))
    return cameras.select("id").join(first.unionByName(second), "id", "left")


def cameras_near(cameras: DataFrame, metres: float = 150.0) -> DataFrame:
    """Other cameras within metres, nearest first: id, rid, place."""
    r = cameras.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    w = Window.partitionBy("id").orderBy("distance", "rid")
    near = within(cameras.select("id", "lat", "lon"), r, metres / 1000, metres=True).filter("id <> rid")
    return near.select("id", "rid", F.row_number().over(w).alias("place"))
