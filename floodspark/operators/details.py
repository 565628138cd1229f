"""Detail pages: impacts, assembled details, favorites, waterway joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodspark.functions import alerts as A
from floodspark.functions import status as S
from floodspark.operators import series as T
from floodspark.operators.nearby import nearby_gauges
from floodspark.operators.search import name_sort_key


def impacts_topn(impacts: DataFrame, most: int = 20) -> DataFrame:
    """impacts (gauge_id, pos, stage, statement): cleaned, highest first."""
    clean = impacts.filter(S.valid_stage(F.col("stage"))).withColumn("statement", A.clean_statement(F.col("statement"))).filter(F.col("statement") != "")
    w = Window.partitionBy("gauge_id").orderBy(F.col("stage").desc(), "pos")
    return clean.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("gauge_id", "place", "stage", "statement")


OBSERVED_HOURS, OBSERVED_POINTS, FORECAST_POINTS = 48, 96, 120


def detail_assembly(meta: DataFrame, observed: DataFrame, forecast: DataFrame, impacts: DataFrame, crests: DataFrame, now: Column, answers: DataFrame | None = None) -> DataFrame:
    """One row for each gauge of meta (id, name, unit): what a detail page shows.

    observed and forecast (gauge_id, pos, t, v, unit; forecast with issued_at) are cleaned, of the last 48 hours and of all
    points, thinned to 96 and 120; trend and newest time are of all observed points. impacts (gauge_id, stage, statement)
    and crests are those of impacts_topn() and crests_topn(). answers (gauge_id, record, observed, forecast) says which requests were
    answered, with rows or without; where it is not given, a source with rows counts as answered. ok: any source was.
    """
    seen, told = (T.series_dedupe(x.filter(S.valid_stage(F.col("v")) & F.col("t").isNotNull())).withColumn("pos", F.unix_micros(F.col("t").cast("timestamp"))) for x in (observed, forecast))
    recent = seen.filter(F.col("t") >= now - F.make_interval(hours=F.lit(OBSERVED_HOURS)))
    points = lambda df, name: df.groupBy("gauge_id").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias(name))
    listed = lambda df, name, *cols: df.groupBy("gauge_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    source = lambda df, name: df.groupBy("gauge_id").agg(F.min_by("unit", "pos").alias(name))
    parts = [
        points(T.downsample(recent, OBSERVED_POINTS), "observed"),
        points(T.downsample(told, FORECAST_POINTS), "forecast"),
        seen.groupBy("gauge_id").agg(F.max("t").alias("observed_at")),
        forecast.groupBy("gauge_id").agg(F.max("issued_at").alias("issued_at")),
        source(observed, "observed_unit"),
        source(forecast, "forecast_unit"),
        observed.select("gauge_id").distinct().withColumn("has_observed", F.lit(True)),
        forecast.select("gauge_id").distinct().withColumn("has_forecast", F.lit(True)),
        T.trend(seen, now).select("gauge_id", "rate", "direction"),
        listed(impacts, "impacts", "place", "stage", "statement"),
        listed(crests, "crests", "kind", "place", "date", "stage"),
    ]
    out = meta.select(F.col("id").alias("gauge_id"), "name", F.col("unit").alias("own_unit"))
    for part in parts:
        out = out.join(part, "gauge_id", "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    record = F.col("own_unit").isNotNull() | F.col("impacts").isNotNull() | F.col("crests").isNotNull()
    answered = {"record": record, "observed": has(F.col("has_observed")), "forecast": has(F.col("has_forecast"))}
    if answers is not None:
        out = out.join(answers.select("gauge_id", *[F.col(c).alias(f"__{c}") for c in answered]), "gauge_id", "left")
        answered = {c: has(F.col(f"__{c}")) for c in answered}
    return out.select(
        "gauge_id",
        "name",
        F.coalesce("own_unit", "observed_unit", "forecast_unit").alias("unit"),
        F.struct(*[answered[c].alias(c) for c in ("record", "observed", "forecast")]).alias("sources"),
        "impacts", "crests", "observed", "observed_at", "forecast", "issued_at", "rate", "direction",
        (answered["record"] | answered["observed"] | answered["forecast"]).alias("ok"),
    )


def favorite_ids(raw: Column, most: int = 50) -> Column:
    """Ids of {"ids": [...]} or a bare array: trimmed, upper case, valid, once each, the first ones; junk gives none."""
    ids = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.from_json(raw, "struct<ids:array<string>>")["ids"])
    clean = F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x.rlike("^[A-Z0-9]{3,12}$"))
    return F.slice(F.array_distinct(clean), 1, most)


def favorites_join(favorites: DataFrame, statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """favorites (user_id, pos, gauge_id) with their statuses (gauge_id, name, rank), worst first, then by name, and those without one."""
    known = favorites.join(statuses, "gauge_id")
    w = Window.partitionBy("user_id").orderBy(F.col("rank").desc(), name_sort_key(F.col("name")), "gauge_id")
    return known.withColumn("place", F.row_number().over(w)), favorites.join(statuses.select("gauge_id"), "gauge_id", "left_anti")


def waterway_status(features: DataFrame, statuses: DataFrame) -> DataFrame:
    """features (feature_id, gauge_id) with their gauge's status; shapes are joined last, by feature_id, by the caller."""
    return features.join(statuses, "gauge_id", "left").withColumn("category", F.coalesce("category", F.lit("not_defined")))


def lake_overrides(lakes: DataFrame, overrides: DataFrame) -> DataFrame:
    """lakes (feature_id, name, owner) retagged by name; changed tells which."""
    x = lakes.join(overrides, "name", "left")
    new = F.coalesce("gauge", "owner")
    return x.select("feature_id", "name", new.alias("owner"), (new != F.col("owner")).alias("changed"))


def resolve_gauge_id(x: Column) -> Column:
    return F.when(x.rlike("^[A-Za-z0-9]{5}$"), F.upper(x))


def local_date(t: Column, zone: Column, zones: tuple[str, ...], dates: bool = True) -> Column:
    """The calendar date of a UTC time in its zone; UTC for zones that are not listed.

    dates: midnight itself, to the microsecond, is a date that was stored without a time and stays; without it all times are instants.
    """
    known = F.when(zone.isin(*zones), zone).otherwise("UTC")
    local = F.to_date(F.from_utc_timestamp(t, known))
    return F.when(F.date_trunc("day", t) == t, F.to_date(t)).otherwise(local) if dates else local


def camera_image_url(camera: Column, photo_at: Column, base: str) -> Column:
    return F.concat(F.lit(base + "/"), camera, F.lit("/"), camera, F.lit("___"), F.date_format(photo_at, "yyyy-MM-dd'T'HH-mm-ss'Z'"), F.lit(".jpg"))


#: Fixed value: the one host that photos may come from.
IMAGE_HOST = "usgs-nims-images.s3.amazonaws.com"


def valid_image_url(url: Column, host: str = IMAGE_HOST) -> Column:
    """Whether a URL is that of a camera's photo on the host: a back-reference says that folder and file name the same camera."""
    form = rf"^https://{re.escape(host)}/720/([A-Za-z0-9_]{{3,120}})/\1___\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}-\d{{2}}-\d{{2}}Z\.jpg$"
    return F.coalesce((F.length(url) <= 300) & url.rlike(form), F.lit(False))


def sort_items(items: DataFrame, by: str, partition: list[str], distance: Column | None = None) -> DataFrame:
    """items (rank, name, id, ...) with place: by "status" (worst first) or "distance"; then nearest where distances are known, name, id."""
    near = [distance.asc_nulls_last()] if distance is not None else []
    worst = [F.col("rank").desc()] if by == "status" else []
    w = Window.partitionBy(*partition).orderBy(*worst, *near, name_sort_key(F.col("name")), "id")
    return items.withColumn("place", F.row_number().over(w))


def gauges_near_place(places: DataFrame, gauges: DataFrame, km: float = 40.0) -> DataFrame:
    """nearby_gauges() from each place (id, lat, lon)."""
    return nearby_gauges(places.select("id", "lat", "lon"), gauges, km)


def waterway_zoom_filter(features: DataFrame, zoom: Column, least: int = 8) -> DataFrame:
    """features (kind): lines only from a zoom on, all else always."""
    return features.filter(~F.col("kind").isin("LineString", "MultiLineString") | (zoom >= least))
