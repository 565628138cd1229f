"""Guarded writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshot(rows: DataFrame, path: str) -> None:
    """History by date, then the latest; an empty snapshot is refused and nothing is overwritten."""
    if rows.isEmpty():
        raise ValueError("a snapshot without gauges is not written")
    dated = rows.withColumn("snapshot_date", F.to_date("snapshot_at"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(f"{path}/history")
    rows.write.mode("overwrite").parquet(f"{path}/latest")


def write_places(places: DataFrame, path: str, least: int = 1500) -> None:
    """Most populous first; fewer rows than least are refused."""
    n = places.limit(least).count()
    if n < least:
        raise ValueError(f"only {n} places")
    places.orderBy(F.col("population").desc(), "name").write.mode("overwrite").parquet(path)


def segments_geojson(pieces: DataFrame) -> DataFrame:
    """pieces (feature_id, owner, coords) as GeoJSON features, one text each: a line, or several where coords holds lines, of which one alone is a plain line."""
    point = lambda p: F.array(p["lon"], p["lat"])
    one = lambda line: F.to_json(F.transform(line, point))
    kind, coordinates = F.lit("LineString"), one(F.col("coords"))
    if pieces.schema["coords"].dataType.elementType.typeName() == "array":
        several = F.size("coords") > 1
        kind = F.when(several, "MultiLineString").otherwise(kind)
        coordinates = F.when(several, F.to_json(F.transform("coords", lambda line: F.transform(line, point)))).otherwise(one(F.col("coords")[0]))
    properties = F.to_json(F.struct(F.col("owner").alias("gaugeId"), F.col("feature_id").alias("featureId")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}"))
    return pieces.select(feature.alias("feature"))
