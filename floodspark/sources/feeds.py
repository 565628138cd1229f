"""Readers of landed feed files. Schemas are explicit; absent fields become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.functions.alerts import UGC, office_link, parse_vtec
from floodspark.operators.rivers import clean_polygons

_POINT = "struct<primary:double,primaryUnit:string,secondary:double,secondaryUnit:string,floodCategory:string,validTime:string>"
GAUGE = (
    "struct<lid:string,name:string,state:struct<abbreviation:string,name:string>,latitude:double,longitude:double,"
    f"flood:struct<stageUnits:string>,ObservedFloodCategory:string,status:struct<observed:{_POINT},forecast:{_POINT}>>"
)
SITE_VALUES = (
    "struct<value:struct<timeSeries:array<struct<sourceInfo:struct<siteCode:array<struct<value:string>>>,"
    "values:array<struct<value:array<struct<dateTime:string,value:string>>>>>>>>"
)
SERIES = "struct<issuedTime:string,primaryUnits:string,data:array<struct<validTime:string,generatedTime:string,primary:double,secondary:double>>>"
_SHAPE = "type:string,coordinates:string"
#: A collection of shapes may hold another; its members' coordinates stay text until their kind is known.
_SHAPES = f"struct<{_SHAPE},geometries:array<struct<{_SHAPE},geometries:array<struct<{_SHAPE}>>>>>"
ALERTS = (
    f"struct<type:string,features:array<struct<id:string,geometry:{_SHAPES},properties:struct<id:string,areaDesc:string,"
    "geocode:struct<UGC:array<string>>,affectedZones:array<string>,sent:string,effective:string,onset:string,expires:string,ends:string,status:string,messageType:string,"
    "event:string,sender:string,senderName:string,headline:string,description:string,instruction:string,"
    "parameters:struct<VTEC:array<string>,NWSheadline:array<string>,flashFloodDamageThreat:array<string>>>>>>"
)
CAMERA = "struct<camId:string,nwisId:string,camName:string,lat:string,lng:string,stateAbrv:string,tz:string,newestImageDT:string,hideCam:boolean>"
TRACK = "struct<type:string,gaugeId:string,referrer:string,visitor:string,at:string>"
LINES = "struct<features:array<struct<properties:struct<gaugeId:string,name:string,ftype:int,nhdId:string>,geometry:struct<type:string,coordinates:string>>>>"


# Shapes of JSON bodies


def _type(v: Column, path: str) -> Column:
    """The kind of what lies under a path of a variant, as Spark names it; null where nothing does."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_alerts_response(v: Column) -> Column:
    """Whether a body (variant) is a stored answer with alerts: a list of alerts with id, event and codes, a time or null, and a flag."""
    alert = lambda a: F.coalesce((_type(a, "$.id") == "STRING") & (_type(a, "$.event") == "STRING") & _type(a, "$.ugc").startswith("ARRAY"), F.lit(False))
    each = F.forall(F.try_variant_get(v, "$.alerts", "array<variant>"), alert)
    return F.coalesce(_type(v, "$.alerts").startswith("ARRAY") & _type(v, "$.updatedAt").isin("STRING", "VOID") & (_type(v, "$.ok") == "BOOLEAN") & each, F.lit(False))


def is_processed(v: Column) -> Column:
    """Whether a body is a processed snapshot: gauges that are no list, and the time of it as text."""
    gauges = _type(v, "$.gauges")
    return F.coalesce(gauges.startswith("OBJECT") & (_type(v, "$.updatedAt") == "STRING"), F.lit(False))


def is_gauge_list(v: Column) -> Column:
    """Whether a body is a raw list of gauges, bare or under its key."""
    return F.coalesce(_type(v, "$").startswith("ARRAY") | _type(v, "$.gauges").startswith("ARRAY"), F.lit(False))


def body_kinds(files: DataFrame) -> DataFrame:
    """files (body, ...) with kind: alerts, processed or list, or null with the reason: no JSON, or JSON of another shape. Each body is parsed once."""
    x = files.withColumn("__v", F.try_parse_json("body"))
    v = F.col("__v")
    kind = F.when(is_alerts_response(v), "alerts").when(is_processed(v), "processed").when(is_gauge_list(v), "list")
    return x.withColumn("kind", kind).withColumn("reason", F.when(v.isNull(), "no JSON").when(F.col("kind").isNull(), "another shape")).drop("__v")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path and body."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def _list(body: Column, kind: str, key: str | None = None) -> Column:
    """A JSON array, or the array that an object holds under key."""
    plain = F.from_json(body, f"array<{kind}>")
    if not key:
        return plain
    held = F.from_json(body, f"struct<{key}:array<{kind}>>")[key]
    return F.when(F.ltrim(body).startswith("["), plain).otherwise(held)


#: An ISO date and time, seconds and fractions if given, and an offset.
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def time_of(text: Column) -> Column:
    """An ISO time with its offset, as UTC without zone; null before 1970 and for what is no time, or one of another form."""
    whole = F.regexp_replace(text, r"(T\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    t = F.when(text.rlike(_ISO), F.try_to_timestamp(whole))
    return F.when(F.unix_millis(t) > 0, F.to_timestamp_ntz(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS")))


def gauge_feed(files: DataFrame, state: str = "TX") -> DataFrame:
    """files (body) to gauge_id, pos, name, lat, lon, v, unit, category, t, forecast of the state's gauges with an id."""
    x = files.select(F.posexplode(_list(F.col("body"), GAUGE, "gauges")).alias("pos", "g"))
    o = F.col("g.status.observed")
    return x.filter(F.col("g.lid").isNotNull() & (F.col("g.state.abbreviation") == state)).select(
        F.col("g.lid").alias("gauge_id"), "pos", "g.name", F.col("g.latitude").alias("lat"), F.col("g.longitude").alias("lon"),
        o["primary"].alias("v"), F.coalesce(F.nullif(F.trim(o["primaryUnit"]), F.lit("")), F.nullif(F.trim("g.flood.stageUnits"), F.lit(""))).alias("feed_unit"),
        F.coalesce(o["floodCategory"], F.col("g.ObservedFloodCategory")).alias("feed_category"), time_of(o["validTime"]).alias("t"), F.col("g.status.forecast").alias("forecast"),
    )


def site_values(files: DataFrame) -> DataFrame:
    """site, pos, t, v; values that are no numbers become null."""
    series = F.explode(F.from_json("body", SITE_VALUES)["value"]["timeSeries"])
    x = files.select(series.alias("s"))
    x = x.select(F.col("s.sourceInfo.siteCode")[0]["value"].alias("site"), F.posexplode(F.col("s.values")[0]["value"]).alias("pos", "p"))
    return x.select("site", "pos", time_of(F.col("p.dateTime")).alias("t"), F.col("p.value").try_cast("double").alias("v"))


def series(files: DataFrame) -> DataFrame:
    """files (gauge_id, body) to gauge_id, pos, t, v, issued_at, unit."""
    x = files.withColumn("s", F.from_json("body", SERIES))
    return x.select("gauge_id", F.posexplode("s.data").alias("pos", "p"), time_of(F.col("s.issuedTime")).alias("issued_at"), F.col("s.primaryUnits").alias("unit")).select(
        "gauge_id", "pos", time_of(F.col("p.validTime")).alias("t"), F.col("p.primary").alias("v"), "issued_at", "unit"
    )


def alert_feed(files: DataFrame) -> DataFrame:
    """One row for each feature; a body without features is an error, not a feed without alerts."""
    x = files.withColumn("a", F.from_json("body", ALERTS))
    kind = ALERTS.removeprefix("struct<type:string,features:").removesuffix(">")
    features = F.coalesce("a.features", F.raise_error(F.lit("an alert feed without features")).cast(kind))
    number = [F.col("number")] if "number" in files.columns else []
    return x.select(*number, F.posexplode(features).alias("pos", "f")).select(*number, "pos", F.col("f.id").alias("feature_id"), "f.geometry", "f.properties")


def _said(x: Column) -> Column:
    """A text that is not blank."""
    return F.when(F.trim(x) != "", x)


def alert_messages(feed: DataFrame, now: Column) -> DataFrame:
    """alert_feed() to the messages that operators.alerts takes.

    id counts features in the order of the feed (of bodies by their number, where files have one). VTEC is the first text of the list that is
    VTEC. A message without a time of sending has that of its effect, or now. Codes are the given ones, or else the tails of zone addresses;
    the threat that makes an emergency is the first one given, in capitals. The shape is that of all usable polygons, or null.
    """
    p = F.col("properties")
    list_ = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    vtec = F.get(F.filter(list_(p["parameters"]["VTEC"]), lambda v: parse_vtec(v).isNotNull()), F.lit(0))
    threat = F.upper(F.get(F.filter(list_(p["parameters"]["flashFloodDamageThreat"]), lambda v: v.isNotNull()), F.lit(0)))
    polys = polygons_of(F.col("geometry"))
    given = F.filter(list_(p["geocode"]["UGC"]), lambda c: c.isNotNull())
    tails = F.filter(F.transform(list_(p["affectedZones"]), lambda z: F.element_at(F.split(z, "/"), -1)), lambda c: c.rlike(UGC))
    number = F.col("number").cast("long") if "number" in feed.columns else F.lit(0).cast("long")
    return feed.select(
        (number * (1 << 32) + F.col("pos")).alias("id"), F.coalesce(_said(p["id"]), _said(F.col("feature_id"))).alias("cap_id"), vtec.alias("vtec"),
        _said(p["event"]).alias("event"), _said(p["status"]).alias("status"), _said(p["messageType"]).alias("message_type"),
        F.coalesce(time_of(p["sent"]), time_of(p["effective"]), now).alias("sent"), time_of(p["ends"]).alias("ends"), time_of(p["expires"]).alias("expires"),
        F.array_distinct(F.when(F.size(given) > 0, given).otherwise(tails)).alias("ugc"), F.coalesce(_said(p["areaDesc"]), F.lit("")).alias("area_desc"),
        F.when(F.size(polys) > 0, polys).alias("polys"), F.coalesce(threat == "CATASTROPHIC", F.lit(False)).alias("catastrophic"), threat.alias("damage_threat"),
        F.coalesce(_said(p["headline"]), F.get(p["parameters"]["NWSheadline"], F.lit(0))).alias("headline"), F.coalesce(_said(p["description"]), F.lit("")).alias("description"),
        _said(p["instruction"]).alias("instruction"), F.coalesce(_said(p["senderName"]), _said(p["sender"]), F.lit("National Weather Service")).alias("sender_name"),
        time_of(p["effective"]).alias("effective"), office_link(parse_vtec(vtec)["office"]).alias("web"),
    )


def peaks(files: DataFrame) -> DataFrame:
    """files (site, body) of tab-separated text to site, pos, date, stage; columns are found by name, the format row is dropped."""
    lines = F.filter(F.split("body", "\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    x = files.select("site", lines.alias("lines")).withColumn("head", F.split(F.col("lines")[0], "\t"))
    rows = x.select("site", "head", F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("pos", "line")).withColumn("cells", F.split("line", "\t"))
    cell = lambda name: F.get("cells", F.array_position("head", F.lit(name)).cast("int") - 1)
    kept = rows.filter(~F.col("cells")[0].rlike(r"^\d+[A-Za-z]$"))
    return kept.select("site", "pos", cell("peak_dt").alias("date"), cell("gage_ht").try_cast("double").alias("stage"))


def cameras(files: DataFrame) -> DataFrame:
    """id, site (8 to 15 digits or null), name, lat, lon, state, hidden, photo_at."""
    x = files.select(F.explode(_list(F.col("body"), CAMERA)).alias("c"))
    return x.select(
        F.col("c.camId").alias("id"), F.when(F.col("c.nwisId").rlike(r"^\d{8,15}$"), F.col("c.nwisId")).alias("site"), F.col("c.camName").alias("name"),
        F.col("c.lat").try_cast("double").alias("lat"), F.col("c.lng").try_cast("double").alias("lon"), F.col("c.stateAbrv").alias("state"),
        F.coalesce("c.hideCam", F.lit(False)).alias("hidden"), time_of(F.col("c.newestImageDT")).alias("photo_at"),
    )


def overrides(files: DataFrame) -> DataFrame:
    """name and gauge of {"byName": {name: gauge}}."""
    return files.select(F.explode(F.from_json("body", "struct<byName:map<string,string>>")["byName"]).alias("name", "gauge"))


def track_events(files: DataFrame, *more: str) -> DataFrame:
    """Events of files that hold one event or an array of them, with their day from the path, and more columns of their file."""
    one = F.array(F.from_json("body", TRACK))
    many = F.from_json("body", f"array<{TRACK}>")
    day = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/", 1)
    return files.select(day.alias("day"), *more, F.explode(F.when(F.ltrim("body").startswith("["), many).otherwise(one)).alias("e")).select("day", *more, "e.*")


def waterways(files: DataFrame) -> DataFrame:
    """part_id, feature, part, properties and coords (array of lon, lat) of lines and polygon rings."""
    x = files.select(F.posexplode(F.from_json("body", LINES)["features"]).alias("feature", "f"))
    c, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    line = F.array(F.from_json(c, "array<array<double>>"))
    lines = F.from_json(c, "array<array<array<double>>>")
    polys = F.flatten(F.from_json(c, "array<array<array<array<double>>>>"))
    parts = F.when(kind == "LineString", line).when(kind.isin("MultiLineString", "Polygon"), lines).when(kind == "MultiPolygon", polys)
    y = x.select("feature", F.col("f.properties").alias("properties"), kind.alias("kind"), F.posexplode(parts).alias("part", "p"))
    return y.select("feature", "part", "kind", "properties", F.transform("p", lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat"))).alias("coords"))


def gazetteer(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """id, name, lat, lon of a padded, delimited place table."""
    schema = "GEOID string, NAME string, INTPTLAT string, INTPTLONG string"
    raw = spark.read.schema(schema).csv(path, sep=sep, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select(F.col("GEOID").alias("id"), F.col("NAME").alias("name"), F.col("INTPTLAT").try_cast("double").alias("lat"), F.col("INTPTLONG").try_cast("double").alias("lon"))


ZONE = f"struct<properties:struct<id:string>,geometry:{_SHAPES}>"


def _polygons(kind: Column, coordinates: Column) -> Column:
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.coalesce(F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many), F.array().cast("array<array<array<array<double>>>>"))


def polygons_of(geometry: Column) -> Column:
    """All usable polygons of a shape: of polygons, of many, or of collections two deep; other kinds have none."""
    flat = lambda g: _polygons(g["type"], g["coordinates"])
    members = F.coalesce(geometry["geometries"], F.array().cast(f"array<struct<{_SHAPE},geometries:array<struct<{_SHAPE}>>>>"))
    second = F.flatten(F.transform(members, lambda g: F.concat(flat(g), F.flatten(F.transform(F.coalesce(g["geometries"], F.array().cast(f"array<struct<{_SHAPE}>>")), flat)))))
    return clean_polygons(F.concat(flat(geometry), second))


def zones(files: DataFrame) -> DataFrame:
    """Zone features, one a file or in collections: code and polys, null where the zone has no usable shape."""
    one = F.from_json("body", ZONE)
    many = F.from_json("body", f"struct<features:array<{ZONE}>>")["features"]
    x = files.select(F.explode(F.coalesce(many, F.array(one))).alias("f")).filter("f.properties.id IS NOT NULL")
    polys = polygons_of(F.col("f.geometry"))
    return x.select(F.col("f.properties.id").alias("code"), F.when(F.size(polys) > 0, polys).alias("polys"))


def slim_list(feed: DataFrame) -> DataFrame:
    """gauge_feed() to the list that other jobs start from: lid, name, latitude, longitude; an empty list is an error."""
    slim = feed.select(F.col("gauge_id").alias("lid"), "name", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    if slim.isEmpty():
        raise ValueError("a list without gauges is not written")
    return slim
