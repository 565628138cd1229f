"""Weather-alert messages to events, and events to places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.functions import alerts as C


def with_keys(messages: DataFrame) -> DataFrame:
    """messages with ``v``, the parsed VTEC, and ``key``, the event they tell of."""
    x = messages.withColumn("v", C.parse_vtec(F.col("vtec")))
    return x.withColumn("key", C.event_key(F.col("v"), F.col("cap_id")))


def _opens(now: Column) -> Column:
    v = F.col("v")
    return F.coalesce(
        F.col("event").isin(*C.FLOOD_EVENTS)
        & F.coalesce(F.col("status") == "Actual", F.lit(True))
        & ~F.coalesce(F.col("message_type").isin("Cancel", "Ack", "Error"), F.lit(False))
        & (v.isNull() | ((v["class"] != "T") & ~v["action"].isin("CAN", "UPG")))
        & C.alert_active(F.col("ends"), F.col("expires"), now)
        & F.col("key").isNotNull(),
        F.lit(False),
    )


def _cancels() -> Column:
    v = F.col("v")
    gone = (v["class"] != "T") & ((v["action"] == "CAN") | F.coalesce(F.col("message_type") == "Cancel", F.lit(False)))
    return F.coalesce(v.isNotNull() & gone, F.lit(False))


def with_roles(messages: DataFrame, now: Column) -> DataFrame:
    """messages with v, key, and whether each one opens (or goes on with) its event or cancels it."""
    return with_keys(messages).withColumn("opens", _opens(now)).withColumn("cancels", _cancels())


def alert_filter(messages: DataFrame, now: Column) -> DataFrame:
    """The messages that tell of a flood event in effect, with v, key and level.

    Tests, cancellations, acknowledgements and errors tell of none; UPG replaces an event by another
    product's; what has passed its end (or, without one, its expiry) is over.
    """
    return with_keys(messages).filter(_opens(now)).withColumn("level", C.alert_level(F.col("event"), F.col("catastrophic")))


def cancellations(messages: DataFrame) -> DataFrame:
    """key and time of the last cancellation (CAN, or a Cancel message) of each event, whatever its event is called."""
    return with_keys(messages).filter(_cancels()).groupBy("key").agg(F.max("sent").alias("cancelled"))


def without_cancelled(messages: DataFrame, now: Column) -> DataFrame:
    """alert_filter() less the messages that are not newer than the last cancellation of their event."""
    left = alert_filter(messages, now).join(cancellations(messages), "key", "left")
    return left.filter(F.col("cancelled").isNull() | (F.col("sent") > F.col("cancelled"))).drop("cancelled")


#: What the newest message of an event says of it, where messages have it.
TEXTS = ("headline", "description", "instruction", "sender_name", "damage_threat", "effective", "web")


def merge_events(messages: DataFrame) -> DataFrame:
    """One row for each key: the newest message's event, level and texts, the latest end and expiry, codes and areas, newest message first.

    The shape is the newest one that any of the messages brings. Of messages sent at the same time, the first (least id) is the
    newest. Messages are read once: each is spread over its codes and areas and one row for itself; equal parts of an event meet
    first, with the newest message that names them, and then all of the event.
    """
    texts = [c for c in TEXTS if c in messages.columns]
    areas = F.filter(F.transform(F.split("area_desc", ";"), lambda x: F.btrim(x)), lambda x: x != "")
    part = lambda kind, x: F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("part"), i.alias("i")))
    itself = F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("part"), F.lit(0).alias("i")))
    rows = messages.select("key", "id", "sent", "ends", "expires", "event", "level", *texts, "polys", F.explode(F.concat(itself, part("ugc", F.col("ugc")), part("area", areas))).alias("p"))
    own = lambda c: F.when(F.col("p.kind") == "", F.col(c))
    newest = F.struct("sent", -F.col("id"))
    each = rows.groupBy("key", "p.kind", "p.part").agg(
        F.min(F.struct(-F.unix_micros(F.col("sent").cast("timestamp")), "id", "p.i")).alias("at"),
        F.max_by(F.struct("id", *[own(c).alias(c) for c in ("event", "level", *texts)]), newest).alias("newest"),
        F.max(own("sent")).alias("sent"), F.max(own("expires")).alias("expires"), F.max(own("ends")).alias("ends"), F.count(own("id")).alias("n"),
        F.max_by(own("polys"), F.when(own("polys").isNotNull(), newest)).alias("own_polys"),
    )
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "part")))), lambda x: x["part"])
    one = lambda c: F.first(F.when(F.col("kind") == "", F.col(c)), ignorenulls=True).alias(c)
    out = each.groupBy("key").agg(*map(one, ("newest", "sent", "expires", "ends", "n", "own_polys")), listed("ugc").alias("ugc"), F.array_join(listed("area"), "; ").alias("area_desc"))
    return out.select("key", "newest.*", "sent", "expires", "ends", "n", "own_polys", "ugc", "area_desc")


def state_codes(ugc: Column, state: str = "TX") -> Column:
    return F.filter(ugc, lambda c: c.rlike(f"^{state}[ZC][0-9]{{3}}$"))


def zone_geometry(events: DataFrame, zones: DataFrame, state: str = "TX") -> DataFrame:
    """events (key, ugc, own_polys) with polys: their own shape, else all polygons of the state's zones, or null where any has none."""
    x = events.filter("own_polys IS NULL").select("key", F.posexplode(state_codes(F.col("ugc"), state)).alias("pos", "code")).join(zones, "code", "left")
    polys = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "polys"))), lambda p: p["polys"]))
    whole = F.count("polys") == F.count("*")
    found = x.groupBy("key").agg(F.when(whole, polys).alias("zone_polys"))
    return events.join(found, "key", "left").withColumn("polys", F.coalesce("own_polys", "zone_polys")).drop("zone_polys")


def level_counts(events: DataFrame) -> DataFrame:
    names = events.sparkSession.createDataFrame([(c,) for c in C.LEVELS], "level string")
    return F.broadcast(names).join(events.groupBy("level").agg(F.count("*").alias("n")), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def zone_cache(cached: DataFrame, now: Column) -> DataFrame:
    """cached (code, fetched_at, polys): usable for 7 days, 6 hours where there is no shape; an older shape still serves."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("fetched_at").cast("timestamp"))
    has = F.col("polys").isNotNull()
    fresh = age < F.when(has, 7 * 86400).otherwise(6 * 3600)
    return cached.select("code", fresh.alias("fresh"), (has | fresh).alias("serves"))


def feed_state(reads: DataFrame, stale_s: int = 600, drop_s: int = 6 * 3600) -> DataFrame:
    """reads (id, held, failed, age_s) to id, state, age_s, stale.

    Nothing held is loading, or unavailable once a read has failed; a copy whose age is unknown or over drop_s is unavailable too. Else
    the copy is ready, and stale over stale_s; an age below zero counts as none.
    """
    age = F.when(F.col("age_s").isNotNull(), F.greatest(F.col("age_s"), F.lit(0)))
    state = F.when(~F.col("held"), F.when(F.col("failed"), "unavailable").otherwise("loading")).when(age.isNull() | (age > drop_s), "unavailable").otherwise("ready")
    x = reads.withColumn("state", state)
    ready = F.col("state") == "ready"
    return x.select("id", "state", F.when(ready, age).alias("age_s"), F.when(ready, age > stale_s).alias("stale"))
