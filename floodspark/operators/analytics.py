"""Daily usage: cleaning, rollups, totals and tops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def track_clean(events: DataFrame, most: int = 50) -> DataFrame:
    """Allowed events only, the first of each batch; a gauge id only on gauge_open, cut to 32 characters; app platforms become referrers."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("batch").orderBy("event_id")
    kept = events.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).filter(F.col("type").isin("pageview", "gauge_open"))
    return kept.select(
        "event_id", "type", "visitor", "at",
        F.when(F.col("type") == "gauge_open", F.substring("gauge_id", 1, 32)).alias("gauge_id"),
        F.when(F.col("platform").isin("ios", "android"), F.concat(F.lit("app:"), "platform")).otherwise(F.col("referrer")).alias("referrer"),
    )


def referrer_host(url: Column, own: str | None = None) -> Column:
    """The host of an address in lower case; null for the own host and what is no address."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(host != own, host) if own else host


def visitor_hash(salt: Column, ip: Column, agent: Column) -> Column:
    """16 hex digits; null without a salt."""
    return F.substring(F.sha2(F.concat(salt, F.lit("|"), F.coalesce(ip, F.lit("")), F.lit("|"), F.coalesce(agent, F.lit(""))), 256), 1, 16)


def client_ip(forwarded: Column, real: Column) -> Column:
    first = F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit(""))
    return F.coalesce(first, F.nullif(F.trim(real), F.lit("")), F.lit("unknown"))


def day_aggregate(events: DataFrame) -> DataFrame:
    """day, pageviews, opens, visitors (distinct)."""
    day = F.date_format("at", "yyyy-MM-dd").alias("day")
    return events.groupBy(day).agg(
        F.count_if(F.col("type") == "pageview").alias("pageviews"),
        F.count_if(F.col("type") == "gauge_open").alias("opens"),
        F.count_distinct("visitor").alias("visitors"),
    )


def keyed_counts(events: DataFrame, key: str) -> DataFrame:
    """day, key, n for events that have the key."""
    return events.filter(F.col(key).isNotNull()).groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), key).agg(F.count("*").alias("n"))


def rollup_merge(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored days, but recomputed ones where they exist."""
    return stored.join(live.select("day"), "day", "left_anti").unionByName(live)


def totals(days: DataFrame) -> DataFrame:
    """Sums over days; visitors are sums of daily distinct ones."""
    return days.agg(F.count("*").alias("days"), *[F.sum(c).alias(c) for c in ("pageviews", "opens", "visitors")])


def top(counts: DataFrame, key: str, n: int) -> DataFrame:
    return counts.groupBy(key).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), key).limit(n)


def write_rollup(days: DataFrame, path: str) -> None:
    """Rewrites only the days that are given; raw events are deleted by a retention job of its own."""
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def repair_days(rollup: DataFrame, raw_days: DataFrame) -> DataFrame:
    """rollup and the days recomputed from raw events that were found for them: a recomputed day replaces its row."""
    return rollup.join(raw_days.select("day"), "day", "left_anti").unionByName(raw_days)


def retained_salts(salts: DataFrame, today: Column) -> DataFrame:
    """salts (day, ...) less those of past days, once these are rolled up."""
    return salts.filter(F.col("day") >= today)
