"""Raw usage files by day, their compaction into counts, and the days that both make.

A file's events become counts by kind and key (a page view, a gauge opened, a referrer, a visitor), which add up over files in any order. They
are written together with the name of their file, in tables that count once they are complete. A file that such a table names is
done: it is deleted, and if it is still there, because the job stopped in between, it does not count again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.sources.feeds import track_events

COUNTS = "day string, file string, kind string, key string, n long"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [str(s.getPath()) for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def move_days(spark: SparkSession, landed: str, raw: str) -> None:
    """Folders day=... of a partitioned table to folders of the days' names, as raw files lie."""
    top, fs = _fs(spark, raw)
    fs.mkdirs(top)
    for f in _folders(spark, landed):
        name = f.rpartition("/")[2]
        if name.startswith("day="):
            fs.rename(_fs(spark, f)[0], _fs(spark, f"{raw}/{name.removeprefix('day=')}")[0])


def compacted(spark: SparkSession, store: str) -> DataFrame:
    """COUNTS of all complete tables."""
    whole = [f for f in _folders(spark, store) if _fs(spark, f"{f}/_SUCCESS")[1].exists(_fs(spark, f"{f}/_SUCCESS")[0])]
    return spark.read.schema(COUNTS).parquet(*whole) if whole else spark.createDataFrame([], COUNTS)


def counts(files: DataFrame) -> DataFrame:
    """files (path, body) to COUNTS; the day is the folder that a file lies in."""
    e = track_events(files.withColumn("__file", F.col("path")), "__file")
    kinds = F.array(
        F.struct(F.lit("pageview").alias("kind"), F.when(F.col("type") == "pageview", "").alias("key")),
        F.struct(F.lit("gauge").alias("kind"), F.when(F.col("type") == "gauge_open", F.col("gaugeId")).alias("key")),
        F.struct(F.lit("referrer").alias("kind"), F.col("referrer").alias("key")),
        F.struct(F.lit("visitor").alias("kind"), F.col("visitor").alias("key")),
    )
    x = e.select("day", F.col("__file").alias("file"), F.explode(kinds).alias("k")).select("day", "file", "k.*").filter("key IS NOT NULL")
    return x.groupBy("day", "file", "kind", "key").agg(F.count("*").alias("n"))


def raw_files(spark: SparkSession, raw: str) -> DataFrame:
    schema = "path string, body string"
    p, fs = _fs(spark, raw)
    if not fs.exists(p) or not _folders(spark, raw):
        return spark.createDataFrame([], schema)
    x = spark.read.option("recursiveFileLookup", True).text(raw, wholetext=True)
    return x.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def _new(spark: SparkSession, raw: str, store: str) -> DataFrame:
    """Raw files that no complete table names."""
    return raw_files(spark, raw).join(compacted(spark, store).select(F.col("file").alias("path")).distinct(), "path", "left_anti")


def compact(spark: SparkSession, raw: str, store: str, today: str, delete: bool = True) -> None:
    """Counts the files of days before today and then deletes them. A run that stops anywhere can be run again."""
    past = lambda c: F.regexp_extract(c, r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1) < today
    new = counts(_new(spark, raw, store).filter(past("path")))
    new.write.parquet(f"{store}/part-{uuid.uuid4().hex}")
    if delete:
        done = raw_files(spark, raw).select("path").filter(past("path")).join(compacted(spark, store).select(F.col("file").alias("path")).distinct(), "path", "left_semi")
        for r in done.toLocalIterator():
            path, fs = _fs(spark, r.path)
            fs.delete(path, False)


def day_rows(spark: SparkSession, raw: str, store: str) -> DataFrame:
    """One row for each day, of compacted and raw files together: day, pageviews, visitors (distinct), and maps of opens and referrers."""
    x = compacted(spark, store).unionByName(counts(_new(spark, raw, store)))
    return days_of(x.groupBy("day", "kind", "key").agg(F.sum("n").alias("n")))


def days_of(sums: DataFrame) -> DataFrame:
    """sums (day, kind, key, n; one row a key) to days."""
    one = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))))
    return sums.groupBy("day").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "pageview", F.col("n"))), F.lit(0)).alias("pageviews"), F.count_if(F.col("kind") == "visitor").alias("visitors"), one("gauge").alias("gauge_opens"), one("referrer").alias("referrers")
    )


def merged_map(days: DataFrame, column: str) -> DataFrame:
    """The sums of a column of maps over all days, as one map."""
    each = days.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    return each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(column))


def totals(days: DataFrame) -> DataFrame:
    """One row: the number of days, sums of page views and of daily visitors, and the merged maps."""
    sums = days.agg(F.count("*").alias("days"), F.coalesce(F.sum("pageviews"), F.lit(0)).alias("pageviews"), F.coalesce(F.sum("visitors"), F.lit(0)).alias("visitors"))
    rows = sums
    for c in ("gauge_opens", "referrers"):
        rows = rows.unionByName(merged_map(days, c), allowMissingColumns=True)
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])
