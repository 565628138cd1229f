"""Tables that jobs keep between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where Spark runs inside one machine's process."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if top:
        return top
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


class Kept:
    """Parquet tables under a folder of their own: a lost executor costs the round since the last one. Keeping a name again drops its table before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}", 0
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        old = self.paths.pop(name, None)
        if old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
