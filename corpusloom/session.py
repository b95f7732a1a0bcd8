"""Sessions, table access and written intermediate tables."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that spark-submit gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK = 500_000  # rows of a task whose memory grows with them


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to tasks of about ``TASK`` of its ``rows``; Spark does not join these tasks up, as it does with others until there are as few as cores."""
    few = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / 10_000))
    return df.repartition(max(1, few, math.ceil(rows / TASK)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Intermediate tables written once to the shared folder.

    ``keep`` cuts a plan: the rows are computed once and survive the loss of executors, and later
    scans read only the columns they need. ``drop`` deletes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # what is written needs its shuffles no more
        was = self.spark.conf.get(freed, "false")
        self.spark.conf.set(freed, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(freed, was)
        if self.n == 1:  # what is left goes when the application ends
            jvm = self.spark.sparkContext._jvm
            root = jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.paths.pop(id(df), None)
            if path:
                jvm = self.spark.sparkContext._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, where it isn't installed there."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = tempfile.mkdtemp(prefix="corpusloom-ship-")  # on the driver only; Spark's file server hands it out
    sc.addPyFile(shutil.make_archive(f"{target}/corpusloom", "zip", package.parent, package.name))
    sc._corpusloom_shipped = True
