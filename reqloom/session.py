"""Session helpers: a tuned local session, table loading and a scratch area for written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that tests and ``bench.py`` use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reqloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows on all cores where a table has fewer splits than there are cores (a small file); else as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a temporary one only where that is unset (local runs)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="reqloom-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written intermediate tables in the shared folder: they cut lineage and outlive the loss of an executor.

    ``put`` writes a table and returns it read back; ``drop`` deletes one that is no longer read. What is left
    (tables that a returned, lazy result still reads) goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._quiet)

    def _quiet(self) -> None:
        try:
            _remove(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone
            pass

    def put(self, df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
        """Write and read back; ``by``: a column of few values, each with a folder of its own."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        out = df.write.mode("overwrite").option("compression", "snappy")
        (out.partitionBy(by) if by else out).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def freed(self, df: DataFrame, name: str = "t") -> DataFrame:
        """``put``, and removes the shuffle files that it took; else they stay until the driver's garbage goes."""
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key)
        conf.set(key, "true")
        try:
            return self.put(df, name)
        finally:
            conf.set(key, before)

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            path = getattr(df, "_scratch_path", None)
            if path:
                _remove(self.spark, path)
