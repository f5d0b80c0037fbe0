"""Session defaults, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings for tests and local runs. On a cluster the submitted configuration wins.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("recallspark")
    settings = LOCAL_CONF | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A temporary one is set only where none is set and the master is
    local; on a cluster, where each executor would write to its own disk, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            current = tempfile.mkdtemp(prefix="recallspark-")
            spark.sparkContext.setCheckpointDir(current)
        found = current
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table in the shared folder, under a folder of this application."""
    return f"{shared_dir(spark)}/recallspark-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage by a written table. It is columnar and compressed, and a lost executor doesn't lose it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, which is counted; else as it is, and the join's strategy is left to
    the optimiser. For narrow tables."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def release(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later plan reads. Only paths under this application's scratch folder are taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = f"recallspark-{spark.sparkContext.applicationId}/"
    for path in paths:
        if root not in path:
            raise ValueError(f"not a scratch path of this application: {path}")
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


#: Least seconds between two collections of the driver's garbage, and when the last one was.
GC_EVERY, _COLLECTED = 5.0, 0.0


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no later plan reads, and let the driver clean up the shuffle files
    of plans that are over; both would otherwise stay on disk until the driver happens to collect its garbage. The driver
    collects at most once in GC_EVERY seconds, so that many small steps don't stall on it."""
    for table_ in tables:
        files = table_.inputFiles()
        if files:
            release(table_.sparkSession, files[0].rsplit("/", 1)[0])
    if tables and time.monotonic() - _COLLECTED >= GC_EVERY:
        sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage now, so that the shuffle files of plans that are over go."""
    global _COLLECTED
    _COLLECTED = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def env_sf_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
