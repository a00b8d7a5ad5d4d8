"""Session and shared-storage helpers used by every part of the engine."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names, else (local tests only) a fresh temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="cloakspark-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared checkpoint folder; survives the loss of any executor, unlike a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """As many partitions as the session shuffles to or has cores, whatever their bytes: for steps that are short on data and long on work."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """The rows with their number, from 0 without gaps, in the order of partitions and within them.

    Rows are counted by partition first (one number a partition comes to the driver). The table is written to the
    checkpoint folder, so that numbers stay the same whenever a partition is read again.
    """
    placed = materialise(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = dict(placed.groupBy("__part").agg(F.max("__at") + 1).collect())
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("__part")] if before else F.lit(0)
    return placed.withColumn(column, (offset + F.col("__at")).cast("long")).drop("__part", "__at")


def widened(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores (few files, large row groups) dealt out to all of them; any other as it is.

    Only for plain scans: it asks for their partitions. A table of many files, as any large one is, isn't shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def local_session(cores: str | int = "*", shuffle: int | None = None) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cloakspark")
        .config("spark.sql.shuffle.partitions", str(shuffle or (os.cpu_count() if cores == "*" else cores)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
