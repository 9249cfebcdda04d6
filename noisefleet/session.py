"""Spark session settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# What the operators rely on, in any session:
# - wall-clock columns are TIMESTAMP_NTZ, and the few casts to TIMESTAMP assume UTC;
# - a window or aggregate by (site, slice) must not settle for rows already placed by site alone, which
#   would put a hot site in one task;
# - a join by site splits a hot site even where that costs a later shuffle.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session options the operators rely on. Call it once with your own session."""
    for name, value in REQUIRED.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "noisefleet") -> SparkSession:
    """A session for tests and the bench. On a cluster, pass your own session to the operators."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("NOISEFLEET_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """Where every executor reads and writes: the cluster's ``spark.checkpoint.dir``.

    A cluster without one is refused, for its executors would each write to a disk of their own. One is made
    up only for a session inside one JVM on one machine, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="noisefleet-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from there: columns and filters reach what is read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    For results that several later steps read: without the cut each of them recomputes what came before.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
