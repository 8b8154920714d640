"""Session factory and the shared-folder checkpoint used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "marginalia", cores: str = "*", shuffle_partitions: int = 8, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE on, ANSI left on; local unless a master is named."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("MARGINALIA_MASTER", f"local[{cores}]"))
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("MARGINALIA_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where all runs on this machine and none is named."""
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    target = spark.conf.get("spark.checkpoint.dir", None)
    if not target:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        target = tempfile.mkdtemp(prefix="marginalia-checkpoint-")
    spark.sparkContext.setCheckpointDir(target)
    return target


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def widen(df: DataFrame) -> DataFrame:
    """For inputs with fewer partitions than cores, as a single small file is: spread before costly functions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def apart(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key once, in as many partitions as configured: what follows costs more than its bytes tell the planner."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).dropDuplicates([key])
