"""Sessions and the handling of lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit a single machine; a cluster brings its own.
LOCAL = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cpus: str | int = "*", **extra: str) -> SparkSession:
    """A session on this machine."""
    conf = LOCAL | {"spark.master": f"local[{cpus}]", "spark.app.name": "sparkloom"} | extra
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is unset and all executors are threads of this machine, as in tests, a folder of this process is made and set; on a cluster
    without the setting this raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir() and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir("file://" + os.path.join(tempfile.mkdtemp(prefix="sparkloom-"), "checkpoints"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows read back from a checkpoint in the shared folder, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that run at once, at least one."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores, if the scan alone has fewer partitions than there are; else as they are, without a shuffle."""
    n = parallelism(df.sparkSession)
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(2 * n, *keys) if keys else df.repartition(2 * n)
