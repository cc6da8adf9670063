"""A session with the settings the operators are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Adaptive execution with skew joins, UTC, Arrow exchange; a cluster's own settings win where it has any."""
    b = SparkSession.builder.appName("panelforge")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    given = spark.sparkContext.getConf()
    for name, value in DEFAULTS.items():
        if not given.contains(name):
            spark.conf.set(name, value)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the cluster names, so that plans built on it start there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))  # a local folder in tests alone
    return df.checkpoint()
