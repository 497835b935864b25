"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "almanac", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors can reach: ``spark.checkpoint.dir`` where the cluster sets it.

    Without that setting a local session (tests, a laptop) gets a temporary folder of its own, and
    a cluster gets none: its machines' own folders are no place for shared data.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="almanac-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/") if folder else None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``; it survives the loss of executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
