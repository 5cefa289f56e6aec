"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if where is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints"
    return where


def shared(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
