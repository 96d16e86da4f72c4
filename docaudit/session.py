"""Session settings and shared scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # small shuffles of costly rows still use all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # nested array expressions resolve one level per pass of the analyzer
    "spark.sql.analyzer.maxIterations": "1000",
    # children hashed on document_id already satisfy (document_id, ...) groupings
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # a look-up of up to so many keys asks every row group for each of them
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder all executors can reach.

    It lies in the folder named by spark.checkpoint.dir, or given to setCheckpointDir; there
    is no other default, as a machine's own folder is out of the other executors' reach.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Cuts the lineage where several later steps need the same costly rows; the written
    table outlives any executor.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
