"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset, it is below the warehouse; in local mode, as in
    tests, below this machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = f"file://{tempfile.gettempdir()}/xylem-checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table: lineage ends there, and scans read only the columns and partitions that a query needs."""
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
