"""Written intermediate tables: they cut long lineages and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no spark.checkpoint.dir.
LOCAL_SCRATCH = "file:///tmp/checkpoints"
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder all executors share, spark.checkpoint.dir. A session on one machine may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_SCRATCH
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialized(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet into the folder all executors share, and read again. Runs the job at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this process has written there. Results that are not written or collected yet need theirs."""
    for path in _made:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.clear()
