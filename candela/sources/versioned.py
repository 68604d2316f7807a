"""Tables in versions: data by partition, and a manifest that says which folder each partition of a version is in.

A version is there once its manifest is; the manifest is written last. So readers see a whole version, the one they began with, whatever
writers do or fail to do; a writer replaces only the partitions that it has rows for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "value string, folder string"


def _children(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    names = [n for n in _children(spark, f"{path}/manifest") if n.startswith("v")]
    return sorted(int(n[1:]) for n in names if "_SUCCESS" in _children(spark, f"{path}/manifest/{n}"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """Partition values and their folders: as many entries as there are partitions."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {version or ''} at {path}")
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{version or known[-1]}").collect()
    return {r["value"]: r["folder"] for r in rows}


def write_version(df: DataFrame, path: str, partition: str, keep: bool = False) -> int:
    """Write df, whose column `partition` is text without nulls, as the next version, and return its number. With keep, partitions that df has no rows for
    stay as they are in the version before. An error leaves all earlier versions as they were; what it has written belongs to none."""
    spark = df.sparkSession
    known = versions(spark, path)
    number = max([*known, *(int(n[1:]) for n in _children(spark, f"{path}/data") if n[:1] == "v"), 0]) + 1
    folder = f"v{number}"
    df.withColumn("_part", F.col(partition)).write.partitionBy("_part").parquet(f"{path}/data/{folder}")
    entries = manifest(spark, path) if keep and known else {}
    written = {n.split("=", 1)[1] for n in _children(spark, f"{path}/data/{folder}") if n.startswith("_part=")}
    entries |= dict.fromkeys(written, folder)
    spark.createDataFrame(list(entries.items()), MANIFEST).coalesce(1).write.mode("error").parquet(f"{path}/manifest/{folder}")
    return number


def read_version(spark: SparkSession, path: str, schema: str, version: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """A version's rows, the latest one's if none is named; of some partitions only, where `only` lists their values."""
    entries = manifest(spark, path, version)
    wanted = entries if only is None else {v: entries[v] for v in only if v in entries}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{folder}/_part={value}" for value, folder in sorted(wanted.items())])
