"""Shared helpers: shared-folder scratch tables, block assignment, byte kernels in numpy."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no spark.checkpoint.dir, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. A session on one machine may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_SCRATCH
    return root.rstrip("/")


_made: dict[str, list[str]] = {"paths": [], "tables": []}


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made["paths"].append(path)
    return path


def scratch_table(name: str) -> str:
    """The name of a table whose files stand at a scratch_path."""
    table = f"{name}_{uuid.uuid4().hex}"
    _made["tables"].append(table)
    return table


def stored(df: DataFrame, name: str, *used_up: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and any executor may be lost. Tables of stored() that
    nothing needs any more can be named: they are deleted."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    for table in used_up:
        drop_stored(table)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(df: DataFrame) -> None:
    """Delete a table of stored() that nothing lazy refers to any more."""
    if path := getattr(df, "_scratch", None):
        _delete(df.sparkSession, path)
        _made["paths"].remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables that this process has made. Results that are not written or collected yet need theirs."""
    for table in _made["tables"]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in _made["paths"]:
        _delete(spark, path)
    _made["tables"].clear()
    _made["paths"].clear()


MOST_HOT = 4096  # a key that holds more than this part of a table's rows is hot, so there are no more hot keys than that
LEAST_HOT = 16  # rows


def most_rows(rows: int) -> int:
    """How many of so many rows a key may have that is not hot."""
    return max(LEAST_HOT, rows // MOST_HOT)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None = None) -> DataFrame:
    """left with the columns of right, whose rows are unique by `on`; null where it has none, or the key is null.

    Rows of left with a hot key stay where they are and get their row of right, at most MOST_HOT in all, by a broadcast; so no task
    gathers the rows of a frequent key. The other rows are shuffled, or what Spark prefers. left is read several times: a stored table. hot are the keys
with more than most_rows() of them, where the caller knows them already."""
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    if hot is None:
        counts = left.filter(known).groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
        hot = stored(counts.filter(F.col("__n") > most_rows(left.count())).select(*on), "join-hot")
    few = right.join(F.broadcast(hot), on, "left_semi")
    frequent = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, "left")
    others = left.filter(known).join(F.broadcast(hot), on, "left_anti").join(right, on, "left")
    without = left.filter(~known).withColumns({f.name: F.lit(None).cast(f.dataType) for f in right.schema if f.name not in on})
    return frequent.unionByName(others).unionByName(without)


def text_or_empty(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def id_text(c: str) -> Column:
    """Ids on their way through pandas, where whole numbers beside nulls would become doubles."""
    return F.col(c).cast("long").cast("string").alias(c)


def ids_of(texts) -> pd.api.extensions.ExtensionArray:
    return pd.array([pd.NA if t is None else int(t) for t in texts], dtype="Int64")


def total_bytes(df: DataFrame, text: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0)


def n_blocks(size: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` bytes; grows with the data."""
    return max(least, math.ceil(size / each))


# -- numpy kernels -------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


class PrefixHash:
    """Polynomial hashes of any slices of an array of small integers, modulo 2**64, then mixed."""

    _power: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int = 0x2545F4914F6CDD1D):
        n = len(values)
        power, inverse = self._powers(base, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])
        self.inverse = inverse

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._power.get(base)
        if have is None or len(have[0]) < n + 1:
            m = max(1 << 16, 1 << (n + 1).bit_length())
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(m, b, np.uint64)
                p[0] = 1
                np.cumprod(p, out=p)
                both.append(p)
            have = cls._power[base] = (both[0], both[1])
        return have

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix64(h + (end - start).astype(np.uint64) * _ODD)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of start[i] .. start[i] + count[i] - 1."""
    count = count.astype(np.int64)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start.astype(np.int64) - (ends - count), count)


def batches(texts: list[bytes], limit: int) -> list[tuple[int, int]]:
    """Consecutive groups of texts of about `limit` bytes (one text at least)."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            out.append((lo, i))
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        out.append((lo, len(texts)))
    return out
