"""Bars kept up to date: stored states that merge, so late ticks touch only the days that they fall on (O-14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.sources.scratch import materialized
from candela.sources.versioned import read_version, versions, write_version

STATE = "symbol string, bar_ts timestamp_ntz, day string, first_ts timestamp_ntz, first_tie array<string>, open double, high double, low double, last_ts timestamp_ntz, last_tie array<string>, close double, volume double, ticks long"


def states(df: DataFrame, price: Column, qty: Column, every: str, ts: str = "ts", symbol: Column | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Mergeable bars of ticks: besides prices and volume the times and ties of the ticks that opened and closed them. Ticks without time are left out;
    those without price count for the volume only. Ties are compared as numbers where they are whole and not negative, else as text."""
    ties = F.array(*[F.lpad(F.col(t).cast("string"), 20, "0") if df.schema[t].dataType.typeName() in ("long", "integer", "short", "byte") else F.col(t).cast("string") for t in tie]).cast("array<string>")
    rows = df.filter(F.col(ts).isNotNull()).select((F.lit("ALL") if symbol is None else symbol).alias("symbol"), F.col(ts).cast("timestamp_ntz").alias("ts"), ties.alias("tie"), price.cast("double").alias("p"), qty.cast("double").alias("q"))
    at = F.when(F.col("p").isNotNull(), F.struct("ts", "tie"))
    grouped = rows.groupBy("symbol", F.window("ts", every)["start"].alias("bar_ts")).agg(
        F.min(at).alias("first"), F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max(at).alias("last"), F.max_by("p", at).alias("close"), F.sum("q").alias("volume"), F.count(F.lit(1)).alias("ticks"),
    )
    return _shaped(grouped)


def merge(parts: DataFrame) -> DataFrame:
    """One state for each bar, of any number of states of it."""
    first, last = (F.when(F.col(f"{k}_ts").isNotNull(), F.struct(f"{k}_ts", f"{k}_tie")) for k in ("first", "last"))
    grouped = parts.groupBy("symbol", "bar_ts").agg(
        F.min(first).alias("first"), F.min_by("open", first).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max(last).alias("last"), F.max_by("close", last).alias("close"), F.sum("volume").alias("volume"), F.sum("ticks").alias("ticks"),
    )
    names = {"first": ("first_ts", "first_tie"), "last": ("last_ts", "last_tie")}
    return _shaped(grouped.withColumns({k: F.when(F.col(k).isNotNull(), F.struct(F.col(k)[a].alias("ts"), F.col(k)[b].alias("tie"))) for k, (a, b) in names.items()}))


def _shaped(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "symbol", "bar_ts", F.date_format("bar_ts", "yyyy-MM-dd").alias("day"), F.col("first.ts").alias("first_ts"), F.col("first.tie").alias("first_tie"), "open", "high", "low",
        F.col("last.ts").alias("last_ts"), F.col("last.tie").alias("last_tie"), "close", "volume", "ticks",
    )


def add_ticks(new: DataFrame, path: str) -> list[str]:
    """Merge states() of new ticks into the store at path (made if there is none) as its next version; the days that were written. Only these are read and
    rewritten. Each tick must be added once; the order in which ticks come does not matter."""
    spark = new.sparkSession
    fresh = materialized(new, "states")
    days = sorted(r["day"] for r in fresh.select("day").distinct().collect())
    if not days:
        return []
    old = read_version(spark, path, STATE, only=days) if versions(spark, path) else spark.createDataFrame([], STATE)
    write_version(merge(old.unionByName(fresh)).repartition("day", F.pmod(F.xxhash64("symbol", "bar_ts"), F.lit(8))), path, "day", keep=True)
    return days


def read_bars(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """symbol, bar_ts, open .. volume of a version of the store."""
    return read_version(spark, path, STATE, version).select("symbol", "bar_ts", "open", "high", "low", "close", "volume")
