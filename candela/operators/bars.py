"""Bars by time buckets (O-10 .. O-14). Buckets are closed left, named by their start, aligned to UTC midnight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OHLC = ["open", "high", "low", "close"]


def _buckets(df: DataFrame, ts: str, every: str) -> DataFrame:
    return df.withColumn("_bucket", F.window(F.col(ts), every)["start"])


def resample_ohlcv(df: DataFrame, every: str, ts: str = "bar_ts", tie: Sequence[str] = ()) -> DataFrame:
    """First open, highest high, lowest low, last close and summed volume of each bucket and symbol. First and last are
    of non-null values; the columns of `tie` order rows of one time. Buckets without rows do not appear."""
    at = F.struct(ts, *tie)
    return (
        _buckets(df, ts, every)
        .groupBy("symbol", "_bucket")
        .agg(
            F.min_by("open", F.when(F.col("open").isNotNull(), at)).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", F.when(F.col("close").isNotNull(), at)).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_bucket", "bar_ts")
    )


def bars_from_ticks(df: DataFrame, price: Column, qty: Column, every: str, ts: str = "ts", symbol: Column | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Bars of trades: one price column is open, high, low and close."""
    ticks = df.select((F.lit("ALL") if symbol is None else symbol).alias("symbol"), F.col(ts).alias("bar_ts"), *[F.col(t) for t in tie], *[price.alias(c) for c in OHLC], qty.alias("volume"))
    return resample_ohlcv(ticks, every, tie=tie)


def drop_empty_bars(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[*OHLC, "volume"])


def multi_timeframe(df: DataFrame, sizes: dict[str, str], tie: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Bars of several sizes from one source. The first size is aggregated from df, the others from its bars when they
    are multiples of it, as first, last, highest, lowest and sum compose: list the smallest size first."""
    names = list(sizes)
    base = drop_empty_bars(resample_ohlcv(df, sizes[names[0]], tie=tie))
    return {names[0]: base} | {n: drop_empty_bars(resample_ohlcv(base, sizes[n])) for n in names[1:]}
