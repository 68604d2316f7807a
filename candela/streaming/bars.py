"""Bars of a stream of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, price: Column, qty: Column, every: str, ts: str = "ts", late: str = "1 hour", symbol: Column | None = None) -> DataFrame:
    """symbol, bar_ts, open .. volume of each bucket once the watermark has passed it (append mode). Ticks later than
    `late` are left out."""
    src = ticks.withColumns({"_p": price, "_q": qty, "symbol": F.lit("ALL") if symbol is None else symbol}).withWatermark(ts, late)
    agg = src.groupBy("symbol", F.window(ts, every)).agg(F.min_by("_p", ts).alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", ts).alias("close"), F.sum("_q").alias("volume"))
    return agg.select("symbol", F.col("window.start").alias("bar_ts"), "open", "high", "low", "close", "volume")
