"""Indicators of a stream of bars, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "symbol string, bar_ts timestamp, close double, volume double, ema double, rsi double, obv double"
STATE = "bars long, close double, total double, ema double, up double, down double, obv double"


class _Indicators(StatefulProcessor):
    """Bars wait in a map by time until the watermark has passed them; timers then take them in order of time."""

    def __init__(self, ema: int, rsi: int):
        self.ema, self.rsi = ema, rsi

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.so_far = handle.getValueState("so_far", STATE)
        self.waiting = handle.getMapState("waiting", "ms long", "close double, volume double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            if f.empty:  # and without columns
                continue
            for ms, close, volume in zip(f["ms"], f["close"], f["volume"], strict=True):
                at, bar = (int(ms),), (float(close), float(volume))
                if self.waiting.containsKey(at):
                    bar = max(bar, tuple(self.waiting.getValue(at)))
                else:
                    self.handle.registerTimer(int(ms) + 1)
                self.waiting.updateValue(at, bar)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((at[0], tuple(bar)) for at, bar in self.waiting.iterator() if at[0] < upto)
        out = [(key[0], ms, *self._next(*bar)) for ms, bar in due]
        for ms, _ in due:
            self.waiting.removeKey((ms,))
        if out:
            f = pd.DataFrame(out, columns=["symbol", "bar_ts", "close", "volume", "ema", "rsi", "obv"])
            yield f.assign(bar_ts=pd.to_datetime(f["bar_ts"], unit="ms"))

    def _next(self, close: float, volume: float) -> tuple:
        n, last, total, ema, up, down, obv = self.so_far.get() if self.so_far.exists() else (0, close, 0.0, 0.0, 0.0, 0.0, 0.0)
        move, n = close - last, n + 1
        total += close
        keep = 1 - 2 / (self.ema + 1)
        ema = total / self.ema if n == self.ema else keep * ema + (1 - keep) * close
        fade = 1 - 1 / self.rsi
        up, down = fade * up + max(move, 0.0), fade * down + max(-move, 0.0)
        obv += volume if n == 1 or move > 0 else -volume if move < 0 else 0.0
        self.so_far.update((n, close, total if n < self.ema else 0.0, ema, up, down, obv))
        rsi = 100 * up / (up + down) if n > self.rsi and up + down > 0 else None
        return close, volume, ema if n >= self.ema else None, rsi, obv

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, ema: int = 10, rsi: int = 14, late: str = "1 hour") -> DataFrame:
    """symbol, bar_ts, close, volume, ema, rsi, obv of a stream of bars (symbol, bar_ts, close, volume), each bar once the watermark has passed it.

    The rows are those of indicators.ema, rsi and obv on the bars as a table, however the stream is cut into batches, as long as no bar is later than
    `late`. Bars that are later are left out. Of several rows for one bar that come in time the one with the greatest (close, volume) counts. Rows without
    symbol, time, close or volume are left out. State for each symbol: seven numbers and the bars of the last `late`. The session's
    state store must be RocksDB (spark.sql.streaming.stateStore.providerClass), as Spark's keyed state wants it."""
    if ema < 2 or rsi < 2:
        raise ValueError("lengths must be above 1")
    src = bars.select("symbol", F.col("bar_ts").cast("timestamp").alias("bar_ts"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume")).dropna()
    src = src.withWatermark("bar_ts", late).withColumn("ms", F.unix_millis("bar_ts"))
    return src.groupBy("symbol").transformWithStateInPandas(statefulProcessor=_Indicators(ema, rsi), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
