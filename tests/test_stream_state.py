"""Indicators of a stream against the same indicators of a table."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import indicators, scan
from candela.streaming.indicators import stream_indicators

T0 = datetime(2024, 1, 1)
SCHEMA = "symbol string, bar_ts timestamp, close double, volume double"


@pytest.fixture(scope="module")
def bars():
    r = np.random.default_rng(11)
    out = []
    for s, n in (("A", 60), ("B", 25), ("C", 3)):
        close = np.round(100 + np.cumsum(r.integers(-2, 3, n)), 2)
        at = T0
        for c in close:
            at += timedelta(minutes=15 * int(r.integers(1, 3)))
            out.append((s, at, float(c), float(r.integers(0, 9))))
    return out


def run(spark, tmp_path, batches, name):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}/{k:03}")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/{name}")
    query = stream_indicators(src, 10, 14, "3 hours").writeStream.outputMode("append").format("memory").queryName(name)
    q = query.option("checkpointLocation", f"file://{tmp_path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r["symbol"], r["bar_ts"], *[None if r[c] is None else round(r[c], 9) for c in ("close", "volume", "ema", "rsi", "obv")]) for r in spark.table(name).collect())


def want(spark, rows):
    df = scan.indexed(spark.createDataFrame(rows, SCHEMA).withColumns({"high": F.col("close"), "low": F.col("close")}))
    out = indicators.obv(indicators.rsi(indicators.ema(df, "close", 10, "ema"), 14, "rsi"), "obv").collect()
    return sorted((r["symbol"], r["bar_ts"], *[None if r[c] is None else round(r[c], 9) for c in ("close", "volume", "ema", "rsi", "obv")]) for r in out)


def test_any_cut_equals_the_table(spark, tmp_path, bars):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    end = [("Z", datetime(2024, 3, 1), 1.0, 1.0)]  # moves the watermark past all bars, and waits itself
    r = np.random.default_rng(3)
    ordered = sorted(bars, key=lambda b: b[1])
    jittered = sorted(bars, key=lambda b: b[1] + timedelta(minutes=float(r.uniform(0, 150))))  # out of order, but in time
    twice = [*jittered[:20], *[(s, t, c - 1, v) for s, t, c, v in jittered[:20]], *jittered[20:]]
    expected = want(spark, bars)
    assert len(expected) == 88 and any(e[5] is not None for e in expected)
    for name, rows, size in (("one", ordered, 1000), ("few", jittered, 30), ("many", twice, 13)):
        batches = [rows[k : k + size] for k in range(0, len(rows), size)] + [end]
        assert run(spark, tmp_path, batches, name) == expected
    missing = [(None, T0, 1.0, 1.0), ("A", T0, None, 1.0)]
    late = [("A", T0 - timedelta(days=3), 9.0, 9.0)]
    assert run(spark, tmp_path, [ordered + missing, end, late, [("Z", datetime(2024, 3, 2), 1.0, 1.0)]], "late")[:88] == expected
