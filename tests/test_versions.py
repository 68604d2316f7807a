"""Versioned tables and bars kept up to date."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import align, samples, scan
from candela.operators.bars import bars_from_ticks
from candela.sources import bar_store, versioned

T0 = datetime(2024, 1, 1)


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "day string, x int")
    schema = "day string, x int"
    with pytest.raises(ValueError):
        versioned.read_version(spark, path, schema)
    assert versioned.write_version(rows, path, "day") == 1
    with pytest.raises(Exception, match="stop"):
        versioned.write_version(rows.withColumn("x", F.when(F.col("x") > 2, F.raise_error(F.lit("stop"))).otherwise(7).cast("int")), path, "day")
    assert versioned.versions(spark, path) == [1]
    assert sorted(r["x"] for r in versioned.read_version(spark, path, schema).collect()) == [1, 2, 3]
    third = versioned.write_version(spark.createDataFrame([("b", 9)], schema), path, "day", keep=True)
    assert sorted(r["x"] for r in versioned.read_version(spark, path, schema).collect()) == [1, 2, 9]
    assert sorted(r["x"] for r in versioned.read_version(spark, path, schema, version=1).collect()) == [1, 2, 3]
    assert versioned.manifest(spark, path) == {"a": "v1", "b": f"v{third}"}
    assert [r["x"] for r in versioned.read_version(spark, path, schema, only=["b", "none"]).collect()] == [9]
    versioned.write_version(spark.createDataFrame([("c", 4)], schema), path, "day")
    assert [r["x"] for r in versioned.read_version(spark, path, schema).collect()] == [4]


def test_late_ticks_touch_their_days_only(spark, tmp_path):
    r = np.random.default_rng(7)
    rows = [(T0 + timedelta(minutes=int(r.integers(0, 4 * 1440))), i, None if i % 50 == 0 else float(r.normal()), float(r.integers(1, 5)), "AB"[i % 2]) for i in range(900)]
    schema = "ts timestamp_ntz, k long, p double, q double, s string"
    ticks = spark.createDataFrame(rows, schema)
    path = f"file://{tmp_path}/bars"
    state = lambda df: bar_store.states(df, F.col("p"), F.col("q"), "1 hour", symbol=F.col("s"), tie=["k"])
    late = (F.col("k") % 5 == 0) & (F.to_date("ts") == "2024-01-02")
    assert bar_store.add_ticks(state(ticks.filter(~late)), path) == [f"2024-01-0{d}" for d in range(1, 5)]
    assert bar_store.add_ticks(state(ticks.filter(late)), path) == ["2024-01-02"]
    assert bar_store.add_ticks(state(ticks.limit(0)), path) == []
    folders = versioned.manifest(spark, path)
    assert [folders[f"2024-01-0{d}"] for d in range(1, 5)] == ["v1", "v2", "v1", "v1"]
    want = bars_from_ticks(ticks, F.col("p"), F.col("q"), "1 hour", symbol=F.col("s"), tie=["k"])
    got = bar_store.read_bars(spark, path).select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 100
    assert bar_store.read_bars(spark, path, 1).agg(F.sum("volume")).first()[0] == sum(x[3] for x in rows if not (x[1] % 5 == 0 and x[0].day == 2))


def test_facts_of_symbols_without_a_shuffle_by_symbol(spark, monkeypatch):
    rows = [(s, T0 + timedelta(hours=i), None if i < k else float(i)) for k, (s, n) in enumerate((("A", 40), ("B", 9), ("C", 3), ("D", 2))) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, x double")
    plan = align.bfill(df, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(symbol" not in plan
    want = {(r["symbol"], r["bar_ts"]): r["x"] for r in align.bfill(df, ["x"]).collect()}
    assert len(want) == 54 and want["C", T0] == 2.0 and want["D", T0] is None
    shares = samples.chrono_split(df).groupBy("symbol", "split").count().collect()
    monkeypatch.setattr(scan, "MOST_FACTS", 1)
    monkeypatch.setattr(scan, "MOST_HOT", 4)
    assert {(r["symbol"], r["bar_ts"]): r["x"] for r in align.bfill(df, ["x"]).collect()} == want
    assert sorted(map(str, samples.chrono_split(df).groupBy("symbol", "split").count().collect())) == sorted(map(str, shares))
