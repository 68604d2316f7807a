"""As-of joins and rolling scans against pandas."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from candela.operators import asof, indicators, rolling, windows

T0 = datetime(2024, 1, 1)


def ticks(n, seed, symbols="AB", unit=60):
    r = np.random.default_rng(seed)
    return [(symbols[int(r.integers(0, len(symbols)))], T0 + timedelta(seconds=unit * int(r.integers(0, 5000))), i, float(r.normal()) if r.random() > 0.1 else None) for i in range(n)]


@pytest.mark.parametrize("block", [None, 3600, 10**7])
@pytest.mark.parametrize(("direction", "exact", "tolerance"), [("backward", True, None), ("backward", False, "30 MINUTES"), ("forward", True, "30 MINUTES"), ("forward", False, None)])
def test_as_of_equals_pandas(spark, block, direction, exact, tolerance):
    base, other = ticks(300, 1), ticks(120, 2, "ABC")
    left = spark.createDataFrame([(s, t, k) for s, t, k, _ in base], "symbol string, bar_ts timestamp_ntz, k int").repartition(3)
    right = spark.createDataFrame(other, "symbol string, bar_ts timestamp_ntz, tie int, x double").repartition(3)
    got = {r["k"]: (r["tie"], r["x"], r["when"]) for r in asof.as_of(left, right, ["tie", "x"], tolerance=tolerance, direction=direction, exact=exact, tie=["tie"], matched="when", block=block).collect()}
    want = {}
    for s, t, k, _ in base:
        rows = [o for o in other if o[0] == s and (o[1] < t if direction == "backward" else o[1] > t) or (o[0], o[1]) == (s, t) and exact]
        best = (max if direction == "backward" else min)((o[1] for o in rows), default=None)
        if best is None or tolerance and abs(best - t) > timedelta(minutes=30):
            want[k] = (None, None, None)
        else:
            last = max((o for o in rows if o[1] == best), key=lambda o: o[2])
            want[k] = (last[2], last[3], best)
    assert got == want and len(got) == 300


def test_as_of_keeps_bars_without_a_base_row(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    base = spark.createDataFrame([("A", at(m)) for m in (0, 15, 75, 130, 500)] + [("B", at(0)), (None, at(70)), ("A", None)], "symbol string, bar_ts timestamp_ntz")
    hours = spark.createDataFrame([("A", at(0), 2.0), ("A", at(60), None), (None, at(0), 9.0), ("A", None, 8.0)], "symbol string, bar_ts timestamp_ntz, x double")
    got = {(r["symbol"], r["bar_ts"]): r["x"] for r in asof.align_as_of(base, hours, ["x"], "1 HOUR", "5 HOURS").collect()}
    assert got == {("A", at(0)): None, ("A", at(15)): None, ("A", at(75)): 2.0, ("A", at(130)): None, ("A", at(500)): None, ("B", at(0)): None, (None, at(70)): None, ("A", None): None}
    assert asof.align_as_of(base, hours.limit(0), ["x"], "1 HOUR").filter("x IS NOT NULL").count() == 0
    assert asof.align_as_of(base.limit(0), hours, ["x"], "1 HOUR").count() == 0


def series(spark, n=230, seed=5):
    r = np.random.default_rng(seed)
    rows = [("A", T0 + timedelta(minutes=15 * i), float(r.integers(0, 99)) if r.random() > 0.02 else None, float(r.normal())) for i in range(n)] + [("B", T0 + timedelta(minutes=i), float(i % 7), 1.0) for i in range(11)]
    return spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, x double, y double").repartition(4), rows


SPECS = {"hi": ("x", "max"), "lo": ("x", "min"), "total": ("x", "sum"), "n": ("x", "count"), "mean": ("y", "avg")}


@pytest.mark.parametrize(("first", "last", "rows"), [(-9, 0, 1024), (-1, 0, 4), (-36, 0, 4), (-36, 0, 5), (-99, 0, 7), (1, 20, 1024), (1, 20, 6), (2, 40, 9), (1, 120, 50), (-3, 4, 2), (0, 12, 3), (-20, -2, 5), (-400, 0, 8)])
@pytest.mark.parametrize("partial", [False, True])
def test_rolling_equals_plain_frames(spark, first, last, rows, partial):
    df, plain = series(spark)
    out = rolling.rolling(df, SPECS, first, last, partial, rows).collect()
    got = {(r["symbol"], r["bar_ts"]): [r[c] for c in SPECS] for r in out}
    assert len(out) == len(plain) and list(out[0].asDict()) == ["symbol", "bar_ts", "x", "y", *SPECS]
    size = last - first + 1
    for s in "AB":
        own = [p for p in plain if p[0] == s]
        for i, p in enumerate(own):
            frame = own[max(0, i + first) : max(0, i + last + 1)]
            x, y = [f[2] for f in frame if f[2] is not None], [f[3] for f in frame]
            have = got[s, p[1]]
            if partial:
                want = [max(x, default=None), min(x, default=None), sum(x) if x else None, len(x), np.mean(y) if y else None]
            else:
                want = [max(x), min(x), sum(x), size] if len(x) == size else [None] * 4
                want.append(np.mean(y) if len(y) == size else None)
            assert have == pytest.approx(want, nan_ok=False) if None not in want and None not in have else [a is None for a in have] == [b is None for b in want]


def test_rolling_range_and_errors(spark):
    df, plain = series(spark)
    x = pd.Series([p[2] for p in plain if p[0] == "A"])
    want = x.rolling(24).max() - x.rolling(24).min()
    got = [r["r"] for r in rolling.rolling_range(df.filter("symbol = 'A'"), "x", 24, "r").orderBy("bar_ts").collect()]
    assert [None if np.isnan(w) else w for w in want] == got
    with pytest.raises(ValueError):
        rolling.rolling(df, SPECS, 0, 0)
    with pytest.raises(ValueError):
        rolling.rolling(df, {"a": ("x", "median")}, -3, 0)
    assert rolling.rolling(df.limit(0), SPECS, -3, 0).count() == 0


def test_rolling_work_does_not_depend_on_the_frame(spark):
    df, _ = series(spark)
    plans = [rolling.rolling_range(df, "x", size, "r")._jdf.queryExecution().executedPlan().toString() for size in (10, 1000)]
    assert plans[0].count("Window") == plans[1].count("Window") and "collect_list" not in "".join(plans)


@pytest.mark.parametrize("rows", [16, 8192])
def test_a_users_function_of_windows(spark, rows, monkeypatch):
    df, plain = series(spark)
    if rows == 16:
        monkeypatch.setattr(windows, "CHUNK_VALUES", 40)
    got = windows.rolling_udf(df, "x", 9, lambda w: np.median(w, axis=1), "m", rows=rows).collect()
    assert len(got) == len(plain) and list(got[0].asDict()) == ["symbol", "bar_ts", "x", "y", "m"]
    by = {(r["symbol"], r["bar_ts"]): r["m"] for r in got}
    for s in "AB":
        own = [p for p in plain if p[0] == s]
        want = pd.Series([p[2] for p in own], dtype=float).rolling(9).median()
        assert [by[s, p[1]] for p in own] == [None if np.isnan(w) else w for w in want]
    two = windows.rolling_udf(df, ["x", "y"], 4, lambda w: (w[:, :, 0] * w[:, :, 1]).sum(1) > 0, "up", "int", rows).filter("symbol = 'A'").orderBy("bar_ts").collect()
    own = [p for p in plain if p[0] == "A"]
    want = [None if i < 3 or any(p[2] is None for p in own[i - 3 : i + 1]) else int(sum(p[2] * p[3] for p in own[i - 3 : i + 1]) > 0) for i in range(len(own))]
    assert [r["up"] for r in two] == want
    assert windows.rolling_udf(df.limit(0), "x", 4, lambda w: w[:, 0], "m").count() == 0


def plain_garch(w, a, b):
    e = (w - w.mean()) ** 2
    s2 = h = e.mean()
    good = 0.0
    for x in e:
        good -= 0.5 * (np.log(h) + x / h)
        h = s2 * (1 - a - b) + a * x + b * h
    return good, np.sqrt(h)


def test_volatility_on_the_grid_and_finer(spark):
    r = np.random.default_rng(9)
    h, x = 1.0, []
    for _ in range(150):
        x.append(float(r.normal() * np.sqrt(h)))
        h = 0.1 + 0.13 * x[-1] ** 2 + 0.78 * h
    x[70] = None
    df = spark.createDataFrame([("A", T0 + timedelta(hours=i), v if v is None else v / 100) for i, v in enumerate(x)], "symbol string, bar_ts timestamp_ntz, r double")
    grid = indicators.garch_grid()
    on, fine = ([q["v"] for q in indicators.conditional_volatility(df, "r", "v", 60, 50, levels=n).orderBy("bar_ts").collect()] for n in (0, 12))
    gains = []
    for i in range(len(x)):
        w = x[max(0, i - 59) : i + 1]
        if len(w) < 60 or None in w:
            assert on[i] is None and fine[i] is None
            continue
        w = np.array(w)
        best = max((plain_garch(w, a, b) for a, b in grid), key=lambda g: g[0])
        assert on[i] == pytest.approx(best[1], rel=1e-9)
        if i % 10 == 0:  # a dense search around, in the same region
            dense = max((plain_garch(w, a, b) for a in np.linspace(1e-4, 0.4, 41) for b in np.linspace(1e-4, 0.998, 51) if a + b < 0.999), key=lambda g: g[0])
            a, b = refined(w, grid)
            assert fine[i] == pytest.approx(plain_garch(w, a, b)[1], rel=1e-9)
            gains.append((best[0], plain_garch(w, a, b)[0], dense[0]))
    assert all(f >= g for g, f, _ in gains) and sum(f > g + 1e-6 for g, f, _ in gains) > len(gains) / 2
    assert np.mean([d - f for _, f, d in gains]) < 0.5 * np.mean([d - g for g, _, d in gains])


def refined(w, grid, levels=12):
    a, b = max(grid, key=lambda p: plain_garch(w, *p)[0])
    da, db = (max(np.diff(sorted({p[k] for p in grid}))) / 2 for k in (0, 1))
    for _ in range(levels):
        near = [(a, b)] + [(max(1e-4, a + i * da), max(1e-4, b + j * db)) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
        was, (a, b) = (a, b), max((p for p in near if sum(p) < 0.999), key=lambda p: plain_garch(w, *p)[0])
        if was == (a, b):
            da, db = da / 2, db / 2
    return a, b


def test_still_windows_have_no_volatility(spark):
    df = spark.createDataFrame([("A", T0 + timedelta(hours=i), 0.0) for i in range(60)], "symbol string, bar_ts timestamp_ntz, r double")
    assert indicators.conditional_volatility(df, "r", "v", 50, 50).filter("v IS NOT NULL").count() == 0
