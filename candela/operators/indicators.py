"""Technical indicators over ordered bars (O-20 .. O-35).

Inputs have symbol, bar_ts, open .. volume and, for smoothing, a row number _i (scan.indexed adds it). Formulas are
the public definitions; `seed` says how smoothing begins, since libraries differ in their first values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.columns import log_of_ratio, ratio
from candela.operators.scan import Smooth, ema_of, frame_window, framed, indexed, running, smooth, wilder_of
from candela.operators.windows import garch_forecast, rolling_udf


def _numbered(df: DataFrame) -> DataFrame:
    return df if "_i" in df.columns else indexed(df)


def lagged(df: DataFrame, cols: dict[str, Column], k: int = 1) -> DataFrame:
    """Adds columns that look k rows back: expressions over frame_window()."""
    return framed(_numbered(df), cols, before=k)


def ema(df: DataFrame, x: str, n: int, out: str, seed: str = "sma") -> DataFrame:
    return smooth(_numbered(df), [ema_of(out, F.col(x), n, seed)])


def wilder(df: DataFrame, x: str, n: int, out: str, seed: str = "ewm", skip: int = 0) -> DataFrame:
    return smooth(_numbered(df), [wilder_of(out, F.col(x), n, seed, skip)])


def rsi_parts(d: str, n: int, seed: str = "ewm") -> list[Smooth]:
    """Smoothed gains _up and losses _down of the moves in column d, whose first value is null."""
    gain, loss = F.greatest(F.col(d), F.lit(0.0)), F.greatest(-F.col(d), F.lit(0.0))
    return [wilder_of("_up", F.when(F.col(d).isNotNull(), gain), n, seed, 1, d), wilder_of("_down", F.when(F.col(d).isNotNull(), loss), n, seed, 1, d)]


def rsi_of_parts() -> Column:
    return 100 * ratio(F.col("_up"), F.col("_up") + F.col("_down"))


def rsi(df: DataFrame, n: int, out: str, close: str = "close", seed: str = "ewm") -> DataFrame:
    """100 U / (U + D), U and D being Wilder means of gains and losses; null where both are 0."""
    moved = lagged(df, {"_d": F.col(close) - F.lag(close).over(frame_window())})
    return smooth(moved, rsi_parts("_d", n, seed)).withColumn(out, rsi_of_parts()).drop("_d", "_up", "_down")


def _range() -> Column:
    c1 = F.lag("close").over(frame_window())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c1), F.abs(F.col("low") - c1))


def true_range(df: DataFrame, out: str = "tr") -> DataFrame:
    """max(high - low, |high - close before|, |low - close before|); high - low on the first bar."""
    return lagged(df, {out: _range()})


def atr(df: DataFrame, n: int, out: str, seed: str = "ewm") -> DataFrame:
    return smooth(true_range(df, "_tr"), [wilder_of(out, F.col("_tr"), n, seed)]).drop("_tr")


def adx(df: DataFrame, n: int, out: str, seed: str = "ewm") -> DataFrame:
    """Wilder mean of |+DI - -DI| / (+DI + -DI) in percent; a quotient of 0 by 0 counts as 0."""
    w = frame_window()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    moved = lagged(df, {"_tr": _range(), "_pdm": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), "_mdm": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0))})
    s = smooth(moved, [wilder_of("_atr", F.when(F.col("_pdm").isNotNull(), F.col("_tr")), n, seed, 1, "_dm"), wilder_of("_p", F.col("_pdm"), n, seed, 1, "_dm"), wilder_of("_m", F.col("_mdm"), n, seed, 1, "_dm")])
    p, m = ratio(100 * F.col("_p"), F.col("_atr")), ratio(100 * F.col("_m"), F.col("_atr"))
    dx = F.when(F.col("_p").isNotNull(), F.coalesce(100 * ratio(F.abs(p - m), p + m), F.lit(0.0)))
    s = smooth(s.withColumn("_dx", dx), [wilder_of(out, F.col("_dx"), n, seed, n)])
    return s.drop("_tr", "_pdm", "_mdm", "_atr", "_p", "_m", "_dx")


def pvo(df: DataFrame, fast: int, slow: int, out: str, volume: str = "volume", seed: str = "sma") -> DataFrame:
    """100 (fast EMA - slow EMA) / slow EMA of volume."""
    s = smooth(_numbered(df), [ema_of("_f", F.col(volume), fast, seed), ema_of("_s", F.col(volume), slow, seed)])
    return s.withColumn(out, 100 * ratio(F.col("_f") - F.col("_s"), F.col("_s"))).drop("_f", "_s")


def signed_volume(d: str) -> Column:
    return F.when(F.col(d).isNull(), 1.0).otherwise(F.signum(d)) * F.col("volume")


def obv(df: DataFrame, out: str = "obv") -> DataFrame:
    """Running sum of volume signed by the move of the close; the first bar counts as a rise."""
    moved = lagged(df, {"_d": F.col("close") - F.lag("close").over(frame_window())})
    return running(moved, [(out, signed_volume("_d"), "sum")]).drop("_d")


def diff(df: DataFrame, x: str, lag: int, out: str) -> DataFrame:
    return lagged(df, {out: F.col(x) - F.lag(x, lag).over(frame_window())}, lag)


def log_return(df: DataFrame, out: str = "log_return", close: str = "close") -> DataFrame:
    return lagged(df, {out: log_of_ratio(F.col(close), F.lag(close).over(frame_window()))})


def rolling_window(df: DataFrame, x: str, size: int, out: str) -> DataFrame:
    """The last `size` values as an array, oldest first; null where there are fewer rows or one of them is null."""
    w = frame_window().rowsBetween(-(size - 1), 0)
    return framed(_numbered(df), {out: F.when(F.count(x).over(w) == size, F.collect_list(x).over(w))}, before=size - 1, rows=max(1024, 4 * size))


def rolling_apply(df: DataFrame, x: str, size: int, f, out: str) -> DataFrame:
    """f, a function from an array column to a column, of the last `size` values."""
    return rolling_window(df, x, size, "_window").withColumn(out, F.when(F.col("_window").isNotNull(), f(F.col("_window")))).drop("_window")


ALPHAS, BETAS = (0.02, 0.05, 0.1, 0.15, 0.2), (0.6, 0.7, 0.8, 0.85, 0.9, 0.95)


def garch_grid(alphas=ALPHAS, betas=BETAS) -> list[tuple[float, float]]:
    """Stationary pairs, alpha + beta < 1."""
    return [(a, b) for a in alphas for b in betas if a + b < 0.999]


def conditional_volatility(df: DataFrame, ret: str, out: str, size: int = 240, least: int = 50, grid: list[tuple[float, float]] | None = None, levels: int = 0) -> DataFrame:
    """One-step GARCH(1,1) volatility forecast of 100 * ret over trailing windows.

    The likelihood is maximised over a fixed grid of (alpha, beta), then `levels` times around the best pair, nearer where none is better; omega is
    the window's variance times 1 - alpha - beta. The first of equally likely pairs wins. Null for windows that are short, hold a null or never
    move. A block's windows walk the grid together, as arrays: nothing is multiplied or shuffled beyond the block's halo."""
    if size < least:
        raise ValueError(f"a window needs {least} returns")
    made = rolling_udf(df.withColumn("_r100", 100 * F.col(ret)), "_r100", size, garch_forecast(grid or garch_grid(), levels), out)
    return made.drop("_r100")


def ewma_volatility(df: DataFrame, ret: str, out: str, decay: float = 0.94) -> DataFrame:
    """Square root of the exponentially weighted mean of squared returns."""
    if not 0 < decay < 1:
        raise ValueError("decay must be between 0 and 1")
    s = smooth(_numbered(df), [Smooth("_v", F.col(ret) * F.col(ret), 1, decay, "ewm", 1)])
    return s.withColumn(out, F.sqrt("_v")).drop("_v")
