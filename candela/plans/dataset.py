"""The whole data set from raw bars or ticks (O-59)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.columns import cyclical_time, dist_from_ema, interaction, pct_of_close, session_mask
from candela.operators import indicators as ind
from candela.operators.align import align_to_base, drop_incomplete, join_timeframes
from candela.operators.labels import apply_minmax, fit_minmax, label_5class
from candela.operators.scan import ema_of, frame_window, framed, indexed, running, smooth, wilder_of
from candela.sources.scratch import materialized

# The names and order of the features.
FEATURES = """RSI_14_M15 ATR_5_pct_M15 dist_from_ema_10_M15 ema10_slope_M15 volume_oscillator_M15 obv_M15 hour_sin hour_cos
RSI_14_H1 ADX_14_H1 EMA_diff_21_H4pct RSI_15_x_NYHours garch_volatility""".split()
SIZES = {"m15": "15 minutes", "h1": "1 hour", "h4": "4 hours", "daily": "1 day"}


@dataclass(frozen=True)
class Settings:
    lookahead: int = 20
    use_atr_stop: bool = True
    volatility_window: int = 240
    fast: int = 12
    slow: int = 26


def base_features(m15: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Features of the smallest bars: one pass for what looks back a bar, one for all smoothing, one for running sums."""
    w, c = frame_window(), F.col("close")
    c1 = F.lag("close").over(w)
    out = framed(indexed(m15), {"_d": c - c1, "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c1), F.abs(F.col("low") - c1))}, before=1)
    specs = [*ind.rsi_parts("_d", 14), wilder_of("_atr", F.col("_tr"), 5), ema_of("_ema", c, 10), ema_of("_f", F.col("volume"), s.fast), ema_of("_s", F.col("volume"), s.slow)]
    out = running(smooth(out, specs), [("obv_M15", ind.signed_volume("_d"), "sum")])
    out = framed(out, {"ema10_slope_M15": F.col("_ema") - F.lag("_ema").over(w)}, before=1)
    sin, cos = cyclical_time(F.col("bar_ts"))
    out = out.withColumns({
        "RSI_14_M15": ind.rsi_of_parts(), "ATR_5_pct_M15": pct_of_close(F.col("_atr"), c), "dist_from_ema_10_M15": dist_from_ema(c, F.col("_ema")),
        "volume_oscillator_M15": 100 * F.try_divide(F.col("_f") - F.col("_s"), F.col("_s")), "hour_sin": sin, "hour_cos": cos,
    })
    return out.drop("_i", "_d", "_tr", "_up", "_down", "_atr", "_ema", "_f", "_s")


def hourly_features(h1: DataFrame, h4: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Hourly RSI, ADX and volatility, and the distance of the 4-hour close from its EMA, filled forward on hours."""
    slow = materialized(ind.ema(h4, "close", 21, "_ema").withColumn("EMA_diff_21_H4pct", dist_from_ema(F.col("close"), F.col("_ema"))), "h4")
    src = materialized(indexed(h1), "h1")
    out = ind.log_return(ind.rsi(ind.adx(src, 14, "ADX_14_H1"), 14, "RSI_14_H1"), "_ret")
    out = ind.conditional_volatility(materialized(out, "h1"), "_ret", "garch_volatility", s.volatility_window, min(50, s.volatility_window))
    own = materialized(out.select("symbol", "bar_ts", "RSI_14_H1", "ADX_14_H1", "garch_volatility"), "h1")
    return join_timeframes(own, (slow, ["EMA_diff_21_H4pct"]))


def build_features(bars: dict[str, DataFrame], s: Settings = Settings()) -> DataFrame:
    """symbol, bar_ts, close, FEATURES, target; unscaled, incomplete rows included."""
    bars = {k: materialized(v, k) for k, v in bars.items() if k in ("m15", "h1", "h4")}
    hours = materialized(hourly_features(bars["h1"], bars["h4"], s), "hours")
    m15 = materialized(base_features(bars["m15"], s), "m15")
    wide = align_to_base(m15, hours, ["RSI_14_H1", "ADX_14_H1", "EMA_diff_21_H4pct", "garch_volatility"])
    wide = wide.withColumn("RSI_15_x_NYHours", interaction(F.col("RSI_14_M15"), session_mask(F.hour("bar_ts"))))
    labels = label_5class(bars["m15"], s.lookahead, s.use_atr_stop).select("symbol", "bar_ts", F.col("label").alias("target"))
    return wide.join(labels, ["symbol", "bar_ts"]).select("symbol", "bar_ts", "close", *FEATURES, "target")


def build_dataset(bars: dict[str, DataFrame], s: Settings = Settings(), must_exist: bool = True) -> tuple[DataFrame, DataFrame]:
    """(data set: symbol, bar_ts, FEATURES scaled to -1 .. 1, target; scaler: feature, min, max)."""
    full = drop_incomplete(materialized(build_features(bars, s), "features"), FEATURES, "target", must_exist)
    scaler = fit_minmax(full, FEATURES)
    return apply_minmax(full, scaler, FEATURES).drop("close"), scaler
