"""Forward-looking labels and scaling (O-50 .. O-58)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.columns import ratio
from candela.operators.align import bfill, fill_const
from candela.operators.indicators import atr
from candela.operators.scan import frame_window, framed, indexed

STOP, ATR_FACTOR, ATR_LENGTH = 0.003, 1.4, 14
SMALL, LARGE = 0.005, 0.02


def forward_return(df: DataFrame, k: int = 20, out: str = "forward_return") -> DataFrame:
    later = F.lead("close", k).over(frame_window())
    return framed(df if "_i" in df.columns else indexed(df), {out: ratio(later - F.col("close"), F.col("close"))}, after=k)


def forward_excursion(df: DataFrame, k: int = 20) -> DataFrame:
    """up_excursion and down_excursion of the next k bars relative to the close."""
    w = frame_window().rowsBetween(1, k)
    c = F.col("close")
    return framed(df if "_i" in df.columns else indexed(df), {"up_excursion": ratio(F.max("high").over(w) - c, c), "down_excursion": ratio(c - F.min("low").over(w), c)}, after=k)


def stop_distance(df: DataFrame, use_atr: bool = True, factor: float = ATR_FACTOR, fixed: float = STOP, length: int = ATR_LENGTH) -> DataFrame:
    """Adds stop_distance: factor * ATR / close (leading nulls filled backward, else `fixed`), or `fixed`."""
    if not use_atr:
        return df.withColumn("stop_distance", F.lit(fixed))
    filled = fill_const(bfill(atr(df, length, "_atr"), ["_atr"]), "_atr", fixed)
    return filled.withColumn("stop_distance", ratio(F.col("_atr"), F.col("close")) * factor).drop("_atr")


def label_5class(df: DataFrame, k: int = 20, use_atr: bool = True, factor: float = ATR_FACTOR, fixed: float = STOP, tail: str = "neutral") -> DataFrame:
    """Adds label (0 strong sell .. 4 strong buy) and neutralized. A move is neutral if the price went against it by
    more than the stop distance meanwhile. The last k rows are neutral, or left out with tail="drop"."""
    w, c = frame_window(), F.col("close")
    ahead = w.rowsBetween(1, k)
    src = stop_distance(df if "_i" in df.columns else indexed(df), use_atr, factor, fixed)
    cols = {"_r": ratio(F.lead("close", k).over(w) - c, c), "_up": ratio(F.max("high").over(ahead) - c, c), "_down": ratio(c - F.min("low").over(ahead), c)}
    out = framed(src, cols, after=k)
    r, stop = F.col("_r"), F.col("stop_distance")
    hit = F.coalesce(((r > 0) & (F.col("_down") > stop)) | ((r < 0) & (F.col("_up") > stop)), F.lit(False))
    label = F.when(hit | r.isNull(), 2).when(r > LARGE, 4).when(r > SMALL, 3).when(r >= -SMALL, 2).when(r >= -LARGE, 1).otherwise(0)
    out = out.withColumns({"label": label.cast("int"), "neutralized": hit})
    if tail == "drop":
        out = out.filter(r.isNotNull())
    return out.drop("_r", "_up", "_down", "stop_distance")


def neutralized_count(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.col("neutralized").cast("long")), F.lit(0)).alias("neutralized"))


def class_distribution(df: DataFrame, col: str, classes: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """class, n, percent; classes that do not occur have 0."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(col).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    listed = spark.createDataFrame([(int(c),) for c in classes], "class int")
    n = F.coalesce("n", F.lit(0))
    return listed.join(counts, "class", "left").crossJoin(F.broadcast(total)).select("class", n.alias("n"), F.coalesce(100.0 * ratio(n.cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("percent"))


def fit_minmax(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """feature, min, max over all rows, or over those that `where` names."""
    src = df if where is None else df.filter(where)
    one = src.agg(*[f(c).cast("double").alias(f"{k}_{c}") for c in cols for k, f in (("min", F.min), ("max", F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max")) for c in cols])
    return one.select(F.inline(rows))


def apply_minmax(df: DataFrame, scaler: DataFrame, cols: Sequence[str], low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Features mapped from their range to low .. high; a feature without range gets low."""
    one = scaler.filter(F.col("feature").isin(list(cols))).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("min", "max")))).alias("_s"))
    out = df.crossJoin(F.broadcast(one))  # one row, one entry for each feature

    def scaled(c: str) -> Column:
        s = F.col("_s")[c]
        width = s["max"] - s["min"]
        return ((F.col(c) - s["min"]) / F.when(width == 0, 1.0).otherwise(width) * (high - low) + low).alias(c)

    return out.select([scaled(c) if c in cols else F.col(c) for c in df.columns])
