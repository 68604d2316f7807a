"""Null handling and alignment of bar sizes (O-40 .. O-46)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.operators.scan import BLOCK_SECONDS, running, with_facts


def ffill(df: DataFrame, cols: Sequence[str], block: int = BLOCK_SECONDS) -> DataFrame:
    """Nulls take the last non-null value before them."""
    return running(df, [(c, F.col(c), "last") for c in cols], block).select(df.columns)


def bfill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Leading nulls of each symbol take its first non-null value (after ffill there are no others)."""
    first = df.groupBy("symbol").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("bar_ts"))).alias(f"_f_{c}") for c in cols])
    return with_facts(df, first).select([F.coalesce(c, f"_f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def fill_const(df: DataFrame, col: str, value: float) -> DataFrame:
    return df.withColumn(col, F.coalesce(col, F.lit(value)))


def align_to_base(base: DataFrame, other: DataFrame, cols: Sequence[str], fill_leading: bool = True) -> DataFrame:
    """Columns of larger bars on the rows of base: matched by equal bar start, then filled forward and, at the beginning,
    backward. A larger bar whose start base lacks is lost, and a null in a matched row takes an older value."""
    got = base.join(other.select("symbol", "bar_ts", *cols), ["symbol", "bar_ts"], "left")
    filled = ffill(got, cols)
    return bfill(filled, cols) if fill_leading else filled


def align_point_in_time(base: DataFrame, other: DataFrame, cols: Sequence[str], length: str) -> DataFrame:
    """As align_to_base, but a larger bar is seen only from its end on, and nothing is filled backward."""
    later = other.withColumn("bar_ts", F.col("bar_ts") + F.expr(f"INTERVAL {length}"))
    return align_to_base(base, later, cols, fill_leading=False)


def join_timeframes(h1: DataFrame, *others: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Columns of larger bars on hourly bars by equal bar start, every column then filled forward."""
    out = h1
    for df, cols in others:
        out = out.join(df.select("symbol", "bar_ts", *cols), ["symbol", "bar_ts"], "left")
    return ffill(out, [c for c in out.columns if c not in ("symbol", "bar_ts")])


def drop_incomplete(df: DataFrame, features: Sequence[str], target: str, must_exist: bool = True) -> DataFrame:
    """Rows with every feature and the target; an error if there are none."""
    out = df.dropna(subset=[*features, target])
    if must_exist and out.isEmpty():
        raise ValueError("no row has all features")
    return out


def completeness(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """rows_before and rows_after of drop_incomplete, without dropping."""
    full = F.lit(True)
    for c in [*features, target]:
        full = full & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("rows_after"))
