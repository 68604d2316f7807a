"""As-of joins of long series (O-44, O-45 without the loss of bars that have no equal start)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.operators.scan import block_seconds

MICROS = 1_000_000


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _interval(length: str) -> Column:
    return F.expr(f"INTERVAL {length}")


def as_of(
    base: DataFrame, other: DataFrame, cols: Sequence[str], *, length: str | None = None, tolerance: str | None = None, direction: str = "backward",
    exact: bool = True, tie: Sequence[str] = (), matched: str | None = None, block: int | None = None,
) -> DataFrame:
    """base with cols of the row of other that is nearest in time, among those of its symbol that are not later (direction "backward") or
    not earlier ("forward"); without exact, strictly so.

    With length, as "1 HOUR", a row of other counts from its end, bar_ts + length, on. A row farther away than tolerance gives nulls, and so do base
    rows without a match, symbol or time; nulls in the matched row stay nulls. Of rows of other at one time the last by the columns of `tie`
    counts, without them the one with the greatest cols. `matched` names a column for the time at which the matched row
    counts. Rows of base that share a time are rows of the result each.

    Both sides are put into blocks of time and scanned in one order; the last row of other in earlier blocks comes by a running value over blocks. No task gathers
    a whole symbol. The length of blocks is measured, or given in seconds."""
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    sign = 1 if direction == "backward" else -1
    sources = other.filter(F.col("symbol").isNotNull() & F.col("bar_ts").isNotNull())
    at = F.col("bar_ts") if length is None else F.col("bar_ts") + _interval(length)
    seen = F.struct(at.alias("at"), *[F.col(c) for c in cols])
    order = F.struct(*[F.col(c) for c in tie or cols])
    right = sources.select("symbol", at.alias("bar_ts"), F.lit(None).cast(base.select(F.struct("*")).schema[0].dataType).alias("_row"), seen.alias("_seen"), order.alias("_tie"))
    left = base.select("symbol", "bar_ts", F.struct("*").alias("_row"), F.lit(None).cast(right.schema["_seen"].dataType).alias("_seen"), F.lit(None).cast(right.schema["_tie"].dataType).alias("_tie"))
    both = left.unionByName(right)
    if block is None:
        block = block_seconds(both.filter("bar_ts IS NOT NULL").select("symbol", "bar_ts"))
    rank = F.when(F.col("_row").isNull() == exact, 0).otherwise(1)
    both = both.withColumns({"_t": sign * _micros(F.col("bar_ts")), "_rank": rank}).withColumn("_tb", F.floor(F.col("_t") / (block * MICROS)))
    in_block = Window.partitionBy("symbol", "_tb").orderBy("_t", "_rank", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.filter(F.col("_seen").isNotNull()).groupBy("symbol", "_tb").agg(F.max_by("_seen", F.struct("_t", "_tie")).alias("_end"))
    blocks = both.select("symbol", "_tb").distinct().join(ends, ["symbol", "_tb"], "left")
    before = Window.partitionBy("symbol").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    carried = blocks.select("symbol", "_tb", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    scanned = both.withColumn("_local", F.last("_seen", ignorenulls=True).over(in_block)).filter(F.col("_row").isNotNull())
    out = scanned.join(carried, ["symbol", "_tb"], "left").withColumn("_got", F.coalesce("_local", "_carry"))
    if tolerance is not None:
        near = F.col("_got.at") >= F.col("bar_ts") - _interval(tolerance) if sign > 0 else F.col("_got.at") <= F.col("bar_ts") + _interval(tolerance)
        out = out.withColumn("_got", F.when(near, F.col("_got")))
    out = out.withColumn("_got", F.when(F.col("symbol").isNotNull() & F.col("bar_ts").isNotNull(), F.col("_got")))
    names = [c for c in base.columns if c not in cols and c != matched]
    more = [] if matched is None else [F.col("_got.at").alias(matched)]
    return out.select(*[F.col("_row")[c].alias(c) for c in names], *[F.col("_got")[c].alias(c) for c in cols], *more)


def align_as_of(base: DataFrame, other: DataFrame, cols: Sequence[str], length: str, tolerance: str | None = None, block: int | None = None) -> DataFrame:
    """Columns of larger bars on the rows of base: of the last larger bar that has ended, whether or not base has a row where it begins or ends."""
    return as_of(base, other, cols, length=length, tolerance=tolerance, block=block)
