"""Ordered scans over series of any length.

A window over a whole symbol would put a long series into one task. Here a series is cut into blocks; windows run
inside (symbol, block), one summary row of each block is scanned, and its result is joined back. Running aggregates use
blocks of time, recursive smoothing and bounded frames blocks of row numbers, so their size does not depend on gaps.

The blocks of time suit bars. For a table of very many rows a day, block_seconds() measures how long a block may be.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.sources.scratch import materialized

BLOCK_SECONDS = 4 * 86_400
BLOCK_ROWS = 1 << 18
FRAME_ROWS = 1024


def _time_block(seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col("bar_ts").cast("timestamp")) / seconds)


def block_seconds(df: DataFrame, rows: int = BLOCK_ROWS) -> int:
    """Length of blocks of time with at most about `rows` rows of a series each, by its densest hour; at most BLOCK_SECONDS."""
    hours = df.groupBy("symbol", _time_block(3600).alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    most = hours.agg(F.max("_n")).first()[0] or 1
    return max(1, min(BLOCK_SECONDS, rows * 3600 // most))


def _in_block(*order: str):
    return Window.partitionBy("symbol", "_tb").orderBy(*(order or ("bar_ts",)))


def running(df: DataFrame, specs: Sequence[tuple[str, Column, str]], block: int = BLOCK_SECONDS) -> DataFrame:
    """Adds running aggregates of each symbol in time order: specs of (name, value, kind), kind being sum, count, max or
    last (last non-null). Every row must have its own (symbol, bar_ts)."""
    names = [n for n, _, _ in specs]
    values = df.withColumn("_tb", _time_block(block)).withColumns({f"_v_{n}": v for n, v, _ in specs})
    w = _in_block().rowsBetween(Window.unboundedPreceding, 0)

    def local(n: str, kind: str) -> Column:
        c = f"_v_{n}"
        return {"sum": F.sum(c), "count": F.count(c), "max": F.max(c), "last": F.last(c, ignorenulls=True)}[kind].over(w)

    def whole(n: str, kind: str) -> Column:
        c = F.col(f"_v_{n}")
        return {"sum": F.sum(c), "count": F.count(c), "max": F.max(c), "last": F.max_by(c, F.when(c.isNotNull(), F.col("bar_ts")))}[kind].alias(f"_w_{n}")

    before = Window.partitionBy("symbol").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)

    def carry(n: str, kind: str) -> Column:
        c = f"_w_{n}"
        return {"sum": F.sum(c), "count": F.sum(c), "max": F.max(c), "last": F.last(c, ignorenulls=True)}[kind].over(before).alias(f"_c_{n}")

    def both(n: str, kind: str) -> Column:
        a, b = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        return {"sum": F.coalesce(a + b, a, b), "count": a + F.coalesce(b, F.lit(0)), "max": F.greatest(a, b), "last": F.coalesce(a, b)}[kind]

    summary = values.groupBy("symbol", "_tb").agg(*[whole(n, k) for n, _, k in specs])
    carried = summary.select("symbol", "_tb", *[carry(n, k) for n, _, k in specs])
    out = values.withColumns({f"_l_{n}": local(n, k) for n, _, k in specs}).join(carried, ["symbol", "_tb"])
    keep = [c for c in df.columns if c not in names]
    return out.select(*keep, *[both(n, k).alias(n) for n, _, k in specs])


def indexed(df: DataFrame, name: str = "_i", block: int = BLOCK_SECONDS) -> DataFrame:
    """Adds the row's number in its series, from 0."""
    out = running(df, [(name, F.lit(1), "count")], block)
    return out.withColumn(name, F.col(name) - 1)


def with_halo(df: DataFrame, before: int = 0, after: int = 0, rows: int = FRAME_ROWS, index: str = "_i") -> DataFrame:
    """Rows of an indexed table with _rb, a block of rows, and copies (_own false) of those that frames of `before` rows
    back and `after` rows ahead need from the neighbour blocks."""
    rows = max(rows, before, after, 1)
    i, b = F.col(index), F.floor(F.col(index) / rows)
    back = F.when(i >= (b + 1) * rows - before, b + 1) if before else F.lit(None)
    ahead = F.when((i < b * rows + after) & (b > 0), b - 1) if after else F.lit(None)
    to = F.array_compact(F.array(b, back.cast("long"), ahead.cast("long")))
    return df.withColumn("_home", b).withColumn("_rb", F.explode(to)).withColumn("_own", F.col("_rb") == F.col("_home")).drop("_home")


def framed(df: DataFrame, specs: dict[str, Column], before: int = 0, after: int = 0, rows: int = FRAME_ROWS) -> DataFrame:
    """Adds columns made with frame_window() over at most `before` rows back and `after` rows ahead."""
    src = df if "_i" in df.columns else indexed(df)
    out = with_halo(src, before, after, rows).withColumns(specs).filter("_own").drop("_rb", "_own")
    return out if "_i" in df.columns else out.drop("_i")


MOST_FACTS = 1 << 20  # symbols whose facts are broadcast together
MOST_HOT = 4096  # a symbol with more than this part of all rows is hot, so there are no more hot symbols than that


def with_facts(df: DataFrame, facts: DataFrame) -> DataFrame:
    """df with one row of facts for each symbol, of which there is one for every symbol of df; df is never shuffled by symbol alone
    where a symbol could be a large part of it.

    The facts are written and counted: up to MOST_FACTS of them are broadcast. Beyond, those of hot symbols are, and only rows of the others
    meet theirs by a shuffle."""
    known = materialized(facts, "facts")
    n = known.count()
    if n <= MOST_FACTS:
        return df.join(F.broadcast(known), "symbol")
    sizes = materialized(df.groupBy("symbol").count(), "sizes")
    total = sizes.agg(F.sum("count")).first()[0] or 0
    hot = known.join(sizes.filter(F.col("count") > total // MOST_HOT).select("symbol"), "symbol", "left_semi")
    frequent = df.join(F.broadcast(hot), "symbol")
    others = df.join(F.broadcast(hot.select("symbol")), "symbol", "left_anti").join(known, "symbol")
    return frequent.unionByName(others)


def frame_window():
    return Window.partitionBy("symbol", "_rb").orderBy("_i")


@dataclass(frozen=True)
class Smooth:
    """y = decay y' + weight x over the rows of a series, after `skip` leading nulls of x.

    seed "ewm": the adjusted exponential mean (weights add up to one); "sma": begins with the mean of the first n values.
    Null for the first n - 1 values. Specs with the same `alike` are null in the same rows, so that those of one decay share their weights."""

    name: str
    value: Column
    n: int
    decay: float
    seed: str = "ewm"
    skip: int = 0
    alike: str = ""

    @property
    def weights(self) -> str:
        return re.sub(r"\W", "_", f"{self.alike}_{self.n}_{self.decay}_{self.seed}_{self.skip}") if self.alike else self.name


def ema_of(name: str, value: Column, n: int, seed: str = "sma", skip: int = 0) -> Smooth:
    return Smooth(name, value, n, 1 - 2 / (n + 1), seed, skip)


def wilder_of(name: str, value: Column, n: int, seed: str = "ewm", skip: int = 0, alike: str = "") -> Smooth:
    return Smooth(name, value, n, 1 - 1 / n, seed, skip, alike)


def smooth(df: DataFrame, specs: Sequence[Smooth]) -> DataFrame:
    """Adds the smoothed columns. df has _i (see indexed). Inside a block of rows decay**k * sum(x decay**-k) is an exact
    running sum; what earlier blocks leave decays so fast that a few of their end values give it to the last bit. A null after
    the first `skip` rows has no weight, while the others' weights decay as if it had one; the result there is null."""
    specs = list(specs)
    for s in specs:
        if not 0 < s.decay < 1:
            raise ValueError(f"{s.name}: length must be above 1")
    rows = max(4, min(256, math.floor(27 / max(-math.log(s.decay) for s in specs))))
    src = df.withColumns({f"_x_{s.name}": s.value.cast("double") for s in specs}).withColumn("_sb", F.floor(F.col("_i") / rows))
    w = Window.partitionBy("symbol", "_sb").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    heads = {f"_m_{s.name}": F.avg(F.when((F.col("_i") >= s.skip) & (F.col("_i") < s.skip + s.n), F.col(f"_x_{s.name}"))) for s in specs if s.seed == "sma"}
    first = max(s.skip + s.n for s in specs)
    if heads and first <= rows:  # they lie in the first block, and only the last row of each is asked for its mean
        src = src.withColumns({n: m.over(w) for n, m in heads.items()})
    elif heads:
        src = with_facts(src, src.filter(F.col("_i") < first).groupBy("symbol").agg(*[m.alias(n) for n, m in heads.items()]))
    r = F.col("_i") - F.col("_sb") * rows

    def weight(s: Smooth) -> Column:
        """Of the row's own value, before it decays."""
        k, there = F.col("_i") - s.skip, F.col(f"_x_{s.name}").isNotNull()
        if s.seed == "sma":
            return F.when(k < s.n - 1, 0.0).when(k == s.n - 1, F.col(f"_m_{s.name}").isNotNull().cast("double")).when(there, 1 - s.decay).otherwise(0.0)
        return F.when((k < 0) | ~there, 0.0).otherwise(1.0)

    def value(s: Smooth) -> Column:
        x = F.col(f"_x_{s.name}")
        return F.coalesce(F.when(F.col("_i") - s.skip == s.n - 1, F.col(f"_m_{s.name}")).otherwise(x) if s.seed == "sma" else x, F.lit(0.0))

    scaled = src.withColumns({f"_w_{s.weights}": weight(s) * F.pow(F.lit(s.decay), -r) for s in specs})
    scaled = scaled.withColumns({f"_u_{s.name}": F.col(f"_w_{s.weights}") * value(s) for s in specs})
    both = [(s, f"u_{s.name}") for s in specs] + [(s, f"w_{k}") for k, s in {s.weights: s for s in specs}.items()]
    local = scaled.withColumns({f"_l{c}": F.sum(f"_{c}").over(w) * F.pow(F.lit(s.decay), r) for s, c in both})
    ends = scaled.groupBy("symbol", "_sb").agg(*[(F.sum(f"_{c}") * s.decay ** (rows - 1)).alias(f"_e{c}") for s, c in both])
    back = {s.name: math.ceil(40 / -math.log(s.decay**rows)) for s in specs}
    most = max(back.values())
    near = with_halo(ends, before=most, rows=64 * most, index="_sb")

    def carry(s: Smooth, c: str) -> Column:
        whole = s.decay**rows
        past = F.collect_list(f"_e{c}").over(Window.partitionBy("symbol", "_rb").orderBy("_sb").rowsBetween(-back[s.name], -1))
        return F.aggregate(past, F.lit(0.0), lambda a, e: a * whole + e).alias(f"_c{c}")

    carried = near.select("symbol", "_sb", "_own", *[carry(s, c) for s, c in both]).filter("_own").drop("_own")
    out = local.join(carried, ["symbol", "_sb"])

    def result(s: Smooth) -> Column:
        total = lambda c: F.col(f"_l{c}") + F.pow(F.lit(s.decay), r + 1) * F.col(f"_c{c}")
        y = F.try_divide(total(f"u_{s.name}"), total(f"w_{s.weights}"))
        return F.when((F.col("_i") - s.skip >= s.n - 1) & F.col(f"_x_{s.name}").isNotNull(), y).alias(s.name)

    names = {s.name for s in specs}
    return out.select(*[c for c in df.columns if c not in names], *[result(s) for s in specs])
