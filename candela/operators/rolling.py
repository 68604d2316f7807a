"""Rolling extremes, sums and counts whose work does not depend on the frame (O-33, O-51).

A series is cut into blocks of rows. Inside each, running values from its begin and from its end are formed; a frame is the end of
one block, whole blocks, and the begin of another. So every value is touched twice and each row is sent at most twice, to the rows whose
frames begin and end with it. What lies between comes from one summary row a block, in frames over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.operators.scan import framed, indexed

BLOCK_ROWS = 1024
KINDS = ("max", "min", "sum", "count", "avg")


def _agg(kind: str, c: str) -> Column:
    return {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[kind](c)


def _joined(kind: str, a: Column, b: Column) -> Column:
    return {"max": F.greatest(a, b), "min": F.least(a, b)}.get(kind, F.coalesce(a + b, a, b))


def rolling(df: DataFrame, specs: dict[str, tuple[str, str]], first: int, last: int, partial: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds, for each name of specs, the (column, kind) of rows i + first .. i + last of the series, i being the row itself; kinds are KINDS.

    Null where the frame goes beyond the series or holds a null in the column; with partial the values that there are count, and null only if there is none (a
    count is 0 then). NaN is a value. Frames beyond about rows**2 rows still cost no more than a frame over blocks."""
    size = last - first + 1
    if size < 2:
        raise ValueError("a frame has two rows or more")
    if bad := [k for _, k in specs.values() if k not in KINDS]:
        raise ValueError(f"unknown kinds: {bad}")
    src = df if "_i" in df.columns else indexed(df)
    keep = [c for c in df.columns if c not in specs]
    block = max(1, min(rows, size - 1))
    inputs = {c: k for k, c in enumerate(dict.fromkeys(c for c, _ in specs.values()))}
    parts = sorted({("sum" if k == "avg" else k, c) for c, k in specs.values()} | {("count", c) for c in inputs})
    names = {p: f"{p[0]}_{inputs[p[1]]}" for p in parts}
    src = src.withColumns({f"_x{k}": F.col(c) for c, k in inputs.items()}).withColumn("_b", F.floor(F.col("_i") / block))
    whole = (size - 1) // block  # a frame that ends at the begin of a block has so many blocks between, or one less

    def values(prefix: str, window=None) -> list[Column]:
        return [(_agg(kind, f"_x{inputs[c]}") if window is None else _agg(kind, f"_x{inputs[c]}").over(window)).alias(prefix + names[kind, c]) for kind, c in parts]

    def merged(a: Column, b: Column) -> Column:
        return F.struct(*[_joined(kind, a[names[kind, c]], b[names[kind, c]]).alias(names[kind, c]) for kind, c in parts])

    def struct(prefix: str) -> Column:
        return F.struct(*[F.col(prefix + n).alias(n) for n in names.values()])

    running = Window.partitionBy("symbol", "_b")
    scanned = src.select("*", *values("_p_", running.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    scanned = scanned.select("*", *values("_s_", running.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)))
    begin, end, ahead = struct("_p_"), struct("_s_"), struct("_s_")
    if whole > 1 or (size - 1) % block or (partial and last > 0):
        sums = src.groupBy("symbol", "_b").agg(*values("_w_"))
        w = Window.partitionBy("symbol", "_rb").orderBy("_i")

        def between(prefix: str, lo: int, hi: int) -> dict[str, Column]:
            """Of blocks lo .. hi, relative to the row's."""
            again = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}
            return {prefix + names[p]: again[p[0]]("_w_" + names[p]).over(w.rowsBetween(lo, hi)) if lo <= hi else F.lit(None).cast(sums.schema["_w_" + names[p]].dataType) for p in parts}

        cols = between("_m_", -(whole - 1), -1) | between("_l_", -whole, -1) | (between("_f_", 1, whole + 1) if partial and last > 0 else {})
        sums = framed(sums.withColumnRenamed("_b", "_i"), cols, before=whole, after=whole + 1 if partial and last > 0 else 0)
        scanned = scanned.join(sums.withColumnRenamed("_i", "_b").drop(*["_w_" + n for n in names.values()]), ["symbol", "_b"])
        longer = F.col("_b") - F.floor((F.col("_i") - (size - 1)) / block) - 1 == whole
        begin = F.when(longer, merged(struct("_l_"), begin)).otherwise(merged(struct("_m_"), begin))
        if partial and last > 0:
            ahead = merged(end, struct("_f_"))
    scanned = scanned.select(*dict.fromkeys([*keep, "symbol", "_i"]), begin.alias("_begin"), end.alias("_end"), ahead.alias("_ahead"))

    # Kind 2 is the row itself, 1 and 0 the rows at the end and the begin of its frame.
    to = [F.struct(F.lit(2).alias("kind"), F.col("_i").alias("at"))]
    to += [F.struct(F.lit(1).alias("kind"), (F.col("_i") - last).alias("at"))] if last else []
    to += [F.struct(F.lit(0).alias("kind"), (F.col("_i") - first).alias("at"))] if first else []
    sent = scanned.withColumn("_to", F.explode(F.array(*to))).filter("_to.at >= 0")
    own = F.col("_to.kind") == 2

    def travelling(c: str, kind: int, needed: bool) -> Column:
        return F.when((F.col("_to.kind") == kind) | (own if not needed else F.lit(False)), F.col(c)).alias(c)

    sent = sent.select(
        "symbol", F.col("_to.kind").alias("_kind"), F.col("_to.at").alias("_at"), F.floor(F.col("_to.at") / block).alias("_b"), F.when(own, F.struct(*dict.fromkeys([*keep, "_i"]))).alias("_row"),
        travelling("_begin", 1, bool(last)), travelling("_end", 0, bool(first)), travelling("_ahead", 0, bool(first)),
    )
    w = Window.partitionBy("symbol", "_b").orderBy("_at", "_kind")

    def got(c: str, kind: int, needed: bool) -> Column:
        if not needed:
            return F.col(c)
        back = [F.when((F.lag("_kind", k).over(w) == kind) & (F.lag("_at", k).over(w) == F.col("_at")), F.lag(c, k).over(w)) for k in (1, 2)]
        return F.coalesce(*back)

    met = sent.withColumns({"_q": got("_begin", 1, bool(last)), "_e": got("_end", 0, bool(first)), "_o": got("_ahead", 0, bool(first))}).filter(F.col("_kind") == 2)
    total = F.when(F.col("_q").isNotNull() & F.col("_e").isNotNull(), merged(F.col("_e"), F.col("_q"))).otherwise(F.coalesce("_q", "_o"))
    met = met.withColumn("_t", total)

    def result(c: str, kind: str) -> Column:
        n = F.coalesce(F.col("_t")[names["count", c]], F.lit(0))
        x = F.try_divide(F.col("_t")[names["sum", c]], n) if kind == "avg" else n if kind == "count" else F.col("_t")[names[kind, c]]
        return x if partial else F.when(n == size, x)

    return met.select(*[F.col("_row")[c].alias(c) for c in keep], *[result(c, kind).alias(name) for name, (c, kind) in specs.items()])


def rolling_range(df: DataFrame, x: str, size: int, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Highest less lowest of the last `size` values, null unless all are there."""
    got = rolling(df, {"_hi": (x, "max"), "_lo": (x, "min")}, -(size - 1), 0, rows=rows)
    return got.withColumn(out, F.col("_hi") - F.col("_lo")).drop("_hi", "_lo")
