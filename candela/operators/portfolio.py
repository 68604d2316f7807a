"""Equity curves, risk figures and reports of a ledger (O-106 .. O-113)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.operators.scan import frame_window, framed, indexed, running
from candela.operators.trades import Rules, start_of_bar
from candela.sources.scratch import materialized


def equity_curve(bars: DataFrame, ledger: DataFrame, rules: Rules = Rules(), halt: bool = True) -> DataFrame:
    """symbol, bar_ts, equity: realised capital when each bar starts; with a halt it ends with the bar of the halt."""
    curve = start_of_bar(bars, ledger, rules)
    if halt:
        breach = curve.filter((F.col("peak") - F.col("equity")) / F.col("peak") > rules.max_drawdown).groupBy("symbol").agg(F.min("bar_ts").alias("_halt"))
        curve = curve.join(breach, "symbol", "left").filter(F.col("_halt").isNull() | (F.col("bar_ts") <= F.col("_halt")))
    return curve.select("symbol", "bar_ts", "equity")


def max_drawdown(curve: DataFrame) -> DataFrame:
    """symbol, max_drawdown in percent of the highest equity so far."""
    top = running(curve, [("_top", F.col("equity"), "max")])
    return top.groupBy("symbol").agg(F.coalesce(F.max(100 * (F.col("_top") - F.col("equity")) / F.col("_top")), F.lit(0.0)).alias("max_drawdown"))


def sharpe(curve: DataFrame, per_year: int = 252) -> DataFrame:
    """symbol, sharpe: mean over population deviation of the returns from bar to bar, times the root of per_year; 0 for
    fewer than two bars or no deviation."""
    moved = framed(indexed(curve), {"_r": F.col("equity") / F.lag("equity").over(frame_window()) - 1}, before=1)
    by = moved.groupBy("symbol").agg(F.avg("_r").alias("m"), F.stddev_pop("_r").alias("s"))
    return by.select("symbol", F.when(F.coalesce(F.col("s"), F.lit(0.0)) == 0, 0.0).otherwise(F.col("m") / F.col("s") * math.sqrt(per_year)).alias("sharpe"))


def trade_stats(ledger: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row a symbol: trades, wins, losses, win rate, average and largest results, profit factor (infinite without a
    loss), final capital and return. A trade that nets 0 is a loss."""
    win, net = F.col("is_profitable"), F.col("net_pnl")
    gained, lost = F.coalesce(F.sum(F.when(win, net)), F.lit(0.0)), F.coalesce(F.sum(F.when(~win, net)), F.lit(0.0))
    n = F.count(F.lit(1))
    wins = F.sum(win.cast("long"))
    total = F.sum(net) - F.sum("entry_slippage")
    return ledger.groupBy("symbol").agg(
        n.alias("total_trades"), wins.alias("winning_trades"), (n - wins).alias("losing_trades"), (100.0 * wins / n).alias("win_rate"),
        F.coalesce(F.avg(F.when(win, net)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(~win, net)), F.lit(0.0)).alias("avg_loss"),
        F.max(net).alias("largest_win"), F.min(net).alias("largest_loss"),
        F.when(n == wins, float("inf")).otherwise(F.abs(F.try_divide(gained, lost))).alias("profit_factor"),
        (F.lit(rules.capital) + total).alias("final_capital"), total.alias("total_return"), (100 * total / rules.capital).alias("total_return_pct"),
    )


def cost_breakdown(ledger: DataFrame) -> DataFrame:
    """symbol, kind (fees, funding, slippage, total), cost; both sides' fees and slippage as the account paid them."""
    one = ledger.groupBy("symbol").agg(F.sum(F.col("entry_fee") + F.col("exit_fee")).alias("fees"), F.sum("funding").alias("funding"), F.sum(F.col("slippage") + F.col("entry_slippage")).alias("slippage"))
    return one.select("symbol", F.expr("stack(4, 'fees', fees, 'funding', funding, 'slippage', slippage, 'total', fees + funding + slippage) AS (kind, cost)"))


def trade_summary(ledger: DataFrame) -> DataFrame:
    """symbol, number (from 1), side (4 letters), entry and exit (16 characters), reason (15), net_pnl."""
    numbered = indexed(ledger.withColumn("bar_ts", F.col("entry_ts")), "_n")
    cut = lambda c, n: F.substring(F.col(c).cast("string"), 1, n)
    side = F.when(F.col("side") > 0, "LONG").otherwise("SHOR")
    return numbered.select("symbol", (F.col("_n") + 1).alias("number"), side.alias("side"), cut("entry_ts", 16).alias("entry"), cut("exit_ts", 16).alias("exit"), cut("exit_reason", 15).alias("reason"), "net_pnl")


def trade_detail(ledger: DataFrame) -> DataFrame:
    numbered = indexed(ledger.withColumn("bar_ts", F.col("entry_ts")), "_n")
    return numbered.select((F.col("_n") + 1).alias("number"), *ledger.columns)


def band(value: Column, good: Column, fair: Column) -> Column:
    return F.when(good, "good").when(fair, "fair").otherwise("poor")


def rating_bands(metrics: DataFrame) -> DataFrame:
    """metrics with a rating of win_rate, profit_factor, sharpe and max_drawdown."""
    w, p, s, d = (F.col(c) for c in ("win_rate", "profit_factor", "sharpe", "max_drawdown"))
    return metrics.withColumns({"win_rate_rating": band(w, w >= 50, w >= 40), "profit_factor_rating": band(p, p > 1.5, p > 1), "sharpe_rating": band(s, s > 1, s > 0), "max_drawdown_rating": band(d, d < 10, d < 20)})


def account_metrics(bars: DataFrame, ledger: DataFrame, rules: Rules = Rules(), halt: bool = True) -> DataFrame:
    """trade_stats, cost totals, max_drawdown and sharpe of every symbol, rated."""
    ledger = materialized(ledger, "ledger")
    curve = materialized(equity_curve(bars, ledger, rules, halt), "curve")
    return rating_bands(trade_stats(ledger, rules).join(max_drawdown(curve), "symbol").join(sharpe(curve), "symbol"))
