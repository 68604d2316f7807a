"""From signals to a trade ledger (O-92 .. O-105, O-116).

The side held after a bar follows from the signals alone as far as a run of them goes, so trades are found in each run
independently: bars are cut into runs, the trades of a run are looked for one after the other, and since size and costs are
proportional to capital, capital is a running product over the trades.

The exit of a trade is the first bar whose tests hold for its entry's levels and the highest (or lowest) trailing stop so far: a search over
arrays of bars, batch by batch as Spark hands on the sorted rows, so a run of any length takes little memory and time in
proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.columns import ratio
from candela.operators.align import ffill
from candela.operators.scan import frame_window, framed, indexed, running
from candela.sources.scratch import materialized

# The reasons for an exit, as ledgers name them.
STOP_LOSS, TAKE_PROFIT, NEUTRAL, AT_END = "Stop Loss", "Take Profit", "Neutral Signal", "End of Backtest"
SELL, BUY = "Trend Reversal (Sell Signal)", "Trend Reversal (Buy Signal)"


@dataclass(frozen=True)
class Rules:
    capital: float = 6_000_000.0
    leverage: float = 5.0
    share: float = 0.95  # of capital in a position
    taker: float = 0.0005
    slippage: float = 0.0005
    funding: float = 0.00001
    use_atr: bool = True
    atr_factor: float = 1.4
    fixed_stop: float = 0.004
    reward: float = 2.0
    trailing: bool = True
    trail_from: float = 1.5  # percent of leveraged profit
    trail_fixed: float = 0.008
    allow_long: bool = True
    allow_short: bool = True
    on_reversal: bool = True
    on_neutral: bool = True
    max_drawdown: float = 0.2
    least_order: float = 10.0
    pyramid_factor: float = 1.5  # of the size of entries above the first level


def signal_to_side(signal: Column, allow_long: bool = True, allow_short: bool = True) -> Column:
    """1 for 3 and 4, -1 for 0 and 1, else 0."""
    return F.when(signal.isin(3, 4) & F.lit(allow_long), 1).when(signal.isin(0, 1) & F.lit(allow_short), -1).otherwise(0)


def entry_levels(price: Column, atr: Column, side: Column, rules: Rules = Rules()) -> tuple[Column, Column]:
    """Stop and target at entry."""
    fixed = price * rules.fixed_stop
    d = F.when(atr > 0, atr * rules.atr_factor).otherwise(fixed) if rules.use_atr else fixed
    return price - side * d, price + side * d * rules.reward


def position_size(capital: Column, price: Column, rules: Rules = Rules(), level: Column | int = 0) -> Column:
    """Units of an entry: a share of capital, at least a least order's worth; more above the first pyramid level."""
    base = F.greatest(F.least(F.lit(rules.share), F.lit(1.0)) * capital / price, F.lit(rules.least_order) / price)
    return base * F.when((F.lit(level) if isinstance(level, int) else level) > 0, rules.pyramid_factor).otherwise(1.0)


def trailing_stops(side: float, entry: float, before: float, close: np.ndarray, atr: np.ndarray, rules: Rules) -> np.ndarray:
    """The trailing stop at each of a trade's bars, NaN before the first: it follows the close where the leveraged profit is large
    enough, and only tightens."""
    if not rules.trailing:
        return np.full(len(close), before)
    new = close * (1 - side * (atr / close if rules.use_atr else rules.trail_fixed))
    gain = (close - entry) * side * rules.leverage / entry * 100
    steps = np.where(gain > rules.trail_from, side * new, np.nan)
    return side * np.fmax.accumulate(np.fmax(steps, side * before))


def exits(side: float, stop: float, target: float, trail: np.ndarray, high: np.ndarray, low: np.ndarray, signal: np.ndarray, rules: Rules) -> np.ndarray:
    """For each bar 0, or the first of these that holds: 1 the worst price reaches the tighter stop, 2 the best price reaches the target, 3 the
    signal is against the side, 4 it is neutral."""
    worst, best = (low, high) if side > 0 else (high, low)
    out = np.zeros(len(high), np.int8)
    if rules.on_neutral:
        out[signal == 2] = 4
    if rules.on_reversal:
        out[(signal <= 1) & (signal >= 0) if side > 0 else signal >= 3] = 3
    out[side * best >= side * target] = 2
    out[side * worst <= np.fmax(side * stop, side * trail)] = 1
    return out


def position_runs(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """bars (symbol, bar_ts, signal, ...) with run, and `ending` true on copies of the bar that ends a run.

    A run is a maximal stretch of one side. If neutral signals do not close, the side goes on through them; if reversals
    do not, only neutral bars part the runs."""
    if not (rules.on_reversal or rules.on_neutral):
        raise ValueError("without exits on reversal and on neutral signals trades depend on the whole past")
    side = signal_to_side(F.col("signal"))
    if not rules.on_neutral:
        src = ffill(bars.withColumn("_side", F.when(side != 0, side)), ["_side"]).withColumn("_side", F.coalesce("_side", F.lit(0)))
    else:
        src = bars.withColumn("_side", side if rules.on_reversal else F.abs(side))
    src = src if "_i" in src.columns else indexed(src)
    flagged = framed(src, {"_new": F.coalesce((F.col("_side") != F.lag("_side").over(frame_window())).cast("int"), F.lit(1))}, before=1)
    runs = running(flagged, [("run", F.col("_new"), "sum")])
    own = runs.withColumn("ending", F.lit(False))
    ends = runs.filter((F.col("_new") == 1) & (F.col("run") > 1)).withColumn("run", F.col("run") - 1).withColumn("ending", F.lit(True))
    return own.unionByName(ends).drop("_new", "_side", *([] if "_i" in bars.columns else ["_i"]))


@dataclass
class Held:
    """A trade that is open."""

    ts: object
    side: int
    price: float
    stop: float
    target: float
    trail: float = float("nan")


class RunTrades:
    """The trades of runs whose bars come in order, some at a time."""

    FIRST = 64  # bars that are searched at once, twice as many each time

    def __init__(self, rules: Rules):
        self.rules, self.held = rules, None
        self.found: list[tuple] = []
        self.symbol = None

    def enter(self, f: dict[str, np.ndarray], k: int) -> None:
        side, price, atr = int(f["go"][k]), float(f["close"][k]), float(f["atr"][k])
        distance = atr * self.rules.atr_factor if self.rules.use_atr and atr > 0 else price * self.rules.fixed_stop
        self.held = Held(f["bar_ts"][k], side, price, price - side * distance, price + side * distance * self.rules.reward)

    def bars(self, f: dict[str, np.ndarray]) -> None:
        i, n = 0, len(f["close"])
        flat = np.flatnonzero(f["go"])
        while i < n:
            if self.held is None:
                at = np.searchsorted(flat, i)
                if at == len(flat):
                    return
                i = int(flat[at])
                self.enter(f, i)
                i += 1
            i = self.exit(f, i, n)

    def exit(self, f: dict[str, np.ndarray], i: int, n: int) -> int:
        """The bar after the exit of the trade that is held, or n."""
        h, size = self.held, self.FIRST
        while i < n:
            z = min(n, i + size)
            trail = trailing_stops(h.side, h.price, h.trail, f["close"][i:z], f["atr"][i:z], self.rules)
            why = exits(h.side, h.stop, h.target, trail, f["high"][i:z], f["low"][i:z], f["signal"][i:z], self.rules)
            k = int((why > 0).argmax())
            if why[k]:
                reason = (STOP_LOSS, TAKE_PROFIT, SELL if h.side > 0 else BUY, NEUTRAL)[why[k] - 1]
                self.found.append((self.symbol, h.ts, f["bar_ts"][i + k], h.side, h.price, float(f["close"][i + k]), reason))
                self.held = None
                if f["go"][i + k]:  # its signal goes on: in again at the same close
                    self.enter(f, i + k)
                return i + k + 1
            h.trail, i, size = float(trail[-1]), z, 2 * size
        return n

    def end(self) -> None:
        if self.held is not None:
            self.found.append((self.symbol, self.held.ts, None, self.held.side, self.held.price, None, None))
            self.held = None


def trades_from_runs(runs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """symbol, entry_ts, exit_ts, side, entry_price, exit_price, exit_reason; an open trade has null exit columns.

    The first exit after an entry counts, tests begin on the next bar, fills are closes, and while its signal goes on a
    run enters again at the close that ended a trade. runs have close, high, low, atr and signal. A run is read in order by one
    task, since each of its trades begins where the last one ended; runs are dealt out by their number."""
    side = signal_to_side(F.col("signal"), rules.allow_long, rules.allow_short)
    bars = runs.select(
        "symbol", "run", "bar_ts", *[F.col(c).cast("double").alias(c) for c in ("close", "high", "low", "atr")],
        F.coalesce(F.col("signal").cast("int"), F.lit(-1)).alias("signal"), F.when(F.col("ending"), 0).otherwise(side).alias("go"),
    )
    columns = ["symbol", "entry_ts", "exit_ts", "side", "entry_price", "exit_price", "exit_reason"]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = RunTrades(rules), None
        for f in frames:
            new = (f["run"] != f["run"].shift()) | (f["symbol"] != f["symbol"].shift())
            starts = np.flatnonzero(new.to_numpy() | (np.arange(len(f)) == 0))
            arrays = {c: f[c].to_numpy() for c in ("bar_ts", "close", "high", "low", "atr", "signal", "go")}
            for a, z in zip(starts, [*starts[1:], len(f)], strict=True):
                key = (f["symbol"].iat[a], f["run"].iat[a])
                if key != at:
                    state.end()
                    at, state.symbol = key, key[0]
                state.bars({c: v[a:z] for c, v in arrays.items()})
            yield found(state)
        state.end()
        yield found(state)

    def found(state: RunTrades) -> pd.DataFrame:
        out = pd.DataFrame(state.found, columns=columns)
        state.found = []
        return out.astype({"entry_price": "float64", "exit_price": "float64", "side": "int32"}).assign(entry_ts=pd.to_datetime(out["entry_ts"]), exit_ts=pd.to_datetime(out["exit_ts"]))

    ts = runs.schema["bar_ts"].dataType.simpleString()
    dealt = bars.repartition("symbol", "run").sortWithinPartitions("symbol", "run", "bar_ts", F.col("go") == 0)
    return dealt.mapInPandas(search, f"symbol string, entry_ts {ts}, exit_ts {ts}, side int, entry_price double, exit_price double, exit_reason string")


def close_at_end(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Open trades closed at the last bar of their symbol."""
    last = bars.groupBy("symbol").agg(F.max("bar_ts").alias("_ts"), F.max_by("close", "bar_ts").alias("_close"))
    open_ = F.col("exit_ts").isNull()
    out = trades.join(last, "symbol").withColumns({"exit_reason": F.when(open_, AT_END).otherwise(F.col("exit_reason")), "exit_price": F.when(open_, F.col("_close")).otherwise(F.col("exit_price"))})
    return out.withColumn("exit_ts", F.coalesce("exit_ts", "_ts")).drop("_ts", "_close")


def growth(side: Column, entry: Column, exit_: Column, rules: Rules = Rules()) -> Column:
    """Capital after a trade over capital before it."""
    cost = rules.taker + rules.slippage
    result = side * (exit_ - entry) * rules.leverage - exit_ * cost - entry * rules.leverage * rules.funding
    return 1 - rules.share * cost + rules.share * result / entry


def capital_path(trades: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds capital_before and capital_after. A trade that leaves less than a least order is ruin: the account ends
    there, later trades are left out, and `ruined` marks it."""
    t = trades.withColumn("_f", growth(F.col("side"), F.col("entry_price"), F.col("exit_price"), rules)).withColumn("bar_ts", F.col("entry_ts"))
    bad = F.col("_f") <= 0
    t = running(t.withColumn("_log", F.when(~bad, F.ln("_f")).otherwise(0.0)), [("_sum", F.col("_log"), "sum"), ("_bad", bad.cast("int"), "sum")])
    after = F.lit(rules.capital) * F.exp("_sum")
    t = t.withColumns({"capital_before": F.lit(rules.capital) * F.exp(F.col("_sum") - F.col("_log")), "capital_after": F.when(bad, F.lit(rules.capital) * F.exp(F.col("_sum")) * F.col("_f")).otherwise(after)})
    floor = rules.least_order / rules.share
    t = t.withColumn("ruined", bad | (F.col("capital_after") < floor))
    t = running(t, [("_ruins", F.col("ruined").cast("int"), "sum")])
    return t.filter((F.col("_ruins") - F.col("ruined").cast("int") == 0) & (F.col("capital_before") >= floor)).drop("_f", "_log", "_sum", "_bad", "_ruins", "bar_ts")


def priced(trades: DataFrame, rules: Rules = Rules(), holding: Column | None = None) -> DataFrame:
    """The ledger: sizes, profit and costs of trades with capital_before. holding_periods is 1 unless given."""
    size = position_size(F.col("capital_before"), F.col("entry_price"), rules)
    out = trades.withColumns({"size": size, "leverage": F.lit(rules.leverage), "holding_periods": F.lit(1) if holding is None else holding})
    out = out.withColumns({
        "pnl": gross_pnl(), "pnl_pct": pnl_pct(), "entry_fee": F.col("size") * F.col("entry_price") * rules.taker, "exit_fee": F.col("size") * F.col("exit_price") * rules.taker,
        "funding": notional() * rules.funding * F.col("holding_periods"), "slippage": F.col("size") * F.col("exit_price") * rules.slippage,
        "entry_slippage": F.col("size") * F.col("entry_price") * rules.slippage, "pyramid_level": F.lit(0),  # a second entry at one time is never made
    })
    return with_net(out)


def notional() -> Column:
    return F.col("size") * F.col("entry_price") * F.col("leverage")


def margin() -> Column:
    return F.col("size") * F.col("entry_price")


def gross_pnl() -> Column:
    return (F.col("exit_price") - F.col("entry_price")) * F.col("side") * F.col("size") * F.col("leverage")


def pnl_pct() -> Column:
    return F.coalesce(100 * ratio(gross_pnl(), margin()), F.lit(0.0))


def with_net(ledger: DataFrame) -> DataFrame:
    """Adds total_fees (all four costs of the record), net_pnl and is_profitable."""
    fees = F.col("entry_fee") + F.col("exit_fee") + F.col("funding") + F.col("slippage")
    return ledger.withColumn("total_fees", fees).withColumn("net_pnl", F.col("pnl") - F.col("total_fees")).withColumn("is_profitable", F.col("net_pnl") > 0)


LEDGER = "symbol entry_ts exit_ts side entry_price exit_price size leverage pnl pnl_pct entry_fee exit_fee funding slippage entry_slippage exit_reason holding_periods pyramid_level total_fees net_pnl is_profitable capital_before capital_after ruined".split()


def run_trades(bars: DataFrame, rules: Rules = Rules(), halt: bool = True) -> DataFrame:
    """The ledger of bars (symbol, bar_ts, close, high, low, atr, signal), each symbol being an account of its own."""
    bars = materialized(bars, "bars")
    found = close_at_end(trades_from_runs(position_runs(bars, rules), rules), bars)
    path = materialized(capital_path(materialized(found, "trades"), rules), "capital")
    if halt:
        path = drawdown_halt(bars, path, rules)
    return priced(path, rules).select(*LEDGER)


def capital_events(path: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """symbol, bar_ts, capital at the end of bars with an entry or exit, and closed: capital after an exit there."""
    cost = rules.share * (rules.taker + rules.slippage)
    entries = path.select("symbol", F.col("entry_ts").alias("bar_ts"), F.lit(1).alias("o"), (F.col("capital_before") * (1 - cost)).alias("c"))
    exits = path.filter(F.col("exit_reason") != AT_END).select("symbol", F.col("exit_ts").alias("bar_ts"), F.lit(0).alias("o"), F.col("capital_after").alias("c"))
    return exits.unionByName(entries).groupBy("symbol", "bar_ts").agg(F.max_by("c", "o").alias("capital"), F.max(F.when(F.col("o") == 0, F.col("c"))).alias("closed"))


def start_of_bar(bars: DataFrame, path: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """symbol, bar_ts, equity (realised capital when the bar starts) and peak (highest capital after a close so far)."""
    src = indexed(bars.select("symbol", "bar_ts")).join(capital_events(path, rules), ["symbol", "bar_ts"], "left")
    known = running(src, [("capital", F.col("capital"), "last"), ("peak", F.col("closed"), "max")])
    w, first = frame_window(), F.lit(rules.capital)
    out = framed(known, {"equity": F.coalesce(F.lag("capital").over(w), first), "_peak": F.coalesce(F.lag("peak").over(w), first)}, before=1)
    return out.select("symbol", "bar_ts", "equity", F.greatest("_peak", first).alias("peak"))


def drawdown_halt(bars: DataFrame, path: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Trades of a capital_path() that the account still makes: it stops at the first bar that starts with a drawdown from
    the peak above the limit, and a trade open then is closed at the last bar."""
    breach = start_of_bar(bars, path, rules).filter((F.col("peak") - F.col("equity")) / F.col("peak") > rules.max_drawdown).groupBy("symbol").agg(F.min("bar_ts").alias("halt_ts"))
    t = path.join(breach, "symbol", "left")
    t = t.filter(F.col("halt_ts").isNull() | (F.col("entry_ts") < F.col("halt_ts")))
    open_ = F.coalesce(F.col("exit_ts") >= F.col("halt_ts"), F.lit(False))
    ts = path.schema["exit_ts"].dataType.simpleString()
    t = t.withColumns({"exit_ts": F.when(open_, F.lit(None).cast(ts)).otherwise(F.col("exit_ts"))}).drop("halt_ts")
    closed = close_at_end(t, bars)
    after = F.col("capital_before") * growth(F.col("side"), F.col("entry_price"), F.col("exit_price"), rules)
    return closed.withColumn("capital_after", F.when(F.col("exit_reason") == AT_END, after).otherwise(F.col("capital_after")))
