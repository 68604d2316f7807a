"""A user's own function of trailing windows, as numpy arrays in blocks of a series (O-33 for what Spark has no expression for)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from candela.operators.scan import indexed, with_halo

BLOCK_ROWS = 8192
CHUNK_VALUES = 1 << 21  # of windows that f sees at once


def rolling_udf(df: DataFrame, cols: str | Sequence[str], size: int, f: Callable[[np.ndarray], np.ndarray], out: str, kind: str = "double", rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds out: f of the last `size` rows' values, null where there are fewer rows or one of the values is null (NaN counts as null).

    f gets an array (windows, size), or (windows, size, columns) for several columns, oldest row first, and gives one number for each window; NaN
    becomes null. It must not change its argument, whose windows overlap in memory. It is called with at most CHUNK_VALUES values at once. The series is cut into blocks of
    rows, each with the size - 1 rows before it, so no task gathers a series; all other columns travel along in Arrow."""
    names = [cols] if isinstance(cols, str) else list(cols)
    if size < 1:
        raise ValueError("a window has a row or more")
    keep = [c for c in df.columns if c != out]
    near = with_halo(df if "_i" in df.columns else indexed(df), before=size - 1, rows=max(rows, 4 * size))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T._parse_datatype_string(kind))])

    def run(table):
        import pyarrow as pa

        table = table.sort_by("_i")
        x = np.stack([table[c].cast(pa.float64()).to_numpy() for c in names], axis=-1)  # null becomes NaN
        own = table["_own"].to_numpy(zero_copy_only=False)
        result = np.full(len(x), np.nan)
        if len(x) >= size:
            windows = np.lib.stride_tricks.sliding_window_view(x, size, axis=0).swapaxes(1, 2)
            holes = np.concatenate([[0], np.cumsum(np.isnan(x).any(1))])
            full = np.flatnonzero((holes[size:] == holes[:-size]) & own[size - 1 :])
            if len(names) == 1:
                windows = windows[:, :, 0]
            each = max(1, CHUNK_VALUES // (size * len(names)))
            for lo in range(0, len(full), each):
                at = full[lo : lo + each]
                result[at + size - 1] = f(windows[at])
        kept = table.filter(table["_own"]).select(keep)
        target = pa.from_numpy_dtype(np.float64)
        made = pa.array(result[own], target, from_pandas=True)
        wanted = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64()}.get(kind, target)
        return kept.append_column(out, made.cast(wanted))

    return near.groupBy("symbol", "_rb").applyInArrow(run, schema)


def garch_forecast(grid: Sequence[tuple[float, float]], levels: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """One-step GARCH(1,1) volatility of windows of returns in percent, by the most likely (alpha, beta) with omega from the window's variance.

    The likelihood is taken at every pair of the grid, then, levels times, at the best pair and its eight neighbours; where no neighbour is
    better, their distance, at first half the grid's, is halved. Pairs stay above 0 with a sum below 0.999. A pair costs one step over the window for all windows at once: per row
    (pairs + 9 * levels) * size steps of a few operations on arrays. The first of equally likely pairs wins. NaN where nothing moves."""
    alphas, betas = (np.array(x) for x in zip(*grid, strict=True))

    def spacing(x: np.ndarray) -> float:
        steps = np.diff(np.unique(x))
        return float(steps.max()) if len(steps) else 0.05

    def walk(squares: np.ndarray, s2: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood and forecast of every window at its pairs; a, b: (windows or 1, pairs)."""
        h = np.broadcast_to(s2[:, None], (len(s2), a.shape[1])).copy()
        base, good = s2[:, None] * (1 - a - b), np.zeros_like(h)
        for t in range(squares.shape[1]):
            e = squares[:, t, None]
            good -= 0.5 * (np.log(h) + e / h)
            h = base + a * e + b * h
        return good, h

    def best_of(squares, s2, a, b):
        good, h = walk(squares, s2, a, b)
        at = good.argmax(1)[:, None]
        pick = lambda x: np.take_along_axis(np.broadcast_to(x, good.shape), at, 1)
        return pick(a), pick(b), pick(h), at

    def f(windows: np.ndarray) -> np.ndarray:
        squares = (windows - windows.mean(1, keepdims=True)) ** 2
        s2 = squares.mean(1)
        out, moves = np.full(len(windows), np.nan), s2 > 0
        squares, s2 = squares[moves], s2[moves]
        if len(s2):
            a, b, h, _ = best_of(squares, s2, alphas[None, :], betas[None, :])
            da, db = np.full_like(a, spacing(alphas) / 2), np.full_like(b, spacing(betas) / 2)
            around = np.array([(0, 0)] + [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) != (0, 0)])
            for _ in range(levels):
                na, nb = np.clip(a + around[:, 0] * da, 1e-4, None), np.clip(b + around[:, 1] * db, 1e-4, None)
                inside = na + nb < 0.999
                a, b, h, at = best_of(squares, s2, np.where(inside, na, a), np.where(inside, nb, b))
                da, db = np.where(at == 0, da / 2, da), np.where(at == 0, db / 2, db)
            out[moves] = np.sqrt(h[:, 0])
        return out

    return f
