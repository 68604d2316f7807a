"""Column functions without order (O-27, O-28, O-31, O-32, O-67, O-68 and pieces of others)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def cyclical_time(ts: Column, period: int = 24) -> tuple[Column, Column]:
    """Sine and cosine of the hour."""
    angle = 2 * math.pi * F.hour(ts) / period
    return F.sin(angle), F.cos(angle)


def pct_of_close(x: Column, close: Column) -> Column:
    return ratio(x, close)


def dist_from_ema(close: Column, ema: Column) -> Column:
    return ratio(close - ema, close)


def session_mask(hour: Column, first: int = 13, last: int = 17) -> Column:
    """1 in the hours first .. last, both included."""
    return hour.between(first, last).cast("int")


def interaction(a: Column, b: Column) -> Column:
    return a * b


def log_of_ratio(x: Column, before: Column) -> Column:
    """ln(x / before), 0 where that ratio is not positive, null where it is null."""
    r = ratio(x, before)
    return F.when(r <= 0, 0.0).otherwise(F.ln(r))


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(probs: Column) -> Column:
    """Class with the highest probability, the first of equals."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def class_array(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])
