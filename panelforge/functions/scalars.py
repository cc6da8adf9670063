"""Scalar expressions of the signal library."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window


def finite(x: Column | str, other: Column | float | None = None) -> Column:
    """x, or `other` where it is NaN or infinite."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(other) if not isinstance(other, Column) else other)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def flow_imbalance(by: tuple[str, ...] = ("ticker", "level"), order: tuple[str, ...] = ("time", "seq")) -> Column:
    """Order-flow imbalance of a book level against its previous snapshot, over mean depth.

    The bid side adds its size when the price holds or rises and takes the previous
    size away when it holds or falls.  The ask side's signs follow the source data's
    convention: up takes the previous size away, down adds the size.  Null for the
    first snapshot and where depth is 0.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    was = {c: F.lag(c).over(w) for c in ("bid", "ask", "bid_size", "ask_size")}
    bid = F.when(F.col("bid") >= was["bid"], F.col("bid_size")).otherwise(0.0) - F.when(F.col("bid") <= was["bid"], was["bid_size"]).otherwise(0.0)
    ask = F.when(F.col("ask") > was["ask"], -was["ask_size"]).when(F.col("ask") < was["ask"], F.col("ask_size")).otherwise(was["ask_size"] - F.col("ask_size"))
    return F.try_divide(bid + ask, (F.col("bid_size") + F.col("ask_size")) / 2)


def book_imbalance(bid: str = "bid_size", ask: str = "ask_size") -> Column:
    """(bid - ask) / (bid + ask), 0 for an empty book."""
    return F.coalesce(F.try_divide(F.col(bid) - F.col(ask), F.col(bid) + F.col(ask)), F.lit(0.0))


def decay(minute: Column, minutes: Column | int, half_life: float, at_open: bool = False) -> Column:
    """Exponential weight of a minute, heaviest at the close (or the open)."""
    age = minute if at_open else F.lit(minutes) + 1 - minute
    return F.exp(-age * (math.log(2) / half_life))


def minute_of_day(time: Column, opens: int = 570, last: int = 390) -> Column:
    """HH:MM text as the minute of the session, from 1 to `last`."""
    return clip(F.substring(time, 1, 2).cast("int") * 60 + F.substring(time, 4, 2).cast("int") - opens + 1, 1, last).cast("int")


def soft_threshold(z: Column, g: Column | float) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - F.lit(g), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(1.0))


def number_name(x: Column, digits: int = 2) -> Column:
    """0.10 as 0p10, for names of runs."""
    return F.replace(F.format_string(f"%.{digits}f", x), F.lit("."), F.lit("p"))


def base_ticker(name: Column) -> Column:
    return F.element_at(F.split(name, "__"), 1)


def percent(x: Column) -> Column:
    return x * 100


def bps(x: Column) -> Column:
    return x * 10_000
