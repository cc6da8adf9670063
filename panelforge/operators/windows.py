"""Per-ticker and cross-sectional windows over (date, ticker, ...) panels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ticker(*keys: str):
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("date")


def trailing(n: int, *keys: str, shift: int = 0):
    """The last n rows up to `shift` rows before the current one."""
    return by_ticker(*keys).rowsBetween(-(n - 1) - shift, -shift)


def full(agg: Column, x: str, window, least: int) -> Column:
    """An aggregate over a window with at least so many values."""
    return F.when(F.count(x).over(window) >= least, agg.over(window))


def ordinal(panel: DataFrame) -> DataFrame:
    """t: the dense number of each date.  Only the distinct dates, a calendar, are numbered in one place."""
    dates = panel.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)
    return panel.join(F.broadcast(dates), "date")


def next_day(panel: DataFrame, x: str, y: str) -> DataFrame:
    """x of a date beside y of the following date of the calendar, whatever gaps a ticker has."""
    p = ordinal(panel)
    after = p.select((F.col("t") - 1).alias("t"), "ticker", F.col("date").alias("next_date"), F.col(y).alias("y"))
    return p.select("date", "t", "ticker", F.col(x).alias("x")).join(after, ["t", "ticker"])


def forward_return(prices: DataFrame, start: str, end: str) -> DataFrame:
    """end at the next calendar date over start, less one (overnight: close to open; close to close)."""
    p = ordinal(prices)
    after = p.select((F.col("t") - 1).alias("t"), "ticker", F.col(end).alias("later"))
    return p.select("date", "t", "ticker", F.col(start).alias("now")).join(after, ["t", "ticker"]).select("date", "ticker", (F.try_divide("later", "now") - 1).alias("ret"))


def rolling_beta(panel: DataFrame, x: str, m: str, n: int = 60) -> DataFrame:
    """beta: covariance with m over its variance in the last n rows (all needed), and what it leaves of x."""
    w = trailing(n)
    beta = F.when(F.count(F.col(x) + F.col(m)).over(w) >= n, F.try_divide(F.covar_samp(x, m).over(w), F.var_samp(m).over(w)))
    return panel.withColumn("beta", beta).where("beta is not null").withColumn("residual", F.col(x) - F.col("beta") * F.col(m))


def rolling_zscore(panel: DataFrame, x: str, n: int = 60, look_ahead: bool = False, least: int | None = None, population: bool = True) -> Column:
    w = trailing(n, shift=0 if look_ahead else 1)
    sd = (F.stddev_pop if population else F.stddev_samp)(x)
    return F.try_divide(F.col(x) - full(F.avg(x), x, w, least or n), full(sd, x, w, least or n))


def trailing_vol(x: str, n: int = 60, least: int = 20, shift: int = 1, floor: float = 1e-8) -> Column:
    w = trailing(n, shift=shift)
    return F.greatest(full(F.stddev_samp(x), x, w, least), F.lit(floor))


def average_rank(x: str, *by: str) -> Column:
    """1-based rank with ties at their mean; nulls have none."""
    same, order = Window.partitionBy(*by, x), Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    return F.when(F.col(x).isNotNull(), F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0)


def percentile_rank(x: str, *by: str) -> Column:
    """The average rank over the number of values."""
    return average_rank(x, *by) / F.count(x).over(Window.partitionBy(*by))


def demeaned(x: str, *by: str) -> Column:
    return F.col(x) - F.avg(x).over(Window.partitionBy(*by))


def correlation(a: str, b: str) -> Column:
    """Their correlation over a group, null where either doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def running(agg: Column, *keys: str, order: str = "date") -> Column:
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return agg.over(w)


def ema(grid: DataFrame, x: str, alpha: float) -> DataFrame:
    """Exponential smoothing along a dense (date, ticker) grid; a missing value ends a stretch, and the
    next value starts anew.  Rows without a value stay out.

    A stretch, part of one ticker's daily series, is smoothed in one pass.
    """
    w = by_ticker()
    island = F.sum(F.col(x).isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = grid.withColumn("island", island).where(F.col(x).isNotNull())

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(ema=pdf[x].astype(float).ewm(alpha=alpha, adjust=False).mean())

    schema = ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("ema", "double")])
    return rows.groupBy("ticker", "island").applyInPandas(smooth, schema).drop("island")


def centred_mean(x: str, order: str, n: int, *keys: str) -> Column:
    """The mean of n neighbours with zeros beyond the ends."""
    h = n // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-h, h)
    return F.sum(x).over(w) / n
