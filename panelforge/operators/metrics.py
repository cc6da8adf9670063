"""Summaries of daily series (date, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

YEAR = 252


def sharpe(x: Column | str, annual: bool = True) -> Column:
    """Mean over sample deviation, null under two values or without variation."""
    s = F.when(F.count(x) >= 2, F.try_divide(F.avg(x), F.when(F.stddev_samp(x) > 1e-15, F.stddev_samp(x))))
    return s * (YEAR**0.5) if annual else s


def performance(series: DataFrame, x: str, *by: str) -> DataFrame:
    g = series.groupBy(*by) if by else series.groupBy()
    c = F.col(x)
    return g.agg(
        F.count(c).alias("n_obs"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.stddev_pop(c).alias("sd_pop"), sharpe(c, False).alias("sharpe"), sharpe(c).alias("sharpe_ann"),
        (F.avg(c) * YEAR).alias("mean_ann"), F.avg((c > 0).cast("double")).alias("hit_rate"), F.sum(c).alias("total"), F.avg((F.abs(c) > 1e-12).cast("double")).alias("active"),
    )


def cumulative(series: DataFrame, x: str, *by: str) -> DataFrame:
    """Running sum, its peak so far, the drawdown from it, and the compounded return."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = series.withColumn("cum", F.sum(x).over(w)).withColumn("peak", F.max("cum").over(w))
    return c.withColumns({"drawdown": F.col("cum") - F.col("peak"), "compound": F.exp(F.sum(F.log1p(x)).over(w)) - 1})


def max_drawdown(series: DataFrame, x: str, *by: str) -> DataFrame:
    """The deepest fall below the running peak, which starts at the first value."""
    c = cumulative(series, x, *by)
    return (c.groupBy(*by) if by else c.groupBy()).agg(F.min("drawdown").alias("max_drawdown"))


def rolling_sharpe(x: str, n: int = 60, clip_at_zero: bool = False) -> Column:
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(n - 1), 0)
    s = F.when(F.count(x).over(w) >= n, F.avg(x).over(w) / (F.stddev_samp(x).over(w) + 1e-9))
    return F.greatest(s, F.lit(0.0)) if clip_at_zero else s


def histogram(df: DataFrame, x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal bins; values outside fall in bins 0 and bins + 1."""
    return df.where(F.col(x).isNotNull()).groupBy(F.width_bucket(F.col(x), F.lit(lo), F.lit(hi), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def winsorised(df: DataFrame, x: str, q: float, *by: str, least: int = 3, passes: int = 1) -> DataFrame:
    """x clipped to its q and 1 - q quantiles in each group with enough values; null x, and x of null keys, stay."""
    cuts = exact_quantiles(df, x, {"_low": q, "_high": 1 - q}, *by, passes=passes).withColumnRenamed("n", "_n")
    both = df.join(cuts, list(by), "left") if by else df.join(cuts, how="left")  # without keys, cuts are one row
    clipped = F.least(F.greatest(F.col(x), F.col("_low")), F.col("_high"))
    return both.withColumn(x, F.when((F.col("_n") >= least) & F.col(x).isNotNull(), clipped).otherwise(F.col(x))).drop("_low", "_high", "_n")
