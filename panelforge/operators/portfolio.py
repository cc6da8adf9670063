"""Long/short portfolios of scored cross-sections: (date, ticker, sector, score, ret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import average_rank, correlation, ordinal, percentile_rank


def sides(scores: DataFrame, q: float, *by: str, score: str = "score") -> DataFrame:
    """side: 1 for the k highest, -1 for the k lowest, ties by ticker; k is max(1, floor(n q)).

    Groups of one name, or too small for two sides, have none.
    """
    up, down = Window.partitionBy(*by).orderBy(score, "ticker"), Window.partitionBy(*by).orderBy(F.desc(score), F.desc("ticker"))
    n = F.count("*").over(Window.partitionBy(*by))
    k = F.greatest(F.lit(1), F.floor(n * F.lit(q)).cast("int"))
    rows = scores.where(F.col(score).isNotNull()).withColumns({"n": n, "k": k, "lo": F.row_number().over(up), "hi": F.row_number().over(down)})
    rows = rows.where("n >= 2 and 2 * k <= n")
    return rows.withColumn("side", F.when(F.col("hi") <= F.col("k"), 1).when(F.col("lo") <= F.col("k"), -1).otherwise(0)).drop("lo", "hi")


def spread(scores: DataFrame, q: float, *by: str, weight: Column | None = None) -> DataFrame:
    """Mean return of the long side less that of the short side, in each group; `weight` averages by weights."""
    s = sides(scores, q, *by)
    mean = lambda side: F.try_divide(F.sum(F.when(F.col("side") == side, F.col("ret") * weight)), F.sum(F.when(F.col("side") == side, weight))) if weight is not None else F.avg(F.when(F.col("side") == side, F.col("ret")))
    return s.groupBy(*by).agg((mean(1) - mean(-1)).alias("spread"))


def gross_spread(scores: DataFrame, q: float = 0.2) -> DataFrame:
    return spread(scores, q, "date")


def sector_neutral_spread(scores: DataFrame, q: float = 0.2, least: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean over sectors with at least `least` names of their spreads; `by` keys runs apart."""
    wide = scores.withColumn("_n", F.count("score").over(Window.partitionBy(*by, "date", "sector"))).where(F.col("_n") >= least)
    return spread(wide, q, *by, "date", "sector").groupBy(*by, "date").agg(F.avg("spread").alias("spread"), F.count("spread").alias("sectors"))


def vol_scaled_spread(scores: DataFrame, q: float = 0.2, vol: str = "vol") -> DataFrame:
    """Ranks by score over volatility, and weighs names by its inverse."""
    v = F.greatest(F.col(vol), F.lit(1e-8))
    return spread(scores.where(F.col(vol).isNotNull()).withColumn("score", F.col("score") / v), q, "date", weight=1 / v)


def gross_weights(scores: DataFrame, q: float = 0.2) -> DataFrame:
    return sides(scores, q, "date").where("side <> 0").select("date", "ticker", (F.col("side") / F.col("k")).alias("w"))


def sector_neutral_weights(scores: DataFrame, q: float = 0.2, least: int = 4) -> DataFrame:
    """Each active sector's gross weights over the number of active sectors."""
    s = sides(scores, q, "date", "sector").where((F.col("n") >= least) & (F.col("side") != 0))
    active = F.size(F.collect_set("sector").over(Window.partitionBy("date")))
    return s.select("date", "ticker", "sector", (F.col("side") / (F.col("k") * active)).alias("w"))


def rank_weights(scores: DataFrame, *by: str) -> DataFrame:
    """Percentile rank less a half, scaled to absolute sum 1 in each group."""
    raw = scores.withColumn("raw", percentile_rank("score", *by) - 0.5)
    return raw.withColumn("w", F.try_divide("raw", F.sum(F.abs("raw")).over(Window.partitionBy(*by)))).drop("raw")


def dense(weights: DataFrame) -> DataFrame:
    """All dates by all tickers, with 0 where there is no weight, and t."""
    dates, names = weights.select("date").distinct(), weights.select("ticker").distinct()
    # A calendar by the tickers of one universe: the grid that turnover is defined on.
    grid = ordinal(dates.join(F.broadcast(names)))
    return grid.join(weights.select("date", "ticker", "w"), ["date", "ticker"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def turnover(weights: DataFrame, one_way: bool = True) -> DataFrame:
    """Half of the sum of absolute changes in weight from the date before (or the whole sum), from flat."""
    change = F.abs(F.col("w") - F.lag("w", 1, 0.0).over(Window.partitionBy("ticker").orderBy("date")))
    moved = dense(weights).withColumn("d", change).groupBy("date").agg(F.sum(F.round("d", 9)).alias("turnover"))
    return moved.withColumn("turnover", F.col("turnover") * 0.5) if one_way else moved


def held(weights: DataFrame, every: int) -> DataFrame:
    """Weights as of the last rebalance, every so many dates."""
    g = dense(weights).withColumn("w", F.when(F.col("t") % every == 0, F.col("w")))
    return g.withColumn("w", F.last("w", True).over(Window.partitionBy("ticker").orderBy("date")))


def net_spread(gross: DataFrame, moved: DataFrame, bps: float) -> DataFrame:
    return gross.join(moved, "date").withColumn("net", F.col("spread") - bps * 1e-4 * F.col("turnover"))


def breakeven(gross: DataFrame, moved: DataFrame) -> DataFrame:
    """Cost in basis points at which the mean spread is used up; null without turnover."""
    j = gross.join(moved, "date").agg(F.avg("spread").alias("p"), F.avg("turnover").alias("t"))
    return j.select(F.when(F.col("t") > 0, F.col("p") / F.col("t") * 10_000).alias("breakeven_bps"))


def daily_ic(scores: DataFrame, least: int = 2) -> DataFrame:
    """Spearman correlation of score and return on each date."""
    both = scores.where("score is not null and ret is not null")
    r = both.withColumns({"a": average_rank("score", "date"), "b": average_rank("ret9", "date")}) if "ret9" in both.columns else both.withColumns({"a": average_rank("score", "date"), "b": average_rank("ret", "date")})
    return r.groupBy("date").agg(F.count("*").alias("n"), correlation("a", "b").alias("ic")).where(F.col("n") >= least)


def factor_positions(signal: DataFrame, weights: DataFrame, loads: DataFrame) -> DataFrame:
    """z = sum of weight * signal over sources; a target's position is load * z, demeaned and of absolute sum 1."""
    z = signal.join(weights, "ticker").groupBy("date").agg(F.sum(F.col("weight") * F.col("signal")).alias("z"))
    p = z.join(F.broadcast(loads)).withColumn("p", F.col("load") * F.col("z"))
    p = p.withColumn("p", F.col("p") - F.avg("p").over(Window.partitionBy("date")))
    return p.select("date", "ticker", F.coalesce(F.try_divide("p", F.sum(F.abs("p")).over(Window.partitionBy("date"))), F.lit(0.0)).alias("w"))


def available_positions(signal: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """A block's position, its source weights scaled up to what is available on the date."""
    z = signal.where("signal is not null").join(F.broadcast(sources), "ticker").groupBy("date")
    z = z.agg(F.try_divide(F.sum(F.col("weight") * F.col("signal")), F.sum(F.abs("weight"))).alias("z"))
    return z.join(F.broadcast(targets)).select("date", "ticker", (F.col("load") * F.col("z")).alias("w"))


def cash_pnl(weights: DataFrame, returns: DataFrame) -> DataFrame:
    r = F.coalesce(F.when(~F.isnan("ret"), F.col("ret")), F.lit(0.0))
    return weights.join(returns, ["date", "ticker"], "left").groupBy("date").agg(F.sum(F.col("w") * r).alias("pnl"))
