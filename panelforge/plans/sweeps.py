"""Sweeps of edge and cluster settings over one walk-forward."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import models as M
from ..operators import sweeps as V
from ..operators import windows as W
from ..session import cut
from ..sources import panels
from .catalog import query

#: Dates of training and dates between refits.
TRAIN, REFIT = 252, 21
#: The settings that are tried.  Thresholds of |t| start low, since returns of the given tables hardly follow signals.
LEVELS, COUNTS = (1.0, 1.5, 2.0, 2.5, 3.0), (2, 5, 10, 20, 50)
RATES, LEAST, CLUSTERS = (0.05, 0.1, 0.2), (40, 100, 120), (2, 4, 6)


def _walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The panel, its windows, and the edges of each window's training dates."""
    p = cut(W.ordinal(panels.weekly(spark, sf_dir)))  # a row a week and name, read by every step
    ranges = M.windows(p, TRAIN, REFIT)
    return p, ranges, E.edge_stats(M.in_window(p, ranges, "tr0", "tr1"), "sig", "ret", 1, "window")


@query()
def edge_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 runs, best first: five |t| thresholds by five least counts of dates; positions are neutral and held for five dates."""
    p, ranges, e = _walked(spark, sf_dir)
    run = ("tstat_min", "min_count")
    dates = V.calendar(ranges, p, 5)
    weights = cut(V.trading_matrices(e, LEVELS, COUNTS, targets=8, sources=8))
    book = cut(V.matrix_positions(weights, p, dates, p.select("ticker").distinct(), *run))
    runs = spark.createDataFrame(list(product(LEVELS, COUNTS)), "tstat_min double, min_count int")
    daily = cut(V.daily_results(book, p, runs, dates, 0.0, *run))
    return V.summaries(daily, *run).orderBy(F.desc_nulls_last(F.round("gross_sharpe", 6)), *run)


@query()
def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """27 runs, best first: three false discovery rates by three least counts by three numbers of clusters; 5 basis points of costs."""
    p, ranges, e = _walked(spark, sf_dir)
    run = ("q", "min_count", "k")
    dates = V.calendar(ranges, p)
    blocks = cut(V.cluster_blocks(E.p_values(e), RATES, LEAST, CLUSTERS))
    book = cut(V.block_positions(blocks, p, dates, *run))
    runs = spark.createDataFrame(list(product(RATES, LEAST, CLUSTERS)), "q double, min_count int, k int")
    daily = cut(V.daily_results(book, p, runs, dates, 5.0, *run))
    return V.summaries(daily, *run).orderBy(F.desc_nulls_last(F.round("net_sharpe", 6)), *run)
