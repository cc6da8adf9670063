"""Runs of many settings over one set of window statistics.

The edges of a window are made once; its task puts them into one matrix and takes every
setting's trading matrix or block from it, with one decomposition for each mask and not
for each run.  What leaves a task is the few weights of a run, and positions, returns
and turnover of all runs are relational from there.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, metrics, moments
from .edges import edge_matrix


def _square(pdf: pd.DataFrame, *values: str) -> tuple[list, list[np.ndarray]]:
    """The names of a window's edges, and a targets by sources matrix of each value; what isn't there is NaN."""
    names = sorted(set(pdf["tgt"]) | set(pdf["src"]))
    return names, [edge_matrix(pdf, v, names, names) for v in values]


def calendar(ranges: DataFrame, panel: DataFrame, every: int = 1) -> DataFrame:
    """(window, t, t0): the test dates of each window and the rebalance that each one holds."""
    span = ranges.withColumn("t", F.explode(F.sequence("te0", F.col("te1") - 1)))
    span = span.select("window", "t", (F.col("t") - (F.col("t") - F.col("te0")) % every).alias("t0"))
    return span.join(panel.select("t").distinct(), "t", "left_semi")


def trading_matrices(edges: DataFrame, levels: tuple[float, ...], counts: tuple[int, ...], targets: int, sources: int, upper: float = 0.99) -> DataFrame:
    """(tstat_min, min_count, window, tgt, src, w): of every run, the mean-over-deviation of the edges that it trades.

    A run keeps edges between two names with so high a |t| and so many dates.  Their |t|, clipped at
    the `upper` quantile, are what the target and source sets are chosen by.
    """

    def runs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, (a, t, n) = _square(pdf, "a", "tstat", "n")
        size, n = np.abs(np.nan_to_num(t)), np.nan_to_num(n)
        np.fill_diagonal(size, 0.0)
        out = []
        for level, least in product(levels, counts):
            keep = (size >= level) & (size > 0) & (n >= least)
            if not keep.any():
                continue
            w = np.where(keep, np.minimum(size, np.quantile(size[keep], upper)), 0.0)
            tgt, src = kernels.alternating(w, targets, sources)
            at = np.zeros(keep.shape, bool)
            at[np.ix_(tgt, src)] = True
            i, j = np.nonzero(keep & at)
            out += [(level, least, key[0], names[x], names[y], float(a[x, y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["tstat_min", "min_count", "window", "tgt", "src", "w"])

    return moments.side_by_side(edges, "window").groupBy("window").applyInPandas(runs, "tstat_min double, min_count int, window int, tgt string, src string, w double")


def block_of(labels: tuple[np.ndarray, np.ndarray], score: np.ndarray, n: np.ndarray, usable: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Of all pairs of a target and a source cluster, the block with the highest mean score weighted by counts:
    that mean, and target loadings and source weights (mean scores over its usable edges) of absolute sum 1."""
    good = usable & np.isfinite(score)
    best = None
    for rc, cc in product(np.unique(labels[0]), np.unique(labels[1])):
        block = good & (labels[0] == rc)[:, None] & (labels[1] == cc)[None]
        if not (count := np.where(block, n, 0.0)).sum() > 0:
            continue
        s = np.where(block, score, 0.0)
        value = float((s * count).sum() / count.sum())
        load, weight = s.sum(1) / np.maximum(block.sum(1), 1), s.sum(0) / np.maximum(block.sum(0), 1)
        if np.abs(load).sum() > 0 and np.abs(weight).sum() > 0 and (best is None or value > best[0]):
            best = (value, load / np.abs(load).sum(), weight / np.abs(weight).sum())
    return best


def cluster_blocks(edges: DataFrame, rates: tuple[float, ...], counts: tuple[int, ...], clusters: tuple[int, ...]) -> DataFrame:
    """(q, min_count, k, window, mask, score, side, ticker, w): the block that each run trades in each window.

    `edges` carry p.  Clusters come from the |t| of edges with enough dates that are kept at a false
    discovery rate of q (mask 0); where none is, or no block is found, of those with enough dates (1); else of all (2).
    """

    def runs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, (a, t, n, p) = _square(pdf, "a", "tstat", "n", "p")
        # Rounded, so that the order of sums doesn't decide between clusters that are equally good.
        size, n = np.abs(np.nan_to_num(t)).round(9), np.nan_to_num(n)
        split: dict[bytes, tuple] = {}
        out = []
        for q, least in product(rates, counts):
            enough = n >= least
            masks = [enough & kernels.discovered(p, q) & np.isfinite(a), enough, size > 0]
            for k in clusters:
                for i, mask in enumerate(masks):
                    w = np.where(mask, size, 0.0)
                    if not w.any():
                        continue
                    if (held := mask.tobytes()) not in split:
                        split[held] = kernels.bipartite_vectors(w)
                    if (held, k) not in split:
                        split[held, k] = kernels.cocluster_of(split[held], k)
                    if (found := block_of(split[held, k], a, n, mask)) is not None:
                        for side, v in (("target", found[1]), ("source", found[2])):
                            out += [(q, least, k, key[0], i, found[0], side, names[j], float(v[j])) for j in np.flatnonzero(v).tolist()]
                        break
        return pd.DataFrame(out, columns=["q", "min_count", "k", "window", "mask", "score", "side", "ticker", "w"])

    return moments.side_by_side(edges, "window").groupBy("window").applyInPandas(runs, "q double, min_count int, k int, window int, mask int, score double, side string, ticker string, w double")


def matrix_positions(weights: DataFrame, signal: DataFrame, dates: DataFrame, names: DataFrame, *by: str) -> DataFrame:
    """(by..., t, ticker, w): each rebalance's signal of the date before through the matrix, demeaned over
    all names and of absolute sum 1, held until the next rebalance.

    A signal that is missing counts as 0.  Runs without an edge in a window have no position there.
    """
    before = signal.select((F.col("t") + 1).alias("t0"), F.col("ticker").alias("src"), F.col("sig").alias("x"))
    raw = weights.join(dates.select("window", "t0").distinct(), "window").join(before, ["t0", "src"])
    raw = raw.groupBy(*by, "t0", F.col("tgt").alias("ticker")).agg(F.sum(F.col("w") * F.col("x")).alias("raw"))
    # Names of one universe: the demeaned position of a name without an edge isn't 0.
    grid = raw.select(*by, "t0").distinct().join(F.broadcast(names)).join(raw, [*by, "t0", "ticker"], "left")
    over = Window.partitionBy(*by, "t0")
    centred = grid.withColumn("raw", F.coalesce("raw", F.lit(0.0))).withColumn("raw", F.col("raw") - F.avg("raw").over(over))
    size = F.sum(F.abs("raw")).over(over)
    sized = centred.withColumn("w", F.when(size > 1e-12, F.col("raw") / size).otherwise(0.0))
    return dates.select("t", "t0").join(sized, "t0").select(*by, "t", "ticker", "w")


def block_positions(blocks: DataFrame, signal: DataFrame, dates: DataFrame, *by: str) -> DataFrame:
    """(by..., t, ticker, w): each date's positions of the blocks, of absolute sum 1: target loadings by the sign of the
    sources' weighted signal of the date before; sources without a signal drop out, and without any there is no position."""
    before = signal.where("sig is not null").select((F.col("t") + 1).alias("t"), "ticker", F.col("sig").alias("x"))
    sources = blocks.where("side = 'source'").select(*by, "window", "ticker", "w").join(dates.select("window", "t"), "window")
    z = sources.join(before, ["t", "ticker"]).groupBy(*by, "window", "t").agg(F.sum(F.col("w") * F.col("x")).alias("z"))
    targets = blocks.where("side = 'target'").select(*by, "window", "ticker", "w")
    return z.where("z <> 0").join(targets, [*by, "window"]).select(*by, "t", "ticker", (F.col("w") * F.signum("z")).alias("w"))


def daily_results(positions: DataFrame, returns: DataFrame, runs: DataFrame, dates: DataFrame, bps: float, *by: str) -> DataFrame:
    """(by..., date, gross, net, turnover, exposure) of every run on every date number; a date without a position has 0.

    Turnover is the whole sum of absolute changes, from flat; a missing return counts as 0.
    """
    ret = F.coalesce(F.when(~F.isnan("ret"), F.col("ret")), F.lit(0.0))
    earned = positions.join(returns.select("t", "ticker", "ret"), ["t", "ticker"], "left")
    earned = earned.groupBy(*by, "t").agg(F.sum(F.col("w") * ret).alias("gross"), F.sum(F.abs("w")).alias("exposure"))
    # A change is today's weight less yesterday's, so that neither needs a grid of all names.
    both = positions.select(*by, "t", "ticker", "w").unionByName(positions.select(*by, (F.col("t") + 1).alias("t"), "ticker", (-F.col("w")).alias("w")))
    moved = both.groupBy(*by, "t", "ticker").agg(F.sum("w").alias("d")).groupBy(*by, "t").agg(F.sum(F.abs("d")).alias("turnover"))
    # A calendar by a table of settings.
    series = runs.join(dates.select("t")).join(earned, [*by, "t"], "left").join(moved, [*by, "t"], "left").fillna(0.0, ["gross", "turnover", "exposure"])
    return series.select(*by, F.col("t").alias("date"), "gross", (F.col("gross") - bps * 1e-4 * F.col("turnover")).alias("net"), "turnover", "exposure")


def summaries(daily: DataFrame, *by: str) -> DataFrame:
    """One row a run: gross and net mean, Sharpe ratio and total, hit rate, deepest fall, turnover, active dates."""
    held = F.col("exposure") > 0
    out = daily.groupBy(*by).agg(
        F.count("*").alias("dates"), F.count(F.when(held, 1)).alias("active"), F.avg("turnover").alias("turnover"),
        F.avg("gross").alias("gross_mean"), metrics.sharpe("gross").alias("gross_sharpe"), F.sum("gross").alias("gross_total"), F.avg((F.col("gross") > 0).cast("double")).alias("hit_rate"),
        F.avg("net").alias("net_mean"), metrics.sharpe("net").alias("net_sharpe"), F.sum("net").alias("net_total"),
    )
    return out.join(metrics.max_drawdown(daily, "net", *by), list(by))
