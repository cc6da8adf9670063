"""Sweeps of edge and cluster settings against plain NumPy on a planted panel."""

import math
from itertools import product

import numpy as np
import pytest

from panelforge.operators import edges as E
from panelforge.operators import kernels as K
from panelforge.operators import models as M
from panelforge.operators import sweeps as V
from panelforge.plans import sweeps

TRAIN, REFIT, EVERY = 60, 21, 5
LEVELS, COUNTS = (1.0, 2.5, 9.0), (2, 45)
RATES, LEAST, CLUSTERS = (0.05, 0.2), (30, 50, 100), (2, 3)


@pytest.fixture(scope="module")
def planted():
    """Signals and returns, dates by names: 4 of 12 names follow 4 others; cells are missing on either side."""
    rng = np.random.default_rng(11)
    sig = rng.normal(size=(130, 12))
    ret = rng.normal(size=(130, 12))
    ret[1:, :4] += 0.5 * sig[:-1, 8:].sum(axis=1, keepdims=True)
    sig[rng.random(sig.shape) < 0.1] = np.nan
    ret[rng.random(ret.shape) < 0.1] = np.nan
    return sig, ret


@pytest.fixture(scope="module")
def walked(spark, planted):
    sig, ret = planted
    cell = lambda v: None if math.isnan(v) else float(v)
    rows = [(t, f"n{j:02}", cell(sig[t, j]), cell(ret[t, j])) for t in range(len(sig)) for j in range(sig.shape[1])]
    p = spark.createDataFrame(rows, "t int, ticker string, sig double, ret double").persist()
    ranges = M.windows(p, TRAIN, REFIT)
    return p, ranges, E.edge_stats(M.in_window(p, ranges, "tr0", "tr1"), "sig", "ret", 1, "window")


def windows(n):
    return [(a, min(a + REFIT, n)) for a in range(TRAIN, n, REFIT)]


def slow_edges(sig, ret, a):
    """n, mean over deviation, and t of every (target, source) within the TRAIN dates before a."""
    s, r = sig[a - TRAIN : a - 1], ret[a - TRAIN + 1 : a]
    n, ratio = np.zeros((12, 12)), np.full((12, 12), np.nan)
    for i, j in product(range(12), range(12)):
        x = r[:, i] * s[:, j]
        x = x[np.isfinite(x)]
        n[i, j], ratio[i, j] = len(x), x.mean() / x.std(ddof=1)
    return n, ratio, ratio * np.sqrt(n)


def unit(x):
    return x / np.abs(x).sum() if np.abs(x).sum() > 1e-12 else np.zeros_like(x)


def measures(book, ret, bps):
    """gross, net Sharpe ratios, mean turnover, deepest fall of net, active dates of positions by date."""
    past, gross, net, turn = np.zeros(12), [], [], []
    for t in range(TRAIN, len(ret)):
        gross.append(float(book[t] @ np.nan_to_num(ret[t])))
        turn.append(np.abs(book[t] - past).sum())
        net.append(gross[-1] - bps / 1e4 * turn[-1])
        past = book[t]
    sharpe = lambda v: np.mean(v) / np.std(v, ddof=1) * 252**0.5 if np.std(v, ddof=1) > 1e-15 else None
    level = np.cumsum(net)
    return sharpe(gross), sharpe(net), np.mean(turn), (level - np.maximum.accumulate(level)).min(), sum(np.abs(book[t]).sum() > 0 for t in range(TRAIN, len(ret)))


def agree(rows, want, *run):
    assert {tuple(r[c] for c in run) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        got = (r.gross_sharpe, r.net_sharpe, r.turnover, r.max_drawdown, r.active)
        for x, y in zip(got, want[tuple(r[c] for c in run)], strict=True):
            assert (x is None and y is None) or x == pytest.approx(y, abs=1e-8), r


def test_trading_matrices_of_every_threshold(spark, planted, walked):
    sig, ret = planted
    p, ranges, e = walked
    want = {}
    for level, least in product(LEVELS, COUNTS):
        book = np.zeros(ret.shape)
        for a, b in windows(len(ret)):
            n, ratio, t = slow_edges(sig, ret, a)
            keep = (np.abs(t) >= level) & (n >= least) & ~np.eye(12, dtype=bool)
            w = np.where(keep, np.abs(t), 0.0)
            m = np.zeros((12, 12))
            if keep.any():
                w = np.minimum(w, np.quantile(w[w > 0], 0.99))
                order = lambda v: sorted(sorted(range(12), key=lambda i: (-v[i], i))[:5])
                src, seen = order(w.sum(0)), None
                while True:
                    tgt = order(w[:, src].sum(1))
                    src = order(w[tgt].sum(0))
                    if seen == (tgt, src):
                        break
                    seen = (tgt, src)
                m[np.ix_(tgt, src)] = np.where(keep, ratio, 0.0)[np.ix_(tgt, src)]
            for t0 in range(a, b, EVERY):
                raw = m @ np.nan_to_num(sig[t0 - 1])
                book[t0 : min(t0 + EVERY, b)] = unit(raw - raw.mean())
        want[level, least] = measures(book, ret, 7.0)
    dates = V.calendar(ranges, p, EVERY)
    weights = V.trading_matrices(e, LEVELS, COUNTS, 5, 5)
    book = V.matrix_positions(weights, p, dates, p.select("ticker").distinct(), "tstat_min", "min_count")
    runs = spark.createDataFrame(list(product(LEVELS, COUNTS)), "tstat_min double, min_count int")
    rows = V.summaries(V.daily_results(book, p, runs, dates, 7.0, "tstat_min", "min_count"), "tstat_min", "min_count").collect()
    agree(rows, want, "tstat_min", "min_count")
    assert {r.active for r in rows} >= {0, 70}, "no run without edges, or none that always trades"


def test_blocks_of_every_mask_and_number_of_clusters(spark, planted, walked):
    sig, ret = planted
    p, ranges, e = walked
    pv = {(r.window, r.tgt, r.src): r.p for r in E.p_values(e).collect()}
    want, used = {}, set()
    for q, least, k in product(RATES, LEAST, CLUSTERS):
        book = np.zeros(ret.shape)
        for i, (a, b) in enumerate(windows(len(ret))):
            n, ratio, t = slow_edges(sig, ret, a)
            ps = sorted((pv[i, f"n{x:02}", f"n{y:02}"], x, y) for x, y in product(range(12), range(12)))
            last = max((j for j, (v, _, _) in enumerate(ps, 1) if v <= q * j / len(ps)), default=0)
            kept = np.zeros((12, 12), bool)
            for _, x, y in ps[:last]:
                kept[x, y] = True
            for level, mask in enumerate((kept & (n >= least), n >= least, np.ones((12, 12), bool))):
                if not mask.any():
                    continue
                row, col = K.cocluster(np.where(mask, np.abs(t).round(9), 0.0), k)
                best = None
                for rc, cc in product(range(k), range(k)):
                    cells = [(x, y) for x, y in product(range(12), range(12)) if row[x] == rc and col[y] == cc and mask[x, y]]
                    if cells:
                        value = sum(ratio[c] * n[c] for c in cells) / sum(n[c] for c in cells)
                        load, weight = np.zeros(12), np.zeros(12)
                        for x in {x for x, _ in cells}:
                            load[x] = np.mean([ratio[c] for c in cells if c[0] == x])
                        for y in {y for _, y in cells}:
                            weight[y] = np.mean([ratio[c] for c in cells if c[1] == y])
                        if best is None or value > best[0]:
                            best = (value, unit(load), unit(weight))
                used.add(level)
                for day in range(a, b):
                    book[day] = unit(best[1] * float(best[2] @ np.nan_to_num(sig[day - 1])))
                break
        want[q, least, k] = measures(book, ret, 5.0)
    assert used == {0, 1, 2} or used == {0, 2}
    dates = V.calendar(ranges, p)
    blocks = V.cluster_blocks(E.p_values(e), RATES, LEAST, CLUSTERS)
    run = ("q", "min_count", "k")
    book = V.block_positions(blocks, p, dates, *run)
    runs = spark.createDataFrame(list(product(RATES, LEAST, CLUSTERS)), "q double, min_count int, k int")
    agree(V.summaries(V.daily_results(book, p, runs, dates, 5.0, *run), *run).collect(), want, *run)


def test_without_dates_there_are_runs_and_no_results(spark, walked):
    p, ranges, e = (x.where("1 = 0") for x in walked)
    dates = V.calendar(ranges, p)
    book = V.block_positions(V.cluster_blocks(E.p_values(e), RATES, LEAST, CLUSTERS), p, dates, "q", "min_count", "k")
    runs = spark.createDataFrame([(0.1, 2, 2)], "q double, min_count int, k int")
    assert V.daily_results(book, p, runs, dates, 5.0, "q", "min_count", "k").count() == 0


def test_discoveries_take_the_last_rank_that_passes():
    p = np.array([[0.01, 0.04], [0.03, np.nan], [0.9, 0.035]])
    assert K.discovered(p, 0.1).tolist() == [[True, True], [True, False], [False, True]]
    assert not K.discovered(np.full((2, 2), np.nan), 0.1).any()


def test_registered_sweeps_have_every_run(spark, sf):
    edges, clusters = sweeps.edge_sweep(spark, sf).collect(), sweeps.cluster_sweep(spark, sf).collect()
    assert len(edges) == 25 and len(clusters) == 27 and all(r.dates > 0 for r in edges + clusters)
    assert any(r.active for r in edges) and all(r.active for r in clusters)
    for rows, c in ((edges, "gross_sharpe"), (clusters, "net_sharpe")):
        known = [round(r[c], 6) for r in rows if r[c] is not None]
        assert known == sorted(known, reverse=True)
