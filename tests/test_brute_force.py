"""Queries without SQL against plain NumPy and pandas over the collected panel."""

import math

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import edges
from panelforge.operators import kernels as K
from panelforge.operators import windows as W
from panelforge.plans import extras, research, signals
from panelforge.sources import files, panels


@pytest.fixture(scope="module")
def week(spark, sf):
    """The weekly panel with date numbers, in pandas."""
    return W.ordinal(panels.weekly(spark, sf)).toPandas().sort_values(["t", "ticker"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def scores(week):
    after = week[["t", "ticker", "ret"]].assign(t=week["t"] - 1)
    return week[["date", "t", "ticker", "sector", "sig"]].rename(columns={"sig": "score"}).merge(after, on=["t", "ticker"])


def ranges(n, train=104, test=52):
    return [(i, s - train, s, min(s + test, n + 1)) for i, s in enumerate(range(train, n + 1, test))]


def wide(rows, value):
    m = rows.pivot_table(index="t", columns="ticker", values=value).sort_index()
    sd = m.std(ddof=0)
    m = m[sd[np.isfinite(sd) & (sd > 1e-12)].index]
    return ((m - m.mean()) / m.std(ddof=0)).fillna(0.0)


def blocks(scores, solver, by_sector=True, least=4):
    """{(window, sector, src, tgt): w} of every training block."""
    out = {}
    for w, lo, hi, _ in ranges(scores["t"].max()):
        train = scores[(scores["t"] >= lo) & (scores["t"] < hi)]
        for sector, rows in train.groupby("sector") if by_sector else [(None, train)]:
            x, y = wide(rows, "score"), wide(rows, "ret")
            x, y = x.align(y, join="inner", axis=0)
            if min(x.shape[1], y.shape[1]) >= least:
                m = solver(x.to_numpy(), y.to_numpy())
                out |= {(w, sector, s, t): m[i, j] for i, s in enumerate(x.columns) for j, t in enumerate(y.columns)}
    return out


def found(df, *keys):
    return {tuple(r[k] if k else None for k in keys): r["w"] for r in df.collect()}


def same(got, want, tol=1e-6):
    assert got.keys() == want.keys() and got
    assert max(abs(got[k] - want[k]) for k in got) < tol


def slow_ridge(x, y, lam=10.0):
    return np.linalg.inv(x.T @ x + lam * np.eye(x.shape[1])) @ x.T @ y


def test_block_models(spark, sf, scores):
    by = ("window", "sector", "src", "tgt")
    same(found(research.sector_block_ridge(spark, sf), *by), blocks(scores, slow_ridge))
    same(found(research.ols_block(spark, sf), *by), blocks(scores, lambda x, y: np.linalg.pinv(x) @ y))
    same(found(research.dense_ridge(spark, sf), "window", None, "src", "tgt"), blocks(scores, slow_ridge, False))
    lasso = found(research.lasso_block(spark, sf), *by)

    def conditions(x, y):
        return x.T @ y / len(x)

    cross, gram = blocks(scores, conditions), {}
    for w, lo, hi, _ in ranges(scores["t"].max()):
        for sector, rows in scores[(scores["t"] >= lo) & (scores["t"] < hi)].groupby("sector"):
            x = wide(rows, "score")
            gram |= {(w, sector, a, b): v for a, r in (x.T @ x / len(x)).iterrows() for b, v in r.items()}
    names = {}
    for w, sector, s, _ in lasso:
        names.setdefault((w, sector), set()).add(s)
    for (w, sector, s, t), b in lasso.items():
        grad = sum(gram[w, sector, s, r] * lasso[w, sector, r, t] for r in names[w, sector]) - cross[w, sector, s, t]
        assert abs(grad) <= 0.05 + 1e-4 and (abs(b) < 1e-12 or abs(grad + 0.05 * np.sign(b)) < 1e-4)


def test_penalised_and_thresholded_models(spark, sf, scores):
    by = ("window", "sector", "src", "tgt")
    value = lambda x, y, w: 0.5 * ((y - x @ w) ** 2).sum() + 0.5 * (w**2).sum() + 5.0 * np.linalg.svd(w, compute_uv=False).sum()
    got = found(research.nuclear_norm(spark, sf), *by)
    seen = []

    def at_a_minimum(x, y):
        seen.append((x, y))
        return np.zeros((x.shape[1], y.shape[1]))

    order = blocks(scores, at_a_minimum)
    cells, i = list(order), 0
    rng = np.random.default_rng(1)
    for x, y in seen:
        w = np.array([got[k] for k in cells[i : i + x.shape[1] * y.shape[1]]]).reshape(x.shape[1], y.shape[1])
        i += w.size
        best = value(x, y, w)
        assert all(value(x, y, w + rng.normal(size=w.shape) * step) >= best - 1e-6 for step in (1e-1, 1e-2, 1e-3) for _ in range(20))
    ridge = blocks(scores, slow_ridge)

    def rank_one(x, y):
        u, s, v = np.linalg.svd(slow_ridge(x, y).T)
        return (s[0] * np.outer(u[:, 0], v[0])).T

    want = {k: 0.0 if k[2] == k[3] else v for k, v in blocks(scores, rank_one).items()}
    same(found(research.lowrank_block(spark, sf), *by), want)
    assert ridge.keys() == want.keys()

    def cut(x, y):
        w = slow_ridge(x, y)
        u, s, v = np.linalg.svd(w, full_matrices=False)
        b = min(w.shape) / max(w.shape)
        if np.median(s) < 1e-14:
            return np.zeros_like(w)
        level = math.sqrt(2 * (b + 1) + 8 * b / (b + 1 + math.sqrt(b * b + 14 * b + 1))) / math.sqrt(K.bulk_median(b)) * np.median(s)
        return (u * np.where(s >= level, s, 0)) @ v

    same(found(research.gd_denoise(spark, sf), "window", None, "src", "tgt"), blocks(scores, cut, False))
    sector = dict(zip(scores["ticker"], scores["sector"], strict=True))
    for (w, s, t), v in {(k[0], k[2], k[3]): v for k, v in found(research.soft_block_ridge(spark, sf), "window", None, "src", "tgt").items() if k[0] == 0 and k[3] == min(scores["ticker"])}.items():
        x, y = (wide(scores[scores["t"] < 104], c) for c in ("score", "ret"))
        lam = np.diag([10.0 if sector[c] == sector[t] else 50.0 for c in x.columns])
        assert v == pytest.approx(float((np.linalg.inv(x.T @ x + lam) @ x.T @ y[t].to_numpy())[list(x.columns).index(s)]), abs=1e-6)


def predictions(scores, lam, spans):
    """(window, t, ticker, score) of block ridge fitted on the first range of each window and applied to the second, in return units."""
    out = []
    for w, (a, b), (c, d) in spans:
        train, test = scores[(scores["t"] >= a) & (scores["t"] < b)], scores[(scores["t"] >= c) & (scores["t"] < d)]
        for _, rows in train.groupby("sector"):
            x, y = wide(rows, "score"), wide(rows, "ret")
            x, y = x.align(y, join="inner", axis=0)
            if min(x.shape[1], y.shape[1]) < 4:
                continue
            m = pd.DataFrame(slow_ridge(x.to_numpy(), y.to_numpy(), lam), x.columns, y.columns)
            stats = rows.groupby("ticker")["score"].agg(["mean", lambda v: v.std(ddof=0) or 1.0])
            z = test[test["ticker"].isin(m.index)].copy()
            z["x"] = (z["score"] - z["ticker"].map(stats.iloc[:, 0])) / z["ticker"].map(stats.iloc[:, 1])
            p = z.pivot(index="t", columns="ticker", values="x").reindex(columns=m.index).fillna(0.0) @ m
            back = rows.groupby("ticker")["ret"].agg(["mean", lambda v: v.std(ddof=0)])
            p = p * back.iloc[:, 1].reindex(p.columns) + back.iloc[:, 0].reindex(p.columns)
            out.append(p.stack().rename("score").reset_index().set_axis(["t", "ticker", "score"], axis=1).assign(window=w))
    return pd.concat(out)


def spread_of(rows, q=0.2):
    out = {}
    for d, g in rows.dropna(subset=["score"]).groupby("t"):
        k = max(1, math.floor(len(g) * q))
        g = g.sort_values(["score", "ticker"])
        if len(g) >= 2 and 2 * k <= len(g):
            out[d] = g["ret"].iloc[-k:].mean() - g["ret"].iloc[:k].mean()
    return out


def walked(scores, lam=10.0):
    spans = [(w, (a, b), (b, c)) for w, a, b, c in ranges(scores["t"].max())]
    p = predictions(scores, lam, spans).sort_values("window").groupby(["t", "ticker"]).last().reset_index()
    return p[["t", "ticker", "score"]].merge(scores[["t", "ticker", "sector", "ret", "date"]], on=["t", "ticker"])


def test_walk_forward(spark, sf, scores):
    p = walked(scores)
    p["score"] = p["score"].round(9)
    want = spread_of(p)
    date = dict(zip(scores["date"], scores["t"], strict=True))
    got = {date[r.date]: (r.spread, r.ic) for r in research.walkforward_ridge(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[t][0] == pytest.approx(want[t], abs=1e-9) for t in want)
    ic = p.groupby("t")[["score", "ret"]].apply(lambda g: g["score"].rank().corr(g["ret"].rank()))
    assert all(got[t][1] is None and math.isnan(ic[t]) or got[t][1] == pytest.approx(ic[t], abs=1e-6) for t in want)
    weight, before, net = {}, {}, {}
    for t, g in p.groupby("t"):
        g, k = g.sort_values(["score", "ticker"]), max(1, math.floor(len(g) * 0.2))
        if t not in want:
            continue
        weight = {**{x: 1 / k for x in g["ticker"].iloc[-k:]}, **{x: -1 / k for x in g["ticker"].iloc[:k]}}
        net[t] = want[t] - 10 * 1e-4 * 0.5 * sum(abs(weight.get(x, 0) - before.get(x, 0)) for x in {*weight, *before})
        before = weight
    got = {date[r.date]: r.net for r in research.walkforward_costs(spark, sf).collect()}
    assert got.keys() == net.keys() and all(got[t] == pytest.approx(net[t], abs=1e-7) for t in net)


def test_parameter_sweep(spark, sf, scores):
    rows = research.param_sweep(spark, sf).collect()
    assert len(rows) == 64 and [r.sharpe for r in rows] == sorted((r.sharpe for r in rows), reverse=True)
    p = walked(scores, 1.0)
    last = {}
    pnl = []
    for t, g in p.groupby("t"):
        g, k = g.sort_values(["score", "ticker"]), max(1, math.floor(len(g) * 0.1))
        if t % 4 == 0 and len(g) >= 2 and 2 * k <= len(g):
            last = {"t": t, **{x: 1 / k for x in g["ticker"].iloc[-k:]}, **{x: -1 / k for x in g["ticker"].iloc[:k]}}
        if last and last["t"] == t - t % 4:
            pnl.append(sum(last.get(x, 0) * r for x, r in zip(g["ticker"], g["ret"], strict=True)))
    (r,) = [r for r in rows if (r.lam, r.q, r.every) == (1.0, 0.1, 4)]
    assert r.n_obs == len(pnl) and r.mean == pytest.approx(np.mean(pnl), abs=1e-9) and r.sharpe == pytest.approx(np.mean(pnl) / np.std(pnl, ddof=1), rel=1e-6)


def test_static_sweep(spark, sf, scores):
    cut = int(scores["t"].nunique() * 0.9)
    early, late = scores[scores["t"] < cut], scores[scores["t"] >= cut]
    pairs = scores.groupby("ticker").size()
    table = lambda rows, c: rows.pivot(index="t", columns="ticker", values=c)[pairs.index[pairs >= 30]]
    x, y, future, ret = table(early, "score"), table(early, "ret"), table(late, "score"), table(late, "ret")
    mx, sx, my, sy = x.mean(), x.std(ddof=0), y.mean(), y.std(ddof=0)
    zx, zy, zf = ((x - mx) / sx).fillna(0.0), ((y - my) / sy).fillna(0.0), ((future - mx) / sx).fillna(0.0)
    sector = scores.groupby("ticker")["sector"].first()
    same = sector[zx.columns].to_numpy()[:, None] == sector[zx.columns].to_numpy()[None]
    sharpe = lambda v: np.mean(v) / np.std(v, ddof=1) * 252**0.5

    def spread(p, r):
        k = max(1, math.floor(len(p) * 0.2))
        order = sorted(p.index, key=lambda c: (p[c], c))
        return r[order[-k:]].mean() - r[order[:k]].mean()

    want = {}
    for lam in research.STATIC:
        block = np.zeros(same.shape)
        for s in sector.unique():
            at = np.flatnonzero(sector[zx.columns] == s)
            if len(at) >= 4:
                block[np.ix_(at, at)] = slow_ridge(zx.to_numpy()[:, at], zy.to_numpy()[:, at], lam)
        own = np.diag((zx * zy).sum() / ((zx**2).sum() + lam))
        off = block * (1 - np.eye(len(same)))
        for model, w in {"dense": slow_ridge(zx.to_numpy(), zy.to_numpy(), lam), "diagonal_only": own, "sector_block": block, "sector_offdiag": off}.items():
            p = ((zf @ w).set_axis(zx.columns, axis=1) * sy + my).round(9).where(ret.notna())
            plain, neutral, ic = [], [], []
            for t in p.index:
                a, r = p.loc[t].dropna(), ret.loc[t].dropna()
                plain.append(spread(a, r))
                parts = [spread(g, r[g.index]) for _, g in a.groupby(sector) if len(g) >= 4]
                neutral += [np.mean(parts)] if parts else []
                ic.append(a.rank().corr(r.rank()))
            want[model, lam] = (sharpe(neutral), sharpe(plain), np.nanmean(ic))
    rows = research.static_sweep(spark, sf).collect()
    assert len(rows) == len(want) == 28
    for r in rows:
        assert (r.sharpe_neutral, r.sharpe, r.ic) == pytest.approx(want[r.model, r.lam], abs=1e-5), (r.model, r.lam)
    for model in {m for m, _ in want}:
        order = sorted((lam for m, lam in want if m == model), key=lambda lam: (*(-round(v, 6) for v in want[model, lam]), lam))
        assert [r.lam for r in sorted((r for r in rows if r.model == model), key=lambda r: r.rank)] == order


@pytest.mark.parametrize("query, last", [(research.lambda_select, 0), (extras.lambda_holdout_share, 21), (extras.lambda_holdout_days, 13)])
def test_penalties(spark, sf, scores, query, last):
    want = {}
    for w, a, b, _ in ranges(scores["t"].max()):
        g = scores[(scores["t"] >= a) & (scores["t"] < b)].copy()
        for c in ("score", "ret"):
            sd = g.groupby("ticker")[c].transform(lambda v: v.std(ddof=0))
            g[c] = (g[c] - g.groupby("ticker")[c].transform("mean")) / sd.where(sd > 0, 1.0)
        early, late = (g[g["t"] < b - last], g[g["t"] >= b - last]) if last else (g, g)
        for lam in research.GRID:
            parts = []
            for sector, rows in early.groupby("sector"):
                x, y = (rows.pivot(index="t", columns="ticker", values=c).fillna(0.0) for c in ("score", "ret"))
                if x.shape[1] >= 4:
                    m = pd.DataFrame(slow_ridge(x.to_numpy(), y.to_numpy(), lam), x.columns, y.columns)
                    z = late[late["sector"] == sector].pivot(index="t", columns="ticker", values="score").reindex(columns=m.index).fillna(0.0)
                    parts.append((z @ m).stack().rename("p").reset_index().set_axis(["t", "ticker", "p"], axis=1))
            p = pd.concat(parts).merge(late[["t", "ticker", "ret"]], on=["t", "ticker"])
            ic = p.groupby("t")[["p", "ret"]].apply(lambda g: g["p"].round(12).rank().corr(g["ret"].rank())).mean()
            want.setdefault(w, []).append(ic)
    got = {r.window: (r.lam, r.ic) for r in query(spark, sf).collect()}
    assert got.keys() == want.keys()
    for w, (lam, ic) in got.items():
        assert ic == pytest.approx(max(want[w]), abs=2e-3) and want[w][research.GRID.index(lam)] == pytest.approx(max(want[w]), abs=2e-3)


def slow_edges(week, size, lag=1):
    """{(window, tgt, src): (n, mean, sd)} of ret times the earlier signal, within windows of dates."""
    out = {}
    w = week.assign(window=week["t"] // size if size else 0)
    j = w.merge(w.assign(t=w["t"] + lag), on=["window", "t"], suffixes=("", "_s"))
    j["v"] = j["ret"] * j["sig_s"]
    for k, g in j.groupby(["window", "ticker", "ticker_s"])["v"]:
        out[k] = (len(g), g.mean(), g.std(ddof=1))
    return out


def t_tail(t, df, steps=200_001):
    """Two-sided tail of Student's t by a plain sum over the density."""
    x = np.linspace(0, abs(t), steps)
    d = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * float(((d[1:] + d[:-1]) / 2).sum() * (x[1] - x[0]))


def kept(p, q=0.1):
    """Benjamini and Hochberg over {key: p}."""
    order = sorted((v, k) for k, v in p.items() if v is not None)
    top = max((v for i, (v, _) in enumerate(order) if v <= q * (i + 1) / len(order)), default=-1)
    return {k: v is not None and v <= top for k, v in p.items()}


def test_edge_p_values_and_false_discovery(spark, sf, week):
    want = slow_edges(week, 120)
    rows = research.edge_p_values(spark, sf).collect()
    got = {(r.window, r.tgt, r.src): r for r in rows}
    assert got.keys() == want.keys()
    for k in sorted(got)[::211]:
        n, mu, sd = want[k]
        t = mu / sd * math.sqrt(n)
        assert got[k].tstat == pytest.approx(t, rel=1e-6) and got[k].p == pytest.approx(t_tail(t, n - 1), abs=1e-6)
    for w in {k[0] for k in got}:
        mine = {k: r.p for k, r in got.items() if k[0] == w}
        assert {k: got[k].keep for k in mine} == kept(mine)
    whole = slow_edges(week, 0)
    rows = {(0, r.tgt, r.src): r for r in research.bh_mask(spark, sf).collect()}
    p = {k: math.erfc(abs(mu / sd * math.sqrt(n)) / math.sqrt(2)) for k, (n, mu, sd) in whole.items()}
    assert rows.keys() == p.keys() and all(rows[k].p == pytest.approx(p[k], abs=1e-9) for k in p)
    assert {k: r.keep for k, r in rows.items()} == kept({k: r.p for k, r in rows.items()})


@pytest.mark.parametrize("by", [(), ("g",)])
def test_false_discovery_with_ties_nulls_and_none(spark, by):
    rng = np.random.default_rng(1)
    rows = []
    for g in (None, "a", "b"):
        p = [*(rng.random(200) ** 3).tolist(), *np.round(rng.random(40), 2).tolist(), 0.0, 0.0, None, None]
        rows += [(g, f"t{i}", "s", v) for i, v in enumerate(p)]
    schema = "g string, tgt string, src string, p double"
    for some in (rows, [(*r[:3], None) for r in rows], []):
        out = edges.false_discovery(spark.createDataFrame(some, schema), 0.1, "p", *by).collect()
        assert len(out) == len(some)
        got = {(r.g or "null", r.tgt): r.keep for r in out}
        for g in {r[0] if by else "all" for r in some}:
            mine = {(r[0] or "null", r[1]): r[3] for r in some if not by or r[0] == g}
            assert {k: got[k] for k in mine} == kept(mine)


def matrices(week, size, stat, lag=1):
    """Windows' matrices of targets by sources, and their names."""
    e = slow_edges(week, size, lag)
    for w in sorted({k[0] for k in e}):
        t, s = sorted({k[1] for k in e if k[0] == w}), sorted({k[2] for k in e if k[0] == w})
        m = np.array([[stat(*e[w, a, b]) if (w, a, b) in e else 0.0 for b in s] for a in t])
        yield w, t, s, np.nan_to_num(m)


def sided(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.window, r.side), {})[r.ticker] = r["value"]
    return out


def test_biclusters(spark, sf, week):
    tstat = lambda n, mu, sd: mu / sd * math.sqrt(n) if sd and sd > 0 else 0.0
    level = lambda n, mu, sd: mu / sd if sd and sd > 0 else 0.0
    dst, sparse, factor, co, spec = (sided(q(spark, sf)) for q in (research.dst_bicluster, research.sparse_bicluster, research.block_factor, research.dhillon, research.spectral_blocks))
    for w, t, s, m in matrices(week, 120, tstat):
        a = np.abs(m)
        rows, cols = (np.array([dst[w, side][x] for x in names]) > 0 for side, names in (("target", t), ("source", s)))
        assert rows.sum() == min(8, len(t)) and cols.sum() == min(8, len(s))
        # Neither side gains by an exchange.
        into, out = a[:, cols].sum(1), a[rows].sum(0)
        assert into[rows].min() >= into[~rows].max(initial=-1) - 1e-9 and out[cols].min() >= out[~cols].max(initial=-1) - 1e-9
        u, v = (np.array([sparse[w, side][x] for x in names]) for side, names in (("target", t), ("source", s)))
        assert (u > 0).sum() <= 8 and (v > 0).sum() <= 8 and np.linalg.norm(u) == pytest.approx(1) and np.linalg.norm(v) == pytest.approx(1)
        near = a @ v
        assert set(np.flatnonzero(u)) == set(np.argsort(-near, kind="stable")[:8]) and np.allclose(u[u > 0], near[u > 0] / np.linalg.norm(near[u > 0]), atol=1e-6)
    for w, t, s, m in matrices(week, 120, level):
        load, weight = (np.array([factor[w, side][x] for x in names]) for side, names in (("target", t), ("source", s)))
        u, d, vt = np.linalg.svd(m)
        assert np.abs(load).sum() == pytest.approx(1) and weight.sum() >= -1e-9
        assert abs(load @ u[:, 0]) == pytest.approx(np.linalg.norm(load), rel=1e-6) and abs(weight @ vt[0]) == pytest.approx(np.linalg.norm(weight), rel=1e-6)
        for labels, z in ((co, embedded(m, 4)), (spec, None)):
            lab = np.array([labels[w, "target"][x] for x in t] + ([labels[w, "source"][x] for x in s] if labels is co else []))
            assert len(set(lab)) <= 4
            if z is not None:
                cost = lambda lab: sum(((z[lab == c] - z[lab == c].mean(0)) ** 2).sum() for c in set(lab))  # noqa: B023, E731
                # No single name is better off in another cluster, its centres fixed.
                centre = {c: z[lab == c].mean(0) for c in set(lab)}
                assert all(min(centre, key=lambda c: ((z[i] - centre[c]) ** 2).sum()) == lab[i] or np.isclose(((z[i] - centre[lab[i]]) ** 2).sum(), min(((z[i] - c) ** 2).sum() for c in centre.values())) for i in range(len(z)))
                assert cost(lab) <= cost(np.random.default_rng(0).permutation(lab)) + 1e-12


def embedded(m, k):
    a = np.abs(m)
    dr, dc = 1 / np.sqrt(a.sum(1)), 1 / np.sqrt(a.sum(0))
    u, _, vt = np.linalg.svd(dr[:, None] * a * dc)
    g = math.ceil(math.log2(k))
    return np.vstack([dr[:, None] * u[:, 1 : g + 1], dc[:, None] * vt[1 : g + 1].T])


def test_trading_matrix_and_screens(spark, sf, week):
    e = slow_edges(week, 120)
    sets = sided(research.dst_bicluster(spark, sf))
    want = {}
    for (w, tgt, src), (n, mu, sd) in e.items():
        t = mu / sd * math.sqrt(n) if sd > 0 else 0
        if abs(t) >= 1.0 and n >= 30 and sets[w, "target"].get(tgt) and sets[w, "source"].get(src):
            for r in week[(week["ticker"] == src) & (week["t"] // 120 == w + 1)].itertuples():
                want[w, r.t + 1, tgt] = want.get((w, r.t + 1, tgt), 0) + math.copysign(1, t) * r.sig
    got = {(r.window, r.t, r.ticker): r.score for r in extras.bicluster_scores(spark, sf).collect()}
    assert got.keys() == want.keys() and got and all(got[k] == pytest.approx(want[k]) for k in got)
    e = slow_edges(week, 60)
    masks = {}
    for (w, tgt, src), (n, mu, sd) in e.items():
        t = abs(mu / sd * math.sqrt(n)) if sd and sd > 0 else 0
        masks.setdefault(w, {}).setdefault(0 if t >= 3.5 and n >= 30 else 1 if n >= 30 else 2, set()).add((tgt, src))
    rows = extras.screened_edges(spark, sf).collect()
    for w, m in masks.items():
        assert {(r.tgt, r.src) for r in rows if r.window == w} == m[min(m)]
    n = week["ticker"].nunique()
    assert [(r.tests, r.expected) for r in extras.expected_false_positives(spark, sf).collect()] == [(n * (n - 1), pytest.approx(n * (n - 1) * math.erfc(t / math.sqrt(2)))) for t in (1.5, 2.0, 3.0)]


def test_ensembles(spark, sf, scores):
    gross = pd.Series(spread_of(scores))
    per = pd.DataFrame({s: spread_of(g[g.groupby("t")["score"].transform("count") >= 4]) for s, g in scores.groupby("sector")}).mean(axis=1).rename("sn")
    j = pd.DataFrame({"a": gross, "b": per}).dropna().sort_index()
    s = (j.rolling(60).mean() / (j.rolling(60).std() + 1e-9)).clip(lower=0).shift(1)
    share = (s["a"] / (s["a"] + s["b"]).replace(0, np.nan)).fillna(0.5)
    want = share * j["a"] + (1 - share) * j["b"]
    date = dict(zip(scores["date"], scores["t"], strict=True))
    got = {date[r.date]: r.spread for r in research.ensemble_srw(spark, sf).collect()}
    assert got.keys() == set(want.index) and all(got[t] == pytest.approx(want[t], abs=2e-6) for t in got)
    grid = scores.pivot(index="t", columns="ticker", values="score")
    smooth = {}
    for c in grid:
        last = None
        for t, v in grid[c].items():
            last = None if np.isnan(v) else v if last is None else 0.3 * v + 0.7 * last
            if last is not None:
                smooth[t, c] = last
    e = scores.assign(ema=[smooth[t, c] for t, c in zip(scores["t"], scores["ticker"], strict=True)])
    e["score"] = (e.groupby("t")["ema"].rank(pct=True) + e.groupby("t")["score"].rank(pct=True)) / 2
    want = spread_of(e)
    got = {date[r.date]: r.spread for r in extras.smoothed_ensemble(spark, sf).collect()}
    assert got.keys() == want.keys() and np.mean([abs(got[t] - want[t]) < 2e-6 for t in got]) > 0.98


def test_cluster_blocks(spark, sf, scores):
    got = extras.cluster_block_ridge(spark, sf).toPandas()
    for w, lo, hi, _ in ranges(scores["t"].max()):
        train = scores[(scores["t"] >= lo) & (scores["t"] < hi)]
        for _, g in got[got["window"] == w].groupby("cluster"):
            rows = train[train["ticker"].isin(set(g["src"]))]
            x, y = wide(rows, "score"), wide(rows, "ret")
            m = pd.DataFrame(slow_ridge(x.to_numpy(), y.to_numpy()), x.columns, y.columns)
            assert len(g) == m.size and all(v == pytest.approx(m.loc[s, t], abs=1e-6) for s, t, v in zip(g["src"], g["tgt"], g["w"], strict=True))
        assert got[got["window"] == w].groupby("src")["cluster"].nunique().max() == 1


def test_integrated_imbalance(spark, sf):
    from panelforge.functions import scalars as S

    s = panels.snapshots(spark, sf).withColumn("ofi", S.flow_imbalance()).select("ticker", "seq", "level", "ofi").toPandas()
    s["ofi"] = s["ofi"].where(np.isfinite(s["ofi"].astype(float)), 0.0).astype(float)
    want = {}
    for ticker, g in s.groupby("ticker"):
        m = g.pivot(index="seq", columns="level", values="ofi").fillna(0.0)
        v = np.linalg.eigh(np.cov(m.to_numpy(), rowvar=False))[1][:, -1]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        want |= {(ticker, q): float(x) for q, x in (m @ v).items()}
    got = {(r.ticker, r.seq): r.iofi for r in signals.iofi_pca(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_panel_regressors(spark, sf, scores):
    s = scores.assign(pct=scores.groupby("t")["score"].rank(pct=True), dev=scores["score"] - scores.groupby(["t", "sector"])["score"].transform("mean"))
    cols = ["score", "pct", "dev"]
    train, test = s[s["t"] < 250], s[s["t"] >= 250]
    z = (train[cols] - train[cols].mean()) / train[cols].std(ddof=0)
    y = train["ret"] - train["ret"].mean()
    n, errors = len(z), []
    for lam in research.ALPHAS:
        hat = z.to_numpy() @ np.linalg.inv(z.T @ z + lam * np.eye(3)) @ z.to_numpy().T
        errors.append((((y - hat @ y) / (1 - np.diag(hat) - 1 / n)) ** 2).mean())
    w = np.linalg.inv(z.T @ z + research.ALPHAS[int(np.argmin(errors))] * np.eye(3)) @ z.T @ y
    want = ((test[cols] - train[cols].mean()) / train[cols].std(ddof=0)) @ w.to_numpy() + train["ret"].mean()
    want = dict(zip(zip(test["date"], test["ticker"], strict=True), want, strict=True))
    got = {(r.date, r.ticker): r.score for r in research.panel_ridge(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in got)


def test_archives_and_zips(spark, tmp_path):
    import gzip
    import zipfile

    for year, days in (("2012", ("20120103", "20121231", "bad")), ("2013", ("20130102",)), ("2014", ("20140102",))):
        with zipfile.ZipFile(tmp_path / f"{year}.zip", "w") as z:
            for d in days:
                z.writestr(f"{year}/{d}.csv.gz", gzip.compress(f"ticker,other,OPCL,SIC\nA,1,{d[-1]}.5,10\nB,2,x,\nC,3,1,1\n".encode()))
            z.writestr("readme.txt", "none")
    got = files.read_daily_zips(spark, str(tmp_path), "ticker", {"opcl": "OPCL", "sic": "SIC"}, "2012-06-01", "2013-12-31", ["A", "B"])
    assert sorted((str(r.date), r.ticker, r.opcl, r.sic) for r in got.collect()) == [("2012-12-31", "A", 1.5, 10.0), ("2012-12-31", "B", None, None), ("2013-01-02", "A", 2.5, 10.0), ("2013-01-02", "B", None, None)]
    names = spark.createDataFrame([("x__BF-B_2013-01-02_2013-12-31_10.7z",), ("C3_2012-01-03_2012-06-29_5.7z",), ("BRK.B_2012-01-03_2012-12-31_1.7z",), ("no.7z",)], "archive string")
    assert [r.ticker for r in files.archive_index(names).collect()] == [None, "BF-B", "C3"]


def test_daily_walk_forward(spark, monkeypatch):
    """Differences of running moments against a refit of every window; the smallest tables have too few days a name."""
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(research, "DAYS", 400)
    monkeypatch.setattr(research, "EVERY", 90)
    s = research.daily_scored(spark, sf).toPandas()
    want = {}
    for te0 in range(400, int(s["t"].max()) + 1, 90):
        rows, te1 = s[(s["t"] >= te0 - 400) & (s["t"] < te0 + 90)], te0 + 90
        train = rows[rows["t"] < te0 - 1]
        n = rows.groupby("ticker").size()
        for _, g in train[train["ticker"].isin(n[n >= 30].index)].groupby("sector"):
            x, y = (g.pivot(index="t", columns="ticker", values=c) for c in ("score", "ret"))
            keep = [c for c in x.columns if x[c].std(ddof=0) > 1e-9 and y[c].std(ddof=0) > 1e-9]
            if len(keep) < 4:
                continue
            x, y = x[keep], y[keep]
            zx, zy = (((m - m.mean()) / m.std(ddof=0)).fillna(0.0) for m in (x, y))
            w = slow_ridge(zx.to_numpy(), zy.to_numpy())
            late = s[(s["t"] >= te0) & (s["t"] < te1) & s["ticker"].isin(keep)]
            z = ((late.pivot(index="t", columns="ticker", values="score").reindex(columns=keep) - x.mean()) / x.std(ddof=0)).fillna(0.0)
            p = z.to_numpy() @ w * y.std(ddof=0).to_numpy() + y.mean().to_numpy()
            p = pd.DataFrame(p, z.index, keep)
            want |= {(r.date, r.ticker): p.loc[r.t, r.ticker] for r in late.itertuples()}
    got = {(r.date, r.ticker): r.score for r in research.walkforward_daily(spark, sf).collect()}
    assert got.keys() == want.keys() and len(want) > 1000
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_own_coefficients_are_blended(spark, sf, scores):
    want = {k: v / 2 if k[2] == k[3] else v for k, v in blocks(scores, slow_ridge).items()}
    same(found(research.blended_block(spark, sf), "window", "sector", "src", "tgt"), want)
