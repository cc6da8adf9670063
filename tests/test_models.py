"""Kernels and operators against plain NumPy, brute force and identities."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import edges as E
from panelforge.operators import kernels as K
from panelforge.operators import models as M
from panelforge.operators import portfolio as P
from panelforge.operators import windows as W
from panelforge.sources import files
from panelforge.streaming import events as stream

RNG = np.random.default_rng(4)
X, Y = RNG.normal(size=(80, 6)), RNG.normal(size=(80, 4))


def test_ridge_meets_its_normal_equations():
    w = K.ridge(X, Y, 3.0)
    assert np.allclose(X.T @ (X @ w - Y) + 3.0 * w, 0)
    assert np.allclose(K.ridge(X, Y, np.full((6, 4), 3.0)), w)
    assert np.allclose(K.ols(X, Y), K.ridge(X, Y, 1e-10), atol=1e-6)


def test_lasso_meets_its_conditions():
    b, lam = K.lasso(X, Y, 0.05), 0.05
    grad = X.T @ (X @ b - Y) / len(X)
    assert np.all(np.abs(grad) <= lam + 1e-4) and np.allclose(grad[b != 0], -lam * np.sign(b[b != 0]), atol=1e-4)


def test_nuclear_shrinks_to_ridge_and_to_zero():
    assert np.allclose(K.nuclear(X, Y, 2.0, 0.0, 5000, 1e-12), K.ridge(X, Y, 2.0), atol=1e-5)
    assert np.allclose(K.nuclear(X, Y, 2.0, 1e6), 0)


def test_threshold_finds_a_planted_rank():
    u, v = np.linalg.qr(RNG.normal(size=(60, 2)))[0], np.linalg.qr(RNG.normal(size=(60, 2)))[0]
    w = 40 * u @ v.T + RNG.normal(size=(60, 60))
    clean, k = K.hard_threshold(w)
    assert k == 2 and np.linalg.norm(clean - 40 * u @ v.T) < np.linalg.norm(w - 40 * u @ v.T)
    assert K.bulk_median(1.0) == pytest.approx(0.6528, abs=1e-3)


def test_blocks_are_found():
    w = np.zeros((9, 9))
    w[:4, 5:] = 1
    w[4:, :5] = 1
    t, s = K.alternating(w + np.eye(9) * 0.01, 4, 4)
    r, c = K.cocluster(w + 1e-6, 2)
    assert (set(t), set(s)) in (({0, 1, 2, 3}, {5, 6, 7, 8}),) or w[np.ix_(t, s)].all()
    assert len(set(r[:4])) == 1 and r[0] != r[8] and c[5] == r[0] and c[0] == r[8]
    u, v = K.sparse_rank_one(w, 4, 4)
    assert w[np.ix_(np.flatnonzero(u), np.flatnonzero(v))].all()
    a = np.kron(np.eye(3), np.ones((4, 4)))
    assert [len(set(K.spectral(a + 0.01, 3)[i : i + 4])) for i in (0, 4, 8)] == [1, 1, 1]
    load, weight = K.block_factor(np.outer([1.0, -1.0, 2.0], [1.0, 3.0]))
    assert weight == pytest.approx([0.25, 0.75]) and load == pytest.approx([0.25, -0.25, 0.5])


def test_leave_one_out_is_refitting():
    y = X @ RNG.normal(size=6) + RNG.normal(size=80)
    lams = (0.1, 10.0, 1000.0)
    err = [np.mean([(y[i] - X[i] @ K.ridge(np.delete(X, i, 0), np.delete(y, i)[:, None], lam)[:, 0]) ** 2 for i in range(80)]) for lam in lams]
    lam, w = K.leave_one_out_ridge(X, y, lams)
    assert lam == lams[int(np.argmin(err))] and np.allclose(w, K.ridge(X, y[:, None], lam)[:, 0])


def test_student_and_normal_p_values(spark):
    e = spark.createDataFrame([("a", "b", 11, 2.228), ("a", "c", 31, 2.042), ("a", "d", 5, None)], "tgt string, src string, n long, tstat double")
    p = {r.src: r.p for r in E.p_values(e).collect()}
    assert p["b"] == pytest.approx(0.05, abs=1e-4) and p["c"] == pytest.approx(0.05, abs=1e-4) and p["d"] is None
    assert {r.src: r.p for r in E.p_values(e, False).collect()}["b"] == pytest.approx(math.erfc(2.228 / 2**0.5))


def test_block_fits_are_the_kernels(spark):
    rows = [(0, "s", t, f"n{j}", float(X[t, j]), float(Y[t, j])) for t in range(80) for j in range(4)] + [(1, "s", t, f"n{j}", 1.0, 1.0) for t in range(9) for j in range(3)]
    train = spark.createDataFrame(rows, "window int, sector string, t int, ticker string, x double, y double")
    got = M.fit_blocks(train, lambda x, y: K.ridge(x, y, 2.0), "window", "sector").toPandas()
    z = lambda m: (m - m.mean(0)) / m.std(0)
    assert np.allclose(got.pivot(index="src", columns="tgt", values="w").to_numpy(), K.ridge(z(X[:, :4]), z(Y), 2.0)) and set(got["window"]) == {0}


def test_windows_overlap_and_end_with_the_calendar(spark):
    p = spark.range(30).withColumnRenamed("id", "t")
    assert [tuple(r) for r in M.windows(p, 10, 8).collect()] == [(0, 0, 10, 10, 18), (1, 8, 18, 18, 26), (2, 16, 26, 26, 30)]
    assert M.windows(p, 10, 8, step=4, skip_first=True).count() == 5
    assert M.windows(p.limit(0), 10, 8).count() == 0


def test_ema_starts_anew_after_a_gap(spark):
    x = [1.0, 3.0, None, 5.0, 7.0]
    grid = spark.createDataFrame([(i, "a", v) for i, v in enumerate(x)], "date int, ticker string, x double")
    assert [r.ema for r in W.ema(grid, "x", 0.5).orderBy("date").collect()] == [1.0, 2.0, 5.0, 6.0]


def test_sides_of_small_and_tied_groups(spark):
    s = spark.createDataFrame([("d", t, 0, 1.0, float(i)) for i, t in enumerate("abcde")] + [("e", "a", 0, 1.0, 1.0)], "date string, ticker string, sector int, score double, ret double")
    got = {r.ticker: r.side for r in P.sides(s, 0.2, "date").collect()}
    assert got == {"a": -1, "b": 0, "c": 0, "d": 0, "e": 1}
    assert P.breakeven(s.select("date", F.lit(1.0).alias("spread")), s.select("date", F.lit(0.0).alias("turnover"))).first()[0] is None


def test_matrices_of_all_formats(spark, tmp_path):
    wide = pd.DataFrame({"date": ["2020-01-01", "2020-01-02"], "A": ["1.5", "x"], "B": ["2", "3"]})
    wide.to_csv(tmp_path / "m.csv", index=False)
    wide.to_parquet(tmp_path / "m.parquet")
    for kind in ("csv", "parquet"):
        got = {(str(r.date), r.ticker): r.value for r in files.read_matrix(spark, f"{tmp_path}/m.{kind}").collect()}
        assert got == {("2020-01-01", "A"): 1.5, ("2020-01-02", "A"): None, ("2020-01-01", "B"): 2.0, ("2020-01-02", "B"): 3.0}
    np.save(tmp_path / "m.npy", np.array([[1.0, np.nan]]))
    assert [tuple(r) for r in files.read_matrix(spark, f"{tmp_path}/m.npy").collect()] == [(0, 0, 1.0), (0, 1, None)]
    np.save(tmp_path / "v.npy", np.zeros(3))
    with pytest.raises(ValueError):
        files.read_matrix(spark, f"{tmp_path}/v.npy")
    (tmp_path / "book.csv").write_text("time,bid_1,ask_1, bid_size_1,ask_size_1\n09:30,1,2,3,bad\n")
    assert [tuple(r)[1:] for r in files.read_snapshots(spark, f"{tmp_path}/book.csv").collect()] == [("09:30", 1, 1.0, 2.0, 3.0, None)]
    assert files.read_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    df = spark.createDataFrame([("a", 1), ("b", 2)], "ticker string, n int")
    files.write_by(df, f"{tmp_path}/out", "ticker")
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a"), (2, "b")]
    files.write_json(df, f"{tmp_path}/json")
    files.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    assert files.list_archives(spark, f"{tmp_path}/csv").count() > 0


def test_streams_give_the_batch_rows(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    run = lambda df, name, mode: df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
    run(stream.windowed(stream.read_events(spark, f"{tmp_path}/in")), "hours", "complete")
    assert spark.table("hours").agg(F.sum("n")).first()[0] == batch.count()
    book = stream.read_events(spark, f"{tmp_path}/in").select(F.col("event_type").alias("ticker"), F.col("event_id").alias("seq"), F.col("value").alias("bid"), (F.col("value") + 1).alias("ask"), F.lit(2.0).alias("bid_size"), F.lit(3.0).alias("ask_size"))
    run(stream.stateful_imbalance(book), "flow", "append")
    assert spark.table("flow").count() == batch.count() - batch.select("event_type").distinct().count()


def test_panel_penalty_is_that_of_refitting_without_each_row(spark):
    x = RNG.normal(size=(40, 3)) * [1, 5, 0.1] + [3, 0, 1]
    y = x @ [0.3, 0.01, 1.0] + RNG.normal(size=40) * 2 + 7
    z = (x - x.mean(0)) / x.std(0)
    lams = (0.01, 10.0, 1000.0)

    def fit(keep, lam):
        m = z[keep].mean(0)
        w = K.ridge(z[keep] - m, (y[keep] - y[keep].mean())[:, None], lam)[:, 0]
        return w, y[keep].mean() - m @ w

    err = []
    for lam in lams:
        fits = [fit(np.arange(40) != i, lam) for i in range(40)]
        err.append(np.mean([(y[i] - z[i] @ w - b) ** 2 for i, (w, b) in enumerate(fits)]))
    rows = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    lam, w, b = M.panel_leave_one_out(rows, ["a", "b", "c"], "y", lams)
    w2, b2 = fit(np.arange(40) >= 0, lam)
    assert lam == lams[int(np.argmin(err))] and lam != 1.0
    assert np.allclose(x @ w + b, z @ w2 + b2)


def test_signals_of_a_ticker_stay_columns_of_their_own(spark):
    x, y = RNG.normal(size=(30, 4, 2)), RNG.normal(size=(30, 4))
    rows = [("s", t, f"T{i}", f"g{k}", float(x[t, i, k]), float(y[t, i])) for t in range(30) for i in range(4) for k in range(2)]
    train = spark.createDataFrame(rows, "sector string, t int, ticker string, signal string, x double, y double")
    got = M.fit_blocks(train, lambda a, b: K.ridge(a, b, 2.0), "sector", signal="signal").toPandas().pivot(index="src", columns="tgt", values="w")
    assert got.index.tolist() == [f"T{i}__g{k}" for i in range(4) for k in range(2)] and got.columns.tolist() == [f"T{i}" for i in range(4)]
    a, b = x.reshape(30, 8), y
    assert np.allclose(got, K.ridge((a - a.mean(0)) / a.std(0), (b - b.mean(0)) / b.std(0), 2.0))


def test_negative_edges_count_only_by_their_size():
    w = np.zeros((6, 6))
    w[:2, :2], w[4:, 4:] = 1.0, -3.0
    t, s = K.alternating(w, 2, 2)
    assert t.tolist() == s.tolist() == [4, 5]
    t, s = K.alternating(w, 2, 2, positive=True)
    assert t.tolist() == s.tolist() == [0, 1]


def pca_by_hand(train, every):
    """Scores of `every` by the first component of standardised training rows, its sign by the raw sums."""
    sd = train.std(axis=0)
    z = lambda m: np.where(sd > 1e-9, (m - train.mean(axis=0)) / np.where(sd > 1e-9, sd, 1), 0.0)
    v = np.linalg.eigh(np.cov(z(train), rowvar=False).reshape(train.shape[1], -1))[1][:, -1]
    score = z(every) @ v
    return -score if np.corrcoef(z(train) @ v, train.sum(axis=1))[0, 1] < 0 else score


def test_minute_components_are_fitted_on_training_days_alone(spark, sf):
    from panelforge.plans import signals

    days = signals.minute_days(spark, sf).toPandas().sort_values(["t", "ticker"])
    v, t = np.stack(days["v"].to_numpy()), days["t"].to_numpy()
    key = list(zip(days["date"], days["ticker"], strict=True))
    early = t < int(0.7 * (t.max() + 1))
    want = dict(zip(key, zip(early.tolist(), pca_by_hand(v[early], v).tolist(), strict=True), strict=True))
    got = {(r.date, r.ticker): (r.train, r.score) for r in signals.minute_pca(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)
    want = {}
    for lo in range(signals.PCA_TRAIN, t.max() + 1, signals.PCA_EVERY):
        train, test = (t >= lo - signals.PCA_TRAIN) & (t < lo), (t >= lo) & (t < lo + signals.PCA_EVERY)
        if train.sum() > 1:
            want |= dict(zip([k for k, x in zip(key, test, strict=True) if x], pca_by_hand(v[train], v[test]).tolist(), strict=True))
    got = {(r.date, r.ticker): r.score for r in signals.rolling_minute_pca(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert signals.pca_portfolio(spark, sf).count() > 0


def test_threshold_without_noise():
    assert K.hard_threshold(np.outer(np.arange(1.0, 6), np.ones(5)))[1] == 0
    assert not K.hard_threshold(np.outer(np.arange(1.0, 6), np.ones(5)))[0].any()
    assert K.hard_threshold(np.zeros((3, 3)))[1] == 0


def test_window_moments_are_those_of_a_refit(spark):
    """Missing cells and names included."""
    from panelforge.operators import moments as G

    rng = np.random.default_rng(8)
    rows = [(s, t, f"{s}{i}", None if rng.random() < 0.1 else float(rng.normal()), None if rng.random() < 0.1 else float(rng.normal())) for s in "pq" for t in range(90) for i in range(5) if rng.random() < 0.9 and not (i == 4 and t < 60)]
    panel = spark.createDataFrame(rows, "sector string, t int, ticker string, x double, y double")
    ranges = M.windows(panel, 50, 7)
    m = G.window_moments(panel, ranges, "sector")
    kept = G.names_kept(m, "sector", 30)
    got = {(r.window, r.sector, r.src, r.tgt): r.w for r in G.ridge_of(m, kept, 2.0, "sector").collect()}
    frame, want = panel.toPandas(), {}
    for r in ranges.collect():
        for s, rows in frame[(frame["t"] >= r.tr0) & (frame["t"] < r.te1)].groupby("sector"):
            both = rows.dropna().groupby("ticker").size()
            rows = rows[rows["ticker"].isin(both[both >= 30].index) & (rows["t"] < r.tr1)]
            x, y = (rows.pivot(index="t", columns="ticker", values=c) for c in "xy")
            x, y = (((f - f.mean()) / f.std(ddof=0)).fillna(0.0) for f in (x, y))
            if x.shape[1] >= 4:
                w = np.linalg.inv(x.T @ x + 2.0 * np.eye(x.shape[1])) @ x.T.to_numpy() @ y.to_numpy()
                want |= {(r.window, s, a, b): w[i, j] for i, a in enumerate(x.columns) for j, b in enumerate(y.columns)}
    assert got.keys() == want.keys() and len({k[0] for k in want}) > 3
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert G.ridge_of(m.where("n < 0"), kept, 2.0, "sector").count() == 0


def slow_split(x, y, w, least, cuts):
    """(gain, feature, threshold) of the best split, by trying every midpoint between values of the whole table."""
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for cut in cuts[f]:
            low = x[:, f] <= cut
            a, b = w[low].sum(), w[~low].sum()
            if a >= least and b >= least:
                gain = round((w[low] @ y[low]) ** 2 / a + (w[~low] @ y[~low]) ** 2 / b - (w @ y) ** 2 / w.sum(), 12)
                if gain > best[0]:
                    best = (gain, f, cut)
    return best


def slow_tree(x, y, w, test, leaves, depth, least):
    """Predictions of a tree grown best leaf first, from raw values."""
    nodes = [(np.ones(len(x), bool), np.ones(len(test), bool), 0)]
    cuts = [(v[1:] + v[:-1]) / 2 for v in map(np.unique, x.T)]
    open_ = {0: slow_split(x, y, w, least, cuts)}
    while len(nodes) < leaves:
        ready = {k: s for k, s in open_.items() if s[1] is not None and nodes[k][2] < depth}
        if not ready:
            break
        k = max(ready, key=lambda k: ready[k][0])
        _, f, cut = ready[k]
        rows, late, level = nodes[k]
        sides = [(rows & side, late & other, level + 1) for side, other in ((x[:, f] <= cut, test[:, f] <= cut), (x[:, f] > cut, test[:, f] > cut))]
        nodes[k], place = sides[0], len(nodes)
        nodes.append(sides[1])
        for i in (k, place):
            open_[i] = slow_split(x[nodes[i][0]], y[nodes[i][0]], w[nodes[i][0]], least, cuts)
    out = np.zeros(len(test))
    for rows, late, _ in nodes:
        out[late] = np.average(y[rows], weights=w[rows])
    return out


def test_trees_split_where_brute_force_does():
    from panelforge.operators import trees as T

    rng = np.random.default_rng(2)
    x, test = rng.integers(0, 9, (120, 4)).astype(float), rng.integers(0, 9, (40, 4)).astype(float)
    y = rng.normal(size=120) + x[:, 1] - 2 * (x[:, 2] > 4)
    bins = T.Bins.of(x)
    for leaves, depth, least in ((2, 9, 5), (8, 9, 5), (99, 3, 10), (15, 99, 20)):
        w = rng.integers(0, 3, 120).astype(float)
        tree = T.grow(bins.apply(x), y, w, leaves, depth, least)
        assert np.allclose(tree.predict(bins.apply(test)), slow_tree(x, y, w, test, leaves, depth, least))
    fit, out = np.full(120, y.mean()), np.full(40, y.mean())
    for _ in range(12):
        step = slow_tree(x, y - fit, np.ones(120), np.concatenate([x, test]), 6, 99, 10)
        fit, out = fit + 0.3 * step[:120], out + 0.3 * step[120:]
    assert np.allclose(T.boosted(x, y, test, 12, 0.3, 6, 10), out)
    flat = T.boosted(np.ones((30, 2)), np.arange(30.0), np.ones((3, 2)))
    assert np.allclose(flat, 14.5) and np.allclose(T.forest(x, np.full(120, 2.0), test, 5), 2.0)
    # A drawn forest is a mean of trees on drawn rows, near what its target is.
    assert np.corrcoef(T.forest(x, y, x, 30, 6, least=5), y)[0, 1] > 0.8


def test_trees_by_window_and_sector(spark, sf, monkeypatch):
    from functools import partial

    from panelforge.operators import trees as T
    from panelforge.plans import research

    def median_of_first(x, y, test):
        return test[:, 0] * 10 + x[:, -1].max() + len(y) / 1e6 + y.sum()

    rows = research.window_rows(spark, sf)
    p = rows.toPandas()
    got = T.fit_each(rows.select("window", "sector", "t", "ticker", "pct", "y", "test"), median_of_first, ["pct"], "window", "sector", flatten=True, least_rows=20, least_names=4)
    got = {(r.window, r.t, r.ticker): r.score for r in got.collect()}
    want = {}
    for (w, _), g in p.groupby(["window", "sector"]):
        early, late = g[~g["test"]], g[g["test"]]
        names = sorted(early["ticker"].unique())
        y = early["y"].dropna()
        if len(names) >= 4 and len(y) >= 20:
            for t, day in late[late["ticker"].isin(names)].groupby("t"):
                first = dict(zip(day["ticker"], day["pct"], strict=True)).get(names[0], 0.0)
                want |= {(w, t, n): first * 10 + len(names) - 1 + len(y) / 1e6 + y.sum() for n in day["ticker"]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    monkeypatch.setattr(T, "boosted", partial(T.boosted, rounds=5))
    one = {(r.date, r.ticker): r.score for r in research.sector_boosting(spark, sf).collect()}
    assert len(one) == len(want)
    # One sector of the first window against the slow trees.
    w, sector = next((w, s) for (w, s), g in p.groupby(["window", "sector"]) if any((w, t, n) in want for t, n in zip(g["t"], g["ticker"], strict=True)))
    g = p[(p["window"] == w) & (p["sector"] == sector)]
    g = g[g["ticker"].isin(g[~g["test"]]["ticker"])]
    names = sorted(g["ticker"].unique())
    m = g.pivot(index="t", columns="ticker", values="pct").reindex(columns=names).fillna(0.0)
    x = {(t, n): [*m.loc[t], float(i)] for t in m.index for i, n in enumerate(names)}
    early, late = g[~g["test"]], g[g["test"]]
    xs, ys = np.array([x[k] for k in zip(early["t"], early["ticker"], strict=True)]), early["y"].to_numpy()
    ts = np.array([x[k] for k in zip(late["t"], late["ticker"], strict=True)])
    fit, out = np.full(len(ys), ys.mean()), np.full(len(ts), ys.mean())
    for _ in range(5):
        step = slow_tree(xs, ys - fit, np.ones(len(ys)), np.concatenate([xs, ts]), 15, 99, 20)
        fit, out = fit + 0.05 * step[: len(ys)], out + 0.05 * step[len(ys) :]
    assert [one[k] for k in zip(late["date"], late["ticker"], strict=True)] == pytest.approx(out.tolist(), abs=1e-9)


def test_windows_use_covered_names_that_vary(spark):
    rows = [(t, k, 0, float((t * 7 + i) % 11), float((t * 5 + i) % 7)) for i, k in enumerate("abcd") for t in range(60)]
    rows = [(t, k, s, 1.0 if k == "b" and t < 40 else x, 2.0 if k == "c" and t < 40 else y) for t, k, s, x, y in rows]
    rows = [(t, k, s, x, None if k == "d" and t % 3 else y) for t, k, s, x, y in rows]
    rows += [(t, "e", 0, float(t % 5), float(t % 3)) for t in range(15, 45)] + [(t, "f", 0, float(t % 5), float(t % 3)) for t in range(16, 45)]
    panel = spark.createDataFrame(rows, "t int, ticker string, sector int, x double, y double")
    got = M.covered(panel, M.windows(panel, 40, 20)).collect()
    # b and c are constant while training, d and f have 20 and 29 dates; the dates of e reach into the test range.
    assert {(r.window, r.ticker) for r in got} == {(0, "a"), (0, "e")}
    assert M.covered(panel.where("t < 0"), M.windows(panel.where("t < 0"), 40, 20)).count() == 0
