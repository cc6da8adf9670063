"""Grouped linear models, decompositions and clusters over long tables.

Every fit is one group of applyInPandas: a (window, sector) block, a window or a ticker
with at most a few hundred names; groups of all windows are fitted side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, moments
from .edges import edge_matrix
from .windows import average_rank, correlation

Solver = Callable[[np.ndarray, np.ndarray], np.ndarray]


def windows(panel: DataFrame, train: int, test: int, step: int | None = None, lag: int = 1, skip_first: bool = False) -> DataFrame:
    """(window, tr0, tr1, te0, te1): half-open ranges of date numbers; test ranges overlap if step < test.

    With skip_first the first window is left out, as where `lag` more dates than `train` are asked of it.
    """
    n = panel.select(F.max("t")).first()[0]
    rows = []
    start = train + (lag if skip_first else 0)
    while n is not None and start <= n:
        rows.append((len(rows), start - train, start, start, min(start + test, n + 1)))
        start += step or test
    return panel.sparkSession.createDataFrame(rows, "window int, tr0 int, tr1 int, te0 int, te1 int")


def in_window(panel: DataFrame, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows of each window's range; the windows are as few as test blocks of the calendar."""
    t = F.broadcast(ranges.select("window", F.col(lo).alias("_lo"), F.col(hi).alias("_hi")))
    return panel.join(t, (panel["t"] >= t["_lo"]) & (panel["t"] < t["_hi"])).drop("_lo", "_hi")


def covered(panel: DataFrame, ranges: DataFrame, least: int = 30) -> DataFrame:
    """(window, ticker): the names that a window's fit may use.

    A name needs `least` dates with both x and y from the window's training range through its
    test range, and an x and a y that vary within training.
    """
    early = F.col("t") < F.col("tr1")
    spread = lambda c: F.coalesce(F.stddev_pop(F.when(early, F.col(c))), F.lit(0.0)) > 1e-12
    rows = in_window(panel, ranges, "tr0", "te1").join(F.broadcast(ranges.select("window", "tr1")), "window")
    seen = rows.groupBy("window", "ticker").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"), spread("x").alias("vx"), spread("y").alias("vy"))
    return seen.where((F.col("n") >= least) & F.col("vx") & F.col("vy")).select("window", "ticker")


def standardised(train: DataFrame, x: str, *by: str) -> DataFrame:
    """mean and population deviation of each group's training values; a deviation of 0 counts as 1."""
    return train.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))


def _named(out: pd.DataFrame, by: tuple[str, ...], key: tuple, cols: list[str]) -> pd.DataFrame:
    """The frame with its group's key, in the order asked for; text as plain objects."""
    out = out.assign(**{b: [k] * len(out) for b, k in zip(by, key, strict=True)})[cols]
    return out.astype({c: object for c in cols if not pd.api.types.is_numeric_dtype(out[c])})


def _wide(pdf: pd.DataFrame, value: str, signal: str | None = None) -> pd.DataFrame:
    """Dates by tickers, or by TICKER__signal where a column names the signal."""
    names = pdf["ticker"] if signal is None else pdf["ticker"] + "__" + pdf[signal].astype(str)
    return pdf.assign(ticker=names).pivot_table(index="t", columns="ticker", values=value, aggfunc="mean").sort_index()


def _standard(m: pd.DataFrame) -> pd.DataFrame:
    sd = m.std(ddof=0)
    m = m.loc[:, sd[np.isfinite(sd) & (sd > 1e-12)].index]
    return ((m - m.mean()) / m.std(ddof=0)).fillna(0.0)


def fit_blocks(train: DataFrame, solver: Solver, *by: str, least: int = 4, signal: str | None = None) -> DataFrame:
    """(by..., src, tgt, w): coefficients of y on x of all names of a block; blocks under `least` names have none.

    With `signal`, a column that tells a ticker's signals apart, each is a column of x of its own, src is
    TICKER__signal, and `least` is asked of the targets.
    """
    kinds = dict(train.dtypes)
    keys = ", ".join(f"{k} {kinds[k]}" for k in by)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _standard(_wide(pdf, "x", signal)), _standard(_wide(pdf, "y"))
        x, y = x.align(y, join="inner", axis=0)
        names = [*by, "src", "tgt", "w"]
        if (y.shape[1] if signal else min(x.shape[1], y.shape[1])) < least or not x.shape[1]:
            return pd.DataFrame({n: np.zeros(0, object if kinds.get(n, "string") == "string" and n != "w" else float) for n in names})
        w = solver(x.to_numpy(), y.to_numpy())
        out = pd.DataFrame({"src": np.repeat(x.columns, y.shape[1]), "tgt": np.tile(y.columns, x.shape[1]), "w": w.ravel()})
        return _named(out, by, key, names)

    return train.groupBy(*by).applyInPandas(fit, f"{keys}, src string, tgt string, w double")


def fit_grid(train: DataFrame, lams: tuple[float, ...], *by: str, least: int = 4, standard: bool = True) -> DataFrame:
    """(by..., lam, src, tgt, w): block ridge for every penalty, from one decomposition of each block.

    Without `standard`, x and y are taken as they are, missing cells at 0.
    """
    kinds = dict(train.dtypes)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ready = _standard if standard else lambda m: m.fillna(0.0)
        x, y = ready(_wide(pdf, "x")), ready(_wide(pdf, "y"))
        x, y = x.align(y, join="inner", axis=0)
        names = [*by, "lam", "src", "tgt", "w"]
        if min(x.shape[1], y.shape[1]) < least:
            return pd.DataFrame({n: np.zeros(0, object if n in ("src", "tgt") or kinds.get(n) == "string" else float) for n in names})
        w = kernels.ridge_grid(x.to_numpy(), y.to_numpy(), lams)
        src, tgt = np.repeat(x.columns, y.shape[1]), np.tile(y.columns, x.shape[1])
        out = pd.DataFrame({"lam": np.repeat(lams, len(src)), "src": np.tile(src, len(lams)), "tgt": np.tile(tgt, len(lams)), "w": w.ravel()})
        return _named(out, by, key, names)

    return moments.side_by_side(train, *by).groupBy(*by).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in by) + ", lam double, src string, tgt string, w double")


def panel_leave_one_out(train: DataFrame, cols: list[str], y: str, lams: tuple[float, ...]) -> tuple[float, np.ndarray, float]:
    """The ridge penalty with the least leave-one-out error, its coefficients on cols as they are, and its intercept.

    Columns are standardised, the intercept bears no penalty; two passes of sums over the
    panel give all penalties' errors, by each row's leverage.
    """
    first = train.agg(F.count("*"), F.avg(y), *(f(c) for c in cols for f in (F.avg, F.stddev_pop))).first()
    n, level = first[0], float(first[1] or 0)
    mean = np.array([float(v or 0) for v in first[2::2]])
    sd = np.array([float(v) if v else 1.0 for v in first[3::2]])
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(cols, mean, sd, strict=True)]
    k = len(cols)
    sums = train.agg(*(F.sum(a * b) for a in z for b in z), *(F.sum(a * (F.col(y) - level)) for a in z)).first()
    sums = np.array([float(v or 0) for v in sums])
    gram, cross = sums[: k * k].reshape(k, k), sums[k * k :]
    inverse = [np.linalg.inv(gram + lam * np.eye(k)) for lam in lams]

    def error(inv: np.ndarray) -> Column:
        w = inv @ cross
        rest = F.col(y) - level - sum(float(w[i]) * z[i] for i in range(k))
        lever = 1 / max(1, n) + sum(float(inv[i, j]) * z[i] * z[j] for i in range(k) for j in range(k))
        return F.avg(F.pow(rest / F.greatest(1 - lever, F.lit(1e-12)), F.lit(2)))

    errors = [float("inf") if e is None else e for e in train.agg(*map(error, inverse)).first()]
    best = int(np.argmin(errors))
    w = inverse[best] @ cross / sd
    return lams[best], w, level - float(w @ mean)


def soft_sector_ridge(lam: float, cross: float, sector: dict[str, int]) -> Callable:
    """A fitter of one window in which coefficients across sectors bear a higher penalty."""

    def fit(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
        same = np.array([[sector.get(a) == sector.get(b) for b in y.columns] for a in x.columns])
        return kernels.ridge(x.to_numpy(), y.to_numpy(), np.where(same, lam, lam * cross))

    return fit


def fit_soft(train: DataFrame, lam: float, cross: float) -> DataFrame:
    """Soft-sector ridge of each window; `train` carries the sector of each ticker."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _standard(_wide(pdf, "x")), _standard(_wide(pdf, "y"))
        w = soft_sector_ridge(lam, cross, dict(zip(pdf["ticker"], pdf["sector"], strict=True)))(x, y)
        return pd.DataFrame({"window": key[0], "src": np.repeat(x.columns, y.shape[1]), "tgt": np.tile(y.columns, x.shape[1]), "w": w.ravel()})

    return train.groupBy("window").applyInPandas(fit, "window int, src string, tgt string, w double")


def denoised(weights: DataFrame, how: Callable[[np.ndarray], np.ndarray], *by: str, zero_diagonal: bool = False) -> DataFrame:
    """Each group's coefficient matrix through a matrix function."""
    kinds = dict(weights.dtypes)

    def apply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s, t = sorted(pdf["src"].unique()), sorted(pdf["tgt"].unique())
        m = how(np.nan_to_num(edge_matrix(pdf, "w", t, s)))
        out = pd.DataFrame({"src": np.tile(s, len(t)), "tgt": np.repeat(t, len(s)), "w": m.ravel()})
        if zero_diagonal:
            out.loc[out["src"] == out["tgt"], "w"] = 0.0
        return _named(out, by, key, [*by, "src", "tgt", "w"])

    return weights.groupBy(*by).applyInPandas(apply, ", ".join(f"{k} {kinds[k]}" for k in by) + ", src string, tgt string, w double")


def diagonal(pairs: DataFrame, lam: float, *by: str) -> DataFrame:
    """Own-signal ridge coefficient: sum xy / (sum xx + lam)."""
    return pairs.groupBy(*by).agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x")) + F.lit(float(lam))).alias("w"), F.count("*").alias("n"))


def predict(x: DataFrame, weights: DataFrame, *by: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(by..., also..., t, ticker, score): signals, already standardised, through the coefficients; `also` are keys of these alone."""
    j = x.withColumnRenamed("ticker", "src").join(weights, [*by, "src"])
    return j.groupBy(*by, *also, "t", F.col("tgt").alias("ticker")).agg(F.sum(F.col("x") * F.col("w")).alias("score"))


def standard_scores(rows: DataFrame, train: DataFrame, column: str, *by: str) -> DataFrame:
    """rows with `column` standardised by each name's training values; names without any go."""
    stats = standardised(train, column, *by, "ticker").drop("n")
    return rows.join(stats, [*by, "ticker"]).withColumn(column, (F.col(column) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def in_return_units(scores: DataFrame, train: DataFrame, *by: str) -> DataFrame:
    """Predictions of standardised returns as returns: times each name's deviation in training, plus its mean there."""
    stats = standardised(train, "y", *by, "ticker").drop("n")
    return scores.join(stats, [*by, "ticker"]).withColumn("score", F.col("score") * F.col("sd") + F.col("mean")).drop("mean", "sd")


def information(scores: DataFrame, *by: str) -> DataFrame:
    """Mean over dates of the rank correlation of score and y."""
    r = scores.withColumns({"_a": average_rank("score", *by, "t"), "_b": average_rank("y", *by, "t")})
    daily = r.groupBy(*by, "t").agg(correlation("_a", "_b").alias("ic"))
    return daily.groupBy(*by).agg(F.avg("ic").alias("ic"))


def choose(candidates: DataFrame, score: str, param: str, *by: str) -> DataFrame:
    """The parameter with the highest score in each group; the smaller one of equals."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), param)
    return candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def blended(weights: DataFrame, alpha: float) -> DataFrame:
    """Own coefficients scaled by alpha; 0 takes them out."""
    return weights.withColumn("w", F.when(F.col("src") == F.col("tgt"), alpha * F.col("w")).otherwise(F.col("w")))


def off_diagonal(weights: DataFrame) -> DataFrame:
    return weights.where("src <> tgt")


def components_of(rows: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by..., place, loading): the first principal component of each group's vectors; places count from 1.

    Tasks add up counts, sums and products of their own rows; what reaches a group's task is one small matrix.
    """
    kinds = dict(rows.dtypes)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = float(pdf["n"].iloc[0]), np.asarray(pdf["s"].iloc[0], float)
        gram = np.asarray(pdf["p"].iloc[0], float).reshape(len(s), len(s))
        v = kernels.leading((gram - np.outer(s, s) / n) / max(1.0, n - 1)) if len(s) > 1 else np.ones(1)
        return pd.DataFrame({**{b: [k] * len(s) for b, k in zip(by, key, strict=True)}, "place": np.arange(1, len(s) + 1, dtype=np.int32), "loading": v})

    return moments.grams(rows, vector, *by).groupBy(*by).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in by) + ", place int, loading double")


def component_scores(days: DataFrame, train: Column, vector: str, *by: str) -> DataFrame:
    """days with score: the first principal component of standardised vectors, fitted on each group's `train` rows alone.

    Places that don't vary in training count as 0.  The component's sign is such that its training scores
    go with the vectors' raw sums.
    """
    load = signed_components(moments.grams(days.where(train), vector, *by), *by)
    return projected(days, load, vector, *by)


def signed_components(grams: DataFrame, *by: str) -> DataFrame:
    """(by..., weights, level): weights of each group's component, and what they make of its mean vector."""
    kinds = dict(grams.dtypes)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = float(pdf["n"].iloc[0]), np.asarray(pdf["s"].iloc[0], float)
        gram = np.asarray(pdf["p"].iloc[0], float).reshape(len(s), len(s)) / n - np.outer(s, s) / n**2
        sd = np.sqrt(np.maximum(np.diag(gram), 0.0))
        scale = np.where(sd > 1e-9, 1 / np.where(sd > 1e-9, sd, 1), 0.0)
        v = kernels.leading(gram * np.outer(scale, scale)) * scale if len(s) else np.zeros(0)
        # The covariance of scores and raw sums is the weights through the covariance's row sums.
        v = -v if float(v @ gram.sum(axis=1)) < 0 else v
        return pd.DataFrame({**{b: [k] for b, k in zip(by, key, strict=True)}, "weights": [v.tolist()], "level": [float(v @ s / n)]})

    return grams.groupBy(*by).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in by) + ", weights array<double>, level double")


def projected(days: DataFrame, load: DataFrame, vector: str, *by: str) -> DataFrame:
    """days with score, by the components of their groups; there is one for each fit."""
    product = F.aggregate(F.zip_with(vector, "weights", lambda a, b: F.coalesce(a, F.lit(0.0)) * b), F.lit(0.0), lambda a, x: a + x)
    return days.join(F.broadcast(load), list(by)).withColumn("score", product - F.col("level")).drop("weights", "level")


def rolling_component_scores(days: DataFrame, ranges: DataFrame, vector: str) -> DataFrame:
    """component_scores() refitted in every window; scores of its test dates."""
    edges = moments.edges_of(ranges)
    blocks = moments.grams(days.withColumn("block", moments.block_of(F.col("t"), edges)).where("block >= 0"), vector, "block")
    flat = blocks.select("block", "k", F.posexplode(F.concat(F.array("n"), "s", "p")).alias("at", "v"))
    grid = flat.select("k", "at").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 1))))
    w = Window.partitionBy("at").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    total = grid.join(flat, ["block", "k", "at"], "left").withColumn("v", F.sum(F.coalesce("v", F.lit(0.0))).over(w))
    parts = []
    for bound, sign in (("tr0", -1.0), ("tr1", 1.0)):
        at = ranges.select("window", (moments.block_of(F.col(bound), edges) - 1).alias("block"))
        parts.append(total.join(F.broadcast(at), "block").select("window", "k", "at", (F.lit(sign) * F.col("v")).alias("v")))
    sums = parts[0].union(parts[1]).groupBy("window", "k", "at").agg(F.sum("v").alias("v"))
    grams = sums.groupBy("window", "k").agg(F.sort_array(F.collect_list(F.struct("at", "v")))["v"].alias("v"))
    grams = grams.where(F.col("v")[0] > 1).select("window", F.col("v")[0].alias("n"), F.slice("v", 2, F.col("k")).alias("s"), F.slice("v", F.col("k") + 2, F.col("k") * F.col("k")).alias("p"))
    return projected(in_window(days, ranges, "te0", "te1"), signed_components(grams, "window"), vector, "window")


def biclusters(edges: DataFrame, value: str, how: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], *by: str) -> DataFrame:
    """(by..., side, ticker, label or weight): what a two-sided method says of targets and sources."""
    kinds = dict(edges.dtypes)

    def apply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, s = sorted(pdf["tgt"].unique()), sorted(pdf["src"].unique())
        a, b = how(np.nan_to_num(edge_matrix(pdf, value, t, s)))
        out = pd.DataFrame({"side": ["target"] * len(t) + ["source"] * len(s), "ticker": t + s, "value": np.concatenate([a, b]).astype(float)})
        return _named(out, by, key, [*by, "side", "ticker", "value"])

    return edges.groupBy(*by).applyInPandas(apply, ", ".join(f"{k} {kinds[k]}" for k in by) + ", side string, ticker string, value double")


def members(how: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Index sets as 0/1 marks."""

    def marked(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, s = how(w)
        a, b = np.zeros(w.shape[0]), np.zeros(w.shape[1])
        a[t], b[s] = 1, 1
        return a, b

    return marked


def best_block(edges: DataFrame, rows: DataFrame, cols: DataFrame, score: str = "a", count: str = "n") -> DataFrame:
    """Of all (row cluster, column cluster) blocks: size and the mean of score weighted by counts, best first."""
    j = edges.join(F.broadcast(rows.toDF("tgt", "rc")), "tgt").join(F.broadcast(cols.toDF("src", "cc")), "src").where(F.col(score).isNotNull())
    b = j.groupBy("rc", "cc").agg(F.try_divide(F.sum(F.col(score) * F.col(count)), F.sum(count).cast("double")).alias("block_score"), F.count("*").alias("edges"))
    return b.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.abs(F.round("block_score", 9)).desc_nulls_last(), "rc", "cc")))


def first_nonempty(masks: DataFrame, priority: str, *by: str) -> DataFrame:
    """Rows of the mask with the smallest priority that has any, in each group."""
    return masks.withColumn("_p", F.min(priority).over(Window.partitionBy(*by))).where(F.col(priority) == F.col("_p")).drop("_p")
