"""Sums of products that merge: Gram matrices of sliding windows without a copy of the panel for each window.

Dates are cut at the edges of all windows.  Every (group, block of dates) is reduced to its
moments by one small matrix product; running sums over blocks give the moments up to each
edge, and a window's are the difference of two.  Cells may be missing: each pair of columns keeps
the count of dates that have both, both sums, and the sum of products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = ("n", "sa", "sb", "sab")
#: Columns of text in what the grouped fits give.
TEXT = ("ticker", "src", "tgt", "a", "b")


def side_by_side(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by their groups over twice the cores: adaptive execution would put small groups with long fits into one task."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def plain(out: pd.DataFrame) -> pd.DataFrame:
    """The frame with text as plain objects, and columns without rows as numbers or plain objects by name."""
    if not len(out):
        return pd.DataFrame({c: np.zeros(0, object if c in TEXT else float) for c in out.columns})
    return out.astype({c: object for c in out.columns if not pd.api.types.is_numeric_dtype(out[c])})


def block_of(t: Column, edges: list[int]) -> Column:
    """The number of the last edge at or before a date; -1 before all."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= t)) - 1


def edges_of(ranges: DataFrame) -> list[int]:
    """All bounds of the windows: as few as the calendar has test blocks."""
    return sorted({int(v) for r in ranges.select("tr0", "tr1", "te1").collect() for v in r})


def partial_moments(panel: DataFrame, by: str, edges: list[int]) -> DataFrame:
    """(by, block, a, b, n, sa, sb, sab) of each block's x columns with all of its columns, and of y with itself.

    panel: (by, t, ticker, x, y), one row a cell.  Columns are named x:TICKER and y:TICKER.
    """
    kind = dict(panel.dtypes)[by]

    def reduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, i = np.unique(pdf["ticker"].to_numpy(str), return_inverse=True)
        dates, t = np.unique(pdf["t"].to_numpy(), return_inverse=True)
        v = np.full((len(dates), 2 * len(names)), np.nan)
        v[t, i], v[t, i + len(names)] = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        mask = np.isfinite(v).astype(float)
        v = np.where(mask > 0, v, 0.0)
        p, cols = len(names), [f"x:{n}" for n in names] + [f"y:{n}" for n in names]
        i, j = np.nonzero(np.concatenate([np.ones((p, 2 * p), bool), np.concatenate([np.zeros((p, p), bool), np.eye(p, dtype=bool)], axis=1)]))
        a, b = np.array(cols, object)[i], np.array(cols, object)[j]
        out = {"n": (mask.T @ mask)[i, j], "sa": (v.T @ mask)[i, j], "sb": (mask.T @ v)[i, j], "sab": (v.T @ v)[i, j]}
        return plain(pd.DataFrame({by: [key[0]] * len(i), "block": np.full(len(i), key[1], np.int32), "a": a, "b": b, **out}))

    rows = panel.withColumn("block", block_of(F.col("t"), edges)).where("block >= 0")
    return side_by_side(rows, by, "block").groupBy(by, "block").applyInPandas(reduce, f"{by} {kind}, block int, a string, b string, n double, sa double, sb double, sab double")


def running(moments: DataFrame, by: str, blocks: int) -> DataFrame:
    """Moments up to and with each of the blocks, of every pair of columns that occurs in any."""
    pairs = moments.select(by, "a", "b").distinct()
    grid = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    w = Window.partitionBy(by, "a", "b").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    dense = grid.join(moments, [by, "block", "a", "b"], "left")
    return dense.select(by, "a", "b", "block", *(F.sum(F.coalesce(c, F.lit(0.0))).over(w).alias(c) for c in SUMS))


def window_moments(panel: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    """(window, by, a, b, n, sa, sb, sab, seen) of each window's training dates; seen counts its test dates too."""
    edges = edges_of(ranges)
    total = running(partial_moments(panel, by, edges), by, len(edges))
    bounds = ranges.select("window", *((block_of(F.col(c), edges) - 1).alias(c) for c in ("tr0", "tr1", "te1")))
    # Of each bound: whether its sums are added or taken off, and its counts of dates with test ones.
    signs = (("tr0", -1.0, -1.0), ("tr1", 1.0, 0.0), ("te1", 0.0, 1.0))
    taken = [bounds.select("window", F.col(c).alias("block"), F.lit(s).alias("sign"), F.lit(k).alias("counts")) for c, s, k in signs]
    rows = total.join(F.broadcast(taken[0].union(taken[1]).union(taken[2])), "block")
    return rows.groupBy("window", by, "a", "b").agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in SUMS), F.sum(F.col("counts") * F.col("n")).alias("seen"))


def names_kept(moments: DataFrame, by: str, least: int = 30) -> DataFrame:
    """(window, by, ticker, mx, sx, my, sy): means and population deviations of the names that a window's fit may use.

    A name needs `least` dates with both x and y from training through test, and an x and a y that vary in training.
    """
    own = moments.where(F.substring("a", 3, 1 << 20) == F.substring("b", 3, 1 << 20)).withColumn("kind", F.concat(F.substring("a", 1, 1), F.substring("b", 1, 1)))
    mean = F.try_divide("sa", "n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("sab", "n") - mean * mean))
    pick = lambda kind, c, name: F.max(F.when(F.col("kind") == kind, c)).alias(name)
    each = own.groupBy("window", by, F.substring("a", 3, 1 << 20).alias("ticker")).agg(
        pick("xx", mean, "mx"), pick("xx", sd, "sx"), pick("yy", mean, "my"), pick("yy", sd, "sy"), pick("xy", F.col("seen"), "seen"),
    )
    # Differences of sums leave rounding noise where a column doesn't vary.
    varies = lambda s, m: F.col(s) > 1e-7 * F.greatest(F.abs(F.col(m)), F.lit(1e-5))
    return each.where((F.col("seen") >= least) & varies("sx", "mx") & varies("sy", "my")).drop("seen")


def ridge_of(moments: DataFrame, kept: DataFrame, lam: float, by: str, least: int = 4) -> DataFrame:
    """(window, by, src, tgt, w): block ridge on standardised columns, missing cells at 0, from moments alone."""
    kind = dict(moments.dtypes)[by]
    side = lambda c, m, s: kept.select("window", by, F.concat(F.lit(f"{c}:"), "ticker").alias("b"), F.col(m).alias("mb"), F.col(s).alias("db"))
    mine = side("x", "mx", "sx").withColumnsRenamed({"b": "a", "mb": "ma", "db": "da"})
    rows = moments.join(mine, ["window", by, "a"]).join(side("x", "mx", "sx").union(side("y", "my", "sy")), ["window", by, "b"])
    cross = F.col("sab") - F.col("ma") * F.col("sb") - F.col("mb") * F.col("sa") + F.col("ma") * F.col("mb") * F.col("n")
    rows = rows.select("window", by, "a", "b", (cross / (F.col("da") * F.col("db"))).alias("z"))

    def fit(key: tuple, m: pd.DataFrame) -> pd.DataFrame:
        names = sorted(m["a"].str[2:].unique())
        p = len(names)
        if p < least:
            return plain(pd.DataFrame(columns=["window", by, "src", "tgt", "w"]))
        at = {n: i for i, n in enumerate(names)}
        i, j, y = m["a"].str[2:].map(at).to_numpy(), m["b"].str[2:].map(at).to_numpy(), (m["b"].str[0] == "y").to_numpy()
        z, gram, target = m["z"].to_numpy(), np.zeros((p, p)), np.zeros((p, p))
        gram[i[~y], j[~y]], target[i[y], j[y]] = z[~y], z[y]
        w = np.linalg.solve(gram + lam * np.eye(p), target)
        names = np.array(names, object)
        return plain(pd.DataFrame({"window": np.full(p * p, key[0], np.int32), by: [key[1]] * (p * p), "src": np.repeat(names, p), "tgt": np.tile(names, p), "w": w.ravel()}))

    return side_by_side(rows, "window", by).groupBy("window", by).applyInPandas(fit, f"window int, {by} {kind}, src string, tgt string, w double")


def own_ridge_of(moments: DataFrame, kept: DataFrame, lam: float, by: str) -> DataFrame:
    """(window, by, ticker, w): each name's return on its own signal alone."""
    own = moments.where(F.col("a").startswith("x:") & F.col("b").startswith("y:") & (F.substring("a", 3, 1 << 20) == F.substring("b", 3, 1 << 20)))
    j = own.withColumn("ticker", F.substring("a", 3, 1 << 20)).join(kept, ["window", by, "ticker"])
    cross = (F.col("sab") - F.col("mx") * F.col("sb") - F.col("my") * F.col("sa") + F.col("mx") * F.col("my") * F.col("n")) / (F.col("sx") * F.col("sy"))
    # Standardised signals' squares sum to their count.
    return j.select("window", by, "ticker", (cross / (F.col("n") + F.lit(float(lam)))).alias("w"))


def grams(rows: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by..., n, s, p): of each group's vectors (arrays of one length, nulls as 0) the count, the sum and the
    products' sum by row; tasks add up what they see before anything moves."""
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"{k} {kinds[k]}" for k in by)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(len(by))
            v = np.nan_to_num(np.asarray(lists.flatten(), float)).reshape(len(batch), -1)
            frame = pd.DataFrame({k: batch.column(i).to_pandas() for i, k in enumerate(by)})
            for key, at in frame.groupby(list(by), dropna=False).indices.items():
                x = v[at]
                new = [len(at), x.sum(0), x.T @ x]
                key = key if isinstance(key, tuple) else (key,)
                held[key] = [a + b for a, b in zip(held[key], new, strict=True)] if key in held else new
        cols = [[k[i] for k in held] for i in range(len(by))]
        arrays = [pa.array(c, batch_type) for c, batch_type in zip(cols, types, strict=True)]
        n, s, p = ([h[i] for h in held.values()] for i in range(3))
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.float64()), pa.array([x.tolist() for x in s], pa.list_(pa.float64())), pa.array([x.ravel().tolist() for x in p], pa.list_(pa.float64()))], names=[*by, "n", "s", "p"])

    from pyspark.sql.pandas.types import to_arrow_type

    picked = rows.select(*by, vector)
    types = [to_arrow_type(picked.schema[k].dataType) for k in by]
    parts = picked.mapInArrow(partial, f"{keys}, n double, s array<double>, p array<double>")
    # Merged by place, so that partial aggregation goes on in the JVM.
    flat = parts.select(*by, "n", F.size("s").alias("k"), F.posexplode(F.concat(F.array("n"), "s", "p")).alias("at", "v"))
    merged = flat.groupBy(*by, "k", "at").agg(F.sum("v").alias("v"))
    return merged.groupBy(*by, "k").agg(F.sort_array(F.collect_list(F.struct("at", "v")))["v"].alias("v")).select(*by, "k", F.col("v")[0].alias("n"), F.slice("v", 2, F.col("k")).alias("s"), F.slice("v", F.col("k") + 2, F.col("k") * F.col("k")).alias("p"))
