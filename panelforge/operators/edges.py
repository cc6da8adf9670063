"""Directed source-to-target edge statistics and what is read from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .windows import ordinal

#: Ranges of ranks in which p values are counted.
CHUNKS = 4096


def edge_stats(panel: DataFrame, signal: str = "sig", ret: str = "ret", lag: int = 1, *by: str) -> DataFrame:
    """(tgt, src, n, mu, sd, a, t): statistics of ret[tgt, t] * signal[src, t - lag].

    The pairs of one date are made by a join on the date's number and reduced by partial
    aggregation before they move, so that what is shuffled is pairs of tickers, not pairs a date.
    """
    p = panel if "t" in panel.columns else ordinal(panel)
    tgt = p.where(F.col(ret).isNotNull()).select(*by, "t", F.col("ticker").alias("tgt"), F.col(ret).alias("r"))
    src = p.where(F.col(signal).isNotNull()).select(*by, (F.col("t") + lag).alias("t"), F.col("ticker").alias("src"), F.col(signal).alias("p"))
    x = F.col("r") * F.col("p")
    e = tgt.join(src, [*by, "t"]).groupBy(*by, "tgt", "src").agg(F.count("*").alias("n"), F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"))
    a = F.try_divide(F.col("mu"), F.when(F.col("sd") > 0, F.col("sd")))
    return e.withColumn("a", a).withColumn("tstat", F.col("a") * F.sqrt("n"))


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by a continued fraction (Lentz), elementwise."""
    a, x = np.asarray(a, float), np.asarray(x, float)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (z > 0) & (z < 1)
    z = np.where(inside, z, 0.5)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.maximum(1 - (p + q) * z / (p + 1), tiny)
    out = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(1 + num * d == 0, tiny, 1 + num * d)
            c = np.where(1 + num / c == 0, tiny, 1 + num / c)
            out *= c * d
        if not len(out) or np.abs(c * d - 1).max() < 1e-14:
            break
    part = np.where(inside, front * out, (np.where(swap, 1 - x, x) >= 1).astype(float))
    return np.where(swap, 1 - part, part)


def p_values(edges: DataFrame, student: bool = True) -> DataFrame:
    """p: two-sided, by Student's t with n - 1 degrees of freedom or by the normal distribution."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])
        for b in batches:
            none = np.asarray(b.column("tstat").is_null())
            t, k = np.asarray(b.column("tstat").fill_null(0.0), float), np.maximum(np.asarray(b.column("n"), float) - 1, 1)
            p = incomplete_beta(k / 2, 0.5, k / (k + t * t)) if student else normal(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64(), mask=none)], names=[*b.schema.names, "p"])

    return edges.mapInArrow(apply, ", ".join(f"`{n}` {t}" for n, t in edges.dtypes) + ", p double")


def _beside(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """df with the other's columns where all keys are the same, null being the same as null; without keys `other` is one row."""
    named = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    if not keys:
        return df.join(F.broadcast(named), how="cross")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(named, on, "left").drop(*(f"_{k}" for k in keys))


def false_discovery(edges: DataFrame, q: float = 0.1, p: str = "p", *by: str) -> DataFrame:
    """keep: Benjamini-Hochberg at level q over the edges with a p value.

    A p value passes from rank k = ceil(p m / q) on.  Values are counted by k, and k in CHUNKS ranges, so
    that no task sorts a group; r values lie up to the last k that has k of them, and the cut is q r / m.
    """
    x = F.col(p)
    given = edges.where(x.isNotNull()).select(*by, p)
    ranked = _beside(given, given.groupBy(*by).agg(F.count("*").alias("_m")), *by).where(~F.isnan(p))
    k = F.when(x <= 0, F.lit(1).cast("long")).otherwise(F.ceil(F.try_divide(x * F.col("_m"), F.lit(float(q)))))
    levels = ranked.withColumn("_k", k).where("_k <= _m").groupBy(*by, "_k").agg(F.count("*").alias("_c"), F.first("_m").alias("_m"))
    levels = levels.withColumn("_chunk", F.floor((F.col("_k") - 1) * F.lit(float(CHUNKS)) / F.col("_m")))
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_chunk")
    before = levels.groupBy(*by, "_chunk").agg(F.sum("_c").alias("_n")).withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).drop("_n")
    rank = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_chunk").orderBy("_k"))
    cut = _beside(levels, before, *by, "_chunk").withColumn("_r", rank).where("_r >= _k").groupBy(*by).agg(F.max(q * F.col("_r") / F.col("_m")).alias("_cut"))
    return _beside(edges, cut, *by).withColumn("keep", F.coalesce(x <= F.col("_cut"), F.lit(False))).drop("_cut")


def significant(edges: DataFrame, t: float = 2.0, n: int = 30) -> DataFrame:
    return edges.where((F.abs("tstat") >= t) & (F.col("n") >= n) & (F.col("src") != F.col("tgt")))


def same_sector(edges: DataFrame, sectors: DataFrame, least: int = 1) -> DataFrame:
    """Edges within sectors of at least `least` names."""
    big = sectors.withColumn("_n", F.count("*").over(Window.partitionBy("sector"))).where(F.col("_n") >= least).drop("_n")
    s, t = big.toDF("src", "s1"), big.toDF("tgt", "s2")
    return edges.join(F.broadcast(s), "src").join(F.broadcast(t), "tgt").where("s1 = s2").drop("s2").withColumnRenamed("s1", "sector")


def degree_scaled(edges: DataFrame, w: str = "w") -> DataFrame:
    """w over the roots of its row's and its column's absolute sums."""
    row, col = F.sum(F.abs(w)).over(Window.partitionBy("tgt")), F.sum(F.abs(w)).over(Window.partitionBy("src"))
    return edges.withColumn("scaled", F.coalesce(F.try_divide(F.col(w), F.sqrt(row * col)), F.lit(0.0)))


def sector_network(edges: DataFrame, sectors: DataFrame, q: float = 0.75) -> DataFrame:
    """Mean absolute weight of each pair of sectors, over edges at or above the q quantile."""
    e = edges.withColumn("aw", F.round(F.abs("w"), 9)).persist()  # read by every pass
    cut = exact_quantiles(e, "aw", {"cut": q}, passes=1).select("cut")  # one row
    strong = e.join(F.broadcast(cut)).where("aw >= cut")
    named = strong.join(F.broadcast(sectors.toDF("src", "src_sector")), "src").join(F.broadcast(sectors.toDF("tgt", "tgt_sector")), "tgt")
    return named.groupBy("src_sector", "tgt_sector").agg(F.avg("aw").alias("weight"), F.count("*").alias("n"))


def strengths(network: DataFrame) -> DataFrame:
    """Out and in strength of each sector."""
    out = network.groupBy(F.col("src_sector").alias("sector")).agg(F.sum("weight").alias("out_strength"))
    into = network.groupBy(F.col("tgt_sector").alias("sector")).agg(F.sum("weight").alias("in_strength"))
    return out.join(into, "sector", "full_outer").fillna(0.0)


def direction_gap(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Mass of |w| from sources to targets, back, and the difference."""
    e = edges.join(F.broadcast(sources.select(F.col("ticker").alias("src"), F.lit(1).alias("ss"))), "src", "left").join(F.broadcast(targets.select(F.col("ticker").alias("tgt"), F.lit(1).alias("tt"))), "tgt", "left")
    e = e.join(F.broadcast(sources.select(F.col("ticker").alias("tgt"), F.lit(1).alias("ts"))), "tgt", "left").join(F.broadcast(targets.select(F.col("ticker").alias("src"), F.lit(1).alias("st"))), "src", "left")
    mass = lambda a, b: F.coalesce(F.sum(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.abs("w"))), F.lit(0.0))
    return e.agg(mass("ss", "tt").alias("forward_mass"), mass("st", "ts").alias("reverse_mass")).withColumn("direction_gap", F.col("forward_mass") - F.col("reverse_mass"))


def expected_false(n_tickers: int, t: float) -> float:
    """Edges beyond |t| that chance alone gives among all ordered pairs."""
    return n_tickers * (n_tickers - 1) * math.erfc(t / math.sqrt(2))


def edge_matrix(rows, value: str, targets: list, sources: list) -> np.ndarray:
    m = np.full((len(targets), len(sources)), np.nan)
    ti, si = {x: i for i, x in enumerate(targets)}, {x: i for i, x in enumerate(sources)}
    for t, s, v in zip(rows["tgt"], rows["src"], rows[value], strict=True):
        m[ti[t], si[s]] = v
    return m
