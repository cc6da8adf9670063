"""Exact quantiles of groups of any size, by histograms that narrow.

Spark's exact percentile holds a group's distinct values in one task.  Here each pass counts
the values of the bins that still hold a wanted rank, so that a group's state is its bins; what
is left after the passes is counted value by value, in order, by a window that can spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins a pass: one pass leaves about one value in 4096 of an even spread, two one in 16 million.
BINS = 4096
#: Infinite values share the outermost bins with the largest finite ones.
_LARGE = 1.7e308


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """Bin of x from lo to hi, never decreasing in x; halves keep the width finite."""
    half = lambda c: F.least(F.greatest(c, F.lit(-_LARGE)), F.lit(_LARGE)) / 2
    share = F.try_divide(half(x) - half(lo), half(hi) - half(lo))
    return F.coalesce(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")


def _picked(counts: DataFrame, state: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of `counts` (keys, order, _c, ...) that hold a wanted rank, with these ranks and the values before."""
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    j = counts.withColumn("_upto", upto).join(state.select(*keys, "_before", "_ranks"), keys)
    j = j.withColumn("_upto", F.col("_before") + F.col("_upto")).withColumn("_before", F.col("_upto") - F.col("_c"))
    inside = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_upto")))
    return j.withColumn("_ranks", inside).where(F.size("_ranks") > 0)


def exact_quantiles(df: DataFrame, x: str, qs: dict[str, float], *by: str, passes: int = 2) -> DataFrame:
    """(by..., n, name...): quantiles of x with linear interpolation, for each name its share q.

    Nulls and NaN take no part, and groups without other values have no row; a null key is a key.
    Without `by` there is one group, and no row for a table without values.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    v = df.select(key.alias("_k"), (F.col(x).cast("double") + F.lit(0.0)).alias("_x")).where("_x is not null and not isnan(_x)")
    sizes = v.groupBy("_k").agg(F.count("*").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    at = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in qs.items()}
    wanted = F.array_distinct(F.array(*(f(h).cast("long") for h in at.values() for f in (F.floor, F.ceil))))
    state = sizes.select("_k", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), wanted.alias("_ranks"))
    keys = ["_k"]
    for i in range(passes):
        v = v.join(state.select(*keys, "_lo", "_hi"), keys).select(*keys, "_x", _bin(F.col("_x"), F.col("_lo"), F.col("_hi")).alias(f"_b{i}"))
        counts = v.groupBy(*keys, f"_b{i}").agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        state = _picked(counts, state, keys, f"_b{i}")
        keys.append(f"_b{i}")
    left = v.join(state.select(*keys), keys).groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    found = _picked(left, state, keys, "_x").select("_k", F.explode("_ranks").alias("_r"), "_x")
    found = found.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_m"))  # two a quantile at most
    out = sizes.join(found, "_k")

    def value(h: Column) -> Column:
        low, high = (F.element_at("_m", f(h).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h)))

    return out.select(*(F.col("_k")[c].alias(c) for c in by), "n", *(value(h).alias(name) for name, h in at.items()))
