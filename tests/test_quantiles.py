"""Exact quantiles against NumPy, on values that bins don't part well."""

import math

import numpy as np
import pytest

from panelforge.operators import edges, metrics, quantiles

QS = {"low": 0.0, "a": 0.05, "mid": 0.5, "b": 0.93, "high": 1.0}


def groups(rng):
    return {
        "even": rng.random(3000),
        "ties": rng.integers(0, 3, 2000).astype(float),
        "one": np.array([4.25]),
        "two": np.array([-1.0, 1.0]),
        "wide": 10.0 ** rng.uniform(-300, 300, 1500) * rng.choice([-1, 1], 1500),
        "far": np.r_[1e300, rng.random(1000)],
        "zeros": np.array([0.0, -0.0, 0.0]),
        None: rng.normal(size=501),
    }


@pytest.mark.parametrize("passes", [0, 1, 2])
def test_quantiles_equal_numpy(spark, passes):
    data = groups(np.random.default_rng(5))
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("even", None), ("ties", math.nan), ("none", None)]
    got = {r.k: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), "x", QS, "k", passes=passes).collect()}
    assert got.keys() == data.keys()
    for k, v in data.items():
        assert got[k].n == len(v)
        for name, q in QS.items():
            assert got[k][name] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12), (k, name)


def test_infinities_and_no_keys(spark):
    df = spark.createDataFrame([(x,) for x in (math.inf, -math.inf, 1.0, 2.0, 3.0, 1.79e308)], "x double")
    r = quantiles.exact_quantiles(df, "x", {"low": 0.0, "a": 0.2, "mid": 0.5, "high": 1.0}).collect()
    assert [tuple(x) for x in r] == [(6, -math.inf, 1.0, 2.5, math.inf)]
    assert quantiles.exact_quantiles(df.where("x is null"), "x", {"mid": 0.5}).collect() == []


def test_clipping_keeps_rows_and_small_groups(spark):
    rows = [("a", float(i)) for i in range(11)] + [("a", None), ("b", 1.0), ("b", 9.0), ("c", None), (None, 5.0)]
    got = metrics.winsorised(spark.createDataFrame(rows, "k string, x double"), "x", 0.1, "k").collect()
    key = lambda p: (str(p[0]), str(p[1]))
    want = [("a", min(max(i, 1.0), 9.0)) for i in range(11)] + rows[11:]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_no_group_is_held_in_one_aggregate(spark):
    df = spark.range(100).selectExpr("cast(id % 3 as string) as k", "cast(id as double) as x", "cast(id as string) as src", "cast(id % 7 as string) as tgt", "cast(id as double) as w")
    sectors = spark.range(100).selectExpr("cast(id as string) as ticker", "id % 2 as sector")
    for q in (metrics.winsorised(df, "x", 0.1, "k"), edges.sector_network(df.select("src", "tgt", "w"), sectors)):
        assert "percentile" not in q._jdf.queryExecution().executedPlan().toString().lower()
