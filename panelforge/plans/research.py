"""Queries over portfolios, metrics, edges, models and walk-forward plans."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import edges as E
from ..operators import kernels as K
from ..operators import metrics as X
from ..operators import models as M
from ..operators import moments as G
from ..operators import portfolio as P
from ..operators import trees as T
from ..operators import windows as W
from ..session import cut
from ..sources import panels
from .catalog import query, rd, sql


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, t, ticker, sector, score, ret): this week's signal beside next week's return."""
    p = W.ordinal(panels.weekly(spark, sf_dir))
    after = p.select((F.col("t") - 1).alias("t"), "ticker", "ret")
    return p.select("date", "t", "ticker", "sector", F.col("sig").alias("score")).join(after, ["t", "ticker"])


#: Sides of a cross-section: k highest and lowest by (score, ticker).
_SIDES = """{name} AS (SELECT *, greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n,
  row_number() OVER (PARTITION BY {by} ORDER BY score, ticker) AS lo, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, ticker DESC) AS hi FROM sc) WHERE n >= {least} AND 2 * greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) <= n)"""
_DAY, _SECTOR = _SIDES.format(name="sd", by="date", least=2), _SIDES.format(name="ss", by="date, sector", least=4)
_GROSS = "WITH " + _DAY + ", gs AS (SELECT date, avg(CASE WHEN hi <= k THEN ret END) - avg(CASE WHEN lo <= k AND hi > k THEN ret END) AS spread FROM sd GROUP BY date) "
_NEUTRAL = "WITH " + _SECTOR + ", g1 AS (SELECT date, sector, avg(CASE WHEN hi <= k THEN ret END) - avg(CASE WHEN lo <= k AND hi > k THEN ret END) AS spread FROM ss GROUP BY 1, 2), ns AS (SELECT date, avg(spread) AS spread, count(spread) AS sectors FROM g1 GROUP BY date) "
_WEIGHTS = _GROSS + ", gw AS (SELECT date, ticker, (CASE WHEN hi <= k THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) / k AS w FROM sd WHERE hi <= k OR lo <= k)"
_TURN = _WEIGHTS + """, dg AS (SELECT d.date, n.ticker, coalesce(w, 0) AS w FROM (SELECT DISTINCT date FROM gw) d CROSS JOIN (SELECT DISTINCT ticker FROM gw) n LEFT JOIN gw ON gw.date = d.date AND gw.ticker = n.ticker),
dd AS (SELECT date, round(abs(w - lag(w, 1, 0) OVER (PARTITION BY ticker ORDER BY date)), 9) AS d FROM dg), tv AS (SELECT date, sum(d) AS twoway, sum(d) / 2 AS oneway FROM dd GROUP BY date) """


@query(sql("sc", _GROSS + "SELECT date, round(spread, 6) + 0 AS spread FROM gs"))
def gross_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gross_spread(scored(spark, sf_dir)).select("date", rd("spread"))


@query(sql("sc", _NEUTRAL + "SELECT date, round(spread, 6) + 0 AS spread, sectors FROM ns"))
def sn_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sector_neutral_spread(scored(spark, sf_dir)).select("date", rd("spread"), "sectors")


@query(sql("sc", """WITH v AS (SELECT * FROM (SELECT date, ticker, ret, score / greatest(v, 1e-8) AS score, 1 / greatest(v, 1e-8) AS w FROM (SELECT *, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END AS v FROM sc WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE v IS NOT NULL)),
r AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS lo, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker DESC) AS hi FROM v), k AS (SELECT *, greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) AS k FROM r)
SELECT date, round(sum(CASE WHEN hi <= k THEN ret * w END) / sum(CASE WHEN hi <= k THEN w END) - sum(CASE WHEN lo <= k AND hi > k THEN ret * w END) / sum(CASE WHEN lo <= k AND hi > k THEN w END), 6) + 0 AS spread FROM k WHERE n >= 2 AND 2 * k <= n GROUP BY date"""))
def vol_scaled_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.trailing(60, shift=1)
    s = scored(spark, sf_dir).withColumn("vol", W.full(F.stddev_samp("ret"), "ret", w, 20))
    return P.vol_scaled_spread(s).select("date", rd("spread"))


@query(sql("sc", _WEIGHTS + "SELECT date, ticker, round(w, 6) + 0 AS w FROM gw"))
def gross_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gross_weights(scored(spark, sf_dir)).select("date", "ticker", rd("w"))


@query(sql("sc", "WITH " + _SECTOR + ", a AS (SELECT *, (SELECT 1) AS one FROM ss WHERE hi <= k OR lo <= k), c AS (SELECT date, count(DISTINCT sector) AS active FROM a GROUP BY date) SELECT date, ticker, sector, round((CASE WHEN hi <= k THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) / (k * active), 6) + 0 AS w FROM a JOIN c USING (date)"))
def sn_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sector_neutral_weights(scored(spark, sf_dir)).select("date", "ticker", "sector", rd("w"))


@query(sql("sc", """WITH r AS (SELECT date, ticker, (rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) - 0.5::DOUBLE AS raw FROM sc)
SELECT date, ticker, round(raw / nullif(sum(abs(raw)) OVER (PARTITION BY date), 0), 6) + 0 AS w FROM r"""))
def rank_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rank_weights(scored(spark, sf_dir), "date").select("date", "ticker", rd("w"))


@query(sql("sc", _TURN + "SELECT date, round(oneway, 6) + 0 AS turnover FROM tv"))
def turnover_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.turnover(P.gross_weights(scored(spark, sf_dir))).select("date", rd("turnover"))


@query(sql("sc", _TURN + "SELECT date, round(twoway, 6) + 0 AS turnover FROM tv"))
def turnover_twoway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.turnover(P.gross_weights(scored(spark, sf_dir)), one_way=False).select("date", rd("turnover"))


@query(sql("sc", _TURN + "SELECT date, round(spread - 10 * 1e-4 * oneway, 6) + 0 AS net FROM gs JOIN tv USING (date)"))
def net_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return P.net_spread(P.gross_spread(s), P.turnover(P.gross_weights(s)), 10).select("date", rd("net"))


@query(sql("sc", _TURN + "SELECT round(CASE WHEN avg(oneway) > 0 THEN avg(spread) / avg(oneway) * 10000 END, 4) + 0 AS breakeven_bps FROM gs JOIN tv USING (date)"))
def breakeven(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return P.breakeven(P.gross_spread(s), P.turnover(P.gross_weights(s))).select((F.round("breakeven_bps", 4) + F.lit(0.0)).alias("breakeven_bps"))


@query(sql("sc", _TURN + "SELECT CAST(bps AS INTEGER) AS bps, round(avg(spread - bps * 1e-4 * oneway) / stddev_samp(spread - bps * 1e-4 * oneway) * sqrt(252), 5) + 0 AS sharpe FROM gs JOIN tv USING (date), (SELECT unnest([0, 5, 10, 20, 30]) AS bps) GROUP BY 1"))
def net_sharpe_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    j = P.gross_spread(s).join(P.turnover(P.gross_weights(s)), "date").withColumn("bps", F.explode(F.array(*map(F.lit, (0, 5, 10, 20, 30)))))
    net = j.withColumn("net", F.col("spread") - F.col("bps") * 1e-4 * F.col("turnover"))
    return net.groupBy("bps").agg((F.round(X.sharpe("net"), 5) + F.lit(0.0)).alias("sharpe"))


_IC = """WITH q AS (SELECT date, sector, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0::DOUBLE AS b FROM sc), ic AS (SELECT date, count(*) AS n, corr(a, b) AS ic FROM q GROUP BY date HAVING count(*) >= 5) """


@query(sql("sc", _IC + "SELECT date, n, round(ic, 6) + 0 AS ic FROM ic"))
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_ic(scored(spark, sf_dir), 5).select("date", "n", rd("ic"))


@query(sql("sc", _IC + "SELECT date, round(CASE WHEN count(ic) OVER w >= 60 THEN avg(ic) OVER w END, 6) + 0 AS ic60 FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"))
def rolling_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-59, 0)
    return P.daily_ic(scored(spark, sf_dir), 5).select("date", rd(W.full(F.avg("ic"), "ic", w, 60), "ic60"))


@query(sql("sc", _GROSS + "SELECT date, round(greatest(CASE WHEN count(spread) OVER w >= 60 THEN avg(spread) OVER w / (stddev_samp(spread) OVER w + 1e-9) END, 0), 5) + 0 AS sharpe FROM gs WHERE true WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)".replace("greatest(CASE", "(CASE").replace("END, 0), 5)", "END), 5)")))
def rolling_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gross_spread(scored(spark, sf_dir)).select("date", (F.round(X.rolling_sharpe("spread", 60), 5) + F.lit(0.0)).alias("sharpe"))


_CUM = _GROSS + ", cu AS (SELECT date, spread, sum(spread) OVER (ORDER BY date) AS cum, exp(sum(ln(1 + spread)) OVER (ORDER BY date)) - 1 AS compound FROM gs), pk AS (SELECT *, max(cum) OVER (ORDER BY date) AS peak FROM cu) "


@query(sql("sc", _CUM + "SELECT date, round(cum, 6) + 0 AS cum, round(peak, 6) + 0 AS peak, round(compound, 6) + 0 AS compound FROM pk"))
def cum_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cumulative(P.gross_spread(scored(spark, sf_dir)), "spread").select("date", rd("cum"), rd("peak"), rd("compound"))


@query(sql("sc", _CUM + "SELECT round(min(cum - peak), 6) + 0 AS max_drawdown FROM pk"))
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.max_drawdown(P.gross_spread(scored(spark, sf_dir)), "spread").select(rd("max_drawdown"))


_PERF = "count(spread) AS n_obs, round(avg(spread), 6) + 0 AS mean, round(stddev_samp(spread), 6) + 0 AS sd, round(avg(spread) / stddev_samp(spread), 5) + 0 AS sharpe, round(avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0.0 END), 6) + 0 AS hit_rate, round(sum(spread), 6) + 0 AS total"
_PERF_COLS = lambda: ("n_obs", rd("mean"), rd("sd"), (F.round("sharpe", 5) + F.lit(0.0)).alias("sharpe"), rd("hit_rate"), rd("total"))


@query(sql("sc", _GROSS + f"SELECT {_PERF} FROM gs"))
def perf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.performance(P.gross_spread(scored(spark, sf_dir)), "spread").select(*_PERF_COLS())


@query(sql("sc", _NEUTRAL + f"SELECT sector, {_PERF} FROM g1 GROUP BY sector"))
def sector_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.performance(P.spread(scored(spark, sf_dir).withColumn("_n", F.count("*").over(Window.partitionBy("date", "sector"))).where("_n >= 4"), 0.2, "date", "sector"), "spread", "sector").select("sector", *_PERF_COLS())


_EDGE = """WITH ed AS (SELECT a.ticker AS tgt, b.ticker AS src, count(*) AS n, avg(a.ret * b.sig) AS mu, stddev_samp(a.ret * b.sig) AS sd FROM pt a JOIN pt b ON a.t = b.t + 1 GROUP BY 1, 2), es AS (SELECT *, mu / nullif(sd, 0) AS a, mu / nullif(sd, 0) * sqrt(n) AS tstat FROM ed) """


@query(sql("pt", _EDGE + "SELECT tgt, src, n, round(mu, 6) + 0 AS mu, round(sd, 6) + 0 AS sd, round(a, 6) + 0 AS a, round(tstat, 5) + 0 AS tstat FROM es"))
def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.edge_stats(panels.weekly(spark, sf_dir))
    return e.select("tgt", "src", "n", rd("mu"), rd("sd"), rd("a"), (F.round("tstat", 5) + F.lit(0.0)).alias("tstat"))


@query(sql("pt", _EDGE + "SELECT tgt, src, n FROM es WHERE abs(tstat) >= 1.5 AND n >= 30 AND src <> tgt"))
def edge_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.significant(E.edge_stats(panels.weekly(spark, sf_dir)), 1.5, 30).select("tgt", "src", "n")


@query()
def bh_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the whole panel kept at a false discovery rate of 0.1, by normal p values."""
    return E.false_discovery(E.p_values(E.edge_stats(panels.weekly(spark, sf_dir)), False), 0.1).select("tgt", "src", "n", "tstat", "p", "keep")


@query(sql("pt", _EDGE + "SELECT tgt, src, round(coalesce(a / nullif(sqrt(sum(abs(a)) OVER (PARTITION BY tgt) * sum(abs(a)) OVER (PARTITION BY src)), 0), 0), 6) + 0 AS scaled FROM es"))
def bipartite_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.degree_scaled(E.edge_stats(panels.weekly(spark, sf_dir)), "a").select("tgt", "src", rd("scaled"))


_NET = _EDGE + ", aw AS (SELECT tgt, src, round(abs(a), 9) AS aw FROM es), nm AS (SELECT DISTINCT ticker, sector FROM pt), st AS (SELECT * FROM aw WHERE aw >= (SELECT quantile_cont(aw, 0.75) FROM aw)), nw AS (SELECT x.sector AS src_sector, y.sector AS tgt_sector, avg(aw) AS weight, count(*) AS n FROM st JOIN nm x ON x.ticker = src JOIN nm y ON y.ticker = tgt GROUP BY 1, 2) "


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    return E.sector_network(E.edge_stats(p).withColumnRenamed("a", "w"), p.select("ticker", "sector").distinct())


@query(sql("pt", _NET + "SELECT src_sector, tgt_sector, round(weight, 6) + 0 AS weight, n FROM nw"))
def sector_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir).select("src_sector", "tgt_sector", rd("weight"), "n")


@query(sql("pt", _NET + "SELECT sector, round(coalesce(o, 0), 6) + 0 AS out_strength, round(coalesce(i, 0), 6) + 0 AS in_strength FROM (SELECT src_sector AS sector, sum(weight) AS o FROM nw GROUP BY 1) FULL JOIN (SELECT tgt_sector AS sector, sum(weight) AS i FROM nw GROUP BY 1) USING (sector)"))
def influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.strengths(_network(spark, sf_dir)).select("sector", rd("out_strength"), rd("in_strength"))


@query(sql("pt", _EDGE + "SELECT count(*) AS n, sum(CASE WHEN x.sector = y.sector THEN 1 ELSE 0 END)::BIGINT AS within FROM es JOIN (SELECT DISTINCT ticker, sector FROM pt) x ON x.ticker = src JOIN (SELECT DISTINCT ticker, sector FROM pt) y ON y.ticker = tgt"))
def same_sector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    e = E.edge_stats(p)
    return e.agg(F.count("*").alias("n")).join(E.same_sector(e, p.select("ticker", "sector").distinct()).agg(F.count("*").alias("within")))


@query(sql("sc", "SELECT ticker, round(sum(score * ret) / (sum(score * score) + 10), 8) + 0 AS w, count(*) AS n FROM sc GROUP BY ticker"))
def diag_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.diagonal(scored(spark, sf_dir).select("ticker", F.col("score").alias("x"), F.col("ret").alias("y")), 10, "ticker")
    return d.select("ticker", (F.round("w", 8) + F.lit(0.0)).alias("w"), "n")


@query(sql("sc", "SELECT ticker, round(sign(sum(score * ret)) * greatest(abs(sum(score * ret)) - 20, 0) / sum(score * score), 8) + 0 AS w FROM sc GROUP BY ticker"))
def diag_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy, xx = F.sum(F.col("score") * F.col("ret")), F.sum(F.col("score") * F.col("score"))
    return scored(spark, sf_dir).groupBy("ticker").agg((F.round(S.soft_threshold(xy, 20.0) / xx, 8) + F.lit(0.0)).alias("w"))


@query(sql("pt", "WITH s AS (SELECT ticker, avg(sig) AS m, stddev_pop(sig) AS sd FROM pt WHERE t < 200 GROUP BY ticker) SELECT date, ticker, round(coalesce((sig - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 0), 6) + 0 AS z FROM pt JOIN s USING (ticker) WHERE t >= 200"))
def train_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.ordinal(panels.weekly(spark, sf_dir))
    j = p.where("t >= 200").join(F.broadcast(M.standardised(p.where("t < 200"), "sig", "ticker")), "ticker")
    return j.select("date", "ticker", rd(F.coalesce((F.col("sig") - F.col("mean")) / F.col("sd"), F.lit(0.0)), "z"))


@query(sql("pt", "WITH m AS (SELECT max(t) AS m FROM pt) SELECT CAST((s - 105) // 13 AS INTEGER) AS \"window\", CAST(s - 104 AS INTEGER) AS tr0, CAST(s AS INTEGER) AS tr1, CAST(s AS INTEGER) AS te0, CAST(least(s + 13, m + 1) AS INTEGER) AS te1 FROM m, (SELECT unnest(range(105, 100000, 13)) AS s) WHERE s <= m"))
def walk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.windows(W.ordinal(panels.weekly(spark, sf_dir)), 104, 13, skip_first=True)


@query(sql("sc", _NEUTRAL.replace("WITH ", "WITH " + _DAY + ", ", 1) + ", gs AS (SELECT date, avg(CASE WHEN hi <= k THEN ret END) - avg(CASE WHEN lo <= k AND hi > k THEN ret END) AS spread FROM sd GROUP BY date) SELECT date, round((gs.spread + ns.spread) / 2, 6) + 0 AS spread FROM gs JOIN ns USING (date)"))
def ensemble_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    j = P.gross_spread(s).join(P.sector_neutral_spread(s).select("date", F.col("spread").alias("other")), "date")
    return j.select("date", rd((F.col("spread") + F.col("other")) / 2, "spread"))


@query()
def ensemble_srw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies weighted by their past rolling Sharpe ratios, half and half where neither is known."""
    s = scored(spark, sf_dir)
    j = P.gross_spread(s).join(P.sector_neutral_spread(s).select("date", F.col("spread").alias("other")), "date")
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    j = j.withColumns({"a": X.rolling_sharpe("spread", 60, True), "b": X.rolling_sharpe("other", 60, True)})
    j = j.withColumns({"a": F.lag("a").over(w), "b": F.lag("b").over(w)})
    share = F.coalesce(F.try_divide("a", F.col("a") + F.col("b")), F.lit(0.5))
    return j.select("date", rd(share * F.col("spread") + (1 - share) * F.col("other"), "spread"))


@query(sql("pw", "WITH q AS (SELECT sector, quantile_cont(sig, 0.05) AS a, quantile_cont(sig, 0.95) AS b FROM pw GROUP BY sector) SELECT date, ticker, round(least(greatest(sig, a), b), 6) + 0 AS sig FROM pw JOIN q USING (sector)"))
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.winsorised(panels.weekly(spark, sf_dir), "sig", 0.05, "sector").select("date", "ticker", rd("sig"))


@query(sql("pt", """WITH k AS (SELECT t // 50 AS w, ticker, sum(sig) AS s FROM pt GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s DESC, ticker) AS k FROM k), m AS (SELECT w, list(ticker ORDER BY ticker) AS m FROM r WHERE k <= 8 GROUP BY w)
SELECT CAST(a.w AS BIGINT) AS block, round(len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m)))::DOUBLE, 6) + 0 AS jaccard FROM m a JOIN m b ON b.w = a.w - 1"""))
def jaccard_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.ordinal(panels.weekly(spark, sf_dir)).groupBy(F.floor(F.col("t") / 50).cast("long").alias("block"), "ticker").agg(F.sum("sig").alias("s"))
    best = p.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("s"), "ticker"))).where("k <= 8")
    m = best.groupBy("block").agg(F.collect_set("ticker").alias("m"))
    before = F.lag("m").over(Window.partitionBy(F.lit(0)).orderBy("block"))
    return m.withColumn("was", before).where("was is not null").select("block", rd(S.jaccard(F.col("m"), F.col("was")), "jaccard"))


@query(sql("pw", "SELECT least(greatest(CAST(floor((sig - 0) / 200) AS BIGINT) + 1, 0), 11) AS bin, count(*) AS n FROM pw GROUP BY 1"))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.histogram(panels.weekly(spark, sf_dir), "sig", 0.0, 2000.0, 10)


@query(sql("pw", "SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, round(covar_samp(a.sig, b.sig), 3) + 0 AS cov, round(corr(a.sig, b.sig), 6) + 0 AS corr FROM pw a JOIN pw b ON a.date = b.date AND a.ticker <= b.ticker GROUP BY 1, 2"))
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    j = p.select("date", F.col("ticker").alias("a"), F.col("sig").alias("x")).join(p.select("date", F.col("ticker").alias("b"), F.col("sig").alias("y")), "date").where("a <= b")
    return j.groupBy("a", "b").agg(F.count("*").alias("n"), (F.round(F.covar_samp("x", "y"), 3) + F.lit(0.0)).alias("cov"), rd(W.correlation("x", "y"), "corr"))


@query(sql("sc", _WEIGHTS + ", dg AS (SELECT d.date, d.t, n.ticker, coalesce(w, 0) AS w FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM gw)) d CROSS JOIN (SELECT DISTINCT ticker FROM gw) n LEFT JOIN gw ON gw.date = d.date AND gw.ticker = n.ticker), h AS (SELECT a.date, a.ticker, b.w FROM dg a JOIN dg b ON a.ticker = b.ticker AND b.t = a.t - a.t % 4) SELECT date, ticker, round(w, 6) + 0 AS w FROM h WHERE w <> 0"))
def rebalance_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.held(P.gross_weights(scored(spark, sf_dir)), 4).select("date", "ticker", rd("w")).where("w <> 0")


@query(sql("sc", _WEIGHTS + "SELECT date, round(sum(w * coalesce(ret, 0)), 6) + 0 AS pnl FROM gw LEFT JOIN sc USING (date, ticker) GROUP BY date"))
def cash_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return P.cash_pnl(P.gross_weights(s), s.select("date", "ticker", "ret")).select("date", rd("pnl"))




@query(sql("pt", _EDGE + "SELECT round(coalesce(sum(CASE WHEN src < 'NATION_15' AND tgt >= 'NATION_22' THEN abs(a) END), 0), 6) + 0 AS forward_mass, round(coalesce(sum(CASE WHEN tgt < 'NATION_15' AND src >= 'NATION_22' THEN abs(a) END), 0), 6) + 0 AS reverse_mass, round(coalesce(sum(CASE WHEN src < 'NATION_15' AND tgt >= 'NATION_22' THEN abs(a) END), 0) - coalesce(sum(CASE WHEN tgt < 'NATION_15' AND src >= 'NATION_22' THEN abs(a) END), 0), 6) + 0 AS direction_gap FROM es"))
def direction_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    names = p.select("ticker").distinct()
    g = E.direction_gap(E.edge_stats(p).withColumnRenamed("a", "w"), names.where("ticker < 'NATION_15'"), names.where("ticker >= 'NATION_22'"))
    return g.select(rd("forward_mass"), rd("reverse_mass"), rd("direction_gap"))


@query(sql("pt", _EDGE + "SELECT CAST(tgt < 'NATION_2' AS INTEGER) AS rc, CAST(src < 'NATION_2' AS INTEGER) AS cc, round(sum(a * n) / sum(n), 6) + 0 AS block_score, count(*) AS edges FROM es WHERE a IS NOT NULL GROUP BY 1, 2"))
def block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    lab = p.select("ticker").distinct().withColumn("c", (F.col("ticker") < "NATION_2").cast("int"))
    return M.best_block(E.edge_stats(p), lab, lab).select("rc", "cc", rd("block_score"), "edges")


_FACTOR = "f AS (SELECT ticker, 1.0::DOUBLE / (1 + length(ticker)) AS load FROM (SELECT DISTINCT ticker FROM pt)), z AS (SELECT date, sum(load * sig) AS z FROM pt JOIN f USING (ticker) GROUP BY date), p AS (SELECT date, ticker, load * z AS p FROM z, f), c AS (SELECT date, ticker, p - avg(p) OVER (PARTITION BY date) AS p FROM p) SELECT date, ticker, round(coalesce(p / nullif(sum(abs(p)) OVER (PARTITION BY date), 0), 0), 6) + 0 AS w FROM c"


@query(sql("pt", "WITH " + _FACTOR))
def factor_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    f = p.select("ticker").distinct().withColumn("load", 1.0 / (1 + F.length("ticker")))
    return P.factor_positions(p.select("date", "ticker", F.col("sig").alias("signal")), f.withColumnRenamed("load", "weight"), f).select("date", "ticker", rd("w"))


def aligned(spark: SparkSession, sf_dir: str, train: int = 104, test: int = 52) -> tuple[DataFrame, DataFrame]:
    """The panel as (t, ticker, sector, x, y) in windows, of the names that each window covers, and the windows."""
    s = scored(spark, sf_dir).select("t", "ticker", "sector", F.col("score").alias("x"), F.col("ret").alias("y"))
    ranges = M.windows(s, train, test)
    return M.in_window(s, ranges, "tr0", "tr1").join(M.covered(s, ranges), ["window", "ticker"], "left_semi"), ranges


def _fit(spark: SparkSession, sf_dir: str, solver: M.Solver) -> DataFrame:
    return M.fit_blocks(aligned(spark, sf_dir)[0], solver, "window", "sector")


@query()
def sector_block_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, partial(K.ridge, lam=10.0))


@query()
def ols_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, K.ols)


@query()
def lasso_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, partial(K.lasso, lam=0.05))


@query()
def nuclear_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, partial(K.nuclear, lam=1.0, mu=5.0))


@query()
def dense_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fit_blocks(aligned(spark, sf_dir)[0], partial(K.ridge, lam=10.0), "window")


@query()
def soft_block_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fit_soft(aligned(spark, sf_dir)[0], 10.0, 5.0)


@query()
def lowrank_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.denoised(sector_block_ridge(spark, sf_dir), partial(K.low_rank, k=1), "window", "sector", zero_diagonal=True)


@query()
def blended_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector-block ridge with own coefficients halved."""
    return M.blended(sector_block_ridge(spark, sf_dir), 0.5)


@query()
def gd_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.denoised(dense_ridge(spark, sf_dir), lambda w: K.hard_threshold(w)[0], "window")


#: Penalties that are tried.
GRID = (0.1, 1.0, 10.0, 100.0, 1000.0)


def ranked_penalties(whole: DataFrame, early: Column, late: Column) -> DataFrame:
    """(window, lam, ic): of each window, the penalty whose fit on its early dates ranks its late ones best; the smaller of equals.

    x and y are standardised by name over the whole window once, and both sides of the ranking stay in these units.
    """
    z = M.standard_scores(M.standard_scores(whole, whole, "x", "window"), whole, "y", "window")
    w = M.fit_grid(z.where(early), GRID, "window", "sector", standard=False).drop("sector")
    judge = z.where(late)
    p = M.predict(judge.select("window", "t", "ticker", "x"), w, "window", also=("lam",)).join(judge.select("window", "t", "ticker", "y"), ["window", "t", "ticker"])
    return M.choose(M.information(p, "window", "lam").withColumn("ic", F.round("ic", 9)), "ic", "lam", "window")


@query()
def lambda_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalty with the highest in-sample rank correlation in each window."""
    return ranked_penalties(aligned(spark, sf_dir)[0], F.lit(True), F.lit(True))


def walk_forward_grid(spark: SparkSession, sf_dir: str, lams: tuple[float, ...]) -> DataFrame:
    """(lam, t, ticker, sector, score, ret): block-ridge predictions, in return units, of every test block; the later block wins."""
    train, ranges = aligned(spark, sf_dir)
    w = M.fit_grid(train, lams, "window", "sector").drop("sector")
    s = scored(spark, sf_dir)
    test = M.in_window(s, ranges, "te0", "te1").select("window", "t", "ticker", F.col("score").alias("x"))
    p = M.predict(M.standard_scores(test, train, "x", "window"), w, "window", also=("lam",))
    p = M.in_return_units(p, train, "window").groupBy("lam", "t", "ticker").agg(F.max_by("score", "window").alias("score"))
    return p.join(s.drop("score"), ["t", "ticker"])


def walk_forward(spark: SparkSession, sf_dir: str, lam: float = 10.0) -> DataFrame:
    return walk_forward_grid(spark, sf_dir, (lam,)).drop("lam")


@query()
def walkforward_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = walk_forward(spark, sf_dir)
    return P.gross_spread(p).join(P.daily_ic(p).select("date", "ic"), "date")


@query()
def walkforward_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = walk_forward(spark, sf_dir)
    return P.net_spread(P.gross_spread(p), P.turnover(P.gross_weights(p)), 10)


#: Own-signal ridge walked forward over `panel` (t, date, ticker, score, ret), predictions in return units.
_OWN = """, r AS (SELECT i AS w, {train} + {test} * i AS te0, least({train} + {test} * (i + 1), n + 1) AS te1 FROM (SELECT max(t) AS n FROM {panel}), (SELECT unnest(range(0, 5000)) AS i) WHERE {train} + {test} * i <= n),
a AS (SELECT w, te0, {panel}.* FROM r JOIN {panel} ON t >= te0 - {train} AND t < te1),
s AS (SELECT w, ticker, avg(score) FILTER (t < te0 - {gap}) AS mx, stddev_pop(score) FILTER (t < te0 - {gap}) AS sx, avg(ret) FILTER (t < te0 - {gap}) AS my, stddev_pop(ret) FILTER (t < te0 - {gap}) AS sy
  FROM a GROUP BY 1, 2 HAVING count(*) FILTER (score IS NOT NULL AND ret IS NOT NULL) >= 30 AND sx > 1e-9 AND sy > 1e-9),
b AS (SELECT w, ticker, sum((score - mx) / sx * (ret - my) / sy) / (sum(((score - mx) / sx) ** 2) + 10) AS b FROM a JOIN s USING (w, ticker) WHERE t < te0 - {gap} GROUP BY 1, 2)
SELECT date, ticker, round(b * (score - mx) / sx * sy + my, 6) + 0 AS score FROM a JOIN s USING (w, ticker) JOIN b USING (w, ticker) WHERE t >= te0"""


@query(sql("sc", "WITH q AS (SELECT 1)" + _OWN.format(panel="sc", train=104, test=52, gap=0)))
def walkforward_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name's return on its own signal, refitted every 52 weeks on the 104 before; predictions in return units."""
    train, ranges = aligned(spark, sf_dir)
    z = M.standard_scores(M.standard_scores(train, train, "x", "window"), train, "y", "window")
    w = M.diagonal(z, 10.0, "window", "ticker").select("window", "ticker", "w")
    test = M.in_window(scored(spark, sf_dir), ranges, "te0", "te1").select("window", "date", "ticker", F.col("score").alias("x"))
    p = M.standard_scores(test, train, "x", "window").join(w, ["window", "ticker"]).withColumn("score", F.col("x") * F.col("w"))
    return M.in_return_units(p, train, "window").select("date", "ticker", rd("score"))


#: Days of training and days between refits.
DAYS, EVERY = 750, 21


def daily_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() by day."""
    p = W.ordinal(panels.daily(spark, sf_dir))
    after = p.select((F.col("t") - 1).alias("t"), "ticker", "ret")
    return p.select("date", "t", "ticker", "sector", F.col("sig").alias("score")).join(after, ["t", "ticker"])


def daily_windows(s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows of the daily walk-forward, their moments, and the names that they keep.

    The last training date's return is the first test date's, so it is left out.
    """
    ranges = M.windows(s, DAYS, EVERY).withColumn("tr1", F.col("tr1") - 1)
    m = G.window_moments(s.select("sector", "t", "ticker", F.col("score").alias("x"), F.col("ret").alias("y")), ranges, "sector").persist()  # used for names and fits
    return ranges, m, G.names_kept(m, "sector")


def _in_units(s: DataFrame, ranges: DataFrame, kept: DataFrame) -> DataFrame:
    """Test rows of each window with x standardised by the window's names, and what turns a prediction into a return."""
    test = M.in_window(s, ranges, "te0", "te1").join(kept.drop("sector"), ["window", "ticker"])
    return test.select("window", "date", "t", "ticker", "sector", "ret", ((F.col("score") - F.col("mx")) / F.col("sx")).alias("x"), "my", "sy")


@query()
def walkforward_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector-block ridge by day, refitted every 21 days on the 750 before, from differences of running moments."""
    s = daily_scored(spark, sf_dir)
    ranges, m, kept = daily_windows(s)
    test = _in_units(s, ranges, kept)
    p = M.predict(test.select("window", "t", "ticker", "x"), G.ridge_of(m, kept, 10.0, "sector").drop("sector"), "window")
    p = p.join(test.drop("x"), ["window", "t", "ticker"])
    return p.select("date", "ticker", "sector", (F.col("score") * F.col("sy") + F.col("my")).alias("score"), "ret")


@query(sql("pd", "WITH pn AS (SELECT pd.*, t FROM pd JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM pd)) USING (date)), sq AS (SELECT a.date, a.t, a.ticker, a.sig AS score, b.ret FROM pn a JOIN pn b ON b.ticker = a.ticker AND b.t = a.t + 1)" + _OWN.format(panel="sq", train=DAYS, test=EVERY, gap=1)))
def walkforward_daily_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows and moments, each name's return on its own signal alone."""
    s = daily_scored(spark, sf_dir)
    ranges, m, kept = daily_windows(s)
    p = _in_units(s, ranges, kept).join(G.own_ridge_of(m, kept, 10.0, "sector").drop("sector"), ["window", "ticker"])
    return p.select("date", "ticker", rd(F.col("x") * F.col("w") * F.col("sy") + F.col("my"), "score"))


@query()
def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of 64 runs, best first: four penalties by four portfolio quantiles by four rebalancing intervals."""
    p = walk_forward_grid(spark, sf_dir, (0.1, 1.0, 10.0, 100.0))
    held = None
    for q in (0.05, 0.1, 0.2, 0.3):
        one = P.sides(p, q, "lam", "t").where("side <> 0").select("lam", F.lit(q).alias("q"), F.col("t").alias("t0"), "ticker", (F.col("side") / F.col("k")).alias("w"))
        held = one if held is None else held.unionByName(one)
    # Weights of the last rebalance earn the returns of the dates up to the next one; a missing return counts as 0.
    dates = p.select("lam", "t").distinct().withColumn("every", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))))
    book = dates.withColumn("t0", F.col("t") - F.col("t") % F.col("every")).join(held, ["lam", "t0"])
    pnl = book.join(p.select("lam", "t", "ticker", "ret"), ["lam", "t", "ticker"], "left").groupBy("lam", "q", "every", "t").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("pnl"))
    return X.performance(pnl, "pnl", "lam", "q", "every").orderBy(F.desc_nulls_last("sharpe"), "lam", "q", "every")


#: Penalties of the static sweep, and the share of dates that it trains on.
STATIC, EARLY = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0), 0.9


def static_weights(train: DataFrame, lams: tuple[float, ...]) -> DataFrame:
    """(model, lam, window, src, tgt, w) of the dense, own-signal, sector-block and block without own-signal ridge, each fitted once for all penalties."""
    z = M.standard_scores(M.standard_scores(train, train, "x", "window"), train, "y", "window")
    sums = z.groupBy("window", "ticker").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    grid = sums.withColumn("lam", F.explode(F.array(*map(F.lit, lams))))
    # Of a name's own pair every model has a row: of a sector too small to fit it is 0, so that the name's mean is predicted.
    model = lambda *names: F.explode(F.array(*map(F.lit, names)))
    own = grid.withColumn("model", model("dense", "diagonal_only", "sector_block", "sector_offdiag"))
    own = own.select("window", "lam", F.col("ticker").alias("src"), F.col("ticker").alias("tgt"), F.when(F.col("model") == "diagonal_only", F.col("xy") / (F.col("xx") + F.col("lam"))).otherwise(0.0).alias("w"), "model")
    dense = M.fit_grid(train, lams, "window").withColumn("model", F.lit("dense"))
    block = M.fit_grid(train, lams, "window", "sector").drop("sector").withColumn("model", model("sector_block", "sector_offdiag")).where("model = 'sector_block' or src <> tgt")
    return own.unionByName(dense).unionByName(block)


@query()
def static_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models by seven penalties, fitted on the first nine tenths of the dates and ranked on the rest: by the
    sector-neutral Sharpe ratio, then the plain one, then the mean rank correlation, then the smaller penalty."""
    s = cut(scored(spark, sf_dir))  # a row a week and name; every step starts from it or from its training rows
    n = s.select(F.countDistinct("t"), F.max("t")).first()
    split = int(n[0] * EARLY)
    ranges = spark.createDataFrame([(0, 0, split, split, n[1] + 1)] if n[0] else [], "window int, tr0 int, tr1 int, te0 int, te1 int")
    rows = s.withColumnsRenamed({"score": "x", "ret": "y"})
    train = cut(M.in_window(rows, ranges, "tr0", "tr1").join(M.covered(rows, ranges), ["window", "ticker"], "left_semi").select("window", "t", "ticker", "sector", "x", "y"))
    test = M.standard_scores(M.in_window(rows, ranges, "te0", "te1").select("window", "t", "ticker", "x"), train, "x", "window")
    p = M.in_return_units(M.predict(test, static_weights(train, STATIC), "window", also=("model", "lam")), train, "window")
    # Rounded, so that the order of sums doesn't decide between equal scores; read by three measures.
    p = cut(p.withColumn("score", F.round("score", 9)).join(s.drop("score"), ["t", "ticker"]))
    run = ("model", "lam")
    neutral = P.sector_neutral_spread(p, by=run).groupBy(*run).agg(X.sharpe("spread").alias("sharpe_neutral"), F.count("spread").alias("dates"))
    plain = P.spread(p, 0.2, *run, "date").groupBy(*run).agg(X.sharpe("spread").alias("sharpe"))
    out = plain.join(neutral, list(run), "left").join(M.information(p.withColumnRenamed("ret", "y"), *run), list(run), "left")
    best = Window.partitionBy("model").orderBy(F.desc_nulls_last(F.round("sharpe_neutral", 6)), F.desc_nulls_last(F.round("sharpe", 6)), F.desc_nulls_last(F.round("ic", 6)), "lam")
    return out.withColumn("rank", F.row_number().over(best)).orderBy("model", "rank")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.ordinal(panels.weekly(spark, sf_dir)).withColumn("window", F.floor(F.col("t") / 120).cast("int"))
    return E.edge_stats(p, "sig", "ret", 1, "window")


@query()
def edge_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.false_discovery(E.p_values(_edges(spark, sf_dir)), 0.1, "p", "window")


@query()
def dst_bicluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.biclusters(_edges(spark, sf_dir), "tstat", M.members(partial(K.alternating, targets=8, sources=8)), "window")


@query()
def sparse_bicluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.biclusters(_edges(spark, sf_dir).withColumn("b", F.abs("tstat")), "b", partial(K.sparse_rank_one, rows=8, cols=8), "window")


@query()
def block_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.biclusters(_edges(spark, sf_dir), "a", K.block_factor, "window")


@query()
def dhillon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.biclusters(_edges(spark, sf_dir), "a", partial(K.cocluster, k=4), "window")


@query()
def spectral_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.biclusters(_edges(spark, sf_dir), "a", lambda w: (lambda s: (s, s))(K.spectral(np.asarray(w), 4)), "window")


_FEATURES = ["score", "pct", "dev"]
#: The reference's penalties.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 1e4)


def _panel_ml(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.ml.feature import VectorAssembler

    s = scored(spark, sf_dir).withColumn("pct", W.percentile_rank("score", "date"))
    s = s.withColumn("dev", F.col("score") - F.avg("score").over(Window.partitionBy("date", "sector")))
    v = VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(s).select("date", "t", "ticker", "sector", *_FEATURES, "features", F.col("ret").alias("label"))
    return v.where("t < 250"), v.where("t >= 250")


def _ml(spark: SparkSession, sf_dir: str, estimator) -> DataFrame:
    train, test = _panel_ml(spark, sf_dir)
    return estimator.fit(train).transform(test).select("date", "ticker", "sector", F.col("prediction").alias("score"), F.col("label").alias("ret"))


@query()
def panel_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on standardised features, with the penalty of least leave-one-out error on the training dates."""
    train, test = _panel_ml(spark, sf_dir)
    _, w, b = M.panel_leave_one_out(train, _FEATURES, "label", ALPHAS)
    score = sum((F.col(c) * float(x) for c, x in zip(_FEATURES, w, strict=True)), F.lit(b))
    return test.select("date", "ticker", "sector", score.alias("score"), F.col("label").alias("ret"))


@query()
def panel_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.regression import RandomForestRegressor

    return _ml(spark, sf_dir, RandomForestRegressor(numTrees=200, maxDepth=6, minInstancesPerNode=50, featureSubsetStrategy="0.5", seed=3))


@query()
def panel_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.regression import GBTRegressor

    return _ml(spark, sf_dir, GBTRegressor(maxIter=200, maxDepth=4, minInstancesPerNode=50, stepSize=0.05, seed=3))


def window_rows(spark: SparkSession, sf_dir: str, train: int = 104, test: int = 52) -> DataFrame:
    """Training and test rows of every window with the panel features, and which is which."""
    s = scored(spark, sf_dir).withColumn("pct", W.percentile_rank("score", "date"))
    s = s.withColumn("dev", F.col("score") - F.avg("score").over(Window.partitionBy("date", "sector"))).withColumnRenamed("ret", "y")
    ranges = M.windows(s, train, test)
    rows = M.in_window(s, ranges, "tr0", "te1").join(F.broadcast(ranges.select("window", "te0")), "window")
    return rows.select("window", "sector", "date", "t", "ticker", *_FEATURES, "y", (F.col("t") >= F.col("te0")).alias("test"))


def _walked_trees(spark: SparkSession, sf_dir: str, model, signals: list[str], *by: str, **how) -> DataFrame:
    rows = window_rows(spark, sf_dir)
    p = T.fit_each(rows.select(*by, "t", "ticker", *signals, "y", "test"), model, signals, *by, **how)
    # Windows' test dates don't overlap, so a date and a name have one score.
    real = rows.where("test").select("t", "ticker", "date", "sector", F.col("y").alias("ret"))
    return p.select("t", "ticker", "score").join(real, ["t", "ticker"]).select("date", "ticker", "sector", "score", "ret")


@query()
def window_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on the panel features, refitted in every window."""
    return _walked_trees(spark, sf_dir, partial(T.forest, trees=200, depth=6, least=50), _FEATURES, "window", flatten=False, least_rows=100)


@query()
def window_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the panel features, refitted in every window."""
    return _walked_trees(spark, sf_dir, partial(T.boosted, least=50), _FEATURES, "window", flatten=False, least_rows=100)


@query()
def sector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest in every window and sector, on the ranked signals of all names of the sector."""
    return _walked_trees(spark, sf_dir, T.forest, ["pct"], "window", "sector", flatten=True, least_rows=20, least_names=4)


@query()
def sector_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees in every window and sector, on the ranked signals of all names of the sector."""
    return _walked_trees(spark, sf_dir, T.boosted, ["pct"], "window", "sector", flatten=True, least_rows=20, least_names=4)
