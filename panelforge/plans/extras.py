"""Further queries: summaries of runs, set operations, positions of a block, batch forms of the streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import edges as E
from ..operators import kernels as K
from ..operators import models as M
from ..operators import portfolio as P
from ..operators import windows as W
from ..operators.quantiles import exact_quantiles
from ..sources import panels
from .catalog import query, rd, sql
from .research import _EDGE, _TURN, aligned, ranked_penalties, scored


@query(sql("sc", _TURN + "SELECT round(avg(oneway), 6) + 0 AS mean, round(median(oneway), 6) + 0 AS median FROM tv"))
def turnover_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.turnover(P.gross_weights(scored(spark, sf_dir)))
    return t.agg(rd(F.avg("turnover"), "mean"), rd(F.median("turnover"), "median"))


@query("SELECT p_brand, round(avg(p_retailprice), 4) + 0 AS mean, min(p_retailprice) AS low, max(p_retailprice) AS high, round(avg(CASE WHEN p_size = 50 THEN 1.0 ELSE 0.0 END), 6) + 0 AS at_ceiling, arg_max(p_partkey, p_retailprice * 1e6 - p_partkey) AS best FROM part GROUP BY 1")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, extremes, share at the ceiling and the best run of each method."""
    p = panels.table(spark, sf_dir, "part")
    best = F.max_by("p_partkey", F.col("p_retailprice") * 1e6 - F.col("p_partkey"))
    return p.groupBy("p_brand").agg((F.round(F.avg("p_retailprice"), 4) + F.lit(0.0)).alias("mean"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), rd(F.avg((F.col("p_size") == 50).cast("double")), "at_ceiling"), best.alias("best"))


@query(sql("pw", "SELECT ticker, sector, round(avg(sig), 6) + 0 AS mean FROM pw GROUP BY 1, 2 ORDER BY avg(sig) DESC, ticker LIMIT 10"))
def head_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly(spark, sf_dir).groupBy("ticker", "sector").agg(rd(F.avg("sig"), "mean")).orderBy(F.desc("mean"), "ticker").limit(10)


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size < 20) UNION ALL SELECT 'rest', count(*) FROM (SELECT p_partkey FROM part WHERE p_size < 20 EXCEPT SELECT l_partkey FROM lineitem)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = panels.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    small = panels.table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("k"))
    both, rest = small.join(used, "k", "left_semi").distinct(), small.join(used, "k", "left_anti").distinct()
    return both.agg(F.lit("both").alias("side"), F.count("*").alias("n")).union(rest.agg(F.lit("rest"), F.count("*")))


@query(sql("pt", "WITH src AS (SELECT DISTINCT ticker, 1.0::DOUBLE / length(ticker) AS weight FROM pt WHERE ticker < 'NATION_2'), tgt AS (SELECT DISTINCT ticker, 1.0::DOUBLE AS load FROM pt WHERE ticker >= 'NATION_22'), z AS (SELECT date, sum(weight * sig) / sum(abs(weight)) AS z FROM pt JOIN src USING (ticker) GROUP BY date) SELECT date, ticker, round(load * z, 6) + 0 AS w FROM z, tgt"))
def block_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    names = p.select("ticker").distinct()
    src, tgt = names.where("ticker < 'NATION_2'").withColumn("weight", 1.0 / F.length("ticker")), names.where("ticker >= 'NATION_22'").withColumn("load", F.lit(1.0))
    return P.available_positions(p.select("date", "ticker", F.col("sig").alias("signal")), src, tgt).select("date", "ticker", rd("w"))


@query()
def expected_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of the universe, and how many of them chance puts beyond each threshold."""
    n = panels.weekly(spark, sf_dir).select("ticker").distinct().count()
    return spark.createDataFrame([(n * (n - 1), t, E.expected_false(n, t)) for t in (1.5, 2.0, 3.0)], "tests long, threshold double, expected double")


@query(sql("pt", _EDGE + "SELECT tgt, arg_max(src, round(abs(a), 9) * 1e6) AS src, count(*) AS n FROM es WHERE src <> tgt AND a IS NOT NULL GROUP BY tgt"))
def strongest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.edge_stats(panels.weekly(spark, sf_dir)).where("src <> tgt and a is not null")
    return e.groupBy("tgt").agg(F.max_by("src", F.round(F.abs("a"), 9) * 1e6).alias("src"), F.count("*").alias("n"))


@query(sql("pw", "SELECT a.sector, count(*) AS pairs FROM (SELECT DISTINCT ticker, sector FROM pw) a JOIN (SELECT DISTINCT ticker, sector FROM pw) b ON a.sector = b.sector WHERE a.ticker <> b.ticker GROUP BY 1"))
def sector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = panels.weekly(spark, sf_dir).select("ticker", "sector").distinct()
    return n.join(n.select(F.col("ticker").alias("other"), "sector"), "sector").where("ticker <> other").groupBy("sector").agg(F.count("*").alias("pairs"))


@query(sql("mi", "SELECT ticker, round(sum(iofi * exp(-minute * (ln(2) / 30))), 4) + 0 AS at_open, round(sum(iofi * exp(-(391 - minute) * (ln(2) / 30))), 4) + 0 AS at_close FROM mi GROUP BY 1"))
def open_close_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("minute")
    part = lambda at_open: (F.round(F.sum(F.col("iofi") * S.decay(m, 390, 30, at_open)), 4) + F.lit(0.0))
    return panels.minutes(spark, sf_dir).groupBy("ticker").agg(part(True).alias("at_open"), part(False).alias("at_close"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0 AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of streaming.events.windowed."""
    e = panels.table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + F.lit(0.0)).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query()
def smoothed_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores smoothed along each ticker's stretches, then averaged with the raw ranks."""
    s = scored(spark, sf_dir)
    dates, names = s.select("date").distinct(), s.select("ticker").distinct()
    grid = dates.join(F.broadcast(names)).join(s, ["date", "ticker"], "left")
    e = W.ema(grid, "score", 0.3).withColumn("a", W.percentile_rank("ema", "date")).withColumn("b", W.percentile_rank("score", "date"))
    return P.gross_spread(e.withColumn("score", (F.col("a") + F.col("b")) / 2).select("date", "ticker", "sector", "score", "ret")).select("date", rd("spread"))


@query(sql("pw", "SELECT ticker, round(avg(CASE WHEN abs(ret) > 0.001 THEN 1.0 ELSE 0.0 END), 6) + 0 AS active, round(quantile_cont(sig, 0.9), 6) + 0 AS q90, round(median(sig), 6) + 0 AS q50 FROM pw GROUP BY 1"))
def quantiles_and_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    active = p.groupBy("ticker").agg(rd(F.avg((F.abs("ret") > 0.001).cast("double")), "active"))
    q = exact_quantiles(p, "sig", {"q90": 0.9, "q50": 0.5}, "ticker", passes=1)
    return active.join(q, "ticker", "left").select("ticker", "active", rd("q90"), rd("q50"))


def _holdout(spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    """The penalty whose fit on the earlier dates of each window ranks its last dates best."""
    train, ranges = aligned(spark, sf_dir)
    train = train.join(F.broadcast(ranges.select("window", "tr1")), "window")
    late = F.col("t") >= F.col("tr1") - last
    return ranked_penalties(train, ~late, late)


@query()
def lambda_holdout_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of each training window held out."""
    return _holdout(spark, sf_dir, 21)


@query()
def lambda_holdout_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 13 dates held out."""
    return _holdout(spark, sf_dir, 13)


@query()
def bicluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a trading matrix: signs of significant edges between a window's target and source sets, on the signal before."""
    p = W.ordinal(panels.weekly(spark, sf_dir)).withColumn("window", F.floor(F.col("t") / 120).cast("int"))
    e = E.edge_stats(p, "sig", "ret", 1, "window")
    marks = M.biclusters(e, "tstat", M.members(partial(K.alternating, targets=8, sources=8)), "window").where("value > 0")
    t, s = (marks.where(F.col("side") == side).select("window", F.col("ticker").alias(name)) for side, name in (("target", "tgt"), ("source", "src")))
    m = e.where("abs(tstat) >= 1.0 and n >= 30").join(t, ["window", "tgt"], "left_semi").join(s, ["window", "src"], "left_semi").select("window", "src", "tgt", F.signum("tstat").alias("w"))
    # The matrix of a window trades the dates of the next one.
    signal = p.select((F.col("window") - 1).alias("window"), (F.col("t") + 1).alias("t"), "ticker", F.col("sig").alias("x"))
    return M.predict(signal, m, "window")


@query()
def screened_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's significant edges; where there are none, those with enough dates; else all."""
    e = E.edge_stats(W.ordinal(panels.weekly(spark, sf_dir)).withColumn("window", F.floor(F.col("t") / 60).cast("int")), "sig", "ret", 1, "window")
    level = F.when((F.abs("tstat") >= 3.5) & (F.col("n") >= 30), 0).when(F.col("n") >= 30, 1).otherwise(2)
    return M.first_nonempty(e.withColumn("mask", level), "mask", "window")


@query()
def cluster_block_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block ridge over spectral clusters of each training window's edges instead of sectors."""
    train, _ = aligned(spark, sf_dir)
    e = E.edge_stats(train.withColumnsRenamed({"x": "sig", "y": "ret"}), "sig", "ret", 0, "window")
    lab = M.biclusters(e, "a", lambda w: (lambda s: (s, s))(K.spectral(w, 4)), "window").where("side = 'target'").select("window", "ticker", F.col("value").cast("int").alias("cluster"))
    return M.fit_blocks(train.join(lab, ["window", "ticker"]), partial(K.ridge, lam=10.0), "window", "cluster", least=3)
