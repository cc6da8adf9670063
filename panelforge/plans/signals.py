"""Queries over scans, filters, joins, reshapes and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import models as M
from ..operators import windows as W
from ..sources import files, panels
from .catalog import query, rd, sql, whole

#: Minutes of a trading day; what comes later counts in the last one.
DAY = 390
#: An archive a ticker and year, named from its first to its last date, in the ways that such names come.
_ARCHIVES = """WITH y AS (SELECT replace(ticker, '_', '') AS k, replace(ticker, '_', '.') AS dotted, sector, CAST(min(date) AS VARCHAR) || '_' || CAST(max(date) AS VARCHAR) AS span FROM pd GROUP BY ticker, sector, year(date)),
n AS (SELECT CASE sector WHEN 0 THEN k || '_' || span || '_10.7z' WHEN 1 THEN 'x__' || k || '_' || span || '_5.7z' WHEN 2 THEN k || '_' || span || '.zip' WHEN 3 THEN dotted || '_' || span || '_10.7z' ELSE lower(k) || '.7z' END AS archive FROM y)"""


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.daily(spark, sf_dir).groupBy("ticker", "sector", F.year("date").alias("year")).agg(F.concat_ws("_", F.min("date").cast("string"), F.max("date").cast("string")).alias("span"))
    k, span = F.regexp_replace("ticker", "_", ""), F.col("span")
    ways = [F.concat(k, F.lit("_"), span, F.lit("_10.7z")), F.concat(F.lit("x__"), k, F.lit("_"), span, F.lit("_5.7z")), F.concat(k, F.lit("_"), span, F.lit(".zip")), F.concat(F.regexp_replace("ticker", "_", "."), F.lit("_"), span, F.lit("_10.7z"))]
    name = F.concat(F.lower(k), F.lit(".7z"))
    for sector in (3, 2, 1, 0):
        name = F.when(F.col("sector") == sector, ways[sector]).otherwise(name)
    return p.select(name.alias("archive"))


@query(sql("pd", _ARCHIVES + r"""
, r AS (SELECT archive, regexp_extract(archive, '^(?:.*__)?([A-Z][A-Z0-9.-]*)_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})(?:_.*)?\.(?:7z|zip)$', ['a', 'b', 'c']) AS r FROM n)
SELECT nullif(r.a, '') AS ticker, CAST(nullif(r.b, '') AS DATE) AS start, CAST(nullif(r.c, '') AS DATE) AS "end", archive, nullif(r.a, '') || '_ofi_daily.csv' AS daily
FROM r WHERE r.a NOT LIKE '%.%'"""))
def index_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.archive_index(archive_names(spark, sf_dir))


@query(r"""
WITH f AS (SELECT n_name, n_regionkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, count(*) AS size, count(*) FILTER (l_discount >= 0.05) AS rows
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
g AS (SELECT * FROM (SELECT DISTINCT week FROM f), (SELECT n_name, n_regionkey FROM nation))
SELECT CASE WHEN n_regionkey = 4 THEN 'bad_name' WHEN coalesce(size, 0) = 0 THEN 'empty' WHEN rows = 0 THEN 'no_data' ELSE 'ok' END AS status, count(*) AS n FROM g LEFT JOIN f USING (n_name, n_regionkey, week) GROUP BY 1""")
def file_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of one file a name and week of the calendar: its size is its trades, its rows those at a discount of 5 % or more."""
    names = panels.table(spark, sf_dir, "nation").select("n_name", "n_regionkey", "n_nationkey")
    j = panels.table(spark, sf_dir, "lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "week").alias("week"), F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("size"), F.count(F.when(F.col("l_discount") >= 0.05, 1)).alias("rows"))
    j = j.join(panels.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), "s_suppkey")
    f = j.groupBy("week", "n_nationkey").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    grid = f.select("week").distinct().crossJoin(names)
    known = grid.join(f, ["week", "n_nationkey"], "left").withColumns({"size": F.coalesce("size", F.lit(0)), "rows": F.coalesce("rows", F.lit(0))})
    name = F.concat(F.when(F.col("n_regionkey") == 4, F.lower("n_name")).otherwise(F.upper(F.regexp_replace("n_name", "_", ""))), F.lit("_"), F.col("week").cast("string"), F.lit("_"), F.col("week").cast("string"), F.lit(".7z"))
    return files.file_status(known, "size", name.rlike(files.ARCHIVE), "rows")


@query(sql("pd", "SELECT ticker, count(*) AS n FROM pd WHERE sig IS NOT NULL AND ret IS NOT NULL GROUP BY ticker HAVING count(*) >= 252 ORDER BY n DESC, ticker LIMIT 400"))
def coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = panels.daily(spark, sf_dir).where("sig is not null and ret is not null").groupBy("ticker").agg(F.count("*").alias("n"))
    return n.where("n >= 252").orderBy(F.desc("n"), "ticker").limit(400)


@query("""WITH t AS (SELECT c_custkey % 700 AS ticker, c_nationkey % 3 AS sector FROM customer), one AS (SELECT ticker FROM t GROUP BY ticker HAVING count(DISTINCT sector) = 1)
SELECT ticker, min(sector) AS sector, count(*) AS n FROM t WHERE ticker IN (SELECT ticker FROM one) GROUP BY ticker""")
def single_sector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = panels.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 700).alias("ticker"), (F.col("c_nationkey") % 3).alias("sector"))
    one = t.groupBy("ticker").agg(F.count_distinct("sector").alias("k")).where("k = 1")
    return t.join(one, "ticker", "left_semi").groupBy("ticker").agg(F.min("sector").alias("sector"), F.count("*").alias("n"))


@query(sql("pw", "SELECT sector, count(*) AS n, min(date) AS first FROM pw WHERE date >= (SELECT max(date) - INTERVAL 24 MONTH FROM pw) GROUP BY sector"))
def last_n_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    last = p.agg(F.add_months(F.max("date"), -24).alias("lo"))
    return p.join(F.broadcast(last)).where("date >= lo").groupBy("sector").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY 1")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("""WITH e AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST('inf' AS DOUBLE) ELSE round(value * 100) END AS x, CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS k FROM events)
SELECT event_type, count(*) AS n, sum(CASE WHEN x IS NULL OR NOT isfinite(x) THEN 0 ELSE x END) AS total FROM e WHERE k IS NOT NULL AND event_type <> 'view' GROUP BY 1""")
def null_and_finite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys go, an excluded name goes, null and non-finite values count as 0."""
    i = F.col("event_id")
    x = F.when(i % 7 == 0, None).when(i % 11 == 0, float("nan")).when(i % 13 == 0, float("inf")).otherwise(F.round(F.col("value") * 100))
    e = panels.table(spark, sf_dir, "events").select("event_type", x.alias("x"), F.when(i % 17 != 0, F.col("user_id")).alias("k"))
    return e.na.drop(subset=["k"]).where("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce(S.finite("x"), F.lit(0.0))).alias("total"))


@query("SELECT TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) IS NULL AS bad, count(*) AS n FROM events GROUP BY 1")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return panels.table(spark, sf_dir, "events").select(text.alias("s")).groupBy(F.expr("try_cast(s as double) is null").alias("bad")).agg(F.count("*").alias("n"))


@query(sql("pt", "SELECT w AS \"window\", ticker, count(*) AS n, round(var_pop(sig), 6) + 0 AS v FROM pt JOIN (SELECT CAST(k AS INTEGER) AS w FROM (SELECT unnest(range(100000)) AS k), (SELECT max(t) AS m FROM pt) WHERE 104 + 60 * k <= m) ON t BETWEEN w * 60 AND w * 60 + 103 GROUP BY 1, 2 HAVING count(*) >= 30 AND var_pop(sig) > 0"))
def block_coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.ordinal(panels.weekly(spark, sf_dir))
    p = M.in_window(p, M.windows(p, 104, 60), "tr0", "tr1")
    return p.groupBy("window", "ticker").agg(F.count("*").alias("n"), rd(F.var_pop("sig"), "v")).where("n >= 30 and v > 0")


@query(sql("pt", "WITH c AS (SELECT t // 100 AS w, date, sector, count(DISTINCT ticker) AS k FROM pt GROUP BY 1, 2, 3) SELECT CAST(w AS BIGINT) AS block, sector, min(k) AS least FROM c GROUP BY 1, 2 HAVING min(k) >= 4"))
def sector_breadth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.ordinal(panels.weekly(spark, sf_dir)).withColumn("block", F.floor(F.col("t") / 100).cast("long"))
    return p.groupBy("block", "date", "sector").agg(F.count_distinct("ticker").alias("k")).groupBy("block", "sector").agg(F.min("k").alias("least")).where("least >= 4")


@query(sql("mi", "SELECT ticker, count(*) AS n FROM mi WHERE minute > 1 GROUP BY ticker"))
def drop_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.minutes(spark, sf_dir).where("minute > 1").groupBy("ticker").agg(F.count("*").alias("n"))


@query(sql("pw", "SELECT ticker, n FROM (SELECT ticker, count(*) AS n FROM pw WHERE sig > 0 GROUP BY 1) ORDER BY n DESC, ticker LIMIT 10"))
def top_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly(spark, sf_dir).where("sig > 0").groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(10)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = panels.table(spark, sf_dir, "orders").select("o_orderkey")
    return files.unless_done(jobs, panels.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(sql("pw mk", "SELECT sector, count(*) AS n, count(mkt) AS matched, round(avg(ret - mkt), 6) + 0 AS excess FROM pw LEFT JOIN mk USING (date) GROUP BY sector"))
def left_join_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    return p.join(panels.market(p), "date", "left").groupBy("sector").agg(F.count("*").alias("n"), F.count("mkt").alias("matched"), rd(F.avg(F.col("ret") - F.col("mkt")), "excess"))


@query(sql("pd oh", "SELECT ticker, count(*) AS n, round(sum(close), 4) AS c, sum(sig) AS s FROM pd JOIN oh USING (date, ticker) GROUP BY ticker"))
def same_date_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = panels.daily(spark, sf_dir).join(panels.ohlc(spark, sf_dir), ["date", "ticker"])
    return j.groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("c"), F.sum("sig").alias("s"))


@query(sql("pt", "SELECT a.date, a.ticker, b.date AS next_date, a.sig AS x, round(b.ret, 6) + 0 AS y FROM pt a JOIN pt b ON a.ticker = b.ticker AND b.t = a.t + 1"))
def next_day_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.next_day(panels.weekly(spark, sf_dir), "sig", "ret").select("date", "ticker", "next_date", "x", rd("y"))


@query(sql("pw", """WITH g AS (SELECT date, ticker FROM (SELECT DISTINCT date FROM pw), (SELECT DISTINCT ticker FROM pw))
SELECT ticker, count(*) AS n, count(sig) AS have, sum(coalesce(sig, 0)) AS total FROM g LEFT JOIN pw USING (date, ticker) GROUP BY ticker"""))
def calendar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    g = p.select("date").distinct().join(F.broadcast(p.select("ticker").distinct()))
    return g.join(p, ["date", "ticker"], "left").groupBy("ticker").agg(F.count("*").alias("n"), F.count("sig").alias("have"), F.sum(F.coalesce("sig", F.lit(0.0))).alias("total"))


@query(sql("pd", """WITH d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM pd)
SELECT n_name AS ticker, count(*) AS days, count(sig) AS have FROM d CROSS JOIN (SELECT DISTINCT ticker AS n_name FROM pd) LEFT JOIN pd ON pd.date = d.date AND pd.ticker = n_name GROUP BY 1"""))
def calendar_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.daily(spark, sf_dir)
    days = p.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    grid = days.join(F.broadcast(p.select("ticker").distinct()))
    return grid.join(p, ["date", "ticker"], "left").groupBy("ticker").agg(F.count("*").alias("days"), F.count("sig").alias("have"))


@query(sql("mi", "SELECT date, ticker, " + ", ".join(f"round(sum(CASE WHEN minute = {k} THEN iofi END), 6) + 0 AS minute_{k}" for k in range(1, DAY + 1)) + " FROM (SELECT date, ticker, least(minute, 390) AS minute, iofi FROM mi) GROUP BY 1, 2"))
def pivot_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = panels.minutes(spark, sf_dir).withColumn("minute", F.least("minute", F.lit(DAY)))
    p = m.groupBy("date", "ticker").pivot("minute", list(range(1, DAY + 1))).agg(F.sum("iofi"))
    return p.select("date", "ticker", *(rd(str(k), f"minute_{k}") for k in range(1, DAY + 1)))


@query(sql("pw", "SELECT date, " + ", ".join(f"sum(CASE WHEN sector = {k} THEN sig END) AS s{k}" for k in range(5)) + " FROM pw GROUP BY date"))
def pivot_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly(spark, sf_dir).groupBy("date").pivot("sector", list(range(5))).agg(F.sum("sig")).toDF("date", *(f"s{k}" for k in range(5)))


@query(sql("pw", "SELECT date, ticker, signal, v AS value FROM (SELECT date, ticker, 'sig' AS signal, sig AS v FROM pw UNION ALL SELECT date, ticker, 'ret', round(ret, 6) + 0 FROM pw) WHERE v <> 0"))
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide to long; several signals as rows of one key."""
    p = panels.weekly(spark, sf_dir).select("date", "ticker", "sig", rd("ret"))
    return p.unpivot(["date", "ticker"], ["sig", "ret"], "signal", "value").where("value is not null and value <> 0")


@query(sql("pt", """WITH b AS (SELECT date, ticker, sig + w AS v, w FROM pt JOIN (SELECT CAST(k AS INTEGER) AS w FROM (SELECT unnest(range(100000)) AS k), (SELECT max(t) AS m FROM pt) WHERE 40 * k <= m) ON t >= w * 40 AND t < w * 40 + 60), r AS (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY w DESC) AS k FROM b)
SELECT date, ticker, v, w AS block FROM r WHERE k = 1"""))
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping blocks one under the other; the later block's row stays."""
    p = W.ordinal(panels.weekly(spark, sf_dir))
    starts = p.agg(F.max("t").alias("m")).select(F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 40).cast("int"))).alias("window"))
    ranges = starts.select("window", (F.col("window") * 40).alias("te0"), (F.col("window") * 40 + 60).alias("te1"))
    b = M.in_window(p, ranges, "te0", "te1").withColumn("v", F.col("sig") + F.col("window"))
    return b.groupBy("date", "ticker").agg(F.max_by("v", "window").alias("v"), F.max("window").alias("block"))


@query(sql("pt", "SELECT date, sector, ticker, CAST(rank() OVER (PARTITION BY date, sector ORDER BY ticker) - 1 AS INTEGER) AS pos, array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN list(sig) OVER (PARTITION BY date, sector ORDER BY ticker ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)], ',') AS features FROM pt"))
def sector_flattened_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = panels.weekly(spark, sf_dir).groupBy("date", "sector").agg(F.sort_array(F.collect_list(F.struct("ticker", F.col("sig").cast("long").cast("string").alias("s")))).alias("f"))
    rows = flat.select("date", "sector", F.posexplode("f").alias("pos", "x"), F.array_join("f.s", ",").alias("features"))
    return rows.select("date", "sector", F.col("x.ticker").alias("ticker"), "pos", "features")


@query("SELECT 'orders' AS source, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS k FROM orders UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem")
def union_with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = panels.table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("k"))
    b = panels.table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("source"), F.col("l_orderkey").alias("k"))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


_IMB = """WITH l AS (SELECT *, lag(bid) OVER w AS b1, lag(ask) OVER w AS a1, lag(bid_size) OVER w AS qb1, lag(ask_size) OVER w AS qa1 FROM sn WINDOW w AS (PARTITION BY ticker, level ORDER BY time, seq)),
o AS (SELECT ticker, level, seq, ((CASE WHEN bid >= b1 THEN bid_size ELSE 0 END) - (CASE WHEN bid <= b1 THEN qb1 ELSE 0 END)
  + (CASE WHEN ask > a1 THEN -qa1 WHEN ask < a1 THEN ask_size ELSE qa1 - ask_size END)) / nullif((bid_size + ask_size) / 2, 0) AS ofi FROM l) """


@query(sql("sn", _IMB + "SELECT ticker, seq, round(ofi, 6) + 0 AS ofi FROM o WHERE level = 1"))
def ofi_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = panels.snapshots(spark, sf_dir, 1)
    return s.select("ticker", "seq", rd(S.flow_imbalance(), "ofi"))


@query(sql("sn", _IMB + "SELECT ticker, level, count(ofi) AS n, round(sum(ofi), 4) + 0 AS total FROM o GROUP BY 1, 2"))
def ofi_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = panels.snapshots(spark, sf_dir).withColumn("ofi", S.flow_imbalance())
    return s.groupBy("ticker", "level").agg(F.count("ofi").alias("n"), (F.round(F.sum("ofi"), 4) + F.lit(0.0)).alias("total"))


@query(sql("sn", _IMB + "SELECT a.ticker, count(*) AS n, round(sum(a.ofi * b.ofi), 3) + 0 AS prod FROM o a JOIN o b ON a.seq = b.seq AND a.ticker = b.ticker WHERE a.level = 1 AND b.level = 2 AND a.ofi IS NOT NULL AND b.ofi IS NOT NULL GROUP BY 1"))
def level_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels stay rows; a pivot by snapshot brings two together without a join."""
    s = panels.snapshots(spark, sf_dir, 2).withColumn("ofi", S.flow_imbalance())
    p = s.groupBy("ticker", "seq").pivot("level", [1, 2]).agg(F.sum("ofi")).toDF("ticker", "seq", "a", "b").where("a is not null and b is not null")
    return p.groupBy("ticker").agg(F.count("*").alias("n"), (F.round(F.sum(F.col("a") * F.col("b")), 3) + F.lit(0.0)).alias("prod"))


@query(sql("sn", "SELECT ticker, seq, round(coalesce((bid_size - ask_size) / nullif(bid_size + ask_size, 0), 0), 6) + 0 AS tib FROM sn WHERE level = 1"))
def tib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.snapshots(spark, sf_dir, 1).select("ticker", "seq", rd(S.book_imbalance(), "tib"))


@query(sql("mi", "WITH k AS (SELECT CAST(h AS INTEGER) AS half_life, CAST(m AS INTEGER) AS minute, exp(-(391 - m) * (ln(2) / h)) / sum(exp(-(391 - m) * (ln(2) / h))) OVER (PARTITION BY h) AS w FROM (SELECT unnest([15, 60, 195]) AS h), (SELECT unnest(range(1, 391)) AS m)), c AS (SELECT least(minute, 390) AS minute, count(*) AS n FROM mi GROUP BY 1) SELECT half_life, minute, round(w * 1e6, 6) + 0 AS w, n FROM k JOIN c USING (minute)"))
def kernel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, in millionths, of the minutes that the panel has, and their rows."""
    seen = panels.minutes(spark, sf_dir).groupBy(F.least("minute", F.lit(DAY)).alias("minute")).agg(F.count("*").alias("n"))
    k = kernel(spark, (15, 60, 195), DAY).select("half_life", "minute", rd(F.col("w") * 1e6, "w"))
    return k.join(seen, "minute").select("half_life", "minute", "w", "n")


def kernel(spark: SparkSession, half_lives: tuple[int, ...], minutes: int) -> DataFrame:
    """Normalised decay weights, emphasis on the close."""
    rows = spark.range(1, minutes + 1).select(F.col("id").cast("int").alias("minute")).withColumn("half_life", F.explode(F.array(*map(F.lit, half_lives))))
    raw = F.exp(-(minutes + 1 - F.col("minute")) * (0.6931471805599453 / F.col("half_life")))
    return rows.withColumn("raw", raw).withColumn("w", F.col("raw") / F.sum("raw").over(Window.partitionBy("half_life")))


@query(sql("mi", "WITH k AS (SELECT CAST(unnest(range(1, 391)) AS INTEGER) AS minute), w AS (SELECT minute, exp(-(391 - minute) * (ln(2) / 195)) / sum(exp(-(391 - minute) * (ln(2) / 195))) OVER () AS w FROM k) SELECT date, ticker, round(sum(iofi * w), 6) + 0 AS signal FROM (SELECT date, ticker, least(minute, 390) AS minute, iofi FROM mi) JOIN w USING (minute) GROUP BY 1, 2"))
def exp_decay_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = kernel(spark, (195,), DAY).select("minute", "w")
    m = panels.minutes(spark, sf_dir).withColumn("minute", F.least("minute", F.lit(DAY)))
    return m.join(F.broadcast(w), "minute").groupBy("date", "ticker").agg(rd(F.sum(F.col("iofi") * F.col("w")), "signal"))


@query(sql("mi", "SELECT date, ticker, round(sum(iofi), 6) + 0 AS day_sum, count(*) AS n FROM mi GROUP BY 1, 2"))
def full_day_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.minutes(spark, sf_dir).groupBy("date", "ticker").agg(rd(F.sum("iofi"), "day_sum"), F.count("*").alias("n"))


@query(sql("mi", "SELECT date, ticker, round(sum(CASE WHEN minute BETWEEN 1 AND 2 THEN iofi ELSE 0 END), 6) + 0 AS b1, round(sum(CASE WHEN minute BETWEEN 3 AND 6 THEN iofi ELSE 0 END), 6) + 0 AS b2, round(sum(CASE WHEN minute >= 7 THEN iofi ELSE 0 END), 6) + 0 AS b3 FROM mi GROUP BY 1, 2"))
def bucket_sums_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("minute")
    part = lambda c: F.sum(F.when(c, F.col("iofi")).otherwise(0.0))
    return panels.minutes(spark, sf_dir).groupBy("date", "ticker").agg(rd(part(m.between(1, 2)), "b1"), rd(part(m.between(3, 6)), "b2"), rd(part(m >= 7), "b3"))


@query(sql("mi", "WITH b AS (SELECT date, ticker, least((minute - 1) * 5 // 390, 4) AS b, iofi FROM mi) SELECT ticker, CAST(b AS INTEGER) AS bucket, round(sum(iofi), 6) + 0 AS total FROM b GROUP BY 1, 2"))
def bucket_sums_equal5(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panels.minutes(spark, sf_dir).withColumn("bucket", F.least(F.floor((F.col("minute") - 1) * 5 / DAY), F.lit(4)).cast("int"))
    return b.groupBy("ticker", "bucket").agg(rd(F.sum("iofi"), "total"))


@query("SELECT CAST(least(greatest(extract(hour FROM ts) * 60 + extract(minute FROM ts) - 570 + 1, 1), 390) AS INTEGER) AS minute, count(*) AS n FROM events GROUP BY 1")
def minute_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.table(spark, sf_dir, "events").groupBy(S.minute_of_day(F.date_format("ts", "HH:mm")).alias("minute")).agg(F.count("*").alias("n"))


@query(sql("pw", "SELECT date, ticker, round((sig - avg(sig) OVER w) / nullif(CASE WHEN count(sig) OVER w >= 20 THEN stddev_pop(sig) OVER w END, 0), 6) + 0 AS z FROM pw WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"))
def rolling_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    return p.select("date", "ticker", rd(W.rolling_zscore(p, "sig", 20), "z"))


@query(sql("pw", "SELECT date, ticker, round((rank() OVER (PARTITION BY date ORDER BY sig) + (count(*) OVER (PARTITION BY date, sig) - 1) / 2.0) / count(*) OVER (PARTITION BY date), 6) + 0 AS pct FROM pw"))
def pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly(spark, sf_dir).select("date", "ticker", rd(W.percentile_rank("sig", "date"), "pct"))


@query(sql("pw", "SELECT date, ticker, round(avg(sig) OVER (PARTITION BY date, sector), 6) + 0 AS sector_mean, round(sig - avg(sig) OVER (PARTITION BY date), 6) + 0 AS neutral FROM pw"))
def sector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    return p.select("date", "ticker", rd(F.avg("sig").over(Window.partitionBy("date", "sector")), "sector_mean"), rd(W.demeaned("sig", "date"), "neutral"))


@query(sql("pw", "SELECT date, ticker, lag(sig) OVER (PARTITION BY ticker ORDER BY date) AS lag1, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date) AS INTEGER) AS k FROM pw"))
def lag_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly(spark, sf_dir).select("date", "ticker", F.lag("sig").over(W.by_ticker()).alias("lag1"), F.row_number().over(W.by_ticker()).alias("k"))


@query(sql("od", "SELECT a.date, a.ticker, round(b.open / a.close - 1, 6) + 0 AS ret FROM od a JOIN od b ON a.ticker = b.ticker AND b.t = a.t + 1"))
def overnight_ret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.forward_return(panels.ohlc(spark, sf_dir), "close", "open").select("date", "ticker", rd("ret"))


@query(sql("od", "SELECT a.date, a.ticker, round(b.close / a.close - 1, 6) + 0 AS ret FROM od a JOIN od b ON a.ticker = b.ticker AND b.t = a.t + 1"))
def ctc_ret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.forward_return(panels.ohlc(spark, sf_dir), "close", "close").select("date", "ticker", rd("ret"))


@query(sql("pw mk", """WITH j AS (SELECT date, ticker, ret, mkt, count(ret + mkt) OVER w AS n, covar_samp(ret, mkt) OVER w AS c, var_samp(mkt) OVER w AS v FROM pw JOIN mk USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT date, ticker, round(c / v, 4) + 0 AS beta, round(ret - c / v * mkt, 4) + 0 AS residual FROM j WHERE n >= 60 AND v <> 0"""))
def rolling_beta_resid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    r = W.rolling_beta(p.join(panels.market(p), "date"), "ret", "mkt", 60)
    return r.select("date", "ticker", (F.round("beta", 4) + F.lit(0.0)).alias("beta"), (F.round("residual", 4) + F.lit(0.0)).alias("residual"))


@query(sql("pw", "SELECT date, ticker, round(greatest(CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END, 1e-8), 6) + 0 AS vol, round(avg(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) + 0 AS ma3 FROM pw WHERE true WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"))
def trailing_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly(spark, sf_dir).select("date", "ticker", rd(W.trailing_vol("ret"), "vol"), rd(F.avg("ret").over(W.trailing(3)), "ma3"))


@query(sql("pw", """WITH RECURSIVE g AS (SELECT d.date, k.ticker, pw.sig, row_number() OVER (PARTITION BY k.ticker ORDER BY d.date) AS i FROM (SELECT DISTINCT date FROM pw) d CROSS JOIN (SELECT DISTINCT ticker FROM pw) k LEFT JOIN pw ON pw.date = d.date AND pw.ticker = k.ticker),
e AS (SELECT date, ticker, sig, i, CAST(sig AS DOUBLE) AS ema FROM g WHERE i = 1 UNION ALL SELECT g.date, g.ticker, g.sig, g.i, CASE WHEN g.sig IS NULL THEN NULL WHEN e.ema IS NULL THEN g.sig ELSE 0.5::DOUBLE * g.sig + 0.5::DOUBLE * e.ema END FROM e JOIN g ON g.ticker = e.ticker AND g.i = e.i + 1)
SELECT date, ticker, round(ema, 6) + 0 AS ema FROM e WHERE sig IS NOT NULL""").replace("WITH pw AS", "WITH RECURSIVE pw AS", 1).replace(", RECURSIVE g AS", ", g AS"))
def ema_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.weekly(spark, sf_dir)
    grid = p.select("date").distinct().join(F.broadcast(p.select("ticker").distinct())).join(p.select("date", "ticker", "sig"), ["date", "ticker"], "left")
    return W.ema(grid, "sig", 0.5).select("date", "ticker", rd("ema"))


@query(sql("mi", """WITH v AS (SELECT minute, round(avg(iofi), 9) AS x FROM mi GROUP BY minute), m AS (SELECT minute, sum(x) OVER (ORDER BY minute ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 AS y FROM v)
SELECT minute, round(y, 6) + 0 AS smooth, arg_max(minute, round(y, 6) * 1000 - minute / 1e6) OVER () AS peak FROM m"""))
def centred_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean profile of the day, smoothed over eleven minutes, and its peak."""
    v = panels.minutes(spark, sf_dir).groupBy("minute").agg(F.round(F.avg("iofi"), 9).alias("x"))
    y = v.select("minute", W.centred_mean("x", "minute", 11, F.lit(0)).alias("y"))
    peak = y.agg(F.max_by("minute", F.round("y", 6) * 1000 - F.col("minute") / 1e6).alias("peak"))
    return y.select("minute", rd("y", "smooth")).join(F.broadcast(peak))


@query("SELECT split_part(p_brand || '__' || p_type, '__', 1) AS base, replace(printf('%.2f', p_size / 10.0), '.', 'p') AS name, count(*) AS n, CAST(sum(CAST(sign(p_size - 25.0) * greatest(abs(p_size - 25.0) - 5, 0) AS BIGINT)) AS BIGINT) AS soft, CAST(sum(least(greatest(p_size, 10), 40)) AS BIGINT) AS clipped FROM part GROUP BY 1, 2")
def name_and_scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    g = p.groupBy(S.base_ticker(F.concat("p_brand", F.lit("__"), "p_type")).alias("base"), S.number_name(size / 10).alias("name"))
    return g.agg(F.count("*").alias("n"), whole(F.sum(S.soft_threshold(size - 25, 5.0)), "soft"), whole(F.sum(S.clip(size, 10.0, 40.0)), "clipped"))


@query()
def iofi_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First principal component of the levels' imbalances of each ticker, and the integrated signal."""
    levels = 3
    s = panels.snapshots(spark, sf_dir, levels).withColumn("ofi", F.coalesce(S.finite(S.flow_imbalance()), F.lit(0.0)))
    at = [F.coalesce(F.sum(F.when(F.col("level") == n, F.col("ofi"))), F.lit(0.0)) for n in range(1, levels + 1)]
    books = s.groupBy("ticker", "seq").agg(F.array(*at).alias("v"))
    load = M.components_of(books, "v", "ticker").groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("place", "loading"))).alias("w"))
    total = sum((F.col("v")[n - 1] * F.col("w")[n] for n in range(1, levels + 1)), F.lit(0.0))
    return books.join(F.broadcast(load), "ticker").select("ticker", "seq", total.alias("iofi"))


def minute_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, t, ticker, v): each ticker's day as a vector of minutes up to the largest present, DAY at most; gaps count as 0."""
    m = panels.minutes(spark, sf_dir).withColumn("minute", F.least("minute", F.lit(DAY)))
    m = m.groupBy("date", "ticker", "minute").agg(F.sum(F.coalesce("iofi", F.lit(0.0))).alias("iofi"))
    n = m.agg(F.max("minute")).first()[0] or 0
    cells = F.map_from_entries(F.collect_list(F.struct("minute", "iofi")))
    days = m.groupBy("date", "ticker").agg(cells.alias("c"))
    at = F.transform(F.sequence(F.lit(1), F.lit(max(1, n))), lambda i: F.coalesce(F.col("c")[i], F.lit(0.0)))
    return W.ordinal(days.select("date", "ticker", at.alias("v"))).select("date", "t", "ticker", "v")


@query()
def minute_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's signal by the minutes' first principal component, fitted on the first 70 % of dates; scores of all."""
    days = minute_days(spark, sf_dir)
    last = days.agg(F.max("t")).first()[0] or 0
    train = F.col("t") < int(0.7 * (last + 1))
    found = M.component_scores(days.withColumn("fit", F.lit(0)), train, "v", "fit")
    return found.select("date", "ticker", train.alias("train"), "score")


#: Dates of training and between refits of the rolling form; the event table holds few dates.
PCA_TRAIN, PCA_EVERY = 10, 5


@query()
def rolling_minute_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, refitted every 5 dates on the 10 before; scores of the dates after each fit.

    Dates are reduced to their moments once, in blocks between refits' bounds, and a window's are the difference of
    two running sums.
    """
    days = minute_days(spark, sf_dir)
    ranges = M.windows(days, PCA_TRAIN, PCA_EVERY)
    return M.rolling_component_scores(days, ranges, "v").select("date", "ticker", "window", "score")


@query()
def pca_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-short spread of the next date's imbalance by the rolling component's signal."""
    from ..operators import portfolio as P

    s = rolling_minute_pca(spark, sf_dir)
    day = W.ordinal(panels.minutes(spark, sf_dir).groupBy("date", "ticker").agg(F.sum("iofi").alias("ret")))
    after = day.select((F.col("t") - 1).alias("t"), "ticker", "ret")
    both = s.join(day.select("date", "t").distinct(), "date").join(after, ["t", "ticker"])
    return P.gross_spread(both.select("date", "t", "ticker", F.lit(0).alias("sector"), "score", "ret"))
