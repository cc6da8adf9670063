"""Cross-sectional panels from the star schema and the event table.

Sums are over whole numbers (quantities, discounts in hundredths), so that they don't
depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shipments(spark: SparkSession, sf_dir: str, date: Column) -> DataFrame:
    # Pre-aggregated by supplier, so that the dimension joins see few rows.
    sums = table(spark, sf_dir, "lineitem").groupBy(date.alias("date"), F.col("l_suppkey").alias("s_suppkey")).agg(
        F.sum("l_quantity").alias("q"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.count("*").alias("n"),
    )
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    keyed = sums.join(names.select("s_suppkey", F.col("n_name").alias("ticker"), F.col("n_regionkey").cast("int").alias("sector")), "s_suppkey")
    return keyed.groupBy("date", "ticker", "sector").agg(F.sum("q").alias("sig"), (F.sum("d").cast("double") / F.sum("n") / 100 - 0.05).alias("ret"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, sector, sig, ret), one row a nation and shipping day."""
    return _shipments(spark, sf_dir, F.col("l_shipdate").cast("date"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by week."""
    return _shipments(spark, sf_dir, F.trunc(F.col("l_shipdate").cast("date"), "week"))


def market(panel: DataFrame) -> DataFrame:
    """(date, mkt): the mean return of each date."""
    return panel.groupBy("date").agg(F.avg(F.round("ret", 9)).alias("mkt"))


def ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, open, close) of unit prices in cents."""
    price = F.round(100 * F.try_divide("l_extendedprice", "l_quantity")).cast("long")
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("s_suppkey")).agg(F.min(price).alias("lo"), F.sum(price).alias("s"), F.count(price).alias("n"))
    keyed = sums.join(names.select("s_suppkey", F.col("n_name").alias("ticker")), "s_suppkey")
    return keyed.groupBy("date", "ticker").agg((F.min("lo").cast("double") / 100).alias("open"), (F.sum("s").cast("double") / F.sum("n") / 100).alias("close"))


def snapshots(spark: SparkSession, sf_dir: str, levels: int = 3) -> DataFrame:
    """(ticker, time, seq, level, bid, ask, bid_size, ask_size): book levels in long form."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    n = F.col("level").cast("double")
    rows = e.select(F.col("event_type").alias("ticker"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.floor("value").cast("double").alias("v"), k.alias("k"))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    return rows.select("ticker", "time", "seq", "level", (F.col("v") - (n - 1)).alias("bid"), (F.col("v") - (n - 1) + 1 + F.pmod("k", F.lit(3.0))).alias("ask"), (F.col("k") + n).alias("bid_size"), (100 - F.col("k") + n).alias("ask_size"))


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, minute, iofi): the k-th event of a user's day as its minute k."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", F.col("ts").cast("date")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("date"), F.row_number().over(w).alias("minute"), (F.col("value") - 50).alias("iofi"))
