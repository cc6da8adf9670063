"""Streaming forms: windowed summaries with a watermark, and imbalance with state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files as they arrive; times become instants, as watermarks need."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum by event type and tumbling (or sliding) window; later events than `late` are left out."""
    w = F.window("ts", length, slide or length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def stateful_imbalance(snapshots: DataFrame) -> DataFrame:
    """(ticker, seq, ofi): each snapshot of (ticker, seq, bid, ask, bid_size, ask_size) against the last one seen of
    its ticker, which is the state.  Within a batch snapshots go by seq."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            now = (r.bid, r.ask, r.bid_size, r.ask_size)
            if last is not None:
                b, a, qb, qa = last
                bid = (r.bid_size if r.bid >= b else 0.0) - (qb if r.bid <= b else 0.0)
                ask = -qa if r.ask > a else r.ask_size if r.ask < a else qa - r.ask_size
                depth = (r.bid_size + r.ask_size) / 2
                out.append((key[0], int(r.seq), (bid + ask) / depth if depth else None))
            last = now
        if last is not None:
            state.update(tuple(float(x) for x in last))
        yield pd.DataFrame(out, columns=["ticker", "seq", "ofi"])

    return snapshots.groupBy("ticker").applyInPandasWithState(step, "ticker string, seq long, ofi double", "bid double, ask double, bid_size double, ask_size double", "append", "NoTimeout")
