"""The register of queries: a Spark function, and DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common parts of the oracles: panels as in sources.panels.
_SHIP = """SELECT {date} AS date, n_name AS ticker, CAST(n_regionkey AS INTEGER) AS sector, sum(l_quantity) AS sig,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 - 0.05 AS ret
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3"""
PARTS = {
    "pd": _SHIP.format(date="CAST(l_shipdate AS DATE)"),
    "pw": _SHIP.format(date="CAST(date_trunc('week', l_shipdate) AS DATE)"),
    "pt": "SELECT pw.*, t FROM pw JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM pw)) USING (date)",
    "sc": "SELECT a.date, a.t, a.ticker, a.sector, a.sig AS score, b.ret FROM pt a JOIN pt b ON b.ticker = a.ticker AND b.t = a.t + 1",
    "mk": "SELECT date, avg(round(ret, 9)) AS mkt FROM pw GROUP BY date",
    "oh": """SELECT CAST(l_shipdate AS DATE) AS date, n_name AS ticker, CAST(min(p) AS DOUBLE) / 100 AS open, CAST(sum(p) AS DOUBLE) / count(p) / 100 AS close
      FROM (SELECT *, CAST(round(100 * (l_extendedprice / nullif(l_quantity, 0))) AS BIGINT) AS p FROM lineitem)
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "od": "SELECT oh.*, t FROM oh JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM oh)) USING (date)",
    "sn": """SELECT ticker, time, seq, CAST(n AS INTEGER) AS level, v - (n - 1) AS bid, v - (n - 1) + 1 + k % 3 AS ask, k + n AS bid_size, 100 - k + n AS ask_size
      FROM (SELECT event_type AS ticker, ts AS time, event_id AS seq, CAST(floor(value) AS DOUBLE) AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
      (SELECT CAST(unnest([1, 2, 3]) AS DOUBLE) AS n)""",
    "mi": "SELECT user_id AS ticker, CAST(ts AS DATE) AS date, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS minute, value - 50 AS iofi FROM events",
}
_NEEDS = {"pt": ["pw"], "sc": ["pw", "pt"], "mk": ["pw"], "od": ["oh"]}


def sql(parts: str, body: str) -> str:
    """A query over named parts, each with the parts it needs."""
    names: list[str] = []
    for p in parts.split():
        names += [x for x in [*_NEEDS.get(p, []), p] if x not in names]
    ctes = ", ".join(f"{n} AS ({PARTS[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def rd(x: Column | str, name: str | None = None) -> Column:
    """Rounded to 6 places, without a negative zero."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.round(c, 6) + F.lit(0.0)).alias(name or x)


def whole(x: Column | str, name: str | None = None) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return c.cast("long").alias(name or x)
