"""Readers and sinks: archives' index, matrices in several formats, partitioned outputs."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matrices
from .remote import listing

#: TICKER_start_end.suffix, with an optional prefix that ends in two underscores.
ARCHIVE = r"^(?:.*__)?([A-Z][A-Z0-9.-]*)_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})(?:_.*)?\.(?:7z|zip)$"

#: What an order book has on each level.
SIDES = ("bid", "ask", "bid_size", "ask_size")


def archive_index(names: DataFrame, name: str = "archive") -> DataFrame:
    """(ticker, start, end, archive, daily): unparsable names keep nulls, tickers with a dot go."""
    part = lambda i: F.nullif(F.regexp_extract(F.element_at(F.split(name, "/"), -1), ARCHIVE, i), F.lit(""))
    out = names.select(part(1).alias("ticker"), F.to_date(part(2)).alias("start"), F.to_date(part(3)).alias("end"), F.col(name).alias("archive"))
    out = out.where(F.col("ticker").isNull() | ~F.col("ticker").contains("."))
    return out.withColumn("daily", F.concat("ticker", F.lit("_ofi_daily.csv"))).orderBy("ticker", "start", "end", "archive")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a folder's files; file contents aren't read."""
    return archive_index(listing(spark, folder).select(F.col("path").alias("archive")))


def file_status(files: DataFrame, size: str, parsed: Column, rows: str) -> DataFrame:
    """Counts by status: bad_name, empty, no_data, ok."""
    status = F.when(~parsed, "bad_name").when(F.col(size) == 0, "empty").when(F.col(rows) == 0, "no_data").otherwise("ok")
    return files.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def read_snapshots(spark: SparkSession, path: str, levels: int = 10) -> DataFrame:
    """Order-book CSV files (`time`, `bid_N`, ` bid_size_N` with its blank, ...) in long form by level."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns]).withColumn("file", F.input_file_name())
    return by_level(raw, levels, "file", "time")


def by_level(wide: DataFrame, levels: int, *keep: str) -> DataFrame:
    """Columns `bid_N`, `ask_N`, `bid_size_N`, `ask_size_N` as rows (keep..., level, bid, ask, bid_size, ask_size)."""
    num = lambda c: F.expr(f"try_cast(`{c}` as double)")
    have = [n for n in range(1, levels + 1) if f"bid_{n}" in wide.columns]
    book = F.array(*[F.struct(F.lit(n).alias("level"), *(num(f"{s}_{n}").alias(s) for s in SIDES)) for n in have])
    return wide.select(*keep, F.explode(book).alias("b")).select(*keep, "b.*")


def read_daily_zips(spark: SparkSession, path: str, ticker: str, values: dict[str, str], start: str, end: str, tickers: list[str]) -> DataFrame:
    """(date, ticker, value...) of the members YYYYMMDD.csv.gz of YYYY.zip archives, from start to end.

    values: of each value column its name in the files; what is no number becomes null.  The
    archives are read by the tasks, one each; years, dates and tickers outside are passed over.
    """
    fields = ", ".join(f"`{v}` double" for v in values)
    wanted = set(tickers)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content"):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for name in sorted(z.namelist()):
                        day = re.fullmatch(r"(?:.*/)?(\d{4})(\d{2})(\d{2})\.csv\.gz", name)
                        if not day or not start <= (date := "-".join(day.groups())) <= end:
                            continue
                        t = csv.read_csv(pa.BufferReader(gzip.decompress(z.read(name))), convert_options=csv.ConvertOptions(include_columns=[ticker, *values.values()], column_types={c: pa.string() for c in (ticker, *values.values())}, strings_can_be_null=True))
                        t = t.filter(pc.is_in(t[ticker], pa.array(sorted(wanted), pa.string())))
                        if t.num_rows:
                            numbers = [pa.array([number(v) for v in t[c].to_pylist()], pa.float64()) for c in values.values()]
                            yield pa.RecordBatch.from_arrays([pa.array([date] * t.num_rows), t[ticker].combine_chunks(), *numbers], names=["date", "ticker", *values])

    years = F.regexp_extract("path", r"(\d{4})\.zip$", 1)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).where(years.between(start[:4], end[:4]))
    return rows.select("content").mapInArrow(members, f"date string, ticker string, {fields}").withColumn("date", F.to_date("date"))


def number(text: str | None) -> float | None:
    try:
        value = float(text)
    except (TypeError, ValueError):
        return None
    return None if value != value else value


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker, value) from a wide CSV, Parquet or pickled table, or (row, col, value) from .npy / .npz of two dimensions."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("pkl", "pickle"):
        return matrices.read_pickle(spark, path)
    if kind == "npy":
        return matrices.read_npy(spark, path)
    if kind == "npz":
        return matrices.read_npz(spark, path)
    if kind in ("parquet", "pq"):
        wide = spark.read.parquet(path)
    elif kind == "csv":
        wide = spark.read.option("header", True).csv(path)
    else:
        raise ValueError(f"no reader for .{kind}")
    date, *cols = wide.columns
    long = wide.select(F.col(f"`{date}`").cast("string").alias("date"), *(F.col(f"`{c}`").cast("string").alias(c) for c in cols)).unpivot("date", cols, "ticker", "value")
    value = F.expr("try_cast(value as double)")
    return long.select(F.expr("try_cast(date as date)").alias("date"), "ticker", F.when(~F.isnan(value), value).alias("value"))


def unless_done(jobs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Jobs whose output doesn't exist yet."""
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet partitioned by keys; rows of a key are brought together first, split where they are many."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested reports, one JSON object a line."""
    df.write.mode("overwrite").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one of that schema where there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def append_blocks(spark: SparkSession, make: Callable[[str], DataFrame], blocks: Iterable[str], path: str, name: str) -> list[str]:
    """Writes make(block) to the partition `name`=block for each block that isn't in the ledger; gives those written.

    A partition is replaced whole before its block enters the ledger (`_done` in the folder), so
    that a run that stopped anywhere can start again and adds nothing twice.  The ledger has one
    row a block (a year, a month); blocks are names of letters, digits, dots and dashes.
    """
    done = {r[0] for r in read_or_empty(spark, f"{path}/_done", "block string").collect()}
    todo = [b for b in dict.fromkeys(blocks) if b not in done]
    if wrong := [b for b in todo if not re.fullmatch(r"[A-Za-z0-9.-]+", b)]:
        raise ValueError(f"no name for a block: {wrong[0]}")
    for b in todo:
        make(b).drop(name).write.mode("overwrite").parquet(f"{path}/{name}={b}")
        spark.createDataFrame([(b,)], "block string").coalesce(1).write.mode("append").parquet(f"{path}/_done")
    return todo
