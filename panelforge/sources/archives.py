"""Order books out of zip and 7z archives: tasks read an archive each, and every archive leaves a status.

bad_name: the name has no ticker and dates, and the archive isn't opened.  empty: no bytes.
extract_error: broken or unreadable.  no_data: no row in any CSV member.  ok: all rows are there.
A run adds skipped (done before) and missing (wanted and not there).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .containers import ContainerError, members
from .files import ARCHIVE, SIDES, by_level, read_or_empty
from .remote import file_system, listing, spread

#: Status of a row of a book, beside those of archives.
ROW = "row"
BLOCK = 4 << 20


def _columns(levels: int) -> list[str]:
    return ["time", *(f"{s}_{n}" for n in range(1, levels + 1) for s in SIDES)]


def _schema(levels: int) -> str:
    return "archive string, member string, status string, seq long, " + ", ".join(f"{c} string" for c in _columns(levels))


def _csv(stream, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The named columns of a CSV member as text, null where it has none; lines of another width are left out."""
    s = io.BufferedReader(stream)
    names = [c.strip() for c in s.readline().decode("utf-8-sig", "replace").split(",")]
    if not s.peek(1):
        return
    with csv.open_csv(
        pa.PythonFile(s, mode="r"), csv.ReadOptions(use_threads=False, block_size=BLOCK, column_names=names), csv.ParseOptions(invalid_row_handler=lambda _: "skip"),
        csv.ConvertOptions(include_columns=columns, include_missing_columns=True, column_types={c: pa.string() for c in {*columns, *names}}, strings_can_be_null=True),
    ) as batches:
        yield from batches


def _batch(archive: str, member: str | None, status: str, seq: list[int], columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    n = len(seq)
    head = [pa.array([archive] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array([status] * n, pa.string()), pa.array(seq, pa.int64())]
    return pa.RecordBatch.from_arrays([*head, *columns], names=["archive", "member", "status", "seq", *names])


def _books(levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _columns(levels)
    for b in batches:
        for r in b.to_pylist():
            status, rows = r["status"], 0
            # A read that fails otherwise than by the archive's own content fails the task, which is tried again.
            try:
                if status is None:
                    where, at = file_system(r["path"])
                    with where.open_input_file(at) as f:
                        for member, stream in members(f):
                            seq = 0
                            for t in _csv(stream, names) if member.lower().endswith(".csv") else ():
                                yield _batch(r["archive"], member, ROW, list(range(seq, seq + t.num_rows)), [t.column(c) for c in names], names)
                                seq += t.num_rows
                            rows += seq
                    status = "ok" if rows else "no_data"
            except (ContainerError, pa.ArrowInvalid):
                status = "extract_error"
            yield _batch(r["archive"], None, status, [rows], [pa.nulls(1, pa.string())] * len(names), names)


def extract(spark: SparkSession, folder: str, out: str, levels: int = 10, wanted: DataFrame | None = None, blocks: int = 16) -> DataFrame:
    """Adds the archives under `folder` that `out` doesn't hold yet; gives (archive, status, rows) of this run.

    Archives go in `blocks` jobs, so that a stop loses one of them.  Rows and status of an archive
    are one partition, replaced whole; so a rerun adds nothing twice.  wanted: (archive) names
    that ought to be there.  Names tell archives apart, whatever folder they are in.
    """
    name = F.element_at(F.split("path", "/"), -1).alias("archive")
    found = listing(spark, folder, ".7z", ".zip").select("path", "length", name).withColumn("block", F.pmod(F.crc32("archive"), F.lit(blocks)))
    found = found.withColumn("status", F.when(~F.col("archive").rlike(ARCHIVE), "bad_name").when(F.col("length") == 0, "empty"))
    before = read_or_empty(spark, out, _schema(levels)).where(F.col("status") != ROW).select("archive").distinct().withColumn("before", F.lit(True))
    # What this run has to do is written down first, since the table that it was read from grows meanwhile.
    found.join(before, "archive", "left").dropDuplicates(["archive"]).write.mode("overwrite").parquet(f"{out}/_run")
    files = spark.read.parquet(f"{out}/_run")
    todo = files.where("before is null")
    for (block,) in sorted(todo.select("block").distinct().collect()):
        mine = spread(todo.where(F.col("block") == block).select("path", "archive", "status"), spark.sparkContext.defaultParallelism * 2)
        rows = mine.mapInArrow(partial(_books, levels), _schema(levels))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("archive").parquet(out)
    now = read_or_empty(spark, out, _schema(levels)).where(F.col("status") != ROW).select("archive", F.col("status").alias("now"), F.col("seq").alias("rows"))
    run = files.join(now, "archive").select("archive", F.when(F.col("before"), "skipped").otherwise(F.col("now")).alias("status"), "rows")
    if wanted is not None:
        run = run.unionByName(wanted.select("archive").distinct().join(files, "archive", "left_anti").select("archive", F.lit("missing").alias("status"), F.lit(0).cast("long").alias("rows")))
    return run


def read_books(spark: SparkSession, out: str, levels: int = 10) -> DataFrame:
    """(archive, member, seq, time, level, bid, ask, bid_size, ask_size) of archives that were read to their end."""
    rows = read_or_empty(spark, out, _schema(levels))
    good = rows.where("status = 'ok'").select("archive")
    return by_level(rows.where(F.col("status") == ROW).join(good, "archive", "left_semi"), levels, "archive", "member", "seq", "time")
