"""Matrices in .npy files: written in parts by ranges of rows, read by ranges of bytes; pickled tables behind an allow-list."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import partial
from zipfile import ZipFile

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .remote import file_system, listing, spread

#: Cells that a task holds at a time.
CELLS = 4_000_000
#: Bytes that are copied at a time.
CHUNK = 8 << 20
CELL = "row long, col int, value double"


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, order and type of an open .npy file, which is left at its first cell."""
    version = npy.read_magic(f)
    return npy.read_array_header_1_0(f) if version == (1, 0) else npy.read_array_header_2_0(f)


def _put_header(f, rows: int, cols: int) -> None:
    npy.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (rows, cols)})


def _batch(top: int, left: int, part: np.ndarray) -> pa.RecordBatch:
    row, col = np.indices(part.shape)
    cells = [pa.array((row + top).ravel(), pa.int64()), pa.array((col + left).ravel(), pa.int32()), pa.array(part.astype(float).ravel(), from_pandas=True)]
    return pa.RecordBatch.from_arrays(cells, names=["row", "col", "value"])


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            where, at = file_system(path)
            with where.open_input_file(at) as f:
                shape, fortran, kind = _header(f)
                wrong = f"two dimensions are needed, not {len(shape)}" if len(shape) != 2 else "numbers are needed" if kind.hasobject else None
                shape = (0, 0) if wrong else shape
                name = path.rsplit("/", 1)[-1]
                first = int(name[5:-4]) if name.startswith("rows-") else 0
                row = {"path": [path], "first": [first], "rows": [shape[0]], "cols": [shape[1]], "fortran": [fortran], "kind": [kind.str], "at": [f.tell()], "wrong": [wrong]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("path", pa.string()), ("first", pa.int64()), ("rows", pa.int64()), ("cols", pa.int64()), ("fortran", pa.bool_()), ("kind", pa.string()), ("at", pa.int64()), ("wrong", pa.string())]))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            kind, (outer, inner) = np.dtype(r["kind"]), (r["cols"], r["rows"]) if r["fortran"] else (r["rows"], r["cols"])
            n = min(r["step"], outer - r["start"])
            where, at = file_system(r["path"])
            with where.open_input_file(at) as f:
                f.seek(r["at"] + r["start"] * inner * kind.itemsize)
                part = np.frombuffer(f.read(n * inner * kind.itemsize), kind).reshape(n, inner)
            for i in range(0, n, step := max(1, 100_000 // max(1, inner))):
                some = part[i : i + step]
                yield _batch(r["first"], r["start"] + i, some.T) if r["fortran"] else _batch(r["first"] + r["start"] + i, 0, some)


def read_npy(spark: SparkSession, path: str, cells: int = CELLS) -> DataFrame:
    """(row, col, value) of a .npy file, or of a folder that write_npy wrote; NaN is null.

    Tasks read a range of bytes each, of `cells` cells at most (or one row, or one column where a
    file keeps columns together).  Other than two dimensions, or objects, are an error.
    """
    head = listing(spark, path, ".npy").select("path").mapInArrow(_headers, "path string, first long, rows long, cols long, fortran boolean, kind string, at long, wrong string")
    if bad := head.where("wrong is not null").select("path", "wrong").first():
        raise ValueError(f"{bad[1]}: {bad[0]}")
    head = head.drop("wrong")
    outer, inner = F.when(F.col("fortran"), F.col("cols")).otherwise(F.col("rows")), F.when(F.col("fortran"), F.col("rows")).otherwise(F.col("cols"))
    head = head.withColumn("step", F.greatest(F.lit(1), F.floor(F.lit(cells) / F.greatest(inner, F.lit(1)))).cast("long")).where("rows > 0 and cols > 0")
    starts = head.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), outer - 1, F.col("step"))))
    return spread(starts, spark.sparkContext.defaultParallelism * 4).mapInArrow(_ranges, CELL)


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            where, at = file_system(path)
            with where.open_input_file(at) as f, ZipFile(f) as z, z.open(z.namelist()[0]) as m:
                (shape, fortran, kind) = _header(m)
                if len(shape) != 2 or kind.hasobject:
                    raise ValueError(f"a matrix of two dimensions is needed, not {len(shape)}: {path}")
                outer, inner = shape[::-1] if fortran else shape
                for i in range(0, outer, step := max(1, 100_000 // max(1, inner))):
                    n = min(step, outer - i)
                    part = np.frombuffer(m.read(n * inner * kind.itemsize), kind).reshape(n, inner)
                    yield _batch(0, i, part.T) if fortran else _batch(i, 0, part)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of the first matrix of an .npz file, as one stream, since it may be compressed."""
    return listing(spark, path, ".npz").select("path").mapInArrow(_zipped, CELL)


def _put(path: str, rows: int, cols: int, high: int, key: tuple, table: pa.Table) -> pa.Table:
    """Writes one file of `high` rows, or what is left."""
    first = key[0].as_py() * high
    n = min(high, rows - first)
    row, col, value = (table.column(c) for c in ("row", "col", "value"))
    keep = row.is_valid()
    row, col = (c.filter(keep).to_numpy() for c in (row, col))
    if len(np.unique((row - first) * cols + col)) < len(row):
        raise ValueError("a cell has more than one value")
    m = np.full((n, cols), np.nan)
    m[row - first, col] = value.filter(keep).to_numpy(zero_copy_only=False)
    where, folder = file_system(path)
    # Written aside and moved, so that a task that runs twice leaves one whole file.
    name, aside = f"{folder}/rows-{first:015d}.npy", f"{folder}/_{uuid.uuid4().hex}"
    with where.open_output_stream(aside) as f:
        _put_header(f, n, cols)
        f.write(memoryview(m).cast("B"))
    try:
        where.move(aside, name)
    except OSError:
        if where.get_file_info(name).type == fs.FileType.NotFound:
            raise
        where.delete_file(aside)
    return pa.table({"first": pa.array([first], pa.int64()), "rows": pa.array([n], pa.int64())})


def write_npy(df: DataFrame, path: str, rows: int, cols: int, cells: int = CELLS) -> int:
    """Writes (row, col, value) as .npy files of whole rows, named by their first row; gives their number.

    Cells without a row of their own, and nulls, are NaN.  Cells outside the shape, or with more
    than one value, are an error.  A task holds one file's cells; the folder must be new or empty.
    """
    where, folder = file_system(path)
    where.create_dir(folder, recursive=True)
    if where.get_file_info(fs.FileSelector(folder)):
        raise FileExistsError(path)
    if not rows or not cols:
        with where.open_output_stream(f"{folder}/rows-{0:015d}.npy") as f:
            _put_header(f, rows, cols)
        return 1
    high = max(1, cells // cols)
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    given = df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    given = given.where(F.when(F.coalesce(inside, F.lit(False)), True).otherwise(F.raise_error(F.lit("a cell outside the shape")).cast("boolean")))
    parts = df.sparkSession.range(-(-rows // high)).select(F.col("id").alias("part"), *(F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("col", "int"), ("value", "double"))))
    dealt = given.withColumn("part", F.floor(F.col("row") / high)).select("part", "row", "col", "value").unionByName(parts)
    put = lambda key, table: _put(path, rows, cols, high, key, table)
    return dealt.groupBy("part").applyInArrow(put, "first long, rows long").count()


def _joined(out: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for paths in b.column("paths").to_pylist():
            opened = [file_system(p) for p in paths]
            shapes = []
            for where, at in opened:
                with where.open_input_file(at) as f:
                    shapes.append((_header(f)[0], f.tell()))
            target, at = file_system(out)
            with target.open_output_stream(at) as o:
                _put_header(o, sum(s[0] for s, _ in shapes), shapes[0][0][1])
                for (where, part), (_, skip) in zip(opened, shapes, strict=True):
                    with where.open_input_file(part) as f:
                        f.seek(skip)
                        while some := f.read(CHUNK):
                            o.write(some)
            yield pa.RecordBatch.from_pydict({"parts": pa.array([len(paths)], pa.int64())})


def join_npy(spark: SparkSession, folder: str, out: str) -> int:
    """One .npy file of a folder's parts, copied in order by one task that holds 8 MB; gives the number of parts.

    Only the parts' names meet in that task.
    """
    names = listing(spark, folder, ".npy").where("path rlike '/rows-[0-9]+[.]npy$'").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return names.mapInArrow(partial(_joined, out), "parts long").collect()[0][0]


#: What a pickled table of numbers and text may name.
ALLOWED = {
    "builtins": {"slice"},
    "datetime": {"date", "datetime"},
    "numpy": {"dtype", "ndarray"},
    "numpy._core.multiarray": {"_reconstruct", "scalar"},
    "numpy._core.numeric": {"_frombuffer"},
    "numpy.core.multiarray": {"_reconstruct", "scalar"},
    "numpy.core.numeric": {"_frombuffer"},
    "pandas": {"DataFrame", "Index", "RangeIndex", "DatetimeIndex", "Timestamp"},
    "pandas._libs.arrays": {"__pyx_unpickle_NDArrayBacked"},
    "pandas._libs.internals": {"_unpickle_block"},
    "pandas._libs.tslibs.offsets": {"BusinessDay", "Day", "__pyx_unpickle_Tick"},
    "pandas._libs.tslibs.timestamps": {"_unpickle_timestamp"},
    "pandas.core.arrays.datetimes": {"DatetimeArray"},
    "pandas.core.frame": {"DataFrame"},
    "pandas.core.indexes.base": {"Index", "_new_Index"},
    "pandas.core.indexes.datetimes": {"DatetimeIndex", "_new_DatetimeIndex"},
    "pandas.core.indexes.range": {"RangeIndex"},
    "pandas.core.internals.managers": {"BlockManager"},
}


class _Tables(pickle.Unpickler):
    """Loads tables and nothing that could run other code."""

    def find_class(self, module: str, name: str):
        if name not in ALLOWED.get(module, ()):
            raise pickle.UnpicklingError(f"{module}.{name} isn't part of a table")
        return super().find_class(module, name)


def _pickled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            where, at = file_system(path)
            with where.open_input_file(at) as f:
                wide = _Tables(f).load()
            if not isinstance(wide, pd.DataFrame):
                raise ValueError(f"a pickled table is needed: {path}")
            dates = pd.to_datetime(pd.Series(wide.index.astype(str)), errors="coerce").dt.date
            for i, name in enumerate(wide.columns):
                value = pd.to_numeric(wide.iloc[:, i], errors="coerce").to_numpy(float)
                yield pa.RecordBatch.from_arrays([pa.array(dates, pa.date32(), from_pandas=True), pa.array([str(name)] * len(wide), pa.string()), pa.array(value, from_pandas=True)], names=["date", "ticker", "value"])


def read_pickle(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker, value) of pickled tables of dates by names; what is no date or no number is null.

    Only the classes that make up such a table are loaded, anything else is an error.  A pickle
    has no parts, so that a task holds one whole.
    """
    return listing(spark, path, ".pkl", ".pickle").select("path").mapInArrow(_pickled, "date date, ticker string, value double")
