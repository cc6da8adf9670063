"""Matrices of any shape go through .npy parts and back; pickles load tables only."""

import os
import pickle

import numpy as np
import pandas as pd
import pytest

from panelforge.sources import files, matrices

CELLS = 60


def cells(df):
    return {(r.row, r.col): r.value for r in df.collect()}


def dense(df, rows, cols):
    m = np.full((rows, cols), np.nan)
    for (i, j), v in cells(df).items():
        m[i, j] = np.nan if v is None else v
    return m


@pytest.mark.parametrize("rows,cols", [(1, 1), (37, 7), (5, 100), (60, 1)])
def test_round_trip_by_parts_and_joined(spark, tmp_path, rows, cols):
    m = np.random.default_rng(rows).normal(size=(rows, cols))
    m[rows // 2] = np.nan  # a row without cells
    given = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(rows) for j in range(cols) if i != rows // 2], "row long, col int, value double")
    parts = matrices.write_npy(given, f"{tmp_path}/m", rows, cols, CELLS)
    names = sorted(os.listdir(tmp_path / "m"))
    assert parts == len([n for n in names if n.endswith(".npy")]) == -(-rows // max(1, CELLS // cols))
    np.testing.assert_array_equal(np.vstack([np.load(tmp_path / "m" / n) for n in names if n.startswith("rows-")]), m)
    np.testing.assert_array_equal(dense(matrices.read_npy(spark, f"{tmp_path}/m", CELLS), rows, cols), m)
    assert matrices.join_npy(spark, f"{tmp_path}/m", f"{tmp_path}/one.npy") == parts
    np.testing.assert_array_equal(np.load(tmp_path / "one.npy"), m)
    back = matrices.read_npy(spark, f"{tmp_path}/one.npy", CELLS)
    assert back.count() == rows * cols
    np.testing.assert_array_equal(dense(back, rows, cols), m)


@pytest.mark.parametrize("kind", ["<f8", "<f4", ">i4", "|u1"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_types_and_orders(spark, tmp_path, kind, order):
    m = np.asarray(np.arange(91).reshape(13, 7), dtype=kind, order=order)
    np.save(tmp_path / "m.npy", m)
    np.savez_compressed(tmp_path / "m.npz", m)
    for name in ("m.npy", "m.npz"):
        np.testing.assert_array_equal(dense(files.read_matrix(spark, f"{tmp_path}/{name}"), 13, 7), m)


def test_wrong_cells_and_folders(spark, tmp_path):
    cell = lambda *rows: spark.createDataFrame(rows, "row long, col int, value double")
    for i, rows in enumerate([[(0, 0, 1.0), (0, 0, 2.0)], [(3, 0, 1.0)], [(-1, 0, 1.0)], [(None, 0, 1.0)], [(0, 2, 1.0)]]):
        with pytest.raises(Exception, match="more than one value|outside the shape"):
            matrices.write_npy(cell(*rows), f"{tmp_path}/w{i}", 3, 2)
    assert matrices.write_npy(cell((0, 0, None)).limit(0), f"{tmp_path}/none", 0, 4) == 1
    assert matrices.read_npy(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(FileExistsError):
        matrices.write_npy(cell((0, 0, 1.0)), f"{tmp_path}/none", 1, 1)
    np.save(tmp_path / "o.npy", np.array([["a", {}]], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="numbers"):
        matrices.read_npy(spark, f"{tmp_path}/o.npy").count()


class Runs:
    def __reduce__(self):
        return os.getcwd, ()


def test_pickled_tables_only(spark, tmp_path):
    wide = pd.DataFrame({"A": [1.0, 2.5, None], "B": ["3", "x", "4"]}, index=pd.to_datetime(["2012-01-04", "2012-01-03", "2012-01-05"]))
    wide.to_pickle(tmp_path / "m.pkl")
    got = {(str(r.date), r.ticker): r.value for r in files.read_matrix(spark, f"{tmp_path}/m.pkl").collect()}
    assert got == {("2012-01-04", "A"): 1.0, ("2012-01-03", "A"): 2.5, ("2012-01-05", "A"): None, ("2012-01-04", "B"): 3.0, ("2012-01-03", "B"): None, ("2012-01-05", "B"): 4.0}
    for name, bad in (("run.pkl", Runs()), ("list.pkl", [1])):
        (tmp_path / name).write_bytes(pickle.dumps(bad))
        with pytest.raises(Exception, match="part of a table|pickled table"):
            files.read_matrix(spark, f"{tmp_path}/{name}").count()
