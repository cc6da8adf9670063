"""Archives of both kinds, whole and broken, read by tasks; runs that stop and start again."""

import io
import lzma
import random
import struct
import zipfile
import zlib

import pytest

from panelforge.sources import archives, containers, files


def number(n):
    """A 7z number, in nine bytes whatever it is."""
    return b"\xff" + struct.pack("<Q", n)


def seven(members, coder="lzma", solid=True, encoded=False, checks=True):
    """A 7z file of {name: bytes}; empty ones have no stream."""
    full = {n: b for n, b in members.items() if b}
    groups = [list(full.items())] if solid and full else [[m] for m in full.items()]
    lc = {"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}
    name, settings, filters = {
        "copy": (b"\x00", b"", None), "lzma": (b"\x03\x01\x01", bytes([93]) + struct.pack("<I", 1 << 16), [lc]),
        "lzma2": (b"\x21", bytes([8]), [{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]), "other": (b"\x03\x04\x01", b"", None),
    }[coder]
    pack = lambda raw: raw if filters is None else lzma.compress(raw, lzma.FORMAT_RAW, filters=filters)
    one = bytes([len(name) | (0x20 if settings else 0)]) + name + ((number(len(settings)) + settings) if settings else b"")

    def streams(at, raws, packed, split):
        out = b"\x06" + number(at) + number(len(packed)) + b"\x09" + b"".join(number(len(p)) for p in packed) + b"\x00"
        out += b"\x07\x0b" + number(len(packed)) + b"\x00" + (number(1) + one) * len(packed) + b"\x0c" + b"".join(number(len(r)) for r in raws) + b"\x00"
        if split:
            out += b"\x08\x0d" + b"".join(number(len(g)) for g in groups)
            sizes = b"".join(number(len(b)) for g in groups for _, b in g[:-1])
            out += b"\x09" + sizes if sizes else b""
            out += (b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(b)) for g in groups for _, b in g) if checks else b"") + b"\x00"
        return out + b"\x00"

    raws = [b"".join(b for _, b in g) for g in groups]
    packed = [pack(r) for r in raws]
    body = b"".join(packed)
    names = b"".join(n.encode("utf-16-le") + b"\0\0" for n in members)
    flags = [not b for b in members.values()]
    bits = bytes(sum(0x80 >> j for j, x in enumerate(flags[i : i + 8]) if x) for i in range(0, len(flags), 8))
    h = b"\x01" + (b"\x04" + streams(0, raws, packed, True) if groups else b"") + b"\x05" + number(len(members))
    h += (b"\x0e" + number(len(bits)) + bits if any(flags) else b"") + b"\x11" + number(len(names) + 1) + b"\x00" + names + b"\x00\x00"
    if encoded:
        small = pack(h)
        h, body = b"\x17" + streams(len(body), [h], [small], False), body + small
    tail = struct.pack("<QQI", len(body), len(h), zlib.crc32(h))
    return b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", zlib.crc32(tail)) + tail + body + h


def book(rows, levels=2, gap=" "):
    head = "time," + ",".join(f"bid_{n},ask_{n},{gap}bid_size_{n},ask_size_{n}" for n in range(1, levels + 1))
    return "\n".join([head, *(f"09:{i:05d}," + ",".join(f"{i}.{n},{i + 1},{n},x" for n in range(1, levels + 1)) for i in range(rows))]).encode() + b"\n"


LARGE = {"a/1.csv": book(40_000), "none.csv": b"", "b/2.csv": random.Random(3).randbytes(3_000_000), "c.txt": b"x"}


@pytest.mark.parametrize("coder", ["copy", "lzma", "lzma2"])
@pytest.mark.parametrize("solid", [True, False])
@pytest.mark.parametrize("encoded", [True, False])
def test_members_come_whole(coder, solid, encoded):
    raw = seven(LARGE, coder, solid, encoded)
    got = {n: s.read() for n, s in containers.members(io.BytesIO(raw))}
    assert got == LARGE
    assert [n for n, _ in containers.members(io.BytesIO(raw))] == [n for n in LARGE if LARGE[n]] + ["none.csv"] or set(got) == set(LARGE)
    assert {n: s.read(5) for n, s in containers.members(io.BytesIO(raw))} == {n: b[:5] for n, b in LARGE.items()}  # streams left unread


def test_broken_archives_are_errors():
    raw = seven({"a.csv": book(500)})
    flipped = bytearray(raw)
    flipped[200] ^= 1
    for bad in (b"no archive", raw[:-3], raw[:40], bytes(flipped), seven({"a.csv": b"text"}, "other")):
        with pytest.raises(containers.ContainerError):
            [s.read() for _, s in containers.members(io.BytesIO(bad))]
    assert list(containers.members(io.BytesIO(seven({})))) == []


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    put = lambda name, raw: (place / name).write_bytes(raw)
    put("AA_2012-01-03_2012-01-04_2.7z", seven({"d1.csv": book(3), "d2.csv": book(2)}, "lzma2", encoded=True))
    with zipfile.ZipFile(place / "x__BB_2012-01-03_2012-01-04_2.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d1.csv", book(4, levels=1, gap="") + b"short,line\n")
        z.writestr("readme.txt", "none")
    broken = bytearray(seven({"d1.csv": book(3), "d2.csv": book(3000)}, "copy"))
    broken[60_000] ^= 1
    put("CC_2012-01-03_2012-01-04_2.7z", bytes(broken))
    put("DD_2012-01-03_2012-01-04_2.7z", b"")
    put("EE_2012-01-03_2012-01-04_2.7z", seven({"d1.csv": book(0), "d2.csv": b"", "n.txt": b"1"}))
    put("nameless.7z", seven({"d1.csv": book(3)}))
    return place


WANT = {"AA": ("ok", 5), "BB": ("ok", 4), "CC": ("extract_error", 3), "DD": ("empty", 0), "EE": ("no_data", 0), "nameless": ("bad_name", 0)}


def short(run):
    return {r.archive.split("__")[-1].split("_")[0].split(".")[0]: (r.status, r.rows) for r in run.collect()}


def test_every_status_and_a_second_run(spark, folder, tmp_path):
    out, wanted = f"{tmp_path}/out", spark.createDataFrame([("AA_2012-01-03_2012-01-04_2.7z",), ("ZZ_2012-01-03_2012-01-04_2.7z",)], "archive string")
    first = short(archives.extract(spark, str(folder), out, 2, wanted, blocks=3))
    assert first.pop("CC")[0] == "extract_error"
    assert first == {k: v for k, v in WANT.items() if k != "CC"} | {"ZZ": ("missing", 0)}
    books = archives.read_books(spark, out, 2)
    got = sorted((r.archive[:2], r.member, r.seq, r.level, r.bid, r.ask, r.bid_size, r.ask_size) for r in books.where("bid is not null").collect())
    want = [("AA", f"d{d}.csv", i, n, float(f"{i}.{n}"), i + 1.0, float(n), None) for d, k in ((1, 3), (2, 2)) for i in range(k) for n in (1, 2)]
    want += [("x_", "d1.csv", i, 1, float(f"{i}.1"), i + 1.0, 1.0, None) for i in range(4)]
    assert got == sorted(want)
    (folder / "FF_2012-01-03_2012-01-04_2.7z").write_bytes(seven({"d1.csv": book(1)}))
    again = short(archives.extract(spark, str(folder), out, 2, blocks=3))
    assert again.pop("FF") == ("ok", 1) and {s for s, _ in again.values()} == {"skipped"} and again.keys() == WANT.keys()
    assert archives.read_books(spark, out, 2).count() == 2 * (9 + 1)


def test_extraction_goes_on_after_a_stop(spark, folder, tmp_path, monkeypatch):
    out, whole, calls = f"{tmp_path}/out", f"{tmp_path}/whole", []

    def stops(df, n):
        calls.append(n)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return df.repartition(2)

    monkeypatch.setattr(archives, "spread", stops)
    with pytest.raises(KeyboardInterrupt):
        archives.extract(spark, str(folder), out, 2, blocks=50)
    monkeypatch.undo()
    run = short(archives.extract(spark, str(folder), out, 2, blocks=50))
    assert 0 < sum(s == "skipped" for s, _ in run.values()) < len(WANT)
    archives.extract(spark, str(folder), whole, 2)
    assert sorted(archives.read_books(spark, out, 2).collect(), key=str) == sorted(archives.read_books(spark, whole, 2).collect(), key=str)


def test_appended_blocks_go_on_after_a_stop(spark, tmp_path):
    path, made = f"{tmp_path}/t", []

    def make(b, stop=None):
        if b == stop:
            raise KeyboardInterrupt
        made.append(b)
        return spark.range(3).selectExpr("id", f"'{b}' as year")

    with pytest.raises(KeyboardInterrupt):
        files.append_blocks(spark, lambda b: make(b, "2013"), ["2012", "2013", "2014"], path, "year")
    # Data without its ledger row, as a stop between the two leaves it, are replaced.
    spark.range(99).write.parquet(f"{path}/year=2013")
    assert files.append_blocks(spark, make, ["2012", "2013", "2014", "2014"], path, "year") == ["2013", "2014"]
    assert files.append_blocks(spark, make, ["2012", "2013", "2014"], path, "year") == []
    assert made == ["2012", "2013", "2014"]
    assert sorted(tuple(r) for r in spark.read.parquet(path).groupBy("year").count().collect()) == [(2012, 3), (2013, 3), (2014, 3)]
    with pytest.raises(ValueError):
        files.append_blocks(spark, make, ["a/b"], path, "year")
