"""Members of zip and 7z archives as streams, for tasks that read an archive each.

Of 7z, folders with one coder are read: stored, LZMA or LZMA2, which is what archives of text
hold.  Other coders and encrypted members are a ContainerError.
"""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

CHUNK = 1 << 20
#: Fixed value: the first bytes of a 7z file.
MAGIC = b"7z\xbc\xaf\x27\x1c"
#: Property ids of the 7z format.
END, HEADER, MAIN_STREAMS, FILES = 0x00, 0x01, 0x04, 0x05
PACK, UNPACK, SUBSTREAMS, SIZE, CRC, FOLDER = 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0B
CODER_SIZES, STREAM_COUNTS, EMPTY_STREAM, EMPTY_FILE, NAMES, ENCODED = 0x0C, 0x0D, 0x0E, 0x0F, 0x11, 0x17
COPY, LZMA2, LZMA1 = b"\x00", b"\x21", b"\x03\x01\x01"


class ContainerError(ValueError):
    """A broken archive, or one that this reader can't read."""


class Folder(NamedTuple):
    coder: bytes
    settings: bytes
    at: int
    packed: int
    size: int
    #: (size, crc or None) of each stream.
    streams: list[tuple[int, int | None]]


def _number(f: BinaryIO) -> int:
    """As many further low bytes as the first one has leading ones; its other bits are the highest."""
    first = _take(f, 1)[0]
    more = 8 - (first ^ 0xFF).bit_length()
    rest = int.from_bytes(_take(f, more), "little")
    return rest if more >= 7 else rest | (first & (0x7F >> more)) << 8 * more


def _take(f: BinaryIO, n: int) -> bytes:
    got = f.read(n)
    if len(got) != n:
        raise ContainerError("the file ends early")
    return got


def _expect(f: BinaryIO, wanted: int) -> None:
    if (got := _take(f, 1)[0]) != wanted:
        raise ContainerError(f"property {got} where {wanted} belongs")


def _bits(f: BinaryIO, n: int) -> list[bool]:
    raw = _take(f, (n + 7) // 8)
    return [bool(raw[i // 8] & 0x80 >> i % 8) for i in range(n)]


def _digests(f: BinaryIO, n: int) -> list[int | None]:
    known = [True] * n if _take(f, 1)[0] else _bits(f, n)
    return [struct.unpack("<I", _take(f, 4))[0] if k else None for k in known]


def _coder(f: BinaryIO) -> tuple[bytes, bytes]:
    if _number(f) != 1:
        raise ContainerError("a chain of coders")
    flags = _take(f, 1)[0]
    if flags & 0x90:
        raise ContainerError("a coder with several streams")
    name = _take(f, flags & 0x0F)
    return name, _take(f, _number(f)) if flags & 0x20 else b""


def _streams(f: BinaryIO) -> list[Folder]:
    """Folders, from the properties that describe packed streams."""
    at, packed, coders, sizes, whole = 0, [], [], [], []
    counts: list[int] = []
    parts: list[list[int]] = []
    crcs: list[int | None] | None = None
    while (kind := _take(f, 1)[0]) != END:
        if kind == PACK:
            at, n = 32 + _number(f), _number(f)
            while (p := _take(f, 1)[0]) != END:
                if p == SIZE:
                    packed = [_number(f) for _ in range(n)]
                elif p == CRC:
                    _digests(f, n)
                else:
                    raise ContainerError(f"property {p} of packed streams")
        elif kind == UNPACK:
            _expect(f, FOLDER)
            n = _number(f)
            _expect(f, 0)
            coders = [_coder(f) for _ in range(n)]
            _expect(f, CODER_SIZES)
            sizes = [_number(f) for _ in range(n)]
            whole = [None] * n
            while (p := _take(f, 1)[0]) != END:
                if p != CRC:
                    raise ContainerError(f"property {p} of coders")
                whole = _digests(f, n)
        elif kind == SUBSTREAMS:
            counts = [1] * len(coders)
            p = _take(f, 1)[0]
            if p == STREAM_COUNTS:
                counts = [_number(f) for _ in coders]
                p = _take(f, 1)[0]
            # Of each folder the last stream's size is what is left.
            for n, size in zip(counts, sizes, strict=True):
                some = [_number(f) for _ in range(n - 1)] if p == SIZE else []
                parts.append([*some, size - sum(some)] if n else [])
            if p == SIZE:
                p = _take(f, 1)[0]
            open_ = [i for i, n in enumerate(counts) if n and not (n == 1 and whole[i] is not None)]
            if p == CRC:
                crcs = _digests(f, sum(counts[i] for i in open_))
                p = _take(f, 1)[0]
            if p != END:
                raise ContainerError(f"property {p} of streams")
        else:
            raise ContainerError(f"property {kind} of a header")
    if len(packed) != len(coders):
        raise ContainerError("packed streams don't match coders")
    rest = iter(crcs or [])
    folders = []
    for i, (name, settings) in enumerate(coders):
        mine = parts[i] if parts else [sizes[i]]
        checks = [whole[i]] if len(mine) == 1 and whole[i] is not None else [next(rest, None) for _ in mine]
        folders.append(Folder(name, settings, at, packed[i], sizes[i], list(zip(mine, checks, strict=True))))
        at += packed[i]
    return folders


class _Unpacked:
    """The unpacked bytes of a folder, a chunk at a time."""

    def __init__(self, f: BinaryIO, folder: Folder):
        self.f, self.at, self.left = f, folder.at, folder.packed
        if folder.coder == COPY:
            self.coder = None
            return
        if folder.coder == LZMA1 and len(s := folder.settings) == 5:
            modes = {"id": lzma.FILTER_LZMA1, "lc": s[0] % 9, "lp": s[0] // 9 % 5, "pb": s[0] // 45, "dict_size": max(4096, int.from_bytes(s[1:], "little"))}
        elif folder.coder == LZMA2 and len(s := folder.settings) == 1 and s[0] <= 40:
            modes = {"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if s[0] == 40 else (2 | s[0] & 1) << s[0] // 2 + 11}
        else:
            raise ContainerError(f"coder {folder.coder.hex()}")
        self.coder = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[modes])

    def _packed(self, n: int) -> bytes:
        n = min(n, self.left)
        self.f.seek(self.at)
        raw = _take(self.f, n)
        self.at, self.left = self.at + n, self.left - n
        return raw

    def read(self, n: int) -> bytes:
        """Up to n bytes, none at the end."""
        if self.coder is None:
            return self._packed(n)
        try:
            while not self.coder.eof:
                raw = self._packed(CHUNK) if self.coder.needs_input else b""
                if (out := self.coder.decompress(raw, n)) or (not raw and self.coder.needs_input):
                    return out
        except lzma.LZMAError as e:
            raise ContainerError(str(e)) from e
        return b""


class Member(io.RawIOBase):
    """One file of a folder, with its checksum held at the end."""

    def __init__(self, source: _Unpacked | None, size: int, crc: int | None):
        self.source, self.left, self.want, self.crc = source, size, crc, 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if not self.left or not len(into):
            return 0
        got = self.source.read(min(len(into), self.left))
        if not got:
            raise ContainerError("a member ends early")
        into[: len(got)] = got
        self.left, self.crc = self.left - len(got), zlib.crc32(got, self.crc)
        if not self.left and self.want is not None and self.crc != self.want:
            raise ContainerError("a checksum differs")
        return len(got)


def _listed(f: BinaryIO) -> tuple[list[Folder], list[str], list[bool]]:
    """Folders, and each file's name and whether it has no stream."""
    if _take(f, 6) != MAGIC:
        raise ContainerError("no 7z file")
    _take(f, 6)
    at, size, crc = struct.unpack("<QQI", _take(f, 20))
    if not size:
        return [], [], []
    f.seek(32 + at)
    raw = _take(f, size)
    while True:
        if zlib.crc32(raw) != crc:
            raise ContainerError("the header's checksum differs")
        h = io.BytesIO(raw)
        kind = _take(h, 1)[0]
        if kind == HEADER:
            break
        if kind != ENCODED:
            raise ContainerError(f"property {kind} starts the header")
        (folder,) = _streams(h)
        raw, crc = io.BufferedReader(Member(_Unpacked(f, folder), *folder.streams[0])).read(), folder.streams[0][1]
        crc = zlib.crc32(raw) if crc is None else crc
    folders, names, empty = [], [], []
    while (kind := _take(h, 1)[0]) != END:
        if kind == MAIN_STREAMS:
            folders = _streams(h)
        elif kind == FILES:
            n = _number(h)
            empty = [False] * n
            while (p := _take(h, 1)[0]) != END:
                body = io.BytesIO(_take(h, _number(h)))
                if p == EMPTY_STREAM:
                    empty = _bits(body, n)
                elif p == NAMES:
                    _expect(body, 0)
                    names = body.read().decode("utf-16-le").split("\0")[:n]
            if len(names) != n:
                raise ContainerError("files without names")
        else:
            raise ContainerError(f"property {kind} of the header")
    return folders, names, empty


def _seven(f: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    folders, names, empty = _listed(f)
    files = iter([(n, e) for n, e in zip(names, empty, strict=True)])
    for folder in folders:
        source = _Unpacked(f, folder)
        for size, crc in folder.streams:
            for name, none in files:
                if not none:
                    break
                yield name, io.BytesIO()
            else:
                raise ContainerError("a stream without a file")
            member = Member(source, size, crc)
            yield name, io.BufferedReader(member, CHUNK)
            while member.left:  # what the caller didn't read
                member.readinto(bytearray(CHUNK))
    for name, none in files:
        if not none:
            raise ContainerError("a file without a stream")
        yield name, io.BytesIO()


def _zip(f: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    with zipfile.ZipFile(f) as z:
        for i in z.infolist():
            if not i.is_dir():
                with z.open(i) as m:
                    yield i.filename, m


def members(f: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    """(name, stream) of an archive's files in its own order; a stream is read before the next is asked for."""
    head = f.read(6)
    f.seek(0)
    try:
        yield from _seven(f) if head == MAGIC else _zip(f)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, UnicodeDecodeError) as e:
        raise ContainerError(str(e)) from e
