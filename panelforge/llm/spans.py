"""Vectorised spans over the UTF-8 bytes of an Arrow text column.

A column's bytes lie in one buffer, so words and their 64-bit hashes come from a
few NumPy passes over that buffer, without a Python object per word.  Work goes
on in runs of whole documents of about BLOCK bytes; only a document that is
longer itself makes a longer run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 4 << 20
#: Bytes that are hashed at a time.
STRETCH = 1 << 18
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: A prime, and a base modulo it.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_220_703_125
#: Powers of BASE and of its inverse modulo 2**64, and of PRIME_BASE and of its inverse modulo PRIME.
_powers_held = np.ones((4, 1), np.uint64)


def _powers(n: int) -> np.ndarray:
    global _powers_held
    if _powers_held.shape[1] < n:
        size = 1 << int(n - 1).bit_length()

        def grown(base: int, modulus: int) -> np.ndarray:
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, modulus))
                if modulus == PRIME:
                    out[done : 2 * done] %= np.uint64(PRIME)
                done *= 2
            return out

        _powers_held = np.stack([grown(pow(b, e, m), m) for b, m in ((BASE, 1 << 64), (PRIME_BASE, PRIME)) for e in (1, -1)])
    return _powers_held[:, :n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(keep: np.ndarray | list[int], lower: bool = False) -> np.ndarray:
    """A byte map in which bytes outside `keep` become 0, and A-Z lower case if asked."""
    out = np.zeros(256, np.uint8)
    out[keep] = keep
    if lower:
        out[65:91] = np.where(out[97:123] > 0, np.arange(97, 123), 0)
    return out


#: The contract's word classes, as bytes (every byte above 0x7F belongs to a word).
ALNUM = table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)], lower=True)
NONSPACE = table([b for b in range(1, 256) if b not in (0x20, *range(9, 14))])
NONSPACE[65:91] = np.arange(97, 123)
#: U+0000 belongs to a word too; 0 means "outside", so it becomes a byte that UTF-8 never has.
NONSPACE[0] = 0xFD


@dataclass
class Run:
    """Whole documents of a batch: their bytes, and len+1 offsets into them."""

    first: int
    data: np.ndarray
    off: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.off) - 1


def column(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def runs(arr: pa.Array, block: int = BLOCK, docs: int = 1 << 30) -> Iterator[Run]:
    """The column in runs of whole documents, balanced by bytes and not by rows; at most `docs` of them."""
    data, off = column(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + docs, max(i + 1, int(np.searchsorted(off, off[i] + block, "right")) - 1))
        yield Run(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def words(mapped: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-zero bytes that stay within a document."""
    inside = mapped != 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    start[edge] |= inside[edge]
    end[edge[1:] - 1] |= inside[edge[1:] - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def document_of(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The document in which each span starts."""
    return np.searchsorted(off, starts, "right") - 1


def hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap.

    Two polynomials make it, one in an odd base modulo 2**64 and one modulo a prime (the
    first alone is the same for some pairs of texts of two letters, whatever the base),
    both taken from prefix sums and mixed with the length.  Spans are done in stretches
    of about STRETCH bytes.
    """
    out = np.empty(len(starts), np.uint64)
    prime = np.uint64(PRIME)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse, power_p, inverse_p = _powers(hi - lo + 1)
        x = mapped[lo:hi].astype(np.uint64)
        a, b = starts[i:j] - lo, ends[i:j] - lo
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(x * power[: hi - lo], out=sums[1:])
        plain = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x *= power_p[: hi - lo]
        if hi - lo > 1 << 23:
            x %= prime  # keeps the sums of a very long span under 2**64
        np.cumsum(x, out=sums[1:])
        out[i:j] = plain + mix((sums[b] - sums[a]) % prime * inverse_p[a] % prime)
        i = j
    return mix(out)


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, at the position of the first."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(BASE)
        out += h[j : j + n]
    return mix(out)


def factorize(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes, sorted distinct values, and where each appears first."""
    order = np.argsort(h)
    by = h[order]
    new = np.append(True, by[1:] != by[:-1])[: len(h)]
    codes = np.empty(len(h), np.int64)
    codes[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return codes, by[starts], np.minimum.reduceat(order, starts) if len(h) else order


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes and where each distinct span appears first; spans lie end to end, from 0 on.

    Hashes find the candidates; each span is then compared with its first, byte by byte,
    and what differs gets codes of its own, so that equal codes mean equal bytes.
    """
    codes, _, first = factorize(hashes(data + np.uint16(1), starts, ends))
    size, model = ends - starts, first[codes]
    like = size == size[model]
    move = np.where(like, starts[model] - starts, 0)
    # A stretch at a time, so that the places of bytes stay small.
    bad = [np.flatnonzero(~like)]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        differ = data[np.arange(lo, hi) + np.repeat(move[i:j], size[i:j])] != data[lo:hi]
        if differ.any():
            bad.append(i + np.unique(np.searchsorted(ends[i:j] - lo, np.flatnonzero(differ), "right")))
        i = j
    bad = np.concatenate(bad)
    if len(bad):
        known: dict[bytes, int] = {}
        first = first.tolist()
        for k in np.sort(bad).tolist():
            span = data[starts[k] : ends[k]].tobytes()
            if span not in known:
                known[span] = len(first)
                first.append(k)
            codes[k] = known[span]
        first = np.array(first)
    return codes, first


def tiles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut documents where byte-level tokenizers cut them too: before a lone ASCII space
    character that stands between two characters that are no white space.

    The public patterns never match across such a place and look no further than
    it, so that the tokens of a text are those of its tiles.  Characters that may be
    white space beyond ASCII (by their first byte) make a place unsafe.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = (data == 0x20) | ((data >= 9) & (data <= 13))
    odd = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)) | ((data >= 0x1C) & (data <= 0x1F))
    cut = white.copy()
    cut[0] = cut[-1] = False
    if n > 1:
        cut[1:] &= ~(white[:-1] | odd[:-1])
        cut[:-1] &= ~(white[1:] | odd[1:])
    for back in (2, 3):
        cut[back:] &= ~odd[:-back]
    edge = off[:-1][off[:-1] < off[1:]]
    cut[edge] = True
    last = edge[1:] - 1
    cut[last] &= np.isin(last, edge)
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


def sums(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums by document."""
    return np.bincount(docs, weights=values, minlength=n).astype(np.int64)


#: What an entry of a memo takes beside its key and value, in bytes.
ENTRY = 160


class Memo:
    """Values of distinct spans by their bytes, in at most about `most` bytes.

    Entries are held in two generations; when the newer one has half of the bytes it
    becomes the older one, and what wasn't asked for since is forgotten.
    """

    def __init__(self, most: int = 64 << 20):
        self.most, self.new, self.old, self.size = most, {}, {}, 0

    def fill(self, keys: list[bytes], make) -> list:
        """The values of `keys`; make(indices) gives those that aren't known, each with its size."""
        new, old = self.new, self.old
        out = [new.get(k) for k in keys]
        missing = []
        for i, v in enumerate(out):
            if v is None:
                v = out[i] = old.get(keys[i])
                if v is None:
                    missing.append(i)
                else:
                    self._put(keys[i], v, 0)
        if missing:
            for i, (v, size) in zip(missing, make(missing), strict=True):
                out[i] = v
                self._put(keys[i], v, size)
        return out

    def _put(self, key: bytes, value, size: int) -> None:
        self.size += len(key) + size + ENTRY
        if self.size > self.most // 2:
            self.old, self.new, self.size = self.new, {}, len(key) + size + ENTRY
        self.new[key] = value
