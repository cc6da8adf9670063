"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

A leaf stands for a byte position and holds the rank of the pair that the token
starting there makes with its right live neighbour (none: infinite).  An inner
node keeps the leftmost minimum of its leaves, so the root names the next merge.
A merge changes three leaves: the merged token's, its left live neighbour's and the
leaf of the token that went away; each change is carried up in logarithmic time.

Short pieces of text run through the same trees many at a time in NumPy arrays
(encode_short); longer ones through one tree of their own (encode_long).

Tiles of texts (spans.tiles) that a worker has met before are remembered, by their bytes,
as packed ids.  A text's ids are laid out from those of its tiles, and its decimal ids and
decoded bytes from tables by id, so that no token or tile of it needs an object of its own.
The vocabulary and these tiles are held from task to task, or dropped at each task's end:
an executor has more workers than cores once a stage has run several Python steps at a
time, and its tasks go round all of them, so that each would hold them.

Definitions: null texts count as empty (0 tokens, no bytes); every row gets a
result, repeated rows each their own, and an empty table an empty one; invalid ids
raise.  No special tokens exist, so their strings are plain text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, spans

OWNER = "bpe"
#: Above every rank; times ROW_BYTES it still fits 32 bits.
NONE = 1 << 24
#: Pieces up to so many bytes go through the arrays.
ROW_BYTES = 64
#: Leaves of the trees that are worked on at a time, bytes of text, and tokens that are laid out.
CELLS, BLOCK, STRETCH = 100_000, 1 << 20, 1 << 17
#: Bytes of tiles that a worker remembers.
REMEMBERED = 64 << 20


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        rank = self.ranks.get
        most = max(self.ranks.values())
        if most >= NONE:
            raise ValueError(f"{path}: ranks of {NONE} or more")
        named = {r: t for t, r in self.ranks.items()}
        texts = [named.get(r, b"") for r in range(most + 1)]
        #: By id: its bytes among those of all, and its decimal number and a space.
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.size = np.array([len(t) for t in texts], np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.decimal = np.array([b"%d " % r for r in range(most + 1)])
        self.digits = np.array([len(str(r)) + 1 for r in range(most + 1)], np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(a << 32 | b): r for t, r in self.ranks.items() for i in range(1, len(t)) if (a := rank(t[:i])) is not None and (b := rank(t[i:])) is not None}
        # A pair stands in the first free slot from its hash's on; a quarter of the slots is taken at most.
        self.bits = (4 * len(self.pairs) + 4).bit_length()
        self.keys, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys, merged = np.fromiter(self.pairs, np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.int32, len(self.pairs))
        at = self._slots(keys)
        while len(at):
            free = np.flatnonzero(self.keys[at] == -1)
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.merged[at[placed]] = merged[placed]
            left = ~placed
            at, keys, merged = (at[left] + 1) & ((1 << self.bits) - 1), keys[left], merged[left]
        self.byte_pairs = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64) * np.uint64(spans.BASE)
        x ^= x >> np.uint64(32)
        x *= np.uint64(spans.BASE)
        return (x >> np.uint64(64 - self.bits)).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids, NONE where they don't make a token (or the right one is -1)."""
        want = left.astype(np.int64) << 32 | right
        at = self._slots(want)
        found, out = self.keys[at], self.merged[at]
        more = np.flatnonzero((found != want) & (found != -1))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            found, asked = self.keys[at[more]], want[more]
            out[more] = self.merged[at[more]]
            more = more[(found != asked) & (found != -1)]
        return out

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers, a space after each."""
        raw = self.decimal[ids].view(np.uint8)
        return raw[raw != 0].tobytes()

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens; an id that isn't there raises."""
        if len(ids) and (ids.min() < 0 or not self.size[ids].all()):
            raise IndexError("not an id of the vocabulary")
        return self.flat[_places(self.start[ids], self.size[ids])].tobytes()


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the items of spans, one span after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def vocabulary(path: str) -> Vocabulary:
    return base.kept(OWNER, path, lambda: Vocabulary(path))


def encode_rows(v: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Token ids of pieces of 1 to ROW_BYTES bytes, by one segment tree a row."""
    tokens, counts = encode_short(v, pieces)
    flat, ends = tokens.tolist(), np.cumsum(counts).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode_short(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same as the ids of all pieces, one after the other, and the count of each piece."""
    data, size = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
    start = np.cumsum(size) - size
    made, width = [], 2
    while width <= ROW_BYTES:
        rows = np.flatnonzero((size <= width) & (size > (width // 2 if width > 2 else 0)))
        many = max(64, CELLS // width)
        for i in range(0, len(rows), many):
            part = rows[i : i + many]
            made.append((part, *_encode_width(v, data, start[part], size[part], width)))
        width *= 2
    return _in_order(made, len(pieces))


def _in_order(made: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of n pieces from parts: the pieces in them, their ids and counts."""
    counts = np.zeros(n, np.int64)
    for part, _, count in made:
        counts[part] = count
    start = np.cumsum(counts) - counts
    tokens = np.empty(int(counts.sum()), np.int32)
    for part, ids, count in made:
        tokens[_places(start[part], count)] = ids
    return tokens, counts


def _encode_width(v: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(size)
    # Place p of piece r lies at p * n + r.  A node is rank * width + place, so that the least
    # one is the leftmost of the least rank.  Place `width` takes what is written behind a full row.
    tree, token = np.empty((2 * width, n), np.int32), np.full((width + 1, n), -1, np.int32)
    tree[width:] = NONE * width + np.arange(width, dtype=np.int32)[:, None]
    last = None
    for p in range(width):
        rows = slice(None) if p <= width // 2 and width > 2 else np.flatnonzero(size > p)
        byte = np.zeros(n, np.int32)
        byte[rows] = data[start[rows] + p]
        token[p, rows] = v.byte_ids[byte[rows]]
        if p:
            tree[width + p - 1, rows] = v.byte_pairs[last[rows] << 8 | byte[rows]] * width + (p - 1)
        last = byte
    level = width
    while level > 1:
        np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2], out=tree[level // 2 : level])
        level //= 2
    after = np.repeat(np.arange(1, width + 2, dtype=np.int32), n)
    before = np.repeat(np.arange(-1, width, dtype=np.int32), n)
    tree, token, root = tree.reshape(-1), token.reshape(-1), tree[1]

    def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray | int) -> None:
        value = rank * width + at
        node = at + width
        tree[node * n + rows] = value
        level = width
        while level > 1:
            value = np.minimum(value, tree[(node ^ 1) * n + rows])
            node = node >> 1
            tree[node * n + rows] = value
            level //= 2

    rows = np.flatnonzero(root < NONE * width)
    while len(rows):
        top = root[rows]
        rank, at = top // width, top % width
        here = at * n + rows
        gone = after[here]
        there = gone * n + rows
        right = after[there]
        token[here], token[there] = rank, -1
        after[here] = right
        beyond = right * n + rows
        before[beyond] = at
        left = before[here]
        first = left < 0
        left = np.where(first, at, left)
        ranks = v.rank(np.concatenate([rank, token[left * n + rows]]), np.concatenate([token[beyond], rank]))
        new = ranks[: len(rows)]
        put(rows, gone, NONE)
        put(rows, at, new)
        # Where nothing stands left of it, the merged token's own leaf is put again.
        put(rows, left, np.where(first, new, ranks[len(rows) :]))
        rows = rows[root[rows] < NONE * width]
    rest = np.ascontiguousarray(token.reshape(width + 1, n)[:width].T)
    live = rest >= 0
    return rest[live], live.sum(1)


def encode_long(v: Vocabulary, piece: bytes) -> list[int]:
    """The same for one piece of any length, in packed arrays: about 35 bytes of memory for each of its own."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    none, pairs = NONE, v.pairs
    first = v.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int64)
    # A node is rank * width + place, so that the least one is the leftmost of the least rank.
    nodes = np.full(2 * width, none * width, np.int64)
    nodes[width : width + n - 1] = v.rank(first[:-1], first[1:]).astype(np.int64) * width
    nodes[width:] += np.arange(width)
    level = width
    while level > 1:
        nodes[level // 2 : level] = np.minimum(nodes[level : 2 * level : 2], nodes[level + 1 : 2 * level : 2])
        level //= 2
    tree, token = array("q", nodes.tobytes()), array("q", first.tobytes())
    del nodes, first
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))

    def put(at: int, rank: int) -> None:
        node = width + at
        tree[node] = rank * width + at
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            new = left if left < right else right
            if tree[node] == new:
                return
            tree[node] = new

    while tree[1] < none * width:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        right = after[gone]
        token[at], token[gone] = rank, -1
        after[at] = right
        if right < n:
            before[right] = at
        put(gone, none)
        put(at, pairs.get(rank << 32 | token[right], none) if right < n else none)
        if before[at] >= 0:
            put(before[at], pairs.get(token[before[at]] << 32 | rank, none))
    return [t for t in token if t >= 0]


def encode_pieces(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, and how many each has: a piece that is a token is that token; else by merges."""
    n = len(pieces)
    whole = np.fromiter(map(v.ranks.get, pieces, itertools.repeat(-1)), np.int32, n)
    size = np.fromiter(map(len, pieces), np.int64, n)
    known = np.flatnonzero(whole >= 0)
    made = [(known, whole[known], np.ones(len(known), np.int64))]
    for i in np.flatnonzero((whole < 0) & (size > ROW_BYTES)).tolist():
        ids = np.array(encode_long(v, pieces[i]), np.int32)
        made.append((np.array([i]), ids, np.array([len(ids)])))
    short = np.flatnonzero((whole < 0) & (size <= ROW_BYTES))
    made.append((short, *encode_short(v, [pieces[i] for i in short.tolist()])))
    return _in_order(made, n)


def decode(v: Vocabulary, ids: bytes) -> bytes:
    """The bytes of decimal ids joined by spaces."""
    return v.decoded(np.array(ids.split(), np.int64))


@functools.lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    # The rank files' libraries count U+001C to U+001F as no white space; here \s would.
    return regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+"))


def encode_tiles(v: Vocabulary, pattern: str, tiles: list[bytes]) -> list[bytes]:
    """Ids of each tile as packed 32-bit numbers."""
    pat, raw = _pattern(pattern), b"".join(tiles)
    ends = np.cumsum(np.fromiter(map(len, tiles), np.int64, len(tiles)))
    # Neighbours here weren't so in their texts: where one doesn't end as tiles do, the pattern starts anew.
    cuts = spans.tiles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    apart = [0, *np.setdiff1d(ends[:-1], cuts).tolist(), len(raw)]
    code: dict[str, int] = {}
    codes = np.array([code.setdefault(m, len(code)) for i, j in itertools.pairwise(apart) for m in pat.findall(raw[i:j].decode())], np.int64)
    pieces = [m.encode() for m in code]
    ids, count = encode_pieces(v, pieces)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))[codes]
    packed = ids[_places((np.cumsum(count) - count)[codes], count[codes])].tobytes()
    if len(tiles) > 1 and size.sum() < len(raw):
        # Not the public patterns, which leave nothing out: places can't be told from lengths.
        return [x for t in tiles for x in encode_tiles(v, pattern, [t])]
    # Tiles end where pieces do.
    stops = (4 * np.append(0, np.cumsum(count[codes]))[np.searchsorted(np.cumsum(size), ends, "right")]).tolist()
    return [packed[i:j] for i, j in itertools.pairwise([0, *stops])]


def encode_texts(texts: pa.Array, path: str, pattern: str, remembered: int = REMEMBERED) -> Iterator[tuple[np.ndarray, bytes, bytes]]:
    """Ids of each text as numbers and as decimals joined by spaces, and the bytes that these ids decode to."""
    v = vocabulary(path)
    memo = base.kept(OWNER, (path, pattern, remembered), lambda: spans.Memo(remembered))
    for run in spans.runs(texts, BLOCK):
        a, b = spans.tiles(run.data, run.off)
        raw = run.data.tobytes()
        codes, first = spans.distinct_spans(run.data, a, b)
        tiles = [raw[i:j] for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True)]
        packed = memo.fill(tiles, lambda new, tiles=tiles: ((ids, len(ids) + 40) for ids in encode_tiles(v, pattern, [tiles[i] for i in new])))
        of_tiles = np.frombuffer(b"".join(packed), np.int32)
        count = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start = np.cumsum(count) - count
        ends = np.cumsum(count[codes])
        laid, decimals, back, i = [], [], [], 0
        while i < len(codes):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STRETCH, "right")))
            c = codes[i:j]
            laid.append(of_tiles[_places(start[c], count[c])])
            decimals.append(v.decimals(laid[-1]))
            back.append(v.decoded(laid[-1]))
            i = j
        bounds = np.append(0, ends)[np.searchsorted(a, run.off)]
        ids, decimals, back = np.concatenate([np.zeros(0, np.int32), *laid]), b"".join(decimals), b"".join(back)
        i = p = q = 0
        for j in bounds[1:].tolist():
            own = ids[i:j]
            to_p, to_q = p + int(v.digits[own].sum()), q + int(v.size[own].sum())
            yield own, decimals[p : to_p - 1] if j > i else b"", back[q:to_q]
            i, p, q = j, to_p, to_q


def encode_column(texts: pa.Array, path: str, pattern: str, remembered: int = REMEMBERED) -> Iterator[tuple[bytes, bytes]]:
    """Ids of each text as decimal numbers joined by spaces, and the bytes that these ids decode to."""
    for _, ids, back in encode_texts(texts, path, pattern, remembered):
        yield ids, back


def bpe(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = True, remembered: int = REMEMBERED, hold: bool = True) -> DataFrame:
    """key, n_tokens, ids (array of int, if asked), and the SHA-256 of ids and of what they decode to.

    remembered: bytes of tiles that a worker remembers; hold: whether it keeps these and
    the vocabulary for its next task.
    """
    base.arrow(docs.sparkSession)

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, h, back, tokens = [], [], [], []
        for own, coded, decoded in encode_texts(batch.column(1), path, pattern, remembered):
            n.append(len(own))
            h.append(hashlib.sha256(coded).hexdigest())
            back.append(hashlib.sha256(decoded).hexdigest())
            if ids:
                tokens.append(own)
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(back, pa.string())]
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            cols.append(pa.array(tokens, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy(OWNER)
        try:
            for batch in batches:
                yield encoded(batch)
                base.trim()
        finally:
            if not hold:
                base.tidy()

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(apply, f"`{key}` {dict(rows.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
