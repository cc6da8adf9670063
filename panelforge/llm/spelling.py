"""Spelling variants by a rare-first q-gram prefix filter.

Words are maximal runs of letters of all texts, lower-cased in A-Z.  A run that its document's
digest picks (once in SLIPS) loses one letter there: a slip, as careless typing makes.
Words of LEAST_LENGTH letters or more that occur LEAST_COUNT times are kept.

Filter.  A word's positional bigrams are ordered by their frequency among all words (then by
bigram, then by place).  One inserted, deleted or replaced letter touches at most
two bigrams of either word, and the others keep their order, so the first one they keep is
among the three rarest of both.  Only those three join.  Position limit: everything left of a
kept bigram is equal, or everything right of it is, on the side where the edit isn't.  So a
bigram joins at the same distance from the start together with the letters before it, or
at the same distance from the end together with those behind it.

Wide groups.  A group of more than WIDE words is split by halves: of the letters that
may still differ, either the first half or the second is equal, in words of equal length as
in those that differ by one, so each word goes on into at most four narrower groups.
It is repeated until no group is wide or just two letters may differ; such groups are
bounded by the alphabet.  Within a group near words meet by the pattern of a replaced
or left-out letter, so that no group is compared pair by pair beyond PAIRS words.

Groups of variants: a word's form is its near word of largest count (ties: smallest in
code-point order) if it has at least twice the word's count; a word's root is the last of its
forms.  Counts double along a way of forms, so it ends, and ways are shortened by halves.

Definitions: null texts have no words; a null key counts as empty text in the digest.
Repeated rows count again, each with the same slips.  An empty table gives no rows.  Runs are
told apart by 64-bit hashes within 4 MB of text, and as strings beyond.
"""

from __future__ import annotations

import operator
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, spans

LEAST_LENGTH, LEAST_COUNT = 5, 3
SLIPS = 97
#: Bigrams of a word that join: one more than an edit can touch.
RAREST = 3
WIDE, PAIRS = 2048, 12
#: Bytes of counted words that a task holds.
HELD = 32 << 20
#: Words of more bytes get their digest by themselves.
LONG = 128

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: The first byte of U+00C0 to U+00FF in UTF-8; their second is any continuation byte.
_LEAD = 0xC3


def letters(run: spans.Run) -> np.ndarray:
    """The run's bytes, A-Z lower-cased, 0 outside of words."""
    low = _LOWER[run.data]
    lead = low == _LEAD
    inside = _LETTER[low] | lead
    inside[1:] |= lead[:-1]
    low[~inside] = 0
    return low


def _shifts() -> np.ndarray:
    """[length, k, byte]: what the k-th byte of a CRC-32 becomes as `length` bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = np.empty((LONG + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for i in range(LONG):
        out[i + 1] = (out[i] >> 8) ^ table[out[i] & 255]
    return out


_shift_table = _shifts()


def digests(heads: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of head and tail from their CRC-32s, where the tail has `sizes` bytes, LONG at most."""
    out = tails.copy()
    for k in range(4):
        out ^= _shift_table[sizes, k, (heads >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def slip(run: str, digest: int) -> str:
    at = digest % len(run)
    return run[:at] + run[at + 1 :]


def run_counts(run: spans.Run, keys: list) -> Iterator[tuple[str, int]]:
    """Words of the run's documents, slips made, with counts; a word may come more than once."""
    low = letters(run)
    starts, ends = spans.words(low, run.off)
    codes, _, first = spans.factorize(spans.hashes(low, starts, ends))
    raw = low.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    doc = spans.document_of(starts, run.off)
    pair, times = np.unique(doc * max(1, len(words)) + codes, return_counts=True)
    doc, code = np.divmod(pair, max(1, len(words)))
    heads = [f"{'' if k is None else k}:".encode() for k in keys]
    head = np.array([zlib.crc32(h) for h in heads], np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    tail = np.array([zlib.crc32(w) for w in words], np.uint32)
    digest = digests(head[doc], tail[code], np.minimum(size, LONG)[code])
    for i in np.flatnonzero(size[code] > LONG).tolist():
        digest[i] = zlib.crc32(words[code[i]], int(head[doc[i]]))
    slips = digest % np.uint32(SLIPS) == 0
    for i in np.flatnonzero(slips).tolist():
        word = words[code[i]].decode()
        if len(word) > LEAST_LENGTH:
            yield slip(word, int(digest[i])), int(times[i])
    plain = np.bincount(code[~slips], weights=times[~slips], minlength=len(words)).astype(np.int64)
    for i in np.flatnonzero((plain > 0) & (size >= LEAST_LENGTH)).tolist():
        word = words[i].decode()
        if len(word) >= LEAST_LENGTH:
            yield word, int(plain[i])


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n) of all texts; tasks add up what they can hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        held: dict[str, int] = defaultdict(int)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for i in range(0, len(words), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 10_000], pa.string()), pa.array([held[w] for w in words[i : i + 10_000]], pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for run in spans.runs(batch.column(1)):
                for word, n in run_counts(run, keys[run.first : run.first + run.docs]):
                    before = len(held)
                    held[word] += n
                    size += (len(held) - before) * (len(word) + 150)
                    if size > HELD:
                        yield from flush()
                        size = 0
        yield from flush()
        base.trim()

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string"))
    parts = rows.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams as 16-bit numbers (no letter is beyond U+00FF), the words they are in and their places."""
    size = np.array([len(w) for w in words], np.int64)
    x = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.uint32)
    who = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    inside = np.flatnonzero(who[:-1] == who[1:])
    return x[inside] << np.uint32(8) | x[inside + 1], who[inside], at[inside]


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """Each bigram's rank from the rarest on.  There are at most 65,536 whatever the corpus holds, so they fit on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(bigrams(batch.column(0).to_pylist())[0], minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["g", "c"])

    total = np.zeros(1 << 16, np.int64)
    for g, c in words.select("word").mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c")).collect():
        total[g] = c
    ranks = np.empty(1 << 16, np.uint64)
    ranks[np.argsort(total, kind="stable")] = np.arange(1 << 16)
    return ranks


def group_of(word: str, left: int, right: int, rest: int) -> int:
    """The group of words with the same first `left` and last `right` letters; rest: letters that may
    differ in the shorter ones, -1 where any number may."""
    part = f"{left}:{right}:{rest}:{word[:left]}:{word[len(word) - right :]}".encode()
    return zlib.crc32(part) << 31 ^ zlib.adler32(part) ^ zlib.crc32(part[::-1]) << 16


ENTRY = "bucket long, word string, n long, left int, right int, rest int"


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "word", "n", "left", "right", "rest"])


def rare_entries(words: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Two entries for each of a word's three rarest bigrams: with all before it, and with all behind it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not names:
                continue
            g, who, at = bigrams(names)
            # Word, rank and place in one number; words of a batch are few, and places under 2**32.
            packed = np.sort(who.astype(np.uint64) << np.uint64(48) ^ ranks[g] << np.uint64(32) ^ at.astype(np.uint64)) if len(names) < 1 << 16 else None
            order = packed >> np.uint64(48)
            nth = np.arange(len(packed)) - np.searchsorted(order, order)
            rows = []
            for w, p in zip(order[nth < RAREST].tolist(), (packed[nth < RAREST] & np.uint64((1 << 32) - 1)).tolist(), strict=True):
                word = names[w]
                for left, right in ((p + 2, 0), (0, len(word) - p)):
                    rows.append((group_of(word, left, right, -1), word, n[w], left, right, -1))
            yield _entries(rows)

    return words.select("word", "n").mapInArrow(emit, ENTRY)


def halves(word: str, left: int, right: int) -> set[tuple[int, int, int]]:
    """(left, right, rest) of the narrower groups of a word whose letters between left and right may differ."""
    free = len(word) - left - right
    out = set()
    for rest in (free, free - 1):
        if rest >= 0:
            half = rest // 2
            out |= {(left + half, right, rest - half), (left, right + rest - half, half)}
    return out


def narrowed(entries: DataFrame, wide: DataFrame) -> DataFrame:
    """Entries, those of wide groups in narrower ones."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n, left, right in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "left", "right")), strict=True):
                rows += [(group_of(word, a, b, rest), word, n, a, b, rest) for a, b, rest in halves(word, left, right)]
            yield _entries(rows)

    told = entries.join(wide.withColumn("wide", F.lit(True)), "bucket", "left")
    return told.where("wide is null").select(*entries.columns).union(told.where("wide").select(*entries.columns).mapInArrow(split, ENTRY))


def near(x: str, y: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes one of the other."""
    if len(x) == len(y):
        return sum(map(operator.ne, x, y)) == 1
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) != 1:
        return False
    i = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(x))
    return x[i:] == y[i + 1 :]


def near_in(group: list[tuple[str, int, int]]) -> set[tuple[int, int]]:
    """Places i < j of near words (word, left, right) of a group."""
    if len(group) <= PAIRS:
        return {(i, j) for i, j in combinations(range(len(group)), 2) if abs(len(group[i][0]) - len(group[j][0])) < 2 and near(group[i][0], group[j][0])}
    middle = [w[a : len(w) - b] for w, a, b in group]
    whole: dict[str, list[int]] = defaultdict(list)
    for i, m in enumerate(middle):
        whole[m].append(i)
    out = set()
    replaced: dict[tuple[int, str], list[int]] = defaultdict(list)
    for i, m in enumerate(middle):
        for p in range(len(m)):
            cut = m[:p] + m[p + 1 :]
            replaced[p, cut].append(i)
            if cut in whole:
                out |= {(min(i, j), max(i, j)) for j in whole[cut]}
    for like in replaced.values():
        if len(like) > 1:
            out |= set(combinations(like, 2))
    # Groups are told apart by a hash, so what they find is looked at once more.
    return {(i, j) for i, j in out if near(group[i][0], group[j][0])}


def near_pairs(entries: DataFrame) -> DataFrame:
    """(a, na, b, nb): near words of a group, with counts; a < b."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int]] = []
        counts: list[int] = []
        at, out = None, []

        def flush() -> None:
            for i, j in near_in(held):
                x, y = sorted(((held[i][0], counts[i]), (held[j][0], counts[j])))
                out.append((*x, *y))

        def done() -> pa.RecordBatch:
            cols = list(zip(*set(out), strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "na", "b", "nb"])

        for batch in batches:
            for bucket, word, n, left, right, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    flush()
                    held, counts, at = [], [], bucket
                if not held or held[-1] != (word, left, right):
                    held.append((word, left, right))
                    counts.append(n)
            if len(out) > 20_000:
                yield done()
                out = []
        flush()
        yield done()

    dealt = entries.repartition("bucket").sortWithinPartitions("bucket", "word")
    return dealt.mapInArrow(compare, "a string, na long, b string, nb long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): ways are followed by doubling, so the rounds are the logarithm of the longest."""
    state = base.checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = base.checkpoint(state.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        state = moved.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every kept word."""
    base.arrow(docs.sparkSession)
    words = base.checkpoint(word_counts(docs, key, text))
    entries = base.checkpoint(rare_entries(words, bigram_ranks(words)))
    while True:
        sizes = entries.where("rest < 0 or rest > 1").groupBy("bucket").agg(F.count("*").alias("m"))
        wide = base.checkpoint(sizes.where(F.col("m") > WIDE).select("bucket"))
        if wide.isEmpty():
            break
        entries = base.checkpoint(narrowed(entries, wide))
    pairs = base.checkpoint(near_pairs(entries))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    takes = -F.col("best.m") >= 2 * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"))
    rows = base.checkpoint(rows)
    return rows.join(roots(rows.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
