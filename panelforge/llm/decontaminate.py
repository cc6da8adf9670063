"""Benchmark decontamination by winnowing.

Words are hashed, GRAM consecutive words make a gram, and of every SPAN - GRAM + 1
consecutive grams (a window of SPAN words) the smallest hash is a fingerprint.  The
choice depends on the window's words alone, so two texts that share SPAN consecutive
words share a fingerprint there.  Fingerprints of documents and of benchmark items
are joined, and each meeting is extended word by word to both sides, on the words
themselves; a shared run of SPAN words or more marks its words in the document.
An item of fewer words is one window as a whole: its one gram of that many words is
its fingerprint, and documents are asked for grams of just the lengths that occur.

Every fingerprint carries the words up to SPAN - GRAM places away on both sides, which
hold every window that contains it; so extension needs no second look at the texts.

Before the join, documents are tested against a bit map of fixed size with the
items' fingerprints; it lets through all true ones and never grows.  The join is left
to Catalyst: adaptive execution sends the items' side to all if it is small as
measured, and otherwise sorts both and splits hot fingerprints.

Definitions: words are runs of 0-9, a-z, A-Z (as lower case) and of characters above
U+007F.  Null or wordless texts have 0 words and no hit.  Repeated rows come back each.
Items without words take no part; items with a null id do, but can't be listed.
Without documents the result is empty; without items every document has no hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, spans

SPAN = 13
GRAM = 8
#: Bits of the bit map, as a power of two: 4 MB.
MAP_BITS = 25
FINGERPRINT = "kind int, gram long, place long, ahead int, around string"


def word_hashes(run: spans.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and hashes of words, and the first word of each document (one more)."""
    mapped = spans.ALNUM[run.data]
    starts, ends = spans.words(mapped, run.off)
    return mapped, starts, ends, spans.hashes(mapped, starts, ends), np.searchsorted(starts, run.off)


def chosen(grams: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Whether each gram `at` is the smallest of some `width` grams in a row within [lo, hi)."""
    out = np.zeros(len(at), bool)
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    near = np.full((2 * width - 1, len(at)), worst)
    for j in range(2 * width - 1):
        p = at + j - (width - 1)
        ok = (p >= lo) & (p < hi)
        near[j, ok] = grams[p[ok]]
    for first in range(width):
        start = at - (width - 1) + first
        inside = (start >= lo) & (start + width <= hi)
        out |= inside & (near[first : first + width].min(axis=0) == grams[at])
    return out


def fingerprints(run: spans.Run, short: tuple[int, ...], bits: np.ndarray | None, items: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Words of each document, and (kind, document, gram, place, ahead, words around) of what is chosen.

    kind 0: winnowed grams; kind n in `short`: all grams of n words (of items: just
    those of items of n words).  bits: grams not in this map are passed over.
    """
    mapped, starts, ends, h, first = word_hashes(run)
    n_words = np.diff(first)
    found = []
    doc = np.repeat(np.arange(run.docs), n_words)
    text = mapped.tobytes()
    for kind in (0, *short):
        k = kind or GRAM
        grams = spans.kgrams(h, k)
        if not len(grams):
            continue
        at = np.arange(len(grams)) if bits is None else np.flatnonzero(in_map(bits, grams, kind))
        d = doc[at]
        lo, hi = first[d], first[d + 1] - k + 1
        keep = (at < hi) & ((n_words[d] == kind) if kind and items else (n_words[d] >= (kind or SPAN)))
        at, lo, hi, d = at[keep], lo[keep], hi[keep], d[keep]
        if not kind:
            keep = chosen(grams, at, lo, hi, SPAN - GRAM + 1)
            at, lo, hi, d = at[keep], lo[keep], hi[keep], d[keep]
        reach = 0 if kind else SPAN - GRAM
        a, b = np.maximum(at - reach, lo), np.minimum(at + k + reach, hi + k - 1)
        around = [b" ".join([text[s:e] for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)]).decode() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        found.append((np.full(len(at), kind, np.int32), d, grams[at].view(np.int64), at - lo, (at - a).astype(np.int32), around))
    return n_words, found


def slot(grams: np.ndarray, kind: int | np.ndarray) -> np.ndarray:
    salt = np.asarray(kind, np.uint64) * np.uint64(0x9E3779B9)
    return ((grams ^ salt) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def in_map(bits: np.ndarray, grams: np.ndarray, kind: int) -> np.ndarray:
    at = slot(grams, kind)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def shared_run(mine: list[str], mine_ahead: int, other: list[str], other_ahead: int, k: int) -> tuple[int, int]:
    """How many words agree ahead of the gram and from its start on; (0, 0) if the gram differs."""
    if mine[mine_ahead : mine_ahead + k] != other[other_ahead : other_ahead + k]:
        return 0, 0
    back = 0
    while back < min(mine_ahead, other_ahead) and mine[mine_ahead - back - 1] == other[other_ahead - back - 1]:
        back += 1
    on = k
    while mine_ahead + on < len(mine) and other_ahead + on < len(other) and mine[mine_ahead + on] == other[other_ahead + on]:
        on += 1
    return back, on


def bit_map(prints: DataFrame) -> bytes:
    """The map of all fingerprints of the items, made from maps of its partitions."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MAP_BITS - 3, np.uint8)
        for b in batches:
            at = slot(np.array(b.column(1), np.int64).view(np.uint64), np.asarray(b.column(0)))
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at >> 12), pa.array(at & 4095), pa.array(bits[at].astype(np.int32))], names=["page", "byte", "value"])

    out = np.zeros(1 << MAP_BITS - 3, np.uint8)
    pages = prints.select("kind", "gram").mapInArrow(part, "page long, byte long, value int").groupBy("page", "byte").agg(F.bit_or("value").alias("value"))
    pages = pages.groupBy("page").agg(F.collect_list(F.struct("byte", "value")).alias("bytes"))
    for r in pages.toLocalIterator():
        for b, v in r["bytes"]:
            out[r["page"] << 12 | b] |= v
    return out.tobytes()


def item_prints(items: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, tuple[int, ...]]:
    """Distinct fingerprints of the items with a number each, the numbers' items (print, item), and the lengths of short items.

    A passage that many items share is one fingerprint and as many rows of the second table: no row holds all of its items.
    """
    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string").alias("text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.concatenate([np.diff(word_hashes(r)[4]) for r in spans.runs(b.column(0))] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(n))], names=["n"])

    short = tuple(sorted(r["n"] for r in rows.select("text").mapInArrow(lengths, "n long").where(f"n between 1 and {SPAN - 1}").distinct().collect()))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in spans.runs(b.column(1)):
                for kind, d, gram, _, ahead, around in fingerprints(run, short, None, True)[1]:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d + run.first)), pa.array(kind), pa.array(gram), pa.array(ahead), pa.array(around, pa.string())], names=["item", "kind", "gram", "ahead", "around"])

    found = rows.mapInArrow(prints, "item string, kind int, gram long, ahead int, around string")
    found = base.checkpoint(found.distinct())
    same = ["kind", "gram", "ahead", "around"]
    numbered = base.checkpoint(found.select(*same).distinct().withColumn("print", F.monotonically_increasing_id()))
    return numbered, found.where("item is not null").join(numbered, same).select("print", "item"), short


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Of every row: key, n_words, n_hit, items (ids as sorted strings), and its hit spans as (first, end) word places."""
    base.arrow(docs.sparkSession)
    theirs, members, short = item_prints(items, item_key, item_text)
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(theirs))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.lit(3), text).alias("same"), F.col(text).cast("string").alias("text"))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        seen = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            for run in spans.runs(b.column(2)):
                n_words, found = fingerprints(run, short, seen, False)
                d = np.concatenate([np.arange(run.docs), *(f[1] for f in found)]) + run.first
                took = b.take(pa.array(d))
                rest = len(d) - run.docs
                # A document's own row has kind -1 and, for its gram, a number that spreads such rows.
                own = spans.mix(np.arange(run.docs).astype(np.uint64) ^ np.asarray(took.column(1)[: run.docs]).view(np.uint64)).view(np.int64)
                join = lambda i, own: pa.array(np.concatenate([own, *(f[i] for f in found)]))  # noqa: B023, E731
                zero = np.zeros(run.docs, np.int64)
                cols = [took.column(0), took.column(1), join(0, np.full(run.docs, -1, np.int32)), join(2, own), join(3, zero), join(4, zero.astype(np.int32)), pa.array([None] * run.docs + [x for f in found for x in f[5]], pa.string()), pa.array(np.append(n_words, np.zeros(rest, np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "same", "kind", "gram", "place", "ahead", "around", "n_words"])

    kind = dict(rows.dtypes)["key"]
    found = rows.mapInArrow(mine, f"key {kind}, same long, {FINGERPRINT}, n_words long")
    met = found.join(theirs.select("kind", "gram", F.col("ahead").alias("their_ahead"), F.col("around").alias("their_around"), "print"), ["kind", "gram"], "left")
    met = met.where("kind < 0 or print is not null")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(n).to_pylist() for n in ("kind", "place", "ahead", "around", "their_ahead", "their_around")}
            first, end = [], []
            for kind, place, ahead, around, their_ahead, their_around in zip(*col.values(), strict=True):
                back, on = (0, 0) if kind < 0 else shared_run(around.split(" "), ahead, their_around.split(" "), their_ahead, kind or GRAM)
                ok = back + on >= (kind or SPAN) if kind >= 0 else False
                first.append(place - back if ok else None)
                end.append(place + on if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("same"), b.column("kind"), b.column("n_words"), pa.array(first, pa.int64()), pa.array(end, pa.int64()), b.column("print")], names=["key", "same", "kind", "n_words", "first", "end", "print"])

    # A row for each document and each meeting; read for the spans and for the items.
    hits = base.checkpoint(met.mapInArrow(extend, f"key {kind}, same long, kind int, n_words long, first long, end long, print long"))
    listed = hits.where("first is not null").select("key", "same", "print").distinct().join(members, "print").select("key", "same", "item").distinct()
    none = lambda t: F.lit(None).cast(t)
    both = hits.where("kind < 0 or first is not null").select("key", "same", "kind", "n_words", "first", "end", none("string").alias("item"))
    both = both.unionByName(listed.select("key", "same", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n_words"), none("long").alias("first"), none("long").alias("end"), "item"))
    per = both.groupBy("key", "same").agg(
        F.sum((F.col("kind") < 0).cast("int")).alias("times"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "end")))).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["to"], s["first"]))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to")),
    )["n"]
    per = per.withColumn("n_hit", covered)
    return per.select(F.col("key").alias(key), "n_words", "n_hit", "items", "spans", F.explode(F.sequence(F.lit(1), "times")).alias("_i")).drop("_i")


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words lies in shared spans."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
