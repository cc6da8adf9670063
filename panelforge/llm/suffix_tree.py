"""Language-model scores by a probabilistic suffix tree, beside a unigram base.

Symbols.  A text becomes its words (runs without ASCII white space, A-Z lower-cased),
each followed by one space, and an end symbol; the tree predicts these bytes one by
one, so its probability is that of the same tokens that the base scores.

Tree.  Contexts are strings of up to DEPTH bytes, all those of the training texts,
however rare.  One is retained if the distribution of the next symbol diverges from that
of its longest retained suffix by DIVERGENCE nats, and significantly (count * KL >= KEEP,
an absolute bound, so that a larger corpus retains more).  Distributions are interpolated
with the suffix's by a Witten-Bell weight, down to a uniform one over 256 bytes, so
nothing has probability 0.

Counting covers all training texts.  Strings of a context and the next symbol are counted
by partition and dealt out by the context's latest HEAD bytes, so that a part of the tree
with its suffixes of HEAD bytes and more lies in one task; nothing of it is collected.
Counts of shorter contexts, bounded by the alphabet and not by the corpus, go to every
executor.  Counts of all words are gathered besides.

Scoring.  Documents are dealt into groups by a hash; each group sends the distinct
strings of its texts to the tree's parts, which answer with these and their probabilities.
Where the training texts are some of the scored ones, the same strings carry their counts
in training texts, so that no text is sorted for counting alone.  Strings and answers
travel as packed arrays.  There are as many groups and
parts as there are shuffle partitions, or more: one for each GROUP training symbols, so
that neither grows with the corpus.

Base counts.  Words with a share of COMMON or more (at most 1/COMMON of them) go to every
executor; the counts of all other words are joined by the word's hash, so that the base
score is exact for a vocabulary of any size.

Definitions: null and empty texts are just an end symbol.  Repeated rows are scored
each.  Without training texts N = V = 0 and symbols are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base, spans

#: Context bytes; with the next symbol they fill a 64-bit number.
DEPTH = 7
#: Latest bytes of a context by which the tree is dealt out.
HEAD = 3
#: Distinct strings that a counting task holds before it passes them on.
HELD = 4_000_000
#: Bytes of text in a run of the counting passes.
RUN = 6 << 20
#: Symbols of training texts for a part of the tree and a group of texts, if there are more than partitions.
GROUP = 80 << 20
#: Bytes of text that are scored together.
SCORED = 1 << 20
KEEP, DIVERGENCE = 5.0, 0.01
COMMON = 1e-7
#: The end symbol, a byte that UTF-8 texts don't hold; 0xFE stands before a text's start.
END, START = 0xFF, 0xFE


@dataclass
class Symbols:
    """A run's bytes as symbols, their documents' bounds, and word hashes (if asked for) with their documents."""

    data: np.ndarray
    off: np.ndarray
    hash: np.ndarray | None
    doc: np.ndarray


def symbols(run: spans.Run, words: bool = False) -> Symbols:
    mapped = spans.NONSPACE[run.data]
    a, b = spans.words(mapped, run.off)
    doc = spans.document_of(a, run.off)
    size = b - a + 1
    n = np.bincount(doc, weights=size, minlength=run.docs).astype(np.int64) + 1
    off = np.append(0, np.cumsum(n))
    out = np.full(int(off[-1]), 0x20, np.uint8)
    # Every place takes the next byte of a word but those of the space after a word and of the end.
    taken = np.ones(len(out), bool)
    taken[np.cumsum(size) + doc - 1] = False
    taken[off[1:] - 1] = False
    out[taken] = mapped[mapped != 0]
    out[off[1:] - 1] = END
    return Symbols(out, off, spans.hashes(mapped, a, b) if words else None, doc)


def strings(s: Symbols) -> np.ndarray:
    """For each symbol the 8 bytes that end with it, the symbol highest and older ones below, START before the text.

    So the strings that agree in the symbol and its k last predecessors share a prefix.
    """
    docs = len(s.off) - 1
    first = s.off[:-1] + DEPTH * np.arange(docs)
    real = np.ones(len(s.data) + DEPTH * docs, bool)
    for k in range(DEPTH):
        real[first + k] = False
    x = np.full(len(real), START, np.uint8)
    x[real] = s.data
    # A number in little-endian order at each place holds the byte there and the seven after it.
    every = np.ndarray(max(0, len(x) - DEPTH), "<u8", x, strides=(1,))
    return every[real[DEPTH:]]


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_counts=True)


class Tally:
    """Counts by 64-bit key, merged from sorted pieces now and then."""

    def __init__(self):
        self.keys, self.counts, self.more, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.more.append((keys, counts))
        self.size += len(keys)
        if self.size > len(self.keys) + 300_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([self.keys, *(k for k, _ in self.more)])
        counts = np.concatenate([self.counts, *(c for _, c in self.more)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[new], np.add.reduceat(counts, new) if len(new) else counts
        self.more, self.size = [], 0
        return self.keys, self.counts


def _batch(kind: int, length: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, length, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "len", "key", "n"])


_COUNTS = "kind int, len int, key long, n long"


def context_first(x: np.ndarray) -> np.ndarray:
    """Strings with their predecessors highest, the latest first, and the symbol lowest."""
    return (x << np.uint64(8)) | (x >> np.uint64(56))


def shortened(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted 8-byte strings, contexts first: sorted distinct strings with k bytes of context, and their counts."""
    cut = (keys >> np.uint64(8 * (8 - k)) << np.uint64(8) if k else np.zeros(len(keys), np.uint64)) | (keys & np.uint64(255))
    order = np.argsort(cut, kind="stable")
    cut = cut[order]
    new = np.flatnonzero(np.append(True, cut[1:] != cut[:-1])) if len(cut) else np.zeros(0, np.int64)
    return cut[new], np.add.reduceat(counts[order], new) if len(new) else counts


def whole(u: np.ndarray, k: int) -> np.ndarray:
    """Strings with k bytes of context as 8-byte strings."""
    return u >> np.uint64(8) << np.uint64(8 * (8 - k)) | u & np.uint64(255)


def first_counts(texts: DataFrame) -> DataFrame:
    """Word counts (kind 0), symbols and texts seen (kind 1), and strings of HEAD - 1 bytes of context (kind 2)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, short, total, docs = Tally(), Tally(), 0, 0
        for batch in batches:
            for run in spans.runs(batch.column(0), RUN):
                s = symbols(run, True)
                words.add(*counted(s.hash))
                total += len(s.data)
                docs += run.docs
                # The symbol and HEAD - 1 predecessors fit in 32 bits, which sort faster.
                x = (strings(s) >> np.uint64(8 * (8 - HEAD))).astype(np.uint32)
                x, n = counted(x)
                x = x.astype(np.uint64)
                at = np.uint64(8 * (HEAD - 1))
                short.add((x << np.uint64(8)) & np.uint64((1 << 8 * HEAD) - 1) | (x >> at), n)
                if words.size + len(words.keys) > HELD:
                    yield _batch(0, 0, *words.merge())
                    words = Tally()
        yield _batch(0, 0, *words.merge())
        yield _batch(1, 0, np.array([0, 1], np.uint64), np.array([total, docs]))
        yield _batch(2, HEAD - 1, *short.merge())

    return texts.mapInArrow(gather, _COUNTS)


def packed(x: np.ndarray) -> bytes:
    """An array's bytes by place, the highest of all numbers together, compressed."""
    return pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def rounded(p: np.ndarray) -> np.ndarray:
    """float32 with 16 bits of mantissa, an error of 8e-6 of the value at most; the last byte, always 0, packs to nothing."""
    return ((p.astype(np.float32).view(np.uint32) + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


def unpacked(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(blob, n * size, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by part of the tree, and the parts' bounds in it."""
    part = (spans.mix(keys >> np.uint64(8 * (8 - HEAD))) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


_PACKED = "part int, grp int, n int, keys binary, counts binary"


def _sent(keys: np.ndarray, counts: np.ndarray | None, parts: int, group: int) -> pa.RecordBatch:
    order, ends = dealt(keys, parts)
    keys = keys[order]
    counts = None if counts is None else counts[order]
    some = np.flatnonzero(np.diff(ends))
    rows = [(packed(keys[ends[i] : ends[i + 1]]), b"" if counts is None else packed(counts[ends[i] : ends[i + 1]])) for i in some]
    cols = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), group, np.int32)), pa.array(np.diff(ends)[some].astype(np.int32)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["part", "grp", "n", "keys", "counts"])


def string_counts(texts: DataFrame, parts: int) -> DataFrame:
    """All strings of the texts with their counts, by part of the tree; group -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for run in spans.runs(batch.column(0), RUN):
                tally.add(*counted(context_first(strings(symbols(run)))))
                if tally.size + len(tally.keys) > HELD:
                    yield _sent(*tally.merge(), parts, -1)
                    tally = Tally()
        yield _sent(*tally.merge(), parts, -1)

    return texts.mapInArrow(count, _PACKED)


def asked(text: pa.ChunkedArray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct strings of a group's texts, with their counts in the learnt ones."""
    tally = Tally()
    for run in spans.runs(text, RUN):
        s = symbols(run)
        x, of = context_first(strings(s)), np.repeat(learnt[run.first : run.first + run.docs], np.diff(s.off))
        tally.add(*counted(x[of]))
        other = np.unique(x[~of])
        tally.add(other, np.zeros(len(other), np.int64))
    return tally.merge()


class Places:
    """Places of numbers in an array of distinct ones.

    Each table has a slot for a number's hash; numbers that lost their slot to another
    go to the next table.  A lookup costs less than half of a sort and a binary search.
    """

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, left = keys, [], np.arange(len(keys), dtype=np.int32)
        while len(left):
            table = np.zeros(1 << max(4, int(len(left)).bit_length()), np.int32)
            self.tables.append(table)
            slot = self._slots(keys[left], len(self.tables) - 1)
            table[slot] = left
            left = left[table[slot] != left]

    def _slots(self, x: np.ndarray, k: int) -> np.ndarray:
        bits = len(self.tables[k]).bit_length() - 1
        return (((x ^ (x >> np.uint64(32))) * np.uint64(spans.BASE * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)).view(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The place of each of x, all of which are among the keys."""
        out, left = np.zeros(len(x), np.int32), None
        for k, table in enumerate(self.tables):
            if left is None:
                out = table[self._slots(x, k)]
                left = np.flatnonzero(self.keys[out] != x)
            else:
                mine = x[left]
                at = table[self._slots(mine, k)]
                out[left] = at
                left = left[self.keys[at] != mine]
            if not len(left):
                break
        return out


def _find(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(among, keys), max(0, len(among) - 1))
    return at, among[at] == keys if len(among) else np.zeros(len(keys), bool)


class Part:
    """Retained contexts of a part of the tree, and those shorter than HEAD, by length."""

    def __init__(self, short: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray):
        """short: strings with HEAD - 1 bytes of context, of all texts; keys: the part's strings, sorted, contexts first."""
        self.levels: list[tuple[np.ndarray, ...]] = []
        # Each length is cut from the next longer one, which has fewer strings than all.
        cut = {HEAD - 1: short, DEPTH: (keys, counts)}
        for k in (*range(HEAD - 2, -1, -1), *range(DEPTH - 1, HEAD - 1, -1)):
            u, n = cut[k + 1]
            cut[k] = shortened(whole(u, k + 1), n, k)
        before, p_before = np.zeros(0, np.uint64), np.zeros(0)
        for k in range(DEPTH + 1):
            u, n = cut.pop(k)
            if not len(u):
                break
            ctx = u >> np.uint64(8)
            new = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
            of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(u))))
            below = p_before[_find(before, u >> np.uint64(16) << np.uint64(8) | u & np.uint64(255))[0]] if k else np.full(len(u), 1 / 256)
            kinds, total = np.diff(np.append(new, len(u))), np.add.reduceat(n, new)
            rest = kinds / (total + kinds)
            p = n / (total + kinds)[of] + rest[of] * below
            # Symbols that don't follow the context have `rest` times the suffix's probability.
            gain = np.add.reduceat(p * np.log(p / below), new) + rest * np.maximum(0, 1 - np.add.reduceat(below, new)) * np.log(rest)
            keep = (gain >= DIVERGENCE) & (total * gain >= KEEP) if k else np.ones(len(new), bool)
            self.levels.append((ctx[new][keep], rest[keep], u[keep[of]], p[keep[of]]))
            before, p_before = u, np.where(keep[of], p, below)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each string's symbol after its longest retained context."""
        out = np.full(len(keys), 1 / 256)
        share, at = np.ones(len(keys)), np.arange(len(keys))
        for k in range(len(self.levels) - 1, -1, -1):
            contexts, rest, pairs, p = self.levels[k]
            mine = keys[at]
            ctx = mine >> np.uint64(8 * (8 - k)) if k else np.zeros(len(mine), np.uint64)
            i, known = _find(contexts, ctx)
            here = np.flatnonzero(known)
            j, seen = _find(pairs, ctx[here] << np.uint64(8) | mine[here] & np.uint64(255))
            out[at[here[seen]]] = p[j[seen]] * share[at[here[seen]]]
            # What a context hasn't seen goes by its suffix, with the weight that the context leaves for it.
            rest_at = here[~seen]
            share[at[rest_at]] *= rest[i[rest_at]]
            go = np.ones(len(at), bool)
            go[here[seen]] = False
            at = at[go]
        out[at] *= share[at]
        return np.log10(out)


def answers(packs: DataFrame, short: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """(grp, part, n, keys, p): each pack of a group's strings, and their log10 probabilities in order."""
    held = packs.sparkSession.sparkContext.broadcast(short)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        counts: dict[int, Tally] = {}
        open_: dict[int, list[tuple[int, int, bytes]]] = {}
        for batch in batches:
            for part, group, n, keys, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c:
                    some = (much := unpacked(c, n, np.int64)) > 0
                    counts.setdefault(part, Tally()).add(unpacked(keys, n, np.uint64)[some], much[some])
                if group >= 0:
                    open_.setdefault(part, []).append((group, n, keys))
        for part, packs_ in open_.items():
            tree = Part(held.value, *counts.pop(part, Tally()).merge())
            for group, n, keys in packs_:
                p = packed(rounded(tree.log10(unpacked(keys, n, np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([keys], pa.binary()), pa.array([p], pa.binary())], names=["grp", "part", "n", "keys", "p"])

    return packs.repartition(parts, "part").mapInArrow(answer, "grp int, part int, n int, keys binary, p binary")


def train(texts: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int, int, int, DataFrame, int]:
    """Counts of short strings, symbols, N (tokens), V (distinct tokens), the counts of all words (key, n), and the number of texts."""
    first = base.checkpoint(first_counts(texts).groupBy("kind", "len", "key").agg(F.sum("n").alias("n")))
    seen = {r["key"]: r["n"] for r in first.where("kind = 1").collect()}
    total, docs = seen.get(0) or 0, seen.get(1) or 0
    words = first.where("kind = 0").select("key", "n")
    sums = words.agg(F.sum("n"), F.count("*")).first()
    n_tokens, distinct = (sums[0] or 0) + docs, sums[1] + (docs > 0)
    short = first.where("kind = 2").select("key", "n").toArrow()
    keys = short["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return (keys[order], short["n"].to_numpy()[order]), total, n_tokens, distinct, words, docs


def lm_scores(docs: DataFrame, train_docs: DataFrame | Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    train_docs: the documents to learn from, or a condition that marks them among docs,
    which takes less time.
    """
    spark = docs.sparkSession
    base.arrow(spark)
    own = isinstance(train_docs, Column)
    texts = (docs.where(train_docs) if own else train_docs).select(F.col(text).cast("string").alias("text"))
    short, n_symbols, n_tokens, distinct, words, n_docs = train(texts)
    common = words.where(F.col("n") >= COMMON * n_tokens).toArrow()
    keys = common["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    held = spark.sparkContext.broadcast((keys[order], common["n"].to_numpy()[order]))
    below = float(n_tokens + 0.1 * (distinct + 1))
    end = float(np.log10((n_docs + 0.1) / below))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_symbols // GROUP + 1)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.lit(9), text).alias("same"), F.col(text).cast("string").alias("text"), (F.coalesce(train_docs, F.lit(False)) if own else F.lit(False)).alias("learnt"))
    grouped = rows.withColumn("grp", F.pmod(F.xxhash64(F.lit(10), "key", "same"), F.lit(parts)).cast("int")).repartition(parts, "grp")

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        strings_, n = asked(group["text"], group["learnt"].to_numpy())
        return pa.Table.from_batches([_sent(strings_, n if own else None, parts, key[0].as_py())])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        base.tidy()
        keys, counts = held.value
        texts = left["text"]
        packs_ = list(zip(*(right[c].to_pylist() for c in ("part", "n", "keys", "p")), strict=True))
        distinct_ = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpacked(k, n, np.uint64) for _, n, k, _ in packs_)]))
        order, ends = dealt(distinct_, parts)
        log = np.zeros(len(distinct_), np.float32)
        for part, n, _, p in packs_:
            log[order[ends[part] : ends[part + 1]]] = unpacked(p, n, np.float32)
        out, places = [], Places(distinct_)
        for run in spans.runs(texts, SCORED):
            s = symbols(run, True)
            score = np.add.reduceat(log[places.of(context_first(strings(s)))].astype(np.float64), s.off[:-1])
            codes, uniq, _ = spans.factorize(s.hash)
            at = np.minimum(np.searchsorted(keys, uniq), max(0, len(keys) - 1))
            hit = keys[at] == uniq if len(keys) else np.zeros(len(uniq), bool)
            value = np.where(hit, np.log10((counts[at] if len(keys) else 0) + np.where(hit, 0.1, 1.0)) - np.log10(below), 0.0)
            n = np.bincount(s.doc, minlength=run.docs)
            base_ = np.bincount(s.doc, weights=value[codes], minlength=run.docs) + end
            known = np.bincount(s.doc, weights=hit[codes], minlength=run.docs).astype(np.int64) + (n_docs > 0)
            rare = np.flatnonzero(~hit[codes])
            ends_ = np.append(0, np.cumsum(np.bincount(s.doc[rare], minlength=run.docs))).astype(np.int32)
            part_ = left.slice(run.first, run.docs)
            cols = [part_["key"], part_["same"], pa.array(n + 1), pa.array(known), pa.array(base_), pa.array(score), pa.ListArray.from_arrays(pa.array(ends_), pa.array(s.hash[rare].view(np.int64)))]
            out.append(pa.table(cols, names=["key", "same", "n_tokens", "n_known", "base_score", "score", "rare"]))
        return pa.concat_tables(out) if out else pa.table([left["key"], left["same"], *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())))], names=["key", "same", "n_tokens", "n_known", "base_score", "score", "rare"])

    packs = grouped.groupBy("grp").applyInArrow(ask, _PACKED)
    packs = packs if own else string_counts(texts, parts).unionByName(packs)
    replies = answers(packs, short, parts)
    scored = base.checkpoint(
        grouped.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(apply, f"key {dict(rows.dtypes)['key']}, same long, n_tokens long, n_known long, base_score double, score double, rare array<long>")
    )
    # Rare words, each once for each text, with the counts of all words.
    uses = scored.where(F.size("rare") > 0).dropDuplicates(["same"]).select("same", F.explode("rare").alias("word"))
    found = uses.join(words.where(F.col("n") < COMMON * n_tokens).withColumnRenamed("key", "word"), "word", "left")
    value = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)) - F.lit(float(np.log10(below)))
    extra = found.groupBy("same").agg(F.sum(value).alias("more"), F.sum((F.coalesce("n", F.lit(0)) > 0).cast("long")).alias("more_known"))
    out = scored.drop("rare").join(extra, "same", "left")
    return out.select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
