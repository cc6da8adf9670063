"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the weighted set of its five-word shingles (weight: occurrences; a text of
one to four words is one shingle).  Similarity is the probability Jaccard index of two
such sets, which equals the Jaccard index where no shingle repeats.

Signatures.  Each shingle is a Poisson process whose rate is its weight; its i-th
arrival meets a register of its own, as a shingle visits the registers in an order
drawn from its hash, and a register keeps the shingle that arrives first.  A shingle
stops as soon as its next arrival comes after the text's latest register (early
termination), so that a text of n shingles takes about n + REGISTERS ln REGISTERS
arrivals rather than n * REGISTERS.

Candidates.  BANDS bands of ROWS registers each; two texts at similarity 0.8 share no
band with probability (1 - 0.8**6)**42 = 3e-6.  Equal word sequences become one node first.

Verification without all pairs.  In each band's bucket every node is compared with the
bucket's star, the node with most exact copies.  Likely links (by sketches of one byte
a register) make clusters; buckets that still hold several clusters are compared in
blocks, where likely pairs just join clusters.  Likely links are then verified from the
texts and make classes; in clusters that still hold several classes, members outside
the largest class are compared with all, again in blocks, exactly, until joined.  A
block gives fewer pairs than it has rows, and no link is lost between texts that meet in
a band.

Wide buckets.  Blocks of a bucket in which r nodes lie outside the largest cluster make
rows in proportion to its nodes times r / HOME.  Where r is over WIDE, as when unlike
documents meet by one common passage, dealing each node into TABLES narrower buckets
costs less: one for each of TABLES sets of NARROW further registers of the sketch.  Two
sketches of similarity 0.8 miss all of them with probability 4e-6; of similarity 0.3 they
meet in any with probability 0.001.  Buckets that are still wide are dealt again, by
other registers, LEVELS times at most; blocks then take whatever remains, of any size.

A link is an exact similarity of at least 0.8, from the texts.  Sketches rule out
pairs only below 0.7, four standard deviations away.

Definitions: null and wordless texts stand alone.  Repeated rows are in one class.
Null keys may be members; a class is named by its smallest non-null key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, spans
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 256
ROWS, BANDS = 6, 42
PLAUSIBLE = 0.7
HOME, BYTES = 128, 4 << 20
NARROW, TABLES, LEVELS = 10, 192, 3
#: Guests of a bucket from which narrower buckets make fewer rows than blocks do.
WIDE = HOME * TABLES // 2
#: Rows up to which a table of (long, long) is sent to every executor: 32 MB.
SMALL = 2_000_000


def shingles(run: spans.Run, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and weight of each distinct shingle in order of (document, hash), the words'
    hashes, and the first word of each document (one more)."""
    mapped = spans.ALNUM[run.data]
    starts, ends = spans.words(mapped, run.off)
    h = spans.hashes(mapped, starts, ends)
    first = np.searchsorted(starts, run.off)
    n = np.diff(first)
    doc = np.repeat(np.arange(run.docs), n)
    grams = spans.kgrams(h, size)
    at = np.flatnonzero(np.arange(len(grams)) + size <= first[doc[: len(grams)] + 1])
    docs, values = [doc[at]], [grams[at]]
    for k in range(1, size):
        if (short := np.flatnonzero(n == k)).size:
            docs.append(short)
            values.append(spans.kgrams(h, k)[first[short]] ^ np.uint64(k))
    d, g = np.concatenate(docs), np.concatenate(values)
    # A document's number stands in the upper bits, so that one sort groups by document.
    shift = max(1, int(run.docs).bit_length())
    packed = np.sort((d.astype(np.uint64) << np.uint64(64 - shift)) | (g >> np.uint64(shift)))
    new = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, np.int64)
    weight = np.diff(np.append(new, len(packed)))
    packed = packed[new]
    return (packed >> np.uint64(64 - shift)).astype(np.int64), packed & np.uint64((1 << 64 - shift) - 1), weight, h, first


def shingle_sets(run: spans.Run) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and weights of each document, of 40 bits or more, alike whatever the run."""
    d, g, w, _, _ = _plain(run)
    ends = np.searchsorted(d, np.arange(run.docs + 1))
    return [(g[a:b], w[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


#: Documents of a run are numbered in so many bits at most, so that hashes are cut alike everywhere.
RUN_BITS = 14


def _plain(run: spans.Run):
    d, g, w, h, first = shingles(spans.Run(run.first, run.data, run.off))
    shift = max(1, int(run.docs).bit_length())
    return d, g >> np.uint64(RUN_BITS - shift), w, h, first


def runs(texts: pa.Array) -> Iterator[spans.Run]:
    """Runs of fewer than 2**RUN_BITS documents."""
    most = (1 << RUN_BITS) - 1
    for run in spans.runs(texts):
        for i in range(0, run.docs, most):
            off = run.off[i : i + most + 1]
            yield spans.Run(run.first + i, run.data[off[0] : off[-1]], off - off[0])


def registers(d: np.ndarray, g: np.ndarray, w: np.ndarray, docs: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle that each register of each document keeps."""
    seed = spans.mix(g + np.uint64(0x632BE59BD9B4E019))
    step = (seed >> np.uint64(40)).astype(np.int64) | 1
    offset = (seed >> np.uint64(20)).astype(np.int64)
    when = np.full(docs * m, np.inf)
    kept = np.zeros(docs * m, np.uint64)
    time = np.zeros(len(g))
    on = np.arange(len(g))
    for i in range(m):
        u = (spans.mix(g[on] ^ np.uint64(((i + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64)
        time[on] -= np.log((u + 0.5) * 2.0**-53) / (w[on] * (m - i))
        latest = when.reshape(docs, m).max(axis=1) if i else np.full(docs, np.inf)
        on = on[time[on] < latest[d[on]]]
        if not len(on):
            break
        slot = d[on] * m + ((step[on] * i + offset[on]) & (m - 1))
        np.minimum.at(when, slot, time[on])
        won = when[slot] == time[on]
        kept[slot[won]] = g[on[won]]
    return kept.reshape(docs, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact index: sum over common i of 1 / sum over j of max(x_j/x_i, y_j/y_i)."""
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, both = x[order], y[order], both[order]
    upto, beyond = np.cumsum(x), y.sum() - np.cumsum(y)
    i = np.flatnonzero(both)
    return float((1 / (upto[i] / x[i] + np.maximum(beyond[i], 0) / y[i])).sum())


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, rid (a hash of the row), node (a hash of the word sequence; null without words), n_bytes, bands, sketch."""
    base.arrow(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("rid"), F.col(text).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        for batch in batches:
            for run in runs(batch.column(2)):
                d, g, w, h, first = _plain(run)
                n = np.diff(first)
                place = np.arange(len(h)) - np.repeat(first[:-1], n)
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(spans.mix(h + spans.mix(place.astype(np.uint64))), out=total[1:])
                node = spans.mix((total[first[1:]] - total[first[:-1]]) ^ n.astype(np.uint64)).view(np.int64)
                kept = registers(d, g, w, run.docs)
                bands = np.stack([spans.mix(_chain(kept[:, i * ROWS : (i + 1) * ROWS]) ^ np.uint64(i + 1)) for i in range(BANDS)], axis=1).view(np.int64)
                none = n == 0
                part = batch.slice(run.first, run.docs)
                ends = np.append(0, np.cumsum(np.where(none, 0, BANDS))).astype(np.int32)
                sketch = (kept & np.uint64(255)).astype(np.uint8)
                cols = [part.column(0), part.column(1), pa.array(node, mask=none), pa.array(np.diff(run.off)), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[~none].ravel())), pa.array([None if x else s.tobytes() for s, x in zip(sketch, none, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "rid", "node", "n_bytes", "bands", "sketch"])
            base.trim()

    return rows.mapInArrow(sign, f"key {dict(rows.dtypes)['key']}, rid long, node long, n_bytes long, bands array<long>, sketch binary")


def _chain(cols: np.ndarray) -> np.ndarray:
    out = cols[:, 0].copy()
    for j in range(1, cols.shape[1]):
        out = spans.mix(out * np.uint64(spans.BASE) + cols[:, j])
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), REGISTERS)


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches allow a link."""
    one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    two = one.join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = agreement(_matrix(x.column("sa")), _matrix(x.column("sb"))) >= PLAUSIBLE
            yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(ok)), x.column("b").filter(pa.array(ok))], names=["a", "b"])

    return two.mapInArrow(near, "a long, b long")


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, text) of the wanted nodes; the table is read once, and only wanted texts move."""
    wanted = base.checkpoint(wanted.join(nodes.select("node", "rid"), "node"))
    small = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    return docs.select(F.xxhash64(key, text).alias("rid"), F.col(text).cast("string").alias("text")).join(small, "rid").select("node", "text").dropDuplicates(["node"])


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b) whose texts have at least the similarity asked for."""
    texts = base.checkpoint(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, key, text))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [[s for run in runs(x.column(c)) for s in shingle_sets(run)] for c in ("ta", "tb")]
            ok = pa.array([probability_jaccard(p, q) >= SIMILARITY for p, q in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(ok), x.column("b").filter(ok)], names=["a", "b"])

    return base.checkpoint(both.mapInArrow(check, "a long, b long"))


def mixed(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """Groups with several kinds: the commonest kind, how many rows are of others, and the numbers of blocks."""
    sizes = rows.groupBy(group, kind).agg(F.count("*").alias("c"), F.sum("n_bytes").alias("b"))
    top = sizes.groupBy(group).agg(F.max(F.struct("c", F.col(kind).alias("k"), "b")).alias("m"), F.sum("c").alias("n"), F.sum("b").alias("b"), F.count("*").alias("kinds"))
    many = lambda n, b: F.ceil(n / F.lit(HOME) + b / F.lit(BYTES)).cast("int")
    guests = F.col("n") - F.col("m.c")
    return base.checkpoint(top.where("kinds > 1").select(group, F.col("m.k").alias("major"), guests.alias("guests"), many(F.col("n"), F.col("b")).alias("ki"), many(guests, F.col("b") - F.col("m.b")).alias("kj")))


def narrowed(rows: DataFrame, wide: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Rows (node, n_bytes, bucket, cluster), those of wide buckets dealt into TABLES narrower ones each."""
    names = ["node", "n_bytes", "bucket", "cluster"]
    at = np.stack([np.random.default_rng([level, t]).choice(REGISTERS, NARROW, replace=False) for t in range(TABLES)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                sketch = _matrix(b.column("sketch")).astype(np.uint64)
                old = np.asarray(b.column("bucket"), np.int64).view(np.uint64)
                for t, places in enumerate(at):
                    new = spans.mix(_chain(sketch[:, places]) ^ spans.mix(old + np.uint64(t + 1))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n_bytes"), pa.array(new), b.column("cluster")], names=names)

    told = rows.join(wide.withColumn("wide", F.lit(True)), "bucket", "left")
    dealt = told.where("wide").join(nodes.select("node", "sketch"), "node").select(*names, "sketch")
    return told.where("wide is null").select(*names).union(dealt.mapInArrow(deal, "node long, n_bytes long, bucket long, cluster long"))


def blocks(rows: DataFrame, top: DataFrame, group: str, kind: str) -> DataFrame:
    """Rows (node, `group`, `kind`, n_bytes) of groups with several kinds (top: mixed()), dealt into blocks (group, i, j).

    A row of any kind is at home in one block i of its group; rows that aren't of the
    group's commonest kind are guests as well, in one block j each, and blocks i and j
    meet once.  So a group of n rows with r guests makes about n * r / HOME + r * n / HOME
    rows and no more than HOME rows, or BYTES of text, of either side come together.
    """
    member = rows.join(top, group)
    i, j = F.pmod(F.xxhash64("node"), "ki").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "kj").cast("int")
    home = member.select(*rows.columns, i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("kj") - 1)).alias("j"), F.lit(True).alias("home"))
    guest = member.where(F.col(kind) != F.col("major")).select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("ki") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("home"))
    return home.union(guest)


class Forest:
    """Which kinds of a block are already joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def similarities(guests: list, homes: list):
    """A function of (guest, home) for the exact similarity; overlaps of a block are counted in one product."""
    keys, place = np.unique(np.concatenate([s[0] for s in guests + homes]), return_inverse=True)
    plain = [bool((s[1] == 1).all()) for s in guests + homes]
    n, size = len(guests) + len(homes), [len(s[0]) for s in guests + homes]
    common = None
    if n * len(keys) <= 1 << 26:
        x = np.zeros((n, len(keys)), np.float32)
        x[np.repeat(np.arange(n), size), place] = 1
        common = x[: len(guests)] @ x[len(guests) :].T

    def of(g: int, h: int) -> float:
        k = len(guests) + h
        if common is not None and plain[g] and plain[k]:
            return float(common[g, h]) / (size[g] + size[k] - float(common[g, h]))
        return probability_jaccard(guests[g], homes[h])

    return of


def joined(rows: DataFrame, group: str, kind: str, exact: bool) -> DataFrame:
    """Pairs (a, b) of nodes of different kinds that connect the kinds of each block that have a link.

    rows: blocks() with sketch, and text if `exact`.  Without `exact` likely links count.
    Likely pairs are tried from the likeliest, and a pair whose kinds are joined by then
    is passed over: a block gives fewer pairs than it has rows.
    """
    names = [group, "i", "j", "node", kind, "home", "sketch"] + ["text"] * exact

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def flush() -> pa.RecordBatch:
            guests, homes = [h for h in held if not h[2]], [h for h in held if h[2]]
            a, b = [], []
            if guests and homes:
                sk = [np.frombuffer(b"".join(h[3] for h in side), np.uint8).reshape(len(side), REGISTERS) for side in (guests, homes)]
                like = np.stack([agreement(sk[1], g) for g in sk[0]])
                like[np.array([g[1] for g in guests])[:, None] == np.array([h[1] for h in homes])[None]] = 0
                x, y = np.nonzero(like >= PLAUSIBLE)
                if len(x) and exact:
                    sets = [[s for run in runs(pa.array([h[4] for h in side], pa.large_string())) for s in shingle_sets(run)] for side in (guests, homes)]
                    of = similarities(*sets)
                forest = Forest()
                for k in np.argsort(-like[x, y], kind="stable").tolist():
                    g, h = guests[x[k]], homes[y[k]]
                    if forest.find(g[1]) != forest.find(h[1]) and (not exact or of(x[k], y[k]) >= SIMILARITY):
                        forest.join(g[1], h[1])
                        a.append(g[0])
                        b.append(h[0])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for *place, node, cls, home, sketch, text in zip(*(batch.column(c).to_pylist() for c in names), *([[None] * len(batch)] if not exact else []), strict=True):
                if place != at and held:
                    yield flush()
                    held = []
                at = place
                held.append((node, cls, home, sketch, text))
        if held:
            yield flush()

    return rows.select(*names).repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "node").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: key, rid (a hash of the row), class_id (the smallest key of its class), class_size, and
    kept: whether it is the one row that stands for its class (copies of that very row carry it too)."""
    signed = base.checkpoint(signatures(docs, key, text))
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # Partitions are merged to as many as the rows need, which keeps files few where shuffles are dealt finely.
    parts = max(8, signed.count() // 20_000)
    nodes = base.checkpoint(nodes.coalesce(parts))
    buckets = nodes.select("node", "copies", "n_bytes", F.explode("bands").alias("bucket"))
    star = buckets.groupBy("bucket").agg(F.max(F.struct("copies", "node"))["node"].alias("star"), F.count("*").alias("n")).where("n > 1").select("bucket", "star")
    shared = base.checkpoint(buckets.drop("copies").join(star.coalesce(parts), "bucket").coalesce(parts))
    pairs = shared.where("node <> star").select(F.col("node").alias("a"), F.col("star").alias("b")).distinct().coalesce(parts)
    likely = base.checkpoint(plausible(pairs, nodes).coalesce(parts))
    named = lambda classes: F.coalesce(classes["class"], F.col("node"))
    # Clusters: what likely links connect, within and across the stars of all buckets.
    clusters = components(likely)
    rows = shared.join(clusters, "node", "left").select("node", "n_bytes", "bucket", named(clusters).alias("cluster"))
    top = mixed(rows, "bucket", "cluster")
    for level in range(LEVELS):
        wide = top.where(F.col("guests") > WIDE).select("bucket")
        if wide.isEmpty():
            break
        rows = base.checkpoint(narrowed(rows, wide, nodes, level))
        top = mixed(rows, "bucket", "cluster")
    met = base.checkpoint(joined(blocks(rows, top, "bucket", "cluster").join(nodes.select("node", "sketch"), "node"), "bucket", "cluster", False))
    if not met.isEmpty():
        clusters = components(likely.union(met))
    # Classes: what verified links connect; all likely pairs lie within a cluster.
    links = verified(likely.union(met).distinct(), nodes, docs, key, text)
    classes = components(links)
    rows = clusters.withColumnRenamed("class", "cluster").join(classes, "node", "left").join(nodes.select("node", "n_bytes"), "node")
    rows = rows.select("node", "n_bytes", "cluster", named(classes).alias("kind"))
    dealt = base.checkpoint(blocks(rows, mixed(rows, "cluster", "kind"), "cluster", "kind"))
    if not dealt.isEmpty():
        texts = base.checkpoint(texts_of(dealt.select("node").distinct(), nodes, docs, key, text))
        more = base.checkpoint(joined(dealt.join(nodes.select("node", "sketch"), "node").join(texts, "node"), "cluster", "kind", True))
        classes = components(links.union(more))
    # A row without words is a class of its own.
    member = signed.where("node is not null").join(classes, "node", "left").select("key", "rid", F.coalesce("class", "node").alias("class"))
    first = F.min(F.struct(F.col("key").isNull().alias("no"), F.col("key").alias("key"), F.col("rid").alias("rid")))
    named = member.groupBy("class").agg(first.alias("f"), F.count("*").alias("class_size"))
    out = member.join(named, "class").select("key", "rid", F.col("f.key").alias("class_id"), "class_size", (F.col("f.rid") == F.col("rid")).alias("kept"))
    alone = signed.where("node is null").select("key", "rid", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone).withColumnRenamed("key", key)
