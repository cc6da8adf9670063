"""Jaccard similarity join of word n-grams by token-combination prefixes.

A document is the set of its distinct five-word shingles, as 50-bit hashes (tokens).  Two
documents link at a Jaccard index of at least 0.8; documents that links connect are one
component.  Equal sets become one node first.

Windows.  A set of n tokens that links with another lacks at most d = n // 5 of them.
Tokens are ordered by their hash, and the first L = d + 1 + e(5n / 4) of a set are its
window (e: spare(), about n / 16; sizes of linked sets differ by a quarter at most).
Whichever of two linked windows ends first in that order has at least 1 + e tokens in
common with the other window, for e of both sizes.  So only a third of all tokens ever
move, and frequencies are counted within windows.

Prefixes.  A window's tokens are ordered from rare to frequent, and a prefix is taken.
Plainly, D + 1 tokens are enough, as at most D = L - 1 - e(n) of a window are not in
common.  Tokens fall into classes: each rare one (in up to RARE windows) is a class of its
own and is indexed singly (k = 1); frequent ones are dealt by hash into subclasses, in
which pairs are indexed (k = 2).  A subclass with c tokens in the prefix needs c - k + 1
losses to lose all its combinations, so the prefix is extended until the sum of
max(0, c - k + 1) is over D; there are at most e(n) subclasses, so that every
window has such a prefix.  Linked sets then share a combination (the one whose
prefix ends first has k common tokens of one class in it, and the other's prefix holds
them too).  The number of subclasses follows the size's power of two, so that
combinations stay in proportion to a set's size; a set whose partners may have a
smaller power is indexed with that number too.  Tokens of one window only are counted and
never moved again: most sets have more than D of those, and no combination at all.

Verification without all pairs.  Each bucket (a combination's sets) has a star, the set with
most copies.  Every set is first compared with its best star, then the ones outside its
component with all stars of their buckets.  What buckets still hold several components is compared
in blocks, members outside the largest component with all, until joined, either bucket by
bucket or in a cluster of buckets at once, where that makes fewer blocks.  All comparisons are exact, on whole sets, and a set is sent once to its star's
group.  Buckets with the same members are one.

Wide clusters.  Texts that have one passage in common, and little else, make clusters that grow
with the table, and their blocks with its square.  A cluster of more than one block is
therefore indexed anew by whole sets: its tokens are counted within it and ordered from
rare to frequent, and a set is indexed by each of its first d + 1 that another has too.
The first token that two linked sets have in common is among these of both, as either set
lacks at most d of its own.  A set with more than d tokens of its own in its cluster
links with none of it and is sent nowhere.

Tokens in so many windows that they would weigh on one task (at least a hundred-thousandth
of all window tokens, so at most that many of them) are found first; they are
known to be frequent and are never dealt by token.

Definitions: null and wordless texts have no shingles and stand alone; texts of fewer than
five words are one shingle.  Repeated rows are in one component.  A component is named by
its smallest non-null key (null where it has none).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, near_dedup, spans
from .components import components
from .near_dedup import HOME, Forest, blocks, mixed, runs

SHINGLE = 5
#: Links have 100 * common >= PERCENT * union.
PERCENT = 80
RARE = 64
#: Bits by which hashes are cut, so that a run's documents can be numbered in front of them.
CUT = 14
#: What is taken for the frequency of tokens that are found to be very frequent beforehand.
CAP = (1 << 31) - 1
#: A token is told apart beforehand from this count on, if it makes the share of all, too.
HOT, SHARE = 64, 100_000
#: Nodes that a task remembers in order to send equal sets once.
SEEN = 1 << 20


def linked(common: np.ndarray, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    return (common > 0) & (100 * common >= PERCENT * (n + m - common))


def losses(n: np.ndarray) -> np.ndarray:
    """Most tokens of a set of n that a linked one lacks."""
    return n - -(-n * PERCENT // 100)


def spare(n: np.ndarray) -> np.ndarray:
    """e(n): never falls, and leaves room for losses(n) + 1 + e(5n / 4) <= n."""
    return np.maximum(0, np.minimum(16 + n // 16, n // 2 - 2))


def window(n: np.ndarray) -> np.ndarray:
    """L(n)."""
    return losses(n) + 1 + spare(-(-n * 100 // PERCENT))


def bands(n: int) -> list[int]:
    """Numbers of subclasses with which a set of n tokens is indexed: of its own power of two, and of its smallest partner's."""
    return sorted({int(spare(np.int64(1 << m.bit_length() - 1))) for m in (n, -(-n * PERCENT // 100))})


def token_sets(run: spans.Run, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a run's documents in order, document by document, and len+1 offsets."""
    mapped = spans.NONSPACE[run.data]
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
            values.append(spans.mix(spans.kgrams(h, k)[first[short]] + np.uint64(k)))
    d, g = np.concatenate(docs).astype(np.uint64), np.concatenate(values)
    packed = np.sort((d << np.uint64(64 - CUT)) | (g >> np.uint64(CUT)))
    packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
    off = np.searchsorted(packed >> np.uint64(64 - CUT), np.arange(run.docs + 1, dtype=np.uint64))
    return packed & np.uint64((1 << 64 - CUT) - 1), off


def node_of(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(spans.mix(tokens + np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return spans.mix((total[off[1:]] - total[off[:-1]]) ^ np.diff(off).astype(np.uint64)).view(np.int64)


def windows_of(tokens: np.ndarray, off: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the window tokens of the given documents, and their documents' places in docs."""
    n = np.diff(off)[docs]
    size = window(n)
    upto = np.cumsum(size)
    who = np.repeat(np.arange(len(docs)), size)
    return off[docs][who] + np.arange(upto[-1] if len(upto) else 0) - (upto - size)[who], who


def signed_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, rid (a hash of the row), node (null without shingles), n, and on one row of each run the tokens
    that are often in its windows, with their counts."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("rid"), F.col(text).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        for batch in batches:
            for run in runs(batch.column(2)):
                tokens, off = token_sets(run)
                n = np.diff(off)
                at, _ = windows_of(tokens, off, np.flatnonzero(n))
                often, times = np.unique(tokens[at], return_counts=True)
                often, times = often[times > 3], times[times > 3]
                ends = np.full(run.docs + 1, len(often), np.int32)
                ends[0] = 0
                part = batch.slice(run.first, run.docs)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64))) for x in (often, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node_of(tokens, off), mask=n == 0), pa.array(n), *lists], names=["key", "rid", "node", "n", "often", "times"])
            base.trim()

    return rows.mapInArrow(sign, f"key {dict(rows.dtypes)['key']}, rid long, node long, n long, often array<long>, times array<long>")


def hot_tokens(signed: DataFrame) -> np.ndarray:
    """Sorted tokens that make a SHARE-th of all window tokens, so no more than SHARE of them."""
    spare_of = lambda n: F.greatest(F.lit(0), F.least(16 + F.floor(n / 16), F.floor(n / 2) - 2))
    size = F.floor(F.col("n") / 5) + 1 + spare_of(F.ceil(F.col("n") * 5 / 4))
    total = signed.where("n > 0").agg(F.sum(size)).first()[0] or 0
    each = signed.where("size(often) > 0").select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy("x.often").agg(F.sum("x.times").alias("c"))
    found = each.where(F.col("c") >= max(HOT, total // SHARE)).select("often").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def window_rows(docs: DataFrame, text: str, hot: np.ndarray) -> DataFrame:
    """(token, node, n): window tokens of sets of four or more tokens (smaller ones link with equal ones only).

    n is 0 for a token to be counted, -1 - token for a hot one, and the set's size in one further row a set.
    Rows are to be dealt by `token`, which is a negative hash of the node where nothing is to be counted.
    """
    schema = "token long, node long, n long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        seen: set[int] = set()
        for batch in batches:
            for run in runs(batch.column(0)):
                tokens, off = token_sets(run)
                node, n = node_of(tokens, off), np.diff(off)
                _, first = np.unique(node, return_index=True)
                fresh = np.array([i for i in first[n[first] > 3].tolist() if int(node[i]) not in seen], np.int64)
                if len(seen) < SEEN:
                    seen.update(node[fresh].tolist())
                at, who = windows_of(tokens, off, fresh)
                t, owner = tokens[at], node[fresh][who]
                place = np.minimum(np.searchsorted(hot, t), max(0, len(hot) - 1))
                very = hot[place] == t if len(hot) else np.zeros(len(t), bool)
                heads, t = node[fresh], t.view(np.int64)
                uncounted = lambda nodes: nodes | np.int64(-1 << 63)
                cols = [np.concatenate([np.where(very, uncounted(owner), t), uncounted(heads)]), np.concatenate([owner, heads]), np.concatenate([np.where(very, -1 - t, 0), n[fresh]])]
                for i in range(0, len(cols[0]), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 17)]) for c in cols], names=["token", "node", "n"])
            base.trim()

    return docs.select(F.col(text).cast("string")).mapInArrow(emit, schema)


def combos(n: int, tokens: np.ndarray, counts: np.ndarray, singles: int) -> np.ndarray:
    """Hashes of the combinations that a set of n is indexed by; tokens: those of its window that other
    windows have too, from rare to frequent; singles: how many of the window nobody has."""
    size = int(window(np.int64(n)))
    most = size - 1 - int(spare(np.int64(n)))
    if singles > most:
        return np.zeros(0, np.uint64)
    rare = counts <= RARE
    out = []
    for b in bands(n):
        group = np.where(rare, -1, (spans.mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(max(1, b))).astype(np.int64)) if b else np.full(len(tokens), -1)
        # A token adds to the sum unless it is the first of its subclass.
        order = np.argsort(group, kind="stable")
        opens = np.zeros(len(tokens), bool)
        opens[order] = np.append(True, group[order][1:] != group[order][:-1])[: len(tokens)]
        adds = (group < 0) | ~opens
        upto = int(np.searchsorted(singles + np.cumsum(adds), most + 1)) + 1
        t, g = tokens[:upto], group[:upto]
        out.append(spans.mix(t[g < 0]))
        for j in np.unique(g[g >= 0]).tolist():
            inside = np.sort(t[g == j])
            if len(inside) > 1:
                x, y = np.array(list(combinations(range(len(inside)), 2))).T
                out.append(spans.mix(spans.mix(inside[x]) * np.uint64(spans.BASE) + inside[y]))
    return np.unique(np.concatenate(out))


def index(counted: DataFrame) -> DataFrame:
    """(bucket, node) of every set with a combination; counted: window_rows with c, the windows that have the token."""
    frequency = F.when(F.col("n") < 0, F.lit(CAP)).otherwise(F.least("c", F.lit(CAP - 1))).cast("long")
    token = F.when(F.col("n") < 0, -1 - F.col("n")).otherwise(F.col("token"))
    rows = counted.select("node", F.col("n").alias("n"), token.alias("token"), frequency.alias("c"))

    def one(n: int, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        new = np.append(True, t[1:] != t[:-1])[: len(t)]
        t, c = t[new].view(np.uint64), c[new]
        return combos(n, t, c, int(window(np.int64(n))) - len(t)).view(np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(cols: np.ndarray) -> Iterator[pa.RecordBatch]:
            """cols: rows of whole nodes; the first of a node is its head."""
            starts = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            buckets, owners = [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), cols.shape[1]], strict=True):
                body = cols[:, a:b][:, cols[1, a:b] <= 0]
                found = one(int(cols[1, a]), body[2], body[3])
                buckets.append(found)
                owners.append(np.full(len(found), cols[0, a]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(owners))], names=["bucket", "node"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(np.stack([np.asarray(c, np.int64) for c in batch.columns]))
            if held[-1][0, -1] == held[0][0, 0]:
                continue
            cols = np.concatenate(held, axis=1)
            last = int(np.searchsorted(cols[0], cols[0, -1]))
            yield from flush(cols[:, :last])
            held = [cols[:, last:]]
        if held:
            yield from flush(np.concatenate(held, axis=1))

    dealt = rows.repartition("node").sortWithinPartitions("node", F.col("n") <= 0, "c", "token")
    return dealt.mapInArrow(emit, "bucket long, node long")


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, n, tokens) of the wanted nodes; the table is read once more, and only wanted texts move."""
    wanted = base.checkpoint(wanted.join(nodes.select("node", "rid"), "node"))
    small = F.broadcast(wanted) if wanted.count() <= 1_000_000 else wanted
    rows = docs.select(F.xxhash64(key, text).alias("rid"), F.col(text).cast("string").alias("text")).join(small, "rid").select("node", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        for batch in batches:
            for run in runs(batch.column(1)):
                tokens, off = token_sets(run)
                packed = [tokens[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.docs), pa.array(np.diff(off)), pa.array(packed, pa.binary())], names=["node", "n", "tokens"])
            base.trim()

    return base.checkpoint(rows.mapInArrow(build, "node long, n long, tokens binary").dropDuplicates(["node"]))


def common(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Tokens that each of `many` has in common with `one`."""
    size = np.array([len(m) for m in many])
    if not len(one) or not size.all():
        return np.array([len(np.intersect1d(one, m)) for m in many])
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.append(0, np.cumsum(size)[:-1]))


def starred(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, star) that link.  A set goes once to its star's group, which is dealt into parts of about HOME."""
    sizes = pairs.groupBy("star").agg(F.ceil(F.count("*") / F.lit(HOME)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = pairs.withColumnRenamed("a", "node").join(sizes, "star").select("star", part.alias("part"), "node", F.lit(False).alias("head"))
    heads = sizes.select("star", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("star").alias("node"), F.lit(True).alias("head"))
    rows = members.union(heads).join(sets, "node").select("star", "part", "head", "node", "tokens")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, top = None, None
        for b in batches:
            stars, parts, heads, names = (b.column(c).to_pylist() for c in ("star", "part", "head", "node"))
            a, s = [], []
            for i, (star, place, head, node) in enumerate(zip(stars, parts, heads, names, strict=True)):
                mine = np.frombuffer(b.column("tokens")[i].as_buffer(), np.uint64)
                if head:
                    at, top = (star, place), mine.copy()
                elif at == (star, place) and bool(linked(common(top, [mine]), len(top), len(mine))[0]):
                    a.append(node)
                    s.append(star)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64())], names=["a", "b"])

    return rows.repartition("star", "part").sortWithinPartitions("star", "part", F.col("head").desc()).mapInArrow(check, "a long, b long")


def narrowed(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (node, n_bytes, bucket, kind, star) by which sets of wide clusters meet: their first tokens, by whole sets.

    members: (node, n_bytes, kind, cluster), a node in one cluster.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = [np.frombuffer(t, np.int64) for t in b.column("tokens").to_pylist()]
            for i in range(0, len(many), 256):
                size = [len(t) for t in many[i : i + 256]]
                owner = [np.repeat(np.asarray(b.column(c), np.int64)[i : i + 256], size) for c in ("cluster", "node")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, owner), pa.array(np.concatenate(many[i : i + 256]))], names=["cluster", "node", "token"])

    tokens = members.select("cluster", "node").join(sets, "node").select("cluster", "node", "tokens").mapInArrow(emit, "cluster long, node long, token long")
    both = tokens.withColumn("c", F.count("*").over(Window.partitionBy("cluster", "token"))).where("c > 1")
    mine = Window.partitionBy("node")
    placed = both.withColumns({"others": F.count("*").over(mine), "place": F.row_number().over(mine.orderBy("c", "token"))})
    n = (F.col("n_bytes") / 8).cast("long")
    first = placed.join(members.drop("cluster"), "node").where(F.col("place") <= F.floor(n * (100 - PERCENT) / 100) + 1 - n + F.col("others"))
    rows = base.checkpoint(first.select("node", "n_bytes", F.xxhash64("cluster", "token").alias("bucket"), "kind"))
    star = rows.groupBy("bucket").agg(F.max("node").alias("star"), F.count("*").alias("m")).where("m > 1").drop("m")
    return rows.join(star, "bucket").select("node", "n_bytes", "bucket", "kind", "star")


def apart(rows: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Blocks of groups of several kinds, in which every two sets of a bucket and of different kinds meet that can link.

    rows: (node, n_bytes, bucket, kind, star).  Groups are buckets, or whole clusters of buckets that share
    members, where a cluster makes no more blocks than its buckets: copies of one text meet
    in hundreds of buckets, and unlike texts that pass on from one passage to the next make
    clusters that are large.  With `sets`, clusters of more than one block are narrowed() first.
    """
    cols = ["node", "n_bytes", "bucket", "kind"]
    tops = mixed(rows, "bucket", "kind")
    many = base.checkpoint(rows.join(tops.select("bucket", (F.col("ki") * F.col("kj").cast("long")).alias("cost")), "bucket"))
    joined = components(many.select(F.col("node").alias("a"), F.col("star").alias("b")))
    placed = base.checkpoint(many.join(joined, "node").select(*cols, "cost", F.col("class").alias("cluster")))
    whole = placed.select("node", "n_bytes", "kind", "cluster").distinct()
    wide = mixed(whole, "cluster", "kind")
    if sets is not None:
        large = base.checkpoint(wide.where("ki * kj > 1").select("cluster"))
        if not large.isEmpty():
            again = apart(narrowed(base.checkpoint(whole.join(large, "cluster").select("node", "n_bytes", "kind", "cluster")), sets))
            small = wide.join(large, "cluster", "left_anti")
            return blocks(whole.select(*(F.col(c) for c in cols if c != "bucket"), "cluster"), small, "cluster", "kind").withColumnRenamed("cluster", "bucket").select(*again.columns).union(again)
    cost = placed.select("cluster", "bucket", "cost").distinct().groupBy("cluster").agg(F.sum("cost").alias("cost"))
    better = base.checkpoint(wide.join(cost, "cluster").where(F.col("ki") * F.col("kj").cast("long") <= F.col("cost")).drop("cost"))
    by_cluster = blocks(whole.select(*(F.col(c) for c in cols if c != "bucket"), "cluster"), better, "cluster", "kind")
    alone = placed.join(better.select("cluster"), "cluster", "left_anti").select(*cols)
    by_bucket = blocks(alone, tops, "bucket", "kind")
    names = [*cols, "i", "j", "home"]
    return by_cluster.withColumnRenamed("cluster", "bucket").select(*names).union(by_bucket.select(*names))


def compared(rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect the kinds of each block; rows: blocks() of bucket and kind, with tokens."""
    names = ["bucket", "i", "j", "node", "kind", "home", "tokens"]

    def flush(held: list[tuple]) -> pa.RecordBatch:
        guests, homes = [h for h in held if not h[2]], [h for h in held if h[2]]
        a, b, forest = [], [], Forest()
        if guests and homes:
            many = [h[3] for h in homes]
            m, kinds = np.array([len(x) for x in many]), np.array([h[1] for h in homes])
            for node, kind, _, mine in guests:
                ok = linked(common(mine, many), len(mine), m) & (kinds != kind)
                for k in np.flatnonzero(ok).tolist():
                    if forest.join(kind, int(kinds[k])):
                        a.append(node)
                        b.append(homes[k][0])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for batch in batches:
            for *place, node, kind, home, tokens in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if place != at and held:
                    yield flush(held)
                    held = []
                at = place
                held.append((node, kind, home, np.frombuffer(tokens, np.uint64)))
        if held:
            yield flush(held)

    return rows.select(*names).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(compare, "a long, b long").distinct()


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, component_size: the documents of its component, itself included."""
    base.arrow(docs.sparkSession)
    with base.shuffles_dropped(docs.sparkSession):
        return _components(docs, key, text)


def _components(docs: DataFrame, key: str, text: str) -> DataFrame:
    signed = base.checkpoint(signed_rows(docs, key, text))
    parts = max(8, signed.count() // 20_000)
    nodes = base.checkpoint(signed.where("node is not null").groupBy("node").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.first("n").alias("n"), F.min("key").alias("key")).coalesce(parts))
    dealt = window_rows(docs, text, hot_tokens(signed)).repartition("token")
    counted = dealt.withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("n <> 0 or c > 1")
    keys = base.checkpoint(index(counted).coalesce(parts))
    # Buckets with the same members are one.
    best = F.max(F.struct("copies", "node"))
    sizes = keys.join(nodes.select("node", "copies"), "node").groupBy("bucket").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), best.alias("best"))
    one = sizes.where("m > 1").groupBy("m", "who").agg(F.min("bucket").alias("bucket"), F.min("best").alias("best"))
    shared = base.checkpoint(keys.join(one.select("bucket", "best"), "bucket").coalesce(parts))
    sets = sets_of(shared.select("node").distinct(), nodes, docs, key, text)
    named = lambda classes, name: F.coalesce(classes[name], F.col("node"))
    # First each set with its best star, then the ones still apart with all stars of their buckets.
    pairs = shared.where(F.col("node") != F.col("best.node")).groupBy(F.col("node").alias("a")).agg(F.max("best")["node"].alias("star"))
    links = base.checkpoint(starred(pairs, sets).coalesce(parts))
    classes = components(links)
    star_class = classes.select(F.col("node").alias("star"), F.col("class").alias("other"))
    rest = shared.where(F.col("node") != F.col("best.node")).select("node", F.col("best.node").alias("star")).distinct()
    rest = rest.join(classes, "node", "left").join(star_class, "star", "left")
    rest = rest.where(F.coalesce("class", "node") != F.coalesce("other", "star")).select(F.col("node").alias("a"), "star").join(pairs, ["a", "star"], "left_anti")
    more = base.checkpoint(starred(rest, sets).coalesce(parts))
    if not more.isEmpty():
        links = links.union(more)
        classes = components(links)
    # Then blocks of what still holds several components.
    rows = shared.join(classes, "node", "left").join(nodes.select("node", (F.col("n") * 8).alias("n_bytes")), "node")
    rows = rows.select("node", "n_bytes", "bucket", named(classes, "class").alias("kind"), F.col("best.node").alias("star"))
    left = base.checkpoint(apart(rows, sets).coalesce(parts))
    if not left.isEmpty():
        more = base.checkpoint(compared(left.join(sets.select("node", "tokens"), "node")))
        if not more.isEmpty():
            classes = components(links.union(more))
    # Names: the smallest key of the component's nodes.
    member = nodes.select("node", "key", "copies").join(classes, "node", "left").select("node", "key", "copies", named(classes, "class").alias("class"))
    names = member.groupBy("class").agg(F.min("key").alias("component_id"), F.sum("copies").alias("component_size"))
    named_nodes = member.join(names, "class").select("node", "component_id", "component_size")
    known = signed.where("node is not null").select("key", "n", "node").join(named_nodes, "node").select("key", F.col("n").alias("n_shingles"), "component_id", "component_size")
    alone = signed.where("node is null").select("key", F.lit(0).cast("long").alias("n_shingles"), F.col("key").alias("component_id"), F.lit(1).cast("long").alias("component_size"))
    return known.union(alone).withColumnRenamed("key", key)
