"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are dealt into LISTS lists.  A list scores every candidate by its own
dimensions; a candidate's score is the sum over the lists.

1. Gather: each block of candidates gives, for each query and list, its k best local
   scores.  The candidates so seen are scored whole, and the k-th best of these over
   all blocks is a cutoff that no member of the answer can be below.
2. Broadcast the cutoff to the query's blocks and collect what suffices: with s lists, a
   candidate at or above the cutoff has in some list a local score of at least
   floor + (cutoff - sum of floors) / s, where a list's floor is the least score it can
   give (minus the product of the query's and the longest candidate's norm there).
3. Resolve: the candidates collected are scored whole, those under the cutoff go, and the
   k best of each query stay, ties to the smaller id.

Vectors are packed into blocks of rows, and blocks of queries meet groups of candidate
blocks by an equi-join on the group's number; a task keeps k entries for each query at
most, so that what moves grows with queries * k * tasks and not with all pairs.

Definitions: components are scaled to whole numbers, floor(scale * x).  Rows with a
null id, a null vector, or a null or non-finite component take no part.  Of two vectors of
different lengths the shorter counts as ended by zeros.  A query's candidates are all
rows with another id, each row for itself where an id is repeated; rows of one id that
are queries give one list together, the k best of all their scores.  Fewer than k
candidates give fewer rows.  Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

LISTS = 4
#: Queries and candidates in a block.
QUERY_ROWS, CANDIDATE_ROWS = 512, 4096
#: Bytes of a block's matrix.
BLOCK_BYTES = 8 << 20
#: Candidates whose blocks one task goes through for a block of queries.
GROUP_ROWS = 32_768


def usable(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and whole-number vector of the rows that take part."""
    x = F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fine = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return vectors.where(F.col(key).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), x.alias("x"))


def packed(rows: DataFrame, size: int, groups: int) -> DataFrame:
    """Blocks of at most `size` rows of one length: ids and matrix as bytes, dealt into groups.

    Rows are dealt by a hash of the whole row, so that a repeated id isn't in one group.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0), np.int64)
            flat = np.asarray(b.column(1).flatten(), np.int64)
            width = np.asarray(b.column(1).value_lengths(), np.int64)
            first = np.cumsum(width) - width
            group = np.asarray(b.column(2), np.int64)
            for g, w in sorted(set(zip(group.tolist(), width.tolist(), strict=True))):
                at = np.flatnonzero((group == g) & (width == w))
                many = max(1, min(size, BLOCK_BYTES // (8 * max(1, w))))
                for i in range(0, len(at), many):
                    part = at[i : i + many]
                    m = flat[first[part][:, None] + np.arange(w)]
                    yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([ids[part].tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["group", "ids", "m"])

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("id", "x", F.lit(5)), F.lit(groups))).repartition(groups, "group")
    return dealt.mapInArrow(pack, "group long, ids binary, m binary")


def exact(*largest: float) -> type:
    """The float type in which sums of products up to these sizes are whole numbers, or Python's own."""
    most = float(np.prod(largest))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _lists(width: int) -> list[slice]:
    edges = np.linspace(0, width, min(LISTS, max(1, width)) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(rows, -1)


class Best:
    """The k best (score, smaller id first) of each query of a block; every candidate row comes once."""

    def __init__(self, k: int):
        self.k, self.q, self.s, self.i = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.append(self.q, q), np.append(self.s, s), np.append(self.i, i)
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        new = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0)) if len(q) else q
        keep = rank < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]


def _whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) if a.dtype != object else np.array([int(np.dot(x, y)) for x, y in zip(a, b, strict=True)], object)


def gathered(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1 in a block: each list's k best for each query, scored whole."""
    qs, cs = [], []
    # Some of the best can be the query's own rows.
    own = int(np.unique(cid, return_counts=True)[1].max(initial=0))
    take = min(k + own, len(c))
    for part in _lists(q.shape[1]):
        local = q[:, part] @ c[:, part].T
        top = np.argpartition(local, len(c) - take, axis=1)[:, len(c) - take :] if take < len(c) else np.tile(np.arange(len(c)), (len(q), 1))
        qs.append(np.repeat(np.arange(len(q)), top.shape[1]))
        cs.append(top.ravel())
    pair = np.unique(np.concatenate(qs) * len(c) + np.concatenate(cs))
    i, j = pair // len(c), pair % len(c)
    ok = qid[i] != cid[j]
    i, j = i[ok], j[ok]
    return i, _whole(q[i], c[j]).astype(np.int64), cid[j]


def collected(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, cutoff: np.ndarray, parts: list[slice], longest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 in a block: what reaches the uniform threshold in a list, scored whole, at the cutoff or above."""
    floors = np.stack([-np.sqrt((q[:, p].astype(np.float64) ** 2).sum(1)) * longest[n] for n, p in enumerate(parts)])
    share = (cutoff - floors.sum(0)) / len(parts)
    seen = np.zeros((len(q), len(c)), bool)
    for n, p in enumerate(parts):
        # A little less than the threshold, for the rounding of norms.
        least = floors[n] + share
        seen |= q[:, p] @ c[:, p].T >= (least - 1e-9 * np.abs(least) - 1e-6)[:, None]
    i, j = np.nonzero(seen)
    out = [[], [], []]
    for a in range(0, len(i), 1 << 18):
        x, y = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
        s = _whole(q[x], c[y]).astype(np.int64)
        ok = (s >= cutoff[x]) & (qid[x] != cid[y])
        for o, v in zip(out, (x[ok], s[ok], cid[y[ok]]), strict=True):
            o.append(v)
    return tuple(np.concatenate([np.zeros(0, np.int64), *o]) for o in out)


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of every query by integer inner product.

    is_query: a condition on the column `id`.
    """
    rows = base.checkpoint(usable(vectors, key, vector, scale))
    schema = "query_id long, rank int, id long, score long"
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    parts = _lists(width)
    norms = [F.sqrt(F.max(F.aggregate(F.slice("x", p.start + 1, p.stop - p.start), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))).alias(f"n{i}") for i, p in enumerate(parts)]
    stats = rows.agg(F.count("*").alias("rows"), F.sum(is_query.cast("long")).alias("queries"), F.max(F.array_max(F.transform("x", F.abs))).cast("double").alias("largest"), *norms).first()
    if not stats["queries"]:
        return vectors.sparkSession.createDataFrame([], schema)
    largest = stats["largest"] or 0.0
    kind = exact(largest, largest, width)
    longest = np.array([stats[f"n{i}"] for i in range(len(parts))])
    groups, blocks = -(-stats["rows"] // GROUP_ROWS), -(-stats["queries"] // QUERY_ROWS)
    candidates = base.checkpoint(packed(rows, CANDIDATE_ROWS, groups))
    queries = base.checkpoint(packed(rows.where(is_query), QUERY_ROWS, blocks).select(F.xxhash64("group", "ids", "m").alias("block"), F.col("ids").alias("qids"), F.col("m").alias("qm")))

    def met(queries: DataFrame) -> DataFrame:
        """Query blocks with each group's candidate blocks, those of one query block and group together."""
        each = queries.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        return each.join(candidates, "group").repartition(max(1, groups * blocks), "block", "group").sortWithinPartitions("block", "group")

    def scored(of) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, best, qid = None, None, None

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(best.q), at[0], np.int64)), pa.array(qid[best.q]), pa.array(best.i), pa.array(best.s)], names=["block", "query_id", "id", "score"])

            for b in batches:
                for r in b.to_pylist():
                    if (r["block"], r["group"]) != at:
                        if at is not None:
                            yield done()
                        at = (r["block"], r["group"])
                        qid = np.frombuffer(r["qids"], np.int64)
                        q = _matrix(r["qm"], len(qid)).astype(kind)
                        best = Best(k)
                    cid = np.frombuffer(r["ids"], np.int64)
                    c = _matrix(r["m"], len(cid)).astype(kind)
                    both = min(q.shape[1], c.shape[1])
                    best.add(*of(q[:, :both], qid, c[:, :both], cid, r))
            if at is not None:
                yield done()

        return run

    out = "block long, query_id long, id long, score long"
    first = met(queries).mapInArrow(scored(lambda q, qid, c, cid, r: gathered(q, qid, c, cid, k)), out)
    # Each partition passes on k scores of a query at most.
    place = F.row_number().over(Window.partitionBy("block", "query_id").orderBy(F.desc("score")))
    merged = first.withColumn("place", place).where(F.col("place") <= k).groupBy("block", "query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    # With fewer than k seen there is no cutoff yet: everything is collected.
    cutoffs = merged.select("block", "query_id", F.when(F.col("n") >= k, F.col("least")).alias("cutoff")).groupBy("block").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cutoffs"))

    def rest(q, qid, c, cid, r):
        known = {x["query_id"]: x["cutoff"] for x in r["cutoffs"] or ()}
        lowest = float(-(2**62))
        cutoff = np.array([lowest if known.get(i) is None else known[i] for i in qid.tolist()], np.float64)
        return collected(q, qid, c, cid, cutoff, parts, longest)

    second = met(queries.join(cutoffs, "block", "left")).mapInArrow(scored(rest), out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return second.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
