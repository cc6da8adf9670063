"""Quality scores by Bradley-Terry pairwise ranking.

A document is described by some numbers about its whole text.  Every labelled training
document takes part in the fit: its features are made once, where its text lies, and
are dealt by a hash of its key into blocks of about FEWER documents of the rarer label and
MORE of the other.  In a block each document is compared with all of the other label, and
weights are learnt by logistic loss on the difference of features of all these pairs, as in the
Bradley-Terry model.  A step of Newton's method is a pass over the blocks; the driver gets the
sums of each task.  Few documents make one block, and so all pairs.  Centre and scale of
features, the cut and the spread come from all these documents as well.  The cut is a
quantile of their scores, the share of label 0 among them: half-way between the two scores that it parts.

Definitions: null texts count as empty; they are scored by the same features.  Without
both labels in training, every text scores CUT.  Repeated rows are scored each; of labels of one
key the smallest counts, of texts the one whose features come first as bytes.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from . import base, spans
from .linear import sigmoid

#: Documents of the rarer and of the other label in a block, about.
FEWER, MORE = 32, 256
RIDGE, STEPS = 1e-3, 40
CUT = 0.3
_KIND = np.zeros(256, np.int8)
for _i, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\r\v\f", b".,;:", b"!?", b"'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256))):
    _KIND[list(_chars)] = _i + 1
KINDS = 12


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeated(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values, and of the commonest, in each document."""
    n = np.bincount(doc, minlength=docs)
    codes, distinct, first = spans.factorize(spans.mix(h + doc.astype(np.uint64) * np.uint64(spans.BASE)))
    count = np.bincount(codes, minlength=len(distinct))
    kinds = np.bincount(doc[first], minlength=docs)
    most = np.zeros(docs)
    np.maximum.at(most, doc[first], count)
    return np.where(n > 0, _share(kinds, n), 1.0), _share(most, n)


def features(run: spans.Run) -> np.ndarray:
    """One row a document."""
    size = np.diff(run.off)
    doc = np.repeat(np.arange(run.docs), size)
    kind = np.bincount(doc * KINDS + _KIND[run.data], minlength=run.docs * KINDS).reshape(run.docs, KINDS)
    share = kind / np.maximum(size, 1)[:, None]
    solid = spans.NONSPACE[run.data]
    a, b = spans.words(solid, run.off)
    wd = spans.document_of(a, run.off)
    n = np.bincount(wd, minlength=run.docs)
    h = spans.hashes(solid, a, b)
    length = b - a
    mean = _share(np.bincount(wd, weights=length, minlength=run.docs), n)
    spread = np.sqrt(np.maximum(0, _share(np.bincount(wd, weights=length.astype(float) ** 2, minlength=run.docs), n) - mean**2))
    types, top = _repeated(h, wd, run.docs)
    first = np.searchsorted(a, run.off)
    repeats = []
    for k in (2, 5):
        g = spans.kgrams(h, k)
        at = np.flatnonzero(np.arange(len(g)) + k <= first[wd[: len(g)] + 1])
        repeats += [1 - r if i == 0 else r for i, r in enumerate(_repeated(g[at], wd[at], run.docs))]
    line = np.where(run.data == 10, 0, 1).astype(np.uint8)
    la, lb = spans.words(line, run.off)
    ld = spans.document_of(la, run.off)
    lines = np.bincount(ld, minlength=run.docs)
    line_types, line_top = _repeated(spans.hashes(run.data + np.uint16(1), la, lb), ld, run.docs)
    last = _KIND[run.data[b - 1]] if len(b) else np.zeros(0, np.int8)
    ends_odd = _share(np.bincount(wd, weights=(last == 10) | (last == 8), minlength=run.docs), n)
    bare_odd = _share(np.bincount(wd, weights=(length == 1) & (last == 10), minlength=run.docs), n)
    upper_words = _share(np.bincount(wd, weights=_KIND[run.data[a]] == 2, minlength=run.docs), n) if len(a) else np.zeros(run.docs)
    letters = kind[:, 1] + kind[:, 2] + kind[:, 11]
    upper = _share(kind[:, 2], letters)
    used = np.where(share > 0, -share * np.log(np.maximum(share, 1e-12)), 0).sum(1)
    log_n = np.log1p(n)
    cols = [
        *(share[:, i] for i in range(1, KINDS)), np.sqrt(share[:, 10]), np.sqrt(share[:, 8]), np.sqrt(share[:, 3]), upper, np.sqrt(upper), upper > 0.5,
        np.log1p(mean), np.log1p(spread), log_n, log_n**2 / 10, types, _share(np.log1p(types * n), log_n), top, np.sqrt(top),
        *repeats, _share(lines, n), np.log1p(_share(size, lines)), 1 - line_types, np.where(lines > 1, line_top, 0), ends_odd, np.sqrt(ends_odd), bare_odd, np.sqrt(bare_odd), upper_words, used, n == 0, n < 20,
    ]
    return np.stack([np.asarray(c, np.float64) for c in cols], axis=1)


class Model:
    """Centre and scale of the features, weights, the cut and the spread of scores."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray):
        self.centre, self.scale = centre, scale
        self.w = np.zeros(len(centre))
        self.cut, self.spread = 0.0, 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) * self.w).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((self.raw(x) - self.cut) / self.spread + np.log(CUT / (1 - CUT)))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x) of every row: its features, as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        for batch in batches:
            x = [r.tobytes() for run in spans.runs(batch.column(1)) for r in features(run)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["key", "x"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return base.checkpoint(rows.mapInArrow(make, f"key {dict(rows.dtypes)['key']}, x binary"))


def dealt(train: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(block, y, once, x), in order of blocks; once: of the rarer label, which is in several blocks, the first."""
    rare = min(counts, key=lambda y: (counts[y], y))
    buckets = max(1, counts[rare] // FEWER)
    # No document is left out for want of one of the other label.
    while buckets > 1 and not train.groupBy(F.col("o") % buckets).agg(F.count_distinct("y").alias("c")).where("c < 2").isEmpty():
        buckets //= 2
    parts = max(1, -(-counts[1 - rare] // (buckets * MORE)))
    own = F.floor(F.col("o") / buckets) % parts
    spread = train.withColumn("part", F.explode(F.when(F.col("y") == rare, F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(own))))
    rows = spread.select((F.col("o") % buckets * parts + F.col("part")).alias("block"), "y", ((F.col("y") != rare) | (F.col("part") == 0)).alias("once"), "o", "x")
    return base.checkpoint(rows.repartition("block").sortWithinPartitions("block", "y", "o", "x").drop("o"))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each feature over all documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _matrix(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.mean(0).tobytes()]), pa.array([((x - x.mean(0)) ** 2).sum(0).tobytes()])], names=["n", "mean", "square"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, 0.0, 0.0
        for b in add(batches):
            m, other, more = b.column(0)[0].as_py(), np.frombuffer(b.column(1)[0].as_py()), np.frombuffer(b.column(2)[0].as_py())
            square = square + more + (other - mean) ** 2 * (n * m / (n + m))
            n, mean = n + m, mean + (other - mean) * (m / (n + m))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()]), pa.array([square.tobytes()])], names=["n", "mean", "square"])

    found = [(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["square"])) for r in rows.where("once").select("x").mapInArrow(merge, "n long, mean binary, square binary").collect()]
    n = sum(f[0] for f in found)
    mean = sum(f[0] * f[1] for f in found) / n
    return mean, np.sqrt(sum(f[2] + f[0] * (f[1] - mean) ** 2 for f in found) / n)


def slopes(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the summed loss log(1 + exp(-(g - b).w)) over all pairs of a good and a bad row."""
    p = sigmoid(-((good @ w)[:, None] - (bad @ w)[None]))
    q = p * (1 - p)
    cross = good.T @ q @ bad
    curve = (good * q.sum(1)[:, None]).T @ good + (bad * q.sum(0)[:, None]).T @ bad - cross - cross.T
    return p.sum(0) @ bad - p.sum(1) @ good, curve


def summed(rows: DataFrame, model: Model) -> tuple[int, np.ndarray, np.ndarray]:
    """Pairs, gradient and curvature at the model's weights over all blocks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.w)
        pairs, grad, curve = 0, np.zeros(d), np.zeros((d, d))

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Labels and features of each block, which may lie in several batches."""
            held: list[tuple[np.ndarray, np.ndarray]] = []
            at = None
            for b in batches:
                if len(b):
                    block, y, x = np.asarray(b.column(0)), np.asarray(b.column(1)), model.scaled(_matrix(b.column(2)))
                    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
                    for i, j in zip(edges[:-1], edges[1:], strict=True):
                        if held and block[i] != at:
                            yield tuple(np.concatenate(v) for v in zip(*held, strict=True))
                            held = []
                        at = block[i]
                        held.append((y[i:j], x[i:j]))
            if held:
                yield tuple(np.concatenate(v) for v in zip(*held, strict=True))

        for y, x in blocks():
            good, bad = x[y == 1], x[y == 0]
            # A share of the larger side at a time, where a block is large.
            for i in range(0, len(good), 1024):
                for j in range(0, len(bad), 1024):
                    g, c = slopes(good[i : i + 1024], bad[j : j + 1024], model.w)
                    grad, curve = grad + g, curve + c
            pairs += len(good) * len(bad)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([grad.tobytes()]), pa.array([curve.tobytes()])], names=["pairs", "grad", "curve"])

    found = rows.select("block", "y", "x").mapInArrow(add, "pairs long, grad binary, curve binary").collect()
    d = len(model.w)
    return sum(r["pairs"] for r in found), sum(np.frombuffer(r["grad"]) for r in found), sum(np.frombuffer(r["curve"]).reshape(d, d) for r in found)


def fitted(rows: DataFrame, counts: dict[int, int]) -> Model:
    """rows: dealt()."""
    mean, deviation = moments(rows)
    model = Model(mean, deviation + 1e-9)
    for _ in range(STEPS):
        pairs, grad, curve = summed(rows, model)
        move = np.linalg.solve(curve / pairs + RIDGE * np.eye(len(model.w)), grad / pairs + RIDGE * model.w)
        size = float(np.linalg.norm(move))
        model.w = model.w - move * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b.column(0))))], names=["raw"])

    raw = base.checkpoint(rows.where("once").select("x").mapInArrow(score, "raw double"))
    # Half-way between the last of as many scores as there are documents of label 0, and the next.
    at = (counts[0] - 0.5) / (counts[0] + counts[1] - 1)
    model.cut = exact_quantiles(raw, "raw", {"cut": at}).first()["cut"]
    far = raw.select(F.abs(F.col("raw") - F.lit(float(model.cut))).alias("far"))
    model.spread = max(1e-6, exact_quantiles(far, "far", {"median": 0.5}).first()["median"] / 3)
    return model


def taught(rows: DataFrame, labels: DataFrame, key: str, label: str) -> Model | None:
    """rows: described()."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("y"))
    train = rows.join(known, "key").groupBy("key", "y").agg(F.min("x").alias("x"))
    train = base.checkpoint(train.select("y", F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 40)).alias("o"), "x"))
    counts = {r["y"]: r["c"] for r in train.groupBy("y").agg(F.count("*").alias("c")).collect()}
    return fitted(dealt(train, counts), counts) if len(counts) == 2 else None


def learnt(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Model | None:
    return taught(described(docs, key, text), labels, key, label)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key and score (0 to 1) of every row of docs, learnt from the texts of the keys in `labels` (key, label 0 or 1)."""
    base.arrow(docs.sparkSession)
    rows = described(docs, key, text)
    model = docs.sparkSession.sparkContext.broadcast(taught(rows, labels, key, label))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            score = m.score(_matrix(batch.column(1))) if m and len(batch) else np.full(len(batch), CUT)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["key", "score"])

    return rows.mapInArrow(apply, f"key {dict(rows.dtypes)['key']}, score double").withColumnRenamed("key", key)
