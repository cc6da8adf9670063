"""Language identification by hierarchical discrimination.

Languages are put into families by the likeness of their mean byte n-gram profiles.
A document's family is decided first, by one linear support vector machine a family;
then one-versus-one linear machines vote among the languages of that family.

The models are fitted on a sample of at most SAMPLE training documents a language, of
any length: the executors make their profiles, and only these go to the driver.
Predictions read whole texts.  A profile counts all 1-, 2- and 3-grams of the
lower-cased bytes in FEATURES hashed cells, so its size doesn't depend on the text's.

Definitions: null texts and texts without a letter are `und` with score 0.  Without
training rows everything is `und`; with one language every text with letters is in it.
Equal votes go to the language whose name sorts first, equal margins to the family whose
first language does.  Repeated rows are predicted each; of training rows with one key
the smallest language and text count.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, spans
from .linear import sigmoid, svm

SAMPLE = 600
FEATURES = 4096
#: Documents and bytes whose profiles are made together: 4 MB of counts.
DOCS, BYTES = 128, 1 << 20
LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def profiles(run: spans.Run) -> np.ndarray:
    """Square roots of n-gram shares, one row a document."""
    x = _LOWER[run.data].astype(np.uint32)
    n = len(x)
    doc = np.repeat(np.arange(run.docs, dtype=np.int64) * FEATURES, np.diff(run.off))
    last = run.off[1:]
    total = np.zeros(run.docs * FEATURES)
    code = x.copy()
    for k in (1, 2, 3):
        if n < k:
            break
        if k > 1:
            code = (code[:-1] << np.uint32(8)) | x[k - 1 :]
        cell = ((code * np.uint32(2654435761) + np.uint32(k * 97)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        at = doc[: n - k + 1] + cell
        if k > 1:
            cross = last[(last < n) & (last > 0)]
            drop = np.concatenate([cross - j for j in range(1, k)]) if len(cross) else cross
            keep = np.ones(len(at), bool)
            keep[drop[(drop >= 0) & (drop < len(at))]] = False
            at = at[keep]
        total += np.bincount(at, minlength=len(total))
    total = total.reshape(run.docs, FEATURES)
    return np.sqrt(total / np.maximum(total.sum(1, keepdims=True), 1)).astype(np.float32)


def families(centres: np.ndarray, many: int) -> list[list[int]]:
    """Average-linkage clusters of the languages' mean profiles."""
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    like = unit @ unit.T
    groups = [[i] for i in range(len(centres))]
    while len(groups) > many:
        pairs = [(like[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(pairs)
        groups[-i] += groups.pop(-j)
    return [sorted(g) for g in groups]


@dataclass
class Model:
    langs: list[str]
    families: list[list[int]]
    #: Of each family, against the rest; of each pair of a family's languages, the first against the second.
    of_family: np.ndarray
    family_bias: np.ndarray
    pairs: list[tuple[int, int]]
    of_pair: np.ndarray
    pair_bias: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and a score."""
        margin = x @ self.of_family.T + self.family_bias
        share = np.exp(3 * (margin - margin.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        family = margin.argmax(1)
        versus = x @ self.of_pair.T + self.pair_bias
        n = len(self.langs)
        votes, chance = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (i, j) in enumerate(self.pairs):
            p = sigmoid(3 * versus[:, k])
            votes[:, i] += (p >= 0.5) + 1e-3 * p
            votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
            chance[:, i] += p
            chance[:, j] += 1 - p
        inside = np.zeros((len(self.families), n), bool)
        for k, g in enumerate(self.families):
            inside[k, g] = True
            if len(g) > 1:
                chance[:, g] /= len(g) - 1
            else:
                chance[:, g] = 1
        lang = np.where(inside[family], votes, -1).argmax(1)
        rows = np.arange(len(x))
        return lang, share[rows, family] * chance[rows, lang]


def fit(x: np.ndarray, named: list[str]) -> Model | None:
    """x: profiles; named: their languages."""
    if not len(x):
        return None
    langs = sorted(set(named))
    y = np.array([langs.index(v) for v in named])
    groups = families(np.stack([x[y == i].mean(0) for i in range(len(langs))]), max(1, int(np.ceil(np.sqrt(len(langs))))))
    of = np.array([next(k for k, g in enumerate(groups) if i in g) for i in range(len(langs))])[y]
    top = [svm(x, np.where(of == k, 1, -1)) if len(groups) > 1 else (np.zeros(x.shape[1]), 1.0) for k in range(len(groups))]
    pairs = [(i, j) for g in groups for i in g for j in g if i < j]
    low = [svm(x[(y == i) | (y == j)], np.where(y[(y == i) | (y == j)] == i, 1, -1)) for i, j in pairs]
    stack = lambda ms: (np.array([m[0] for m in ms], np.float32).reshape(len(ms), x.shape[1]), np.array([m[1] for m in ms], np.float32))
    return Model(langs, groups, *stack(top), pairs, *stack(low))


def profiled(rows: DataFrame) -> DataFrame:
    """Profiles of base.picked() rows: cells that aren't 0, and their values, as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        for batch in batches:
            for run in spans.runs(batch.column("_t"), BYTES, DOCS):
                x = profiles(run)
                at = [np.flatnonzero(r).astype(np.uint16) for r in x]
                part = batch.slice(run.first, run.docs)
                cols = [part.column("_k"), part.column("_y"), part.column("_o"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["_k", "_y", "_o", "cells", "shares"])

    kinds = dict(rows.dtypes)
    return base.hashed(rows).mapInArrow(make, f"_k {kinds['_k']}, _y {kinds['_y']}, _o long, cells binary, shares binary")


def learnt(train: DataFrame, key: str, text: str, lang: str) -> Model | None:
    rows = base.few(profiled(base.picked(train, train, key, lang, text, SAMPLE)).collect(), SAMPLE)
    x = np.zeros((len(rows), FEATURES), np.float32)
    for to, r in zip(x, rows, strict=True):
        to[np.frombuffer(r["cells"], np.uint16)] = np.frombuffer(r["shares"], np.float32)
    return fit(x, [r["_y"] for r in rows])


def identify(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: bool = False, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """key, lang_pred and score of every row of docs, learnt from text and lang of `train`.

    With `keep` every column of docs comes along; `into` names the two new ones.
    """
    base.arrow(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learnt(train, key, text, lang))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        m = model.value
        for batch in batches:
            texts = batch.column(text)
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for run in spans.runs(texts, BYTES, DOCS) if m else ():
                latin = ((run.data >= 65) & (run.data <= 90)) | ((run.data >= 97) & (run.data <= 122))
                count = np.append(0, np.cumsum(latin))
                some = count[run.off[1:]] > count[run.off[:-1]]
                for i in np.flatnonzero(~some & (np.diff(run.off) > 0)).tolist():
                    some[i] = LETTER.search(texts[run.first + i].as_py()) is not None
                best, score = m.predict(profiles(run))
                for i in np.flatnonzero(some).tolist():
                    names[run.first + i] = m.langs[best[i]]
                scores[run.first : run.first + run.docs][some] = score[some]
            new = [pa.array(names, pa.string()), pa.array(scores)]
            old = batch.columns if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[*(batch.schema.names if keep else [key]), *into])
            base.trim()

    rows = docs if keep else docs.select(F.col(key), F.col(text).cast("string").alias(text))
    schema = ", ".join(f"`{n}` {t}" for n, t in (rows.dtypes if keep else rows.dtypes[:1]))
    return rows.mapInArrow(apply, f"{schema}, `{into[0]}` string, `{into[1]}` double")
