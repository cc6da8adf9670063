"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

Kernel.  Two words are compared by their common subsequences of ORDER characters, each
occurrence weighted by DECAY to the length it spans, so that gaps and inserted
characters lower the kernel but don't break it; it is normalised to 1 for equal words.
Words are cut at white space only, lower-cased and stripped of other ASCII marks, and
single characters in a row are joined, so that `i.d.i.o.t` and `i d i o t` become words.
A word longer than a landmark counts by its windows of the landmark's length, and of two
bytes more, too: the kernel is the largest over all of them, so that a glued or spelled-out
sentence of any length shows the landmarks in it.  Words under ORDER bytes have no
subsequence of ORDER characters, and so no kernel.

Landmarks.  From labelled training documents (a sample of at most SAMPLE a label), the
words of up to LONGEST bytes that speak most for label 1 become landmarks, and some common
words of label 0 besides.  A sentence's kernel with a landmark is the largest over its
words, and the Nystroem map turns kernels with the landmarks into features, K^(-1/2) k.

Training.  Sentences inherit their document's label; of a sampled document of more than
FITTED characters so many are taken, as whole sentences chosen by a hash.  Of a document
with label 1 the sentence that scores highest is its witness (chosen anew in each of
ROUNDS rounds), and so is each sentence with a telling word itself; copies of witnesses
with characters inserted in or taken out of the telling word join them.  Of clean
sentences the HARDEST that score highest are fitted on.  A document's score is that of its
worst sentence, through a logistic fit.

Whole texts are scored.  Kernels under FLOOR count as 0; bounds that are proven (Mark,
_likeness) rule out most pairs of a word and a landmark before.  A worker remembers the
kernels of words, by their bytes.

Definitions: null and empty texts have no sentence and score as a text without any
likeness to a landmark.  Without both labels in training every score is 0; without any
word of ORDER bytes in training every text scores alike.  Repeated rows are scored each;
of labels and texts of one key the smallest count.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, spans
from .linear import logistic, sigmoid, svm

SAMPLE = 1500
#: Characters of a document's sample of sentences, and clean sentences in the fit, those that score highest.
FITTED, HARDEST = 20_000, 20_000
LANDMARKS, PLAIN = 48, 16
ORDER, DECAY = 4, 0.8
FLOOR = 0.25
#: Bytes of a landmark, and of a word that is compared as a whole too.
LONGEST = 24
#: How much longer than its mark a window is, and window starts that are looked at together.
WIDER = (0, 2)
WINDOWS = 200_000
ROUNDS = 3

#: Bytes of words: letters and digits, and all beyond ASCII; white space parts; the rest is left out.
_PART = np.zeros(256, bool)
_PART[[0x20, *range(9, 14)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


class Words:
    """Words of a run of documents, with their documents and sentences."""

    def __init__(self, run: spans.Run):
        keep = (spans.ALNUM[run.data] > 0) | _PART[run.data]
        edge = np.zeros(len(run.data), bool)
        edge[run.off[:-1][run.off[:-1] < run.off[1:]]] = True
        count = np.append(0, np.cumsum(keep))
        self.off = count[run.off]
        # A sentence ends at a stop before white space (a dot within a word ends none) or at a line's end.
        stop = _STOP[run.data]
        stop[:-1] &= _PART[run.data[1:]] | (run.data[:-1] == 10)
        sentence = np.cumsum(np.append(False, stop[:-1]) | edge) if len(run.data) else np.zeros(0, np.int64)
        mapped = np.where(_PART[run.data], 0, spans.ALNUM[run.data])[keep]
        self.bytes = mapped
        a, b = spans.words(mapped, self.off)
        hashes = spans.hashes(mapped, a, b)
        sentence = sentence[keep][a] if len(a) else np.zeros(0, np.int64)
        doc = spans.document_of(a, self.off)
        a, b, hashes, sentence, doc = self._joined(a, b, hashes, sentence, doc)
        self.starts, self.ends, self.hash, self.sentence, self.doc = a, b, hashes, sentence, doc

    def _joined(self, a, b, h, sentence, doc):
        """Three or more single characters in a row, as one word in place of the first."""
        single = b - a == 1
        same = np.append(False, single[1:] & single[:-1] & (doc[1:] == doc[:-1])) if len(a) else single
        if not same.any():
            return a, b, h, sentence, doc
        first = np.flatnonzero(single & ~same)
        # Length of each chain: up to the next word that isn't its continuation.
        stop = np.flatnonzero(~same)
        size = np.append(stop[1:], len(a))[np.searchsorted(stop, first)] - first
        chains = first[size >= 3]
        if not len(chains):
            return a, b, h, sentence, doc
        size = size[size >= 3]
        # The characters of a chain are put behind the other bytes, so that they lie together.
        at = np.concatenate([np.arange(i, i + n) for i, n in zip(chains.tolist(), size.tolist(), strict=True)])
        tail = len(self.bytes) + 1
        self.bytes = np.concatenate([self.bytes, [0], self.bytes[a[at]]]).astype(np.uint8)
        ends = tail + np.cumsum(size)
        starts = ends - size
        gone = np.zeros(len(a), bool)
        gone[at] = True
        h2 = spans.hashes(self.bytes, starts, ends)
        out = [np.concatenate([x[~gone], y]) for x, y in ((a, starts), (b, ends), (h, h2), (sentence, sentence[chains]), (doc, doc[chains]))]
        order = np.argsort(out[3], kind="stable")
        return tuple(x[order] for x in out)

    def strings(self, at: np.ndarray) -> list[bytes]:
        raw = self.bytes.tobytes()
        return [raw[i:j] for i, j in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def letters(words: list[bytes], width: int = LONGEST) -> np.ndarray:
    """Bytes of each word, of at most `width`, in a row, 0 beyond its end."""
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def raw_kernel(x: np.ndarray, mark: bytes, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Sum over common subsequences of `order` characters, of all rows of x with one mark.

    The usual recursion over both strings' positions; rows are done at once, and the sums
    over earlier positions are products with matrices of decay powers.
    """
    n, width = x.shape
    m = len(mark)
    hit = (x[:, :, None] == np.frombuffer(mark, np.uint8)).astype(np.float32)
    same = hit * np.float32(decay * decay)
    earlier = lambda k: np.triu(decay ** np.maximum(np.arange(k)[None] - np.arange(k)[:, None] - 1.0, 0), 1).astype(np.float32)
    over_x, over_mark = np.ascontiguousarray(earlier(width).T), earlier(m)
    hit = same
    for _ in range(order - 1):
        hit = same * (over_x @ (hit.reshape(n * width, m) @ over_mark).reshape(n, width, m))
    return hit.reshape(n, -1).sum(1)


def own_kernel(x: np.ndarray) -> np.ndarray:
    """Each row's kernel with itself."""
    n, width = x.shape
    if not n:
        return np.zeros(0, np.float32)
    same = ((x[:, :, None] == x[:, None, :]) & (x != 0)[:, :, None]).astype(np.float32) * np.float32(DECAY * DECAY)
    earlier = np.triu(DECAY ** np.maximum(np.arange(width)[None] - np.arange(width)[:, None] - 1.0, 0), 1).astype(np.float32)
    hit, before = same, np.ascontiguousarray(earlier.T)
    for _ in range(ORDER - 1):
        hit = same * (before @ (hit @ earlier))
    return hit.reshape(n, -1).sum(1)


def common(x: np.ndarray, mark: bytes) -> np.ndarray:
    """Length of the longest common subsequence of each row with the mark, bit-parallel."""
    m = len(mark)
    bits = np.zeros(256, np.uint32)
    for i, c in enumerate(mark):
        bits[c] |= np.uint32(1 << i)
    bits[0] = 0
    v = np.full(len(x), (1 << m) - 1, np.uint32)
    for i in range(x.shape[1]):
        hit = v & bits[x[:, i]]
        v = (v + hit) | (v - hit)
    return m - np.bitwise_count(v & np.uint32((1 << m) - 1)).astype(np.int64)


#: Bytes in 64 classes, and 0 in none: a set of classes is a 64-bit number.
_CLASS = np.zeros(256, np.uint64)
_CLASS[1:] = np.uint64(1) << ((np.arange(1, 256) * 29) % 64).astype(np.uint64)
_CLASS[48:58] = np.uint64(1) << np.arange(10, dtype=np.uint64)
_CLASS[97:123] = np.uint64(1) << np.arange(10, 36, dtype=np.uint64)
_CLASS[128:] = np.uint64(1) << (36 + np.arange(128) % 28).astype(np.uint64)
#: Classes of a mark that are told apart; the others count as present.
TOLD = 12


def classes(x: np.ndarray) -> np.ndarray:
    """The set of classes of each row's bytes."""
    out = np.zeros(len(x), np.uint64)
    for i in range(x.shape[1]):
        out |= _CLASS[x[:, i]]
    return out


class Mark:
    """A landmark, and which sets of its characters a word must have for a kernel of FLOOR or more.

    By Cauchy and Schwarz a normalised kernel is at most sqrt(part / own), where own is the
    mark's kernel with itself and part the share of it that comes from subsequences that
    the word has too; these lie within the characters that the word has.
    """

    def __init__(self, mark: bytes):
        self.mark = mark
        self.own = float(own_kernel(letters([mark], len(mark)))[0])
        at = np.frombuffer(mark, np.uint8)
        self.bits = np.unique(_CLASS[at])[:TOLD]
        subsets = np.arange(1 << len(self.bits))
        x = np.tile(at, (len(subsets), 1))
        for i, bit in enumerate(self.bits):
            x[np.ix_((subsets >> i & 1) == 0, _CLASS[at] == bit)] = 0
        part = np.concatenate([raw_kernel(x[i : i + 1024], mark) for i in range(0, len(x), 1024)])
        self.able = part * (1 + 1e-4) >= FLOOR**2 * self.own
        self.fewest = min((int(s).bit_count() for s in np.flatnonzero(self.able)), default=len(self.bits) + 1)
        self.all = np.bitwise_or.reduce(self.bits)

    def may(self, sets: np.ndarray) -> np.ndarray:
        """Rows, by their classes, whose kernel can be FLOOR or more."""
        at = np.flatnonzero(np.bitwise_count(sets & self.all) >= self.fewest)
        code = np.zeros(len(at), np.int64)
        for i, bit in enumerate(self.bits):
            code |= ((sets[at] & bit) > 0).astype(np.int64) << i
        return at[self.able[code]]


#: Least kernel with itself of a word of n bytes: that of a word without any byte twice.
LEAST_OWN = [0.0, *(float(own_kernel(np.arange(1, n + 1, dtype=np.uint8)[None])[0]) for n in range(1, LONGEST + WIDER[-1] + 1))]


def _likeness(x: np.ndarray, size: np.ndarray, sets: np.ndarray, mark: Mark, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x whose normalised kernel with the mark is FLOOR or more, and the kernels.

    sets: the rows' classes; own: their kernels with themselves, negative where unknown, filled in where needed.
    Rows are ruled out by bounds alone: by their characters, by a common subsequence shorter
    than ORDER, and by the least that a word of their length can have for itself.
    """
    at = mark.may(sets)
    at = at[common(x[at], mark.mark) >= ORDER]
    raw = np.zeros(len(at), np.float32)
    for i in range(0, len(at), 2000):
        s = at[i : i + 2000]
        raw[i : i + 2000] = raw_kernel(x[s, : int(size[s].max())], mark.mark)
    least = np.array(LEAST_OWN)[size[at]]
    keep = raw * (1 + 1e-4) >= FLOOR * np.sqrt(least * mark.own)
    at, raw = at[keep], raw[keep]
    new = at[own[at] < 0]
    for i in range(0, len(new), 1000):
        s = new[i : i + 1000]
        own[s] = own_kernel(x[s, : int(size[s].max())])
    value = raw / np.sqrt(np.maximum(own[at] * mark.own, 1e-12))
    return at[value >= FLOOR], value[value >= FLOOR]


def kernels(words: list[bytes], marks: list[bytes]) -> np.ndarray:
    """Normalised kernels of words with marks, the largest over a whole word of up to LONGEST bytes and its windows; under FLOOR they are 0."""
    return kernels_with(words, [Mark(m) for m in marks])


def kernels_with(words: list[bytes], marks: list[Mark]) -> np.ndarray:
    out = np.zeros((len(words), len(marks)), np.float32)
    if not len(marks):
        return out
    for lo in range(0, len(words), 20_000):
        part = words[lo : lo + 20_000]
        best = out[lo : lo + 20_000]
        length = np.array([len(w) for w in part])
        some = np.flatnonzero((length >= ORDER) & (length <= LONGEST))
        x, own = letters([part[i] for i in some]), np.full(len(some), -1.0, np.float32)
        sets = classes(x)
        for k, mark in enumerate(marks):
            at, value = _likeness(x, length[some], sets, mark, own)
            best[some[at], k] = value
        _windows(part, length, marks, best)
    return out


def _windows(words: list[bytes], length: np.ndarray, marks: list[Mark], best: np.ndarray) -> None:
    """Raises best (words x marks) to the kernels of all windows of words longer than the window."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(length)
    for width in sorted({len(m.mark) + more for m in marks for more in WIDER}):
        mine = [k for k, m in enumerate(marks) if width - len(m.mark) in WIDER]
        for lo in range(0, len(data) - width + 1, WINDOWS):
            start = np.arange(lo, min(lo + WINDOWS, len(data) - width + 1))
            owner = np.searchsorted(ends, start, "right")
            ok = (start + width <= ends[owner]) & (length[owner] > width)
            start, owner = start[ok], owner[ok]
            if not len(start):
                continue
            codes, _, first = spans.factorize(spans.kgrams(data[start[0] : start[-1] + width].astype(np.uint64), width)[start - start[0]])
            x = data[start[first][:, None] + np.arange(width)]
            own, size, sets = np.full(len(x), -1.0, np.float32), np.full(len(x), width), classes(x)
            for k in mine:
                at, value = _likeness(x, size, sets, marks[k], own)
                if len(at):
                    all_ = np.zeros(len(x), np.float32)
                    all_[at] = value
                    hit = np.flatnonzero(all_[codes])
                    np.maximum.at(best[:, k], owner[hit], all_[codes[hit]])


def telling(docs: list[set[bytes]], labels: np.ndarray, many: int) -> list[bytes]:
    """Words of label 1 that speak most for it, by the log-likelihood ratio of documents with the word."""
    with_, without = Counter(), Counter()
    for d, y in zip(docs, labels, strict=True):
        (with_ if y else without).update(d)
    n1, n0 = max(1, labels.sum()), max(1, (1 - labels).sum())
    score = {w: c * np.log((c + 0.5) / (n1 + 1) / ((without[w] + 0.5) / (n0 + 1))) for w, c in with_.items() if c >= 3 and ORDER <= len(w) <= LONGEST and c / n1 > 4 * without[w] / n0}
    out: list[bytes] = []
    for w in sorted(score, key=lambda w: (-score[w], w))[: 20 * many]:
        if len(out) < many and (not out or kernels([w], out).max() < 0.9):
            out.append(w)
    return out


def corrupted(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one character put in or taken out."""
    i = int(rng.integers(1, max(2, len(word))))
    other = bytes([int(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz013", np.uint8)))])
    return word[:i] + other + word[i:] if rng.random() < 0.7 or len(word) <= ORDER + 1 else word[:i] + word[i + 1 :]


class Model:
    """Landmarks, and the SVM's weights on kernels with them (the Nystroem map folded in)."""

    def __init__(self, rows: list[tuple[str, int]], share: float):
        rng = np.random.default_rng(5)
        y = np.array([v for _, v in rows])
        parts = [Words(r) for r in spans.runs(pa.array([t for t, _ in rows], pa.large_string()))]
        sets: list[set[bytes]] = []
        held = []
        for w in parts:
            codes, _, first = spans.factorize(w.hash)
            names = np.array([*w.strings(first), None], object)[:-1]
            docs = len(w.off) - 1
            ends = np.searchsorted(w.doc, np.arange(docs + 1))
            for i in range(docs):
                seen = codes[ends[i] : ends[i + 1]]
                sets.append(set(names[seen].tolist()))
                held.append((seen, names, w.sentence[ends[i] : ends[i + 1]]))
        told = telling(sets, y, LANDMARKS)
        often = Counter(x for s, v in zip(sets, y, strict=True) if not v for x in s if ORDER <= len(x) <= LONGEST)
        self.marks = [Mark(x) for x in told + [x for x, _ in sorted(often.items(), key=lambda t: (-t[1], t[0]))[:PLAIN] if x not in told]]
        distinct = sorted({x for s in sets for x in s})
        place = {x: i for i, x in enumerate(distinct)}
        k = kernels_with(distinct, self.marks)
        bag, of_doc = [], []
        for i, (seen, names, sentence) in enumerate(held):
            rows_ = k[[place[names[c]] for c in seen.tolist()]] if len(seen) else np.zeros((0, len(self.marks)), np.float32)
            cuts = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])) if len(sentence) else np.zeros(0, int)
            s = np.maximum.reduceat(rows_, cuts, axis=0) if len(cuts) else np.zeros((1, len(self.marks)), np.float32)
            bag.append(s)
            of_doc += [i] * len(s)
        x, of_doc = np.concatenate(bag).astype(np.float64), np.array(of_doc)
        names = [m.mark for m in self.marks]
        gram = np.maximum(kernels_with(names, self.marks), np.eye(len(names)))
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        self.root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
        z = x @ self.root
        bad = y[of_doc] == 1
        # Without a telling word, any likeness makes a sentence a witness.
        worst = x[:, : len(told) or None].max(1, initial=0)
        sure = x[:, : len(told)].max(1, initial=0) > 0.95
        starts = np.flatnonzero(np.append(True, of_doc[1:] != of_doc[:-1]))
        for _ in range(ROUNDS):
            top = np.array([a + int(np.argmax(worst[a:b])) for a, b in zip(starts, np.append(starts[1:], len(of_doc)), strict=True)])
            # Sentences of label 1 with a telling word itself are witnesses whichever scores highest.
            witness = np.union1d(top[bad[top] & (x[top].max(1, initial=0) > 0)], np.flatnonzero(bad & sure))
            gaps = [corrupted(names[int(x[i].argmax())], rng) for i in witness]
            more = kernels_with(gaps, self.marks).astype(np.float64) @ self.root if gaps else np.zeros((0, z.shape[1]))
            clean = np.flatnonzero(~bad)
            clean = clean[np.argsort(-worst[clean], kind="stable")[:HARDEST]]
            given = np.concatenate([z[witness], more, z[clean], np.zeros((1, z.shape[1]))])
            side = np.concatenate([np.ones(len(witness) + len(more)), -np.ones(len(clean) + 1)])
            w, b = svm(given, side, c=200.0, steps=400)
            worst = z @ w + b
        self.w, self.b = self.root @ w, b
        top = np.maximum.reduceat(worst, starts)
        # Corrupted copies weigh a tenth of the documents of label 1, which occur in their true share.
        more_top = more @ w + b
        margin, truth = np.append(top, more_top), np.append(y, np.ones(len(more_top)))
        weight = np.where(truth == 1, share / max(1, y.sum()), (1 - share) / max(1, (truth != 1).sum()))
        weight[len(top) :] *= 0.1 * y.sum() / max(1, len(more_top))
        a = logistic(np.stack([margin, np.ones(len(margin))], 1), y=np.where(truth == 1, 1, -1), weight=weight, ridge=1e-4)
        self.a, self.c = (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)
        self.memo = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def score(self, run: spans.Run) -> np.ndarray:
        if self.memo is None:
            self.memo = spans.Memo()
        docs = run.docs
        margin = np.full(docs, self.b)
        w = Words(run)
        if len(w.hash):
            codes, _, first = spans.factorize(w.hash)
            names = w.strings(first)

            def make(new: list[int]) -> list[tuple]:
                k = kernels_with([names[i] for i in new], self.marks)
                return [(r, 4 * len(r)) if some else ((), 0) for r, some in zip(k, k.any(1).tolist(), strict=True)]

            rows = self.memo.fill(names, make)
            some = np.array([len(r) > 0 for r in rows])
            if some.any():
                table = np.stack([r for r in rows if len(r)])
                place = np.cumsum(some) - 1
                at = np.flatnonzero(some[codes])
                cut = np.flatnonzero(np.append(True, w.sentence[at][1:] != w.sentence[at][:-1]))
                k = np.maximum.reduceat(table[place[codes[at]]], cut, axis=0)
                np.maximum.at(margin, w.doc[at[cut]], k @ self.w + self.b)
        return sigmoid(self.a * margin + self.c)


def fit(rows: list[tuple[str, int]], share: float) -> Model | None:
    """rows: (text, label); share: of label 1 among all labels, which the sample doesn't show."""
    return Model(rows, share) if len({v for _, v in rows}) == 2 else None


def sentences(rows: DataFrame) -> DataFrame:
    """base.picked() rows with at most FITTED characters of text: of a longer one, sentences chosen by a hash, in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            for i, t in enumerate(texts):
                if t is not None and len(t) > FITTED:
                    parts = [p[j : j + FITTED // 4] for p in re.split(r"(?<=[.!?])\s+|\n", t) for j in range(0, len(p), FITTED // 4)]
                    kept, size = [], 0
                    for j in sorted(range(len(parts)), key=lambda j: zlib.crc32(f"{j} {parts[j]}".encode())):
                        if size + len(parts[j]) <= FITTED:
                            kept.append(j)
                            size += len(parts[j]) + 1
                    texts[i] = "\n".join(parts[j] for j in sorted(kept))
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_y"), batch.column("_o"), pa.array(texts, pa.string())], names=["_k", "_y", "_o", "_t"])

    kinds = dict(rows.dtypes)
    return base.hashed(rows).select("_k", "_y", "_o", "_t").mapInArrow(cut, f"_k {kinds['_k']}, _y {kinds['_y']}, _o long, _t string")


def learnt(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Model | None:
    known = labels.where(F.col(label).isin(0, 1))
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if share is None:
        return None
    rows = base.few(sentences(base.picked(known, docs, key, label, text, SAMPLE)).collect(), SAMPLE)
    return fit([(r["_t"], r["_y"]) for r in rows], share)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """key and score (0 to 1) of every row of docs, learnt from the texts of the keys in `labels` (key, label 0 or 1)."""
    base.arrow(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels, key, text, label))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        m = model.value
        for batch in batches:
            parts = [m.score(run) if m else np.zeros(run.docs) for run in spans.runs(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *parts]))], names=[key, "score"])

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(apply, f"`{key}` {dict(rows.dtypes)[key]}, score double")
