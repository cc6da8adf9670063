"""Secret scans with multipart credential linking.

Strong findings stand alone: assignments to a secret's name, access identifiers of a
known form, long hexadecimal runs.  Weak candidates are named accounts, random-looking
bare strings and endpoints.  They are joined by interval with what complements them:
two parts are in one scope if they lie in the same paragraph and at most REACH
characters apart.  A bare string counts with an identifier in scope, an account with
a secret in scope, an endpoint with an identifier and a secret in scope; nothing weak
is reported by itself.

A cheap look at the bytes decides which texts need regular expressions at all; it
lets through every text that can have a finding.  Positions are code points, ends are
exclusive.  Null texts count as empty; every row gives a row, an empty table none.  Scanning one
text takes time in proportion to its length, and to the logarithm of its parts.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, spans

#: The contract's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "account", "bare", "endpoint")
STRONG = KINDS[:3]

#: Weak parts; a name can stand behind an underscore (DB_USER=).
ACCOUNT = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?<![A-Za-z0-9])(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::\d+)?""", re.IGNORECASE | re.ASCII)
PARAGRAPH = re.compile(r"\n[ \t]*\n")
REACH = 400
#: Bits a character of a bare string, and the kinds of character in it.
ENTROPY = 3.5

_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"user", b"login", b"client", b"account", b"access")
_HEX = spans.table([*b"0123456789abcdef"])

Span = tuple[int, int, str]


def random_looking(s: str) -> bool:
    n = len(s)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    return entropy >= ENTROPY and any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


def strong(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def within(parts: list[Span], others: list[Span], scope: list[int]) -> list[bool]:
    """Whether each part has one of `others` in scope, other than itself; scope: where paragraphs start.

    An interval join of one sorted side against the other: of those that start before a
    part's scope ends, the one that ends last decides, or the next if that is the part itself.
    """
    others = sorted(others)
    starts = [o[0] for o in others]
    # The two spans that end last of those up to each: one of them may be the part itself.
    last: list[tuple[Span, Span | None]] = []
    top: Span | None = None
    second: Span | None = None
    for o in others:
        if top is None or o[1] > top[1]:
            top, second = o, top if top is None or top[:2] != o[:2] else second
        elif o[:2] != top[:2] and (second is None or o[1] > second[1]):
            second = o
        last.append((top, second))
    out = []
    for a, b, _ in parts:
        p = bisect.bisect_right(scope, a) - 1
        lo = max(scope[p], a - REACH)
        hi = min(scope[p + 1] if p + 1 < len(scope) else 1 << 62, b + REACH)
        i = bisect.bisect_left(starts, hi)
        out.append(i > 0 and any(o is not None and o[1] > lo and o[:2] != (a, b) for o in last[i - 1]))
    return out


def scan(text: str) -> list[Span]:
    """All spans by start, then kind as listed."""
    found = strong(text)
    ids = [s for s in found if s[2] == "access"]
    accounts = [(m.start(), m.end(), "account") for m in ACCOUNT.finditer(text)]
    if ids or accounts:
        taken = sorted(s[:2] for s in found + accounts)
        first = [t[0] for t in taken]
        furthest = list(itertools.accumulate((t[1] for t in taken), max))

        def free(m: re.Match) -> bool:
            i = bisect.bisect_left(first, m.end())
            return not (i and furthest[i - 1] > m.start())

        bare = [(m.start(), m.end(), "bare") for m in BARE.finditer(text) if free(m) and random_looking(m[0])]
        ends = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
        scope = [0, *(m.end() for m in PARAGRAPH.finditer(text))]
        named = ids + accounts
        bare = [s for s, ok in zip(bare, within(bare, named, scope), strict=True) if ok]
        hidden = [s for s in found if s[2] != "access"] + bare
        accounts = [s for s, ok in zip(accounts, within(accounts, hidden, scope), strict=True) if ok]
        ends = [s for s, x, y in zip(ends, within(ends, ids + accounts, scope), within(ends, hidden, scope), strict=True) if x and y]
        found += bare + accounts + ends
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def needed(run: spans.Run) -> np.ndarray:
    """Documents of the run that can have a finding."""
    out = np.zeros(run.docs, bool)
    a, b = spans.words(_HEX[run.data], run.off)
    out[spans.document_of(a[b - a >= 32], run.off)] = True
    low = run.data.tobytes().lower()
    for word in (*_WORDS, b"akia"):
        at = low.find(word)
        while at >= 0:
            d = int(np.searchsorted(run.off, at, "right")) - 1
            out[d] = True
            at = low.find(word, int(run.off[d + 1]) if at + len(word) <= run.off[d + 1] else at + 1)
    return np.flatnonzero(out)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span, or joined overlapping spans, replaced."""
    out, at = [], 0
    for a, b, _ in found:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


SCHEMA = "found array<struct<kind: string, start: long, end: long>>, base_sha256 string, spans string"


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", redact: bool = False) -> DataFrame:
    """key, found (kind, start, end), the digest of strong spans, spans as text; `redact` adds the text without them.

    With `redact` all columns of docs come along, and `text` is the redacted one; null stays null.
    """
    base.arrow(docs.sparkSession)
    rows = docs if redact else docs.select(F.col(key), F.col(text).cast("string").alias(text))
    empty = hashlib.sha256(b"").hexdigest()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        for batch in batches:
            texts = batch.column(text)
            found: list[list[Span]] = [[]] * len(texts)
            for run in spans.runs(texts):
                for i in (needed(run) + run.first).tolist():
                    found[i] = scan(texts[i].as_py())
            if redact:
                new = [redacted(t, f) if f else t for t, f in zip(texts.to_pylist(), found, strict=True)]
                cols = [pa.array(new, pa.string()) if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
                base.trim()
                continue
            digest = [hashlib.sha256(listed([s for s in f if s[2] in STRONG]).encode()).hexdigest() if f else empty for f in found]
            cols = [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in f] for f in found], kind), pa.array(digest), pa.array([listed(f) for f in found])]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "found", "base_sha256", "spans"])

    if redact:
        return rows.mapInArrow(apply, rows.schema)
    return rows.mapInArrow(apply, f"`{key}` {dict(rows.dtypes)[key]}, {SCHEMA}")
