"""Fill-in-the-middle transformation by a constant-memory two-pass streaming matcher.

A text is a sequence of units, the matches of UNIT from left to right.  The first pass
over a text counts its units; from the count and the document's digest two ranks
are drawn.  The second pass advances a lazy match iterator to both ranks, of which only
the end positions are kept.  No array of units exists at any time: beside the text
itself and its output a worker holds two numbers.

Forms: `plain` (the text as it is), `psm` (prefix, suffix, middle) and `spm` (suffix,
prefix, middle), each part behind its marker.  A text is plain if it is empty or holds a
marker, or if its digest says so.  So markers in an output stand at joints only, and
restore() can rebuild the text from output and form by built-in functions.

The digest of a document is the SHA-256 of seed, colon and decimal key; a null key counts
as empty text, and repeated keys draw alike.  Null texts count as empty.  Every row
gives a row, an empty table none.  Positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: The contract's units and markers.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80
#: Bytes of output after which a batch is handed on.
BYTES = 4 << 20


def count_units(text: str) -> int:
    """First pass."""
    return sum(1 for _ in UNIT.finditer(text))


def ends_at(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first `low` and the first `high` units end, low <= high."""
    units = UNIT.finditer(text)
    first = second = 0
    if low:
        first = second = next(islice(units, low - 1, None)).end()
    if high > low:
        second = next(islice(units, high - low - 1, None)).end()
    return first, second


def draws(key: object, seed: int = SEED) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def transform(key: object, text: str, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and of middle (None if plain), and the output."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends_at(text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output; other columns of docs are left out."""
    base.arrow(docs.sparkSession)
    names = [key, *(base.fresh(docs.select(key), c) for c in ("n", "form", "prefix_chars", "middle_chars", "output"))]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy()
        for batch in batches:
            keys, done, size, out = batch.column(0).to_pylist(), 0, 0, []

            def flush() -> pa.RecordBatch:
                cols = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds[1:], strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(out)), *cols], names=names)  # noqa: B023

            for i, k in enumerate(keys):
                out.append(transform(k, batch.column(1)[i].as_py() or "", seed, rate, spm))
                size += len(out[-1][-1])
                if size >= BYTES:
                    yield flush()
                    done, size, out = i + 1, 0, []
            if out:
                yield flush()
            base.trim()

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    types = [dict(rows.dtypes)[key], "long", "string", "long", "long", "string"]
    return rows.mapInArrow(apply, ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True)))


def restore(output: Column | str, form: Column | str) -> Column:
    """The text from an output and its form; a form that isn't known gives null."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
