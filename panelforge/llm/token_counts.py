"""Token counts of whole texts by a public tokenizer, lengths only.

Arrow batches are cut into runs of about 4 MB of text, whatever their number of
rows.  For a byte-level vocabulary each run is split at places that no token
crosses (spans.tiles), a tile that the worker does not remember goes through the library's
batch encoder once, and a text's count is the sum over its tiles; so a very long text is
encoded in pieces wherever it has such a place (a text without any lone space, like one
base64 string, is one tile).  A tile is known by its bytes.  Other kinds of vocabulary
(sentencepiece, word-end BPE) get whole texts in the same byte-balanced batches.

Null and empty texts have 0 bytes and 0 tokens.  Repeated rows are counted each on
their own; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, spans

SCHEMA = "n_bytes long, n_tokens long"
OWNER = "token counts"
#: Texts are given to the batch encoder up to so many bytes at a time.
ENCODE_BYTES = 1 << 20


@functools.lru_cache(maxsize=4)
def _lengths(path: str) -> tuple[bool, Callable[[list[str]], list[int]]]:
    """Whether tiles may be counted one by one, and a counter of a list of texts."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return False, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = plain and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) for a in spec["added_tokens"])
    return plain, lambda texts: [len(x) for x in tok.encode_batch(texts, add_special_tokens=False)]


def _balanced(texts: list[str], count: Callable[[list[str]], list[int]]) -> list[int]:
    out: list[int] = []
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= ENCODE_BYTES:
            out += count(held)
            held, size = [], 0
    return out + count(held) if held else out


def count_column(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """n_bytes and n_tokens of each text."""
    tiled, count = _lengths(path)
    memo = base.kept(OWNER, path, spans.Memo)
    tokens = []
    for run in spans.runs(texts):
        raw = run.data.tobytes()
        if not tiled:
            tokens.append(_balanced([raw[a:b].decode() for a, b in zip(run.off[:-1], run.off[1:], strict=True)], count))
            continue
        a, b = spans.tiles(run.data, run.off)
        codes, first = spans.distinct_spans(run.data, a, b)
        tiles = [raw[i:j] for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True)]
        lengths = memo.fill(tiles, lambda new, tiles=tiles: [(n, 32) for n in _balanced([tiles[i].decode() for i in new], count)])
        tokens.append(spans.sums(np.asarray(lengths, np.float64)[codes], spans.document_of(a, run.off), run.docs) if len(a) else np.zeros(run.docs, np.int64))
    _, off = spans.column(texts)
    return np.diff(off), np.concatenate(tokens).astype(np.int64) if tokens else np.zeros(0, np.int64)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8) and n_tokens of every row."""
    base.arrow(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.tidy(OWNER)
        for batch in batches:
            n_bytes, n_tokens = count_column(batch.column(1), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], names=[key, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(count, f"`{key}` {dict(rows.dtypes)[key]}, {SCHEMA}")
