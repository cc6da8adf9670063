"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  A stage works on every document that
its predecessor kept.  All but the last return the columns of documents (and any
columns beyond these that came in).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import base
from panelforge.llm.bpe import bpe
from panelforge.llm.decontaminate import contamination, is_contaminated
from panelforge.llm.langid import identify
from panelforge.llm.near_dedup import near_duplicates
from panelforge.llm.secrets import secrets

#: Predictions below this score don't count as any language.  With few languages the winner's
#: share of the pairs lies well above it, so that in practice only "und" is rejected.
LEAST_SCORE = 0.2
#: Bytes of tiles that a worker remembers within a task.
REMEMBERED = 32 << 20


def row_id() -> Column:
    """A row's identity, from its key and whole text; copies of a row share it."""
    return F.xxhash64("doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text has a language, and set lang to it."""
    lang, score = into = base.fresh(docs, "lang_pred"), base.fresh(docs, "score")
    found = identify(docs, docs.where(~base.held_out("doc_id", 5)), keep=True, into=into)
    kept = found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(lang)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates, the one with the smallest id."""
    rid = base.fresh(docs, "rid")
    kept = near_duplicates(docs).where("kept").select(F.col("rid").alias(rid)).distinct()
    rows = docs.withColumn(rid, row_id())
    return rows.join(kept, rid, "left_semi").dropDuplicates([rid]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least a twentieth is a benchmark's."""
    rid = base.fresh(docs, "rid")
    rows = docs.withColumn(rid, row_id())
    bad = contamination(rows, base.table(spark, sf_dir, "benchmark"), key=rid).where(is_contaminated()).select(rid).distinct()
    return rows.join(bad, rid, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    clean = secrets(docs, redact=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the decoded bytes.

    The stages before leave an executor more workers than cores; none holds a vocabulary after its task.
    """
    return bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered=REMEMBERED, hold=False)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", redact_secrets),
    ("bpe", encode),
]
#: Models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs, last = base.table(spark, sf_dir, "documents"), None
    out = f"{base.shared(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{out}/{i}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _delete(spark, last)  # no later stage reads it
        last = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
