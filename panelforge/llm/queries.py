"""The contract's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .bpe import bpe
from .decontaminate import contamination, is_contaminated
from .fill_middle import fill_in_middle, restore
from .jaccard_join import ngram_components
from .langid import identify
from .near_dedup import near_duplicates
from .oracles import ORACLES
from .quality import CUT, quality
from .secrets import secrets
from .spelling import spelling_variants
from .suffix_tree import lm_scores
from .token_counts import token_counts
from .toxicity import toxicity
from .topk import top_k


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(base.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = base.table(spark, sf_dir, "labels").where(~base.held_out("doc_id", 5))
    found = toxicity(base.table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", base.held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_k(base.table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
    return best.withColumnRenamed("id", "vec_id")


def op4_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    found = identify(docs, docs.where(~base.held_out("doc_id", 5)))
    return found.select("doc_id", base.held_out("doc_id", 5).alias("held_out"), "lang_pred", "score")


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), is_contaminated().alias("contaminated"))


def op6_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = base.table(spark, sf_dir, "labels").where(~base.held_out("doc_id", 5))
    found = quality(base.table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", base.held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op7_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(base.table(spark, sf_dir, "documents")).drop("rid")


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    found = lm_scores(docs, ~base.held_out("doc_id", 10))
    return found.select("doc_id", base.held_out("doc_id", 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(base.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op10_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(base.table(spark, sf_dir, "documents"))
    kinds = F.col("found.kind")
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, "base_sha256", "spans")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(base.table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(base.table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    again = restore("output", "form")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(base.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
