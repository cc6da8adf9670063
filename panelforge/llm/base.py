"""What the text operators share: columns, folds, samples, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; operators cut batches further by bytes.
BATCH_ROWS = 1000


def arrow(spark: SparkSession) -> None:
    """Smaller Arrow batches than the default, since a row can hold a very long text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[tuple[str, object], object] = {}


def kept(owner: str, name: object, make: Callable[[], object]) -> object:
    """What a worker holds from task to task for one operator, made where it isn't there."""
    if (owner, name) not in _kept:
        _kept[owner, name] = make()
    return _kept[owner, name]


def tidy(owner: str = "") -> None:
    """At a task's start: forget what this worker holds for other operators, and give freed memory back to the system."""
    import gc

    for k in [k for k in _kept if k[0] != owner]:
        del _kept[k]
    gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the system, so that a worker's size follows what it holds."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def fold(key: str, n: int) -> Column:
    """crc32(key as text) mod n; a null key counts as empty text, which is in fold 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def held_out(key: str, n: int) -> Column:
    return fold(key, n) == 0


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names in spark.checkpoint.dir,
    else the session's checkpoint folder; only where neither is set, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if (held := spark.sparkContext.getCheckpointDir()) is None:
        spark.sparkContext.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        held = spark.sparkContext.getCheckpointDir()
    return held


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the cluster names in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as their query ends, and not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def picked(labels: DataFrame, docs: DataFrame, key: str, label: str, text: str, per_label: int) -> DataFrame:
    """(_k, _y, _t): about per_label keys of each label and their texts, chosen by a hash of the key.

    A key with several labels counts with the smallest, one with several texts with the
    smallest.  Labels are counted first; the hashes below a label's share are then taken where
    they lie, so that no task ranks a label's keys and only chosen keys move.  A little
    more than per_label is taken, for few() to cut exactly.
    """
    keyed = labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).where("_k is not null and _y is not null")
    one = keyed.groupBy("_k").agg(F.min("_y").alias("_y"))
    # Labels are few: a model on the driver has weights for each.
    share = one.groupBy("_y").agg(F.least(F.lit(1.0), F.lit(per_label + 5 * per_label**0.5 + 16) / F.count("*")).alias("_f"))
    few = one.join(F.broadcast(share), "_y").where(F.pmod(F.xxhash64("_k", F.lit(11)), F.lit(1 << 40)) < F.col("_f") * F.lit(float(1 << 40)))
    texts = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    return texts.join(F.broadcast(few.select("_k", "_y")), "_k").groupBy("_k", "_y").agg(F.min("_t").alias("_t"))


def few(rows: list, per_label: int) -> list:
    """Of collected rows with _k, _y and _o (the key's hash), per_label of each label, in order of the key."""
    seen: dict[object, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["_o"], r["_k"])):
        seen[r["_y"]] = seen.get(r["_y"], 0) + 1
        if seen[r["_y"]] <= per_label:
            out.append(r)
    return sorted(out, key=lambda r: r["_k"])


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_o", F.pmod(F.xxhash64("_k", F.lit(11)), F.lit(1 << 40)))
