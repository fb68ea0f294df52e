"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhire.sources.shipping import ship

__all__ = ["drop_kept", "give_back", "held_out", "keep", "read", "shared_dir", "ship", "small_side", "training_rows"]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a local session (tests) may do without it."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyhire-checkpoints-")
        sc.setCheckpointDir(where)
    return where


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again. Survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tallyhire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(*frames: DataFrame) -> None:
    """Empty the folders of what keep() wrote, once nothing reads it any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            df.sparkSession.range(0).write.mode("overwrite").parquet(file.rpartition("/")[0])


def give_back() -> None:
    """Returns a Python worker's free memory to the system at the end of a task: workers live on while those of the next stage work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def small_side(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A side of a join, few long columns wide: to be broadcast where it has at most so many rows, else shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held_out() -> Column:
    """True for the third of the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents (doc_id, text, y and the other columns of docs).

    They are the rows lowest by a hash of doc_id among those that may be learnt from: a bounded sample that does not
    depend on partitioning. Null labels, null ids and labels other than 0 and 1 are left out; of repeated doc_ids one
    label (the smallest) and one text (the smallest) count.
    """
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # max_rows bounds the broadcast side
    joined = docs.filter(F.col("doc_id").isNotNull()).join(F.broadcast(picked), "doc_id")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = joined.groupBy("doc_id", "y").agg(F.min(F.struct("text", *others)).alias("least"))
    return one.select("doc_id", F.col("least.text").alias("text"), *(F.col("least")[c].alias(c) for c in others), "y")
