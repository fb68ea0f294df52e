"""Uploaded files and the audit of stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhire.functions.documents import data_uri, mime_of

MAX_BYTES = 50 * 1024 * 1024


def ingest_files(spark: SparkSession, glob: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """((public_id, path, mime, length, data_uri), rejects (path, length, code, reason)) of the files.

    Larger ones than max_bytes are rejects, and their content is not read. Payloads stay in their rows; nothing shuffles them.
    """
    files = spark.read.format("binaryFile").load(glob)
    name = F.element_at(F.split("path", "/"), -1)
    large = files.filter(F.col("length") > max_bytes).select("path", "length", F.lit(413).alias("code"), F.lit("too_large").alias("reason"))
    return files.filter(F.col("length") <= max_bytes).select(F.sha2("path", 256).alias("public_id"), "path", mime_of(name).alias("mime"), "length", data_uri(name, F.col("content")).alias("data_uri")), large


def referenced(users: DataFrame, companies: DataFrame) -> DataFrame:
    """(public_id) that any resume, picture or logo points to."""
    ids = users.select(F.explode(F.array("resume_public_id", "profile_pic_public_id")).alias("public_id")).union(companies.select("logo_public_id"))
    return ids.filter(F.col("public_id").isNotNull()).distinct()


def orphans(stored: DataFrame, users: DataFrame, companies: DataFrame) -> DataFrame:
    """Stored assets that no row points to."""
    return stored.join(referenced(users, companies), "public_id", "left_anti")
