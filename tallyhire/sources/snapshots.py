"""Whole-table replacement that readers never see half done.

A table is a folder of versions. A new version's rows are written beside the old ones; then a manifest of one row names
them, and appears by the one rename with which Spark commits its file. Readers take the newest manifest and stay with its
version, whatever is written meanwhile. A writer that dies leaves files that no manifest names.

Only Spark reads and writes here, so any store that it knows will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, folder string, schema string, based_on long, written_at timestamp"


class SnapshotConflict(RuntimeError):
    """Another writer has replaced the version that a change was based on."""


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(version, folder, schema, based_on, written_at), a row for each version; empty where there is no table yet."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{path}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current_version(spark: SparkSession, path: str) -> int:
    """The newest version, 0 without any."""
    return manifests(spark, path).agg(F.max("version")).first()[0] or 0


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the newest), which stay the same however often the table is replaced later."""
    found = manifests(spark, path)
    wanted = F.max_by(F.struct("folder", "schema"), "version")
    row = (found if version is None else found.filter(F.col("version") == version)).agg(wanted.alias("x")).first()["x"]
    if row is None:
        raise ValueError(f"{path} has no version {version or ''}".rstrip())
    return spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).parquet(f"{path}/data/{row['folder']}")


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None, based_on: int | None = None) -> int:
    """Replaces a table and returns its new version. df may read the version that it replaces.

    based_on: the version that df was made from; SnapshotConflict if another one is there when the rows are written.
    """
    spark = df.sparkSession
    before = current_version(spark, path) if based_on is None else based_on
    version, folder = before + 1, f"v{before + 1}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data/{folder}")
    if current_version(spark, path) != before:
        raise SnapshotConflict(f"{path}: version {before} is no longer the newest")
    row = spark.createDataFrame([(version, folder, df.schema.json(), before)], "version long, folder string, schema string, based_on long").withColumn("written_at", F.current_timestamp())
    try:
        row.coalesce(1).write.mode("errorifexists").json(f"{path}/manifests/{version:012d}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise SnapshotConflict(f"{path}: version {version} was written by another") from None
    return version


def update(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], partition_by: list[str] | None = None, attempts: int = 3) -> int:
    """Replaces a table by what change makes of it; begins again with the newest version if another writer was faster."""
    for left in reversed(range(attempts)):
        version = current_version(spark, path)
        try:
            return write_snapshot(change(read_snapshot(spark, path, version)), path, partition_by, based_on=version)
        except SnapshotConflict:
            if not left:
                raise
    raise AssertionError("unreachable")


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Empties the folders of all but the newest `keep` versions, which readers must be done with; returns these versions."""
    old = [(r["version"], r["folder"]) for r in manifests(spark, path).orderBy(F.desc("version")).collect()[keep:]]
    for _, folder in old:
        spark.range(0).write.mode("overwrite").parquet(f"{path}/data/{folder}")
    return sorted(version for version, _ in old)
