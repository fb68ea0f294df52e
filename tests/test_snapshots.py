"""Versions of a table: old or new, never half; conflicts; pinned readers."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhire.operators import lifecycle
from tallyhire.sources import snapshots
from tallyhire.sources.schemas import TABLES


def table(spark, n, name="x"):
    return spark.range(n).select("id", F.lit(name).alias("name"))


def content(spark, path, version=None):
    return sorted((r["id"], r["name"]) for r in snapshots.read_snapshot(spark, path, version).collect())


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.current_version(spark, path) == 0
    with pytest.raises(ValueError, match="no version"):
        snapshots.read_snapshot(spark, path)
    assert snapshots.write_snapshot(table(spark, 5), path) == 1
    pinned = snapshots.read_snapshot(spark, path)
    assert snapshots.write_snapshot(table(spark, 3, "y"), path) == 2
    assert pinned.count() == 5 and content(spark, path) == [(k, "y") for k in range(3)] and content(spark, path, 1) == [(k, "x") for k in range(5)]
    assert [r["based_on"] for r in snapshots.manifests(spark, path).orderBy("version").collect()] == [0, 1]
    assert snapshots.expire(spark, path, keep=1) == [1] and content(spark, path) == [(k, "y") for k in range(3)]


def test_a_table_may_be_made_of_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_snapshot(table(spark, 10), path, partition_by=["name"])
    snapshots.update(spark, path, lambda old: old.filter("id % 2 = 0").withColumn("name", F.lit("even")), partition_by=["name"])
    assert content(spark, path) == [(k, "even") for k in range(0, 10, 2)]
    snapshots.update(spark, path, lambda old: old.filter("false"))
    assert content(spark, path) == [] and snapshots.read_snapshot(spark, path).columns == ["id", "name"]


def test_a_writer_that_dies_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_snapshot(table(spark, 5), path)
    dying = table(spark, 1000).repartition(8).withColumn("name", F.when(F.col("id") == 777, F.raise_error(F.lit("killed"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="killed"):
        snapshots.write_snapshot(dying, path)
    table(spark, 99).write.parquet(f"{path}/data/v2-written-but-never-named")
    assert snapshots.current_version(spark, path) == 1 and content(spark, path) == [(k, "x") for k in range(5)]
    assert snapshots.write_snapshot(table(spark, 2), path) == 2 and len(content(spark, path)) == 2


def test_conflicts(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_snapshot(table(spark, 5), path)
    snapshots.write_snapshot(table(spark, 6), path)
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.write_snapshot(table(spark, 7), path, based_on=1)
    calls = []

    def change(old):
        if not calls:  # another writer comes between reading and writing
            snapshots.write_snapshot(table(spark, 8), path)
        calls.append(old.count())
        return old.withColumn("name", F.lit("changed"))

    assert snapshots.update(spark, path, change) == 4
    assert calls == [6, 8] and content(spark, path) == [(k, "changed") for k in range(8)]


def test_update_jobs_in_place(spark, tmp_path):
    """The portal's UPDATE on one table: read, changed and replaced under one path."""
    path = str(tmp_path / "jobs")
    rows = [(k, f"job {k}", "d", Decimal("10.00"), "Oslo", "Full-time", Decimal("1.0"), "dev", "Remote", 1, 7, None, True) for k in range(50)]
    snapshots.write_snapshot(spark.createDataFrame(rows, TABLES["jobs"]), path)
    requests = spark.createDataFrame(
        [(1, 7, 3, "new title", "d", "12.50", "Oslo", "dev", "Full-time", "2", "Remote", False, 1), (2, 8, 4, "stolen", "d", "1", "Oslo", "dev", "Full-time", "2", "Remote", True, 2)],
        "request_id long, actor_user_id long, job_id long, title string, description string, salary string, location string, role string, job_type string, openings string, work_location string, is_active boolean, requested_at long",
    )
    found = []

    def change(jobs):
        new, rejects = lifecycle.update_jobs(jobs, requests)
        found.append(rejects)
        return new

    assert snapshots.update(spark, path, change) == 2
    after = {r["job_id"]: (r["title"], r["salary"], r["is_active"]) for r in snapshots.read_snapshot(spark, path).collect()}
    assert after[3] == ("new title", Decimal("12.50"), False) and after[4][0] == "job 4" and len(after) == 50
    assert [r["reason"] for r in found[0].collect()] == ["not_owner"]
    assert {r["title"] for r in snapshots.read_snapshot(spark, path, 1).collect()} == {f"job {k}" for k in range(50)}
