"""Parallel reads of a database: the one in Spark's own jars, in memory."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyhire.sources import jdbc
from tallyhire.sources.io import WHOLE_KEYS, read_table
from tallyhire.sources.portal import Portal
from tallyhire.sources.schemas import TABLES

DATA = "/root/testdata/sf0.001"
OPTIONS = {"url": "jdbc:derby:memory:portal;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def store(df, name):
    df.write.jdbc(OPTIONS["url"], name, mode="overwrite", properties={k: v for k, v in OPTIONS.items() if k != "url"})


def sizes(df):
    return [n for n in (r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())]


@pytest.mark.parametrize("name", sorted(WHOLE_KEYS))
def test_read_equals_parquet(spark, tmp_path, name):
    portal = Portal(spark, DATA)
    rows = getattr(portal, name)().select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields))
    rows.write.parquet(str(tmp_path / name))
    want = read_table(spark, name, path=str(tmp_path / name))
    store(want, name)
    found = read_table(spark, name, jdbc=OPTIONS, parts=4)
    assert found.schema.simpleString() == want.schema.simpleString()
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    if want.count() >= 200:
        each = sizes(found)
        assert len(each) >= 3 and max(each) <= 2 * min(each), each
    plain = read_table(spark, name, jdbc=OPTIONS)
    assert plain.count() == want.count()


def test_skewed_keys_are_balanced(spark):
    """Equal ranges of this key would put nearly all rows into one part."""
    rows = spark.range(20_000).select((F.col("id") * F.col("id") * F.col("id") + F.when(F.col("id") % 2 == 0, 10**14).otherwise(0)).alias("k"), F.col("id").alias("v"))
    rows = rows.unionByName(spark.range(37).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v")))
    store(rows, "skewed")
    found = jdbc.read_in_parts(spark, OPTIONS, "skewed", "k", 8)
    each = sizes(found.filter("k IS NOT NULL"))
    assert found.exceptAll(rows).isEmpty() and found.count() == rows.count()
    assert 7 <= len(each) <= 9 and max(each) <= 2 * min(each), each


def test_hot_key_is_dealt_out(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("v"))
    store(rows, "hot")
    found = jdbc.read_in_parts(spark, OPTIONS, "hot", "k", 10, spread='"v" / 3')
    each = sizes(found)
    assert found.exceptAll(rows).isEmpty() and found.count() == 6000 and max(each) <= 1000, each


def test_empty_and_null_keys(spark):
    store(spark.createDataFrame([], "k long, v long"), "no_rows")
    assert jdbc.read_in_parts(spark, OPTIONS, "no_rows", "k", 4).count() == 0
    store(spark.createDataFrame([(None, 1), (None, 2)], "k long, v long"), "null_keys")
    assert sorted(r["v"] for r in jdbc.read_in_parts(spark, OPTIONS, "null_keys", "k", 4).collect()) == [1, 2]
