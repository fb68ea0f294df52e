"""Readers and writers of tables: Parquet paths or JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhire.sources.jdbc import read_in_parts
from tallyhire.sources.schemas import KEYS, TABLES

#: The whole-number column that a table is read in parts by, and what a key with very many rows is dealt by.
WHOLE_KEYS = {"users": "user_id", "skills": "skill_id", "user_skills": "user_id", "companies": "company_id", "jobs": "job_id", "applications": "job_id"}
SPREAD = {"user_skills": '"skill_id"', "applications": 'LENGTH("applicant_email") + LENGTH("application_id")'}


def read_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """A portal table with its fixed schema; a password column is never read.

    jdbc: Spark's JDBC options. With parts, the table is read in about so many partitions of about one size (see
    sources.jdbc); else with lowerBound, upperBound and numPartitions, in equal ranges of its key.
    """
    schema = TABLES[name]
    if path is not None:
        return spark.read.schema(schema).parquet(path)
    if parts is not None:
        found = read_in_parts(spark, {k: v for k, v in (jdbc or {}).items() if k != "dbtable"}, (jdbc or {}).get("dbtable", name), WHOLE_KEYS[name], parts, SPREAD.get(name))
        return found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
    options = {"dbtable": name} | (jdbc or {})
    if "numPartitions" in options:
        options.setdefault("partitionColumn", KEYS[name][0])
    return spark.read.format("jdbc").options(**options).load().select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Whole-table replacement. Write to a new path when df reads the old one."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object that keeps its null fields."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
