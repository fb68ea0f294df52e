"""Company pages, ownership and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

JOB_FIELDS = [
    "job_id", "title", "description", "salary", "location", "job_type", "openings", "role", "work_location", "company_id", "posted_by_recruiter_id", "created_at", "is_active",
]


def companies_of(companies: DataFrame, recruiter_ids: DataFrame) -> DataFrame:
    """Companies of the given recruiters (recruiter_id)."""
    return companies.join(recruiter_ids.select("recruiter_id"), "recruiter_id", "left_semi")


def company_pages(companies: DataFrame, jobs: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Each company with an array of all its jobs, inactive ones too, by job_id; empty without any.

    max_jobs keeps a page to the first so many jobs, ranked before they are collected.
    """
    mine = jobs.select(*JOB_FIELDS)
    if max_jobs is not None:
        mine = mine.withColumn("n", F.row_number().over(Window.partitionBy("company_id").orderBy("job_id"))).filter(F.col("n") <= max_jobs)
    lists = mine.groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct(*JOB_FIELDS))).alias("jobs"))
    page = companies.join(lists, "company_id", "left")
    empty = F.array().cast(page.schema["jobs"].dataType)
    return page.withColumn("jobs", F.coalesce("jobs", empty))


#: Job ids of one range are counted and ranked together.
ID_RANGE = 4096


def company_page_shards(companies: DataFrame, jobs: DataFrame, size: int = 500) -> DataFrame:
    """Each company's page in shards: the company's columns, shard (from 0), n_shards, and an array of at most `size` jobs by job_id.

    A company without jobs has one empty shard. Jobs are ranked within ranges of ids, and each range starts where counts say
    the earlier ones end; so no task ranks or collects all jobs of a company that holds a third of them.
    """
    mine = jobs.select(*JOB_FIELDS).withColumn("id_range", F.floor(F.col("job_id") / ID_RANGE))
    earlier = Window.partitionBy("company_id").orderBy("id_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = mine.groupBy("company_id", "id_range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("company_id", "id_range").orderBy("job_id")) - 1
    ranked = mine.withColumn("place", place).join(starts.select("company_id", "id_range", "start"), ["company_id", "id_range"])
    shard = F.floor((F.col("start") + F.col("place")) / size).cast("int")
    lists = ranked.withColumn("shard", shard).groupBy("company_id", "shard").agg(F.sort_array(F.collect_list(F.struct(*JOB_FIELDS))).alias("jobs"))
    shards = starts.groupBy("company_id").agg(F.ceil(F.sum("n") / size).cast("int").alias("n_shards"))
    page = companies.join(shards, "company_id", "left").join(lists, "company_id", "left")
    empty = F.array().cast(page.schema["jobs"].dataType)
    return page.select(*companies.columns, F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("n_shards", F.lit(1)).alias("n_shards"), F.coalesce("jobs", empty).alias("jobs"))


def owned(rows: DataFrame, parents: DataFrame, key: str, owner: str) -> DataFrame:
    """rows (key, actor_user_id, ...) with `owned`: whether the parent of that key is there and the actor is its owner."""
    mine = parents.select(key, F.col(owner).alias("actor_user_id"), F.lit(True).alias("owned"))
    return rows.join(mine, [key, "actor_user_id"], "left").withColumn("owned", F.coalesce("owned", F.lit(False)))


def fk_orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, reference: str) -> DataFrame:
    """(reference, key): the child's key values that the parent lacks, a row for each child row."""
    missing = child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return missing.select(F.lit(reference).alias("reference"), F.col(child_key).cast("string").alias("key"))


def reference_audit(companies: DataFrame, jobs: DataFrame, applications: DataFrame, users: DataFrame) -> DataFrame:
    """What the three columns without foreign keys refer to in vain."""
    return (
        fk_orphans(companies, "recruiter_id", users, "user_id", "companies.recruiter_id")
        .unionByName(fk_orphans(jobs, "posted_by_recruiter_id", users, "user_id", "jobs.posted_by_recruiter_id"))
        .unionByName(fk_orphans(applications, "applicant_email", users, "email", "applications.applicant_email"))
    )
