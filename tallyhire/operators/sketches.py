"""Sketches that are kept as tables and merged upward, so that larger groups and longer spans need no second look at the rows.

Both kinds have a bounded size whatever they have seen: HyperLogLog for distinct applicants, KLL for quantiles of scores. A
new day's rows make new sketches, which are appended to the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a HyperLogLog's register number: a relative error of about 0.8 % (one deviation), 16 KB at most.
LG_K = 14
#: Of KLL: a rank error of about 0.7 % in 99 of 100 cases.
KLL_K = 400


def applicant_sketches(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """(recruiter_id, company_id, job_id, day, sketch): the distinct applicants of each job and day; day is null where applied_at is."""
    where = jobs.select("job_id", "company_id", F.col("posted_by_recruiter_id").alias("recruiter_id"))
    rows = applications.select("job_id", F.to_date("applied_at").alias("day"), "applicant_email")
    # sketched by job first: a few bytes for each job and day meet the jobs, not the applications
    by_job = rows.groupBy("job_id", "day").agg(F.hll_sketch_agg("applicant_email", LG_K).alias("sketch"))
    return by_job.join(where, "job_id").select("recruiter_id", "company_id", "job_id", "day", "sketch")


def united(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, sketch): sketches of larger groups, united from those of their parts."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def applicants(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, applicants): about how many different applicants each group has."""
    return united(sketches, *by).select(*by, F.hll_sketch_estimate("sketch").alias("applicants"))


def score_sketches(ats: DataFrame, day: str | None = None) -> DataFrame:
    """(dimension, day, sketch) of parsed ATS documents (doc, and a column with their day, if named), the total as dimension 'total'."""
    when = F.lit(None).cast("date") if day is None else F.col(day)
    rows = ats.select("doc", when.alias("day"))
    parts = rows.select("day", F.explode(F.map_entries("doc.scoreBreakdown")).alias("e")).select(F.col("e.key").alias("dimension"), "day", F.col("e.value.score").alias("score"))
    total = rows.select(F.lit("total").alias("dimension"), "day", F.col("doc.atsScore").alias("score"))
    scores = parts.unionByName(total).filter(F.col("score").isNotNull())
    return scores.groupBy("dimension", "day").agg(F.kll_sketch_agg_bigint(F.col("score").cast("long"), F.lit(KLL_K)).alias("sketch"))


def merged_scores(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", F.lit(KLL_K)).alias("sketch"))


def score_quantiles(sketches: DataFrame, *by: str, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(by, n, quantiles): how many scores each group has, exactly, and about their quantiles, in the order of `at`."""
    found = merged_scores(sketches, *by)
    return found.select(*by, F.kll_sketch_get_n_bigint("sketch").alias("n"), F.kll_sketch_get_quantile_bigint("sketch", F.array(*map(F.lit, at))).alias("quantiles"))
