"""Sketches against exact answers, merged upward and grown by days."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyhire.operators import sketches


def applied(spark, n=120_000):
    """Job 0 has half of all applications; applicants come back, on other days and at other jobs."""
    h = lambda k: F.abs(F.xxhash64("id", F.lit(k)))
    job = F.when(h(1) % 2 == 0, 0).otherwise(h(2) % 40)
    day = F.date_add(F.lit("1995-01-01").cast("date"), (h(3) % 9).cast("int"))
    return spark.range(n).select(job.cast("long").alias("job_id"), F.concat(F.lit("u"), (h(4) % 30_000).cast("string")).alias("applicant_email"), day.cast("timestamp_ntz").alias("applied_at"))


def test_united_sketches_are_close(spark):
    rows = applied(spark)
    jobs = spark.range(45).select(F.col("id").alias("job_id"), (F.col("id") % 6).alias("company_id"), (F.col("id") % 2).alias("posted_by_recruiter_id"))
    kept = sketches.applicant_sketches(rows, jobs).cache()
    where = rows.join(jobs.withColumnRenamed("posted_by_recruiter_id", "recruiter_id"), "job_id").withColumn("day", F.to_date("applied_at"))
    for by in (["job_id"], ["company_id"], ["recruiter_id"], ["recruiter_id", "day"], []):
        exact = {tuple(r[b] for b in by): r["n"] for r in where.groupBy(*by).agg(F.count_distinct("applicant_email").alias("n")).collect()}
        got = {tuple(r[b] for b in by): r["applicants"] for r in sketches.applicants(kept, *by).collect()}
        assert got.keys() == exact.keys() and all(abs(got[k] - n) <= max(1, 0.03 * n) for k, n in exact.items()), by
    # united from days or built at once: the estimators differ by a trifle
    at_once = rows.groupBy("job_id").agg(F.hll_sketch_agg("applicant_email", sketches.LG_K).alias("sketch"))
    once, by_days = ({r["job_id"]: r["applicants"] for r in sketches.applicants(s, "job_id").collect()} for s in (at_once, kept))
    assert once.keys() == by_days.keys() and all(abs(by_days[k] - n) <= 1 + 0.005 * n for k, n in once.items())


def test_days_are_appended(spark):
    jobs = spark.range(45).select(F.col("id").alias("job_id"), F.lit(1).alias("company_id"), F.lit(1).alias("posted_by_recruiter_id"))
    rows, early = applied(spark, 20_000), F.col("applied_at") < F.lit("1995-01-05").cast("timestamp_ntz")
    grown = sketches.applicant_sketches(rows.filter(early), jobs).unionByName(sketches.applicant_sketches(rows.filter(~early), jobs))
    once, by_days = ({r["job_id"]: r["applicants"] for r in sketches.applicants(s, "job_id").collect()} for s in (sketches.applicant_sketches(rows, jobs), grown))
    assert once.keys() == by_days.keys() and all(abs(by_days[k] - n) <= 1 + 0.02 * n for k, n in once.items())
    assert sketches.applicants(sketches.applicant_sketches(rows.limit(0), jobs), "job_id").count() == 0


def test_merged_quantiles_hold_their_rank(spark):
    """Skewed scores: most are 90 and more, a tail reaches down to 0."""
    n, days = 60_000, 7
    score = F.when(F.rand(4) < 0.8, 90 + F.floor(F.rand(5) * 11)).otherwise(F.floor(F.pow(F.rand(6), 3.0) * 90)).cast("int")
    doc = F.struct(score.alias("atsScore"), F.map_from_arrays(F.array(F.lit("keywords")), F.array(F.struct((F.col("id") % 50).cast("int").alias("score"), F.lit("f").alias("feedback")))).alias("scoreBreakdown"))
    ats = spark.range(n).select(doc.alias("doc"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") % days).cast("int")).alias("day")).cache()
    kept = sketches.score_sketches(ats, "day")
    assert kept.count() == 2 * days
    at = (0.01, 0.1, 0.25, 0.5, 0.9, 0.99)
    found = {r["dimension"]: r for r in sketches.score_quantiles(kept, "dimension", at=at).collect()}
    assert {d: r["n"] for d, r in found.items()} == {"total": n, "keywords": n}
    exact = np.sort([r[0] for r in ats.select("doc.atsScore").collect()])
    for q, v in zip(at, found["total"]["quantiles"], strict=True):
        below, upto = np.searchsorted(exact, v, "left") / n, np.searchsorted(exact, v, "right") / n
        assert below - 0.015 <= q <= upto + 0.015
    assert sketches.score_quantiles(sketches.score_sketches(ats.limit(0), "day"), "dimension").count() == 0
