"""Applying, ranking and deciding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhire.functions.text import fits, is_falsy
from tallyhire.sources.schemas import STATUSES


def first_reason(*checks: tuple[Column, int, str]) -> Column:
    """struct<code, reason> of the first check that fails (a true condition), null if none does."""
    out = None
    for condition, code, reason in checks:
        value = F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, so that it combines before the shuffle; a window would not."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return one.select(*keys, "first.*").select(df.columns)


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*").select(df.columns)


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def none_of(checks: list[tuple[Column, int, str]]) -> Column:
    """Whether no check fails. Unlike `reject IS NULL`, the plan can take it apart and drop rows before the joins that other checks need."""
    out = F.lit(True)
    for condition, _, _ in checks:
        out = out & ~condition
    return out


def with_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests (user_id) with what admission needs of their users, and what their users fail by."""
    who = users.select(
        "user_id", F.col("email").alias("applicant_email"), "resume", "subscription", F.coalesce(F.col("role") != "jobseeker", F.lit(True)).alias("no_seeker"), is_falsy(F.col("resume")).alias("no_resume"),
        (~(fits(F.col("email"), 255) & fits(F.col("resume"), 255))).alias("too_long"),
    )
    return requests.join(who, "user_id", "left")


def admission_checks() -> list[tuple[Column, int, str]]:
    """Checks of the rows of known()."""
    return [
        (F.coalesce("no_seeker", F.lit(True)), 403, "not_jobseeker"),
        (F.coalesce("no_resume", F.lit(True)), 400, "no_resume"),
        (is_falsy(F.col("job_id"), numeric=True), 400, "no_job_id"),
        (F.col("known").isNull(), 404, "job_not_found"),
        (~F.coalesce("is_active", F.lit(False)), 400, "job_inactive"),
        (F.coalesce("too_long", F.lit(False)), 400, "too_long"),
    ]


def known(attempts: DataFrame, users: DataFrame, jobs: DataFrame) -> DataFrame:
    """attempts with what admission needs of users and jobs. Those that with_users() has been given already are not joined with users again."""
    rows = attempts if "no_seeker" in attempts.columns else with_users(attempts, users)
    return rows.join(jobs.select("job_id", "is_active", F.lit(True).alias("known")), "job_id", "left")


def with_subscribed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("subscribed", F.coalesce(F.col("subscription") > F.col("attempted_at"), F.lit(False)))


def checked(attempts: DataFrame, users: DataFrame, jobs: DataFrame) -> DataFrame:
    """attempts (attempt_id, user_id, job_id, attempted_at) with what admission needs, and the first failing check."""
    return with_subscribed(known(attempts, users, jobs).withColumn("reject", first_reason(*admission_checks())))


#: Shards of a key in which its first attempt is looked for, before the shards' firsts are compared.
SHARDS = 32


def refused(rows: DataFrame, keys: list[str], existing: DataFrame | None) -> DataFrame:
    """The rejects among checked attempts: those that fail a check, and valid ones after their key's first.

    Rows are read once and stay where the join with jobs has put them, if job_id is in keys. Else a key's attempts are
    compared in shards and then only the shards' firsts with each other, so no task holds a busy applicant's whole log.
    """
    rows = rows.select("attempt_id", "job_id", "user_id", "applicant_email", "attempted_at", "reject").withColumn("first", F.col("reject").isNull())
    for by in [keys] if "job_id" in keys else [[*keys, F.pmod(F.xxhash64("attempt_id"), F.lit(SHARDS))], keys]:
        spread = F.when(F.col("first"), F.lit(0)).otherwise(F.xxhash64("attempt_id"))  # the others need no company
        least = F.min(F.when(F.col("first"), F.struct("attempted_at", "attempt_id"))).over(Window.partitionBy(*by, spread))
        rows = rows.withColumn("least", least).withColumn("first", F.col("first") & F.coalesce(F.col("attempt_id") == F.col("least.attempt_id"), F.lit(False)))
    if existing is not None:
        held = existing.select(*keys, F.lit(True).alias("held")).distinct()
        rows = rows.join(held, keys, "left").withColumn("first", F.col("first") & F.col("held").isNull())
    duplicate = F.struct(F.lit(409).alias("code"), F.lit("duplicate").alias("reason"))
    rows = rows.filter(~F.col("first")).withColumn("reject", F.coalesce("reject", duplicate))
    return rows.select("attempt_id", "job_id", "user_id", "reject.code", "reject.reason")


def admit(attempts: DataFrame, users: DataFrame, jobs: DataFrame, existing: DataFrame | None = None, scope: str = "declared") -> tuple[DataFrame, DataFrame]:
    """(applications, rejects): the attempts in order of (attempted_at, attempt_id), judged as if one after the other.

    scope 'declared': one application for each (job, email); 'literal': one for each applicant, as the stored key has it.
    existing: applications made before (job_id, applicant_email). Each attempt is in exactly one of the results; an
    attempt_id that repeats within a key counts as one attempt.
    """
    keys = {"declared": ["job_id", "applicant_email"], "literal": ["applicant_email"]}[scope]
    valid = with_subscribed(known(attempts, users, jobs).filter(none_of(admission_checks())))
    firsts = dedup_first(valid.select("attempt_id", "job_id", "applicant_email", "resume", "attempted_at", "subscribed"), keys, ["attempted_at", "attempt_id"])
    if existing is not None:
        firsts = firsts.join(existing.select(*keys).distinct(), keys, "left_anti")
    new = firsts.select(F.col("attempt_id").alias("application_id"), "job_id", "applicant_email", F.lit("Submitted").alias("status"), "resume", F.col("attempted_at").alias("applied_at"), "subscribed")
    return new, refused(checked(attempts, users, jobs), keys, existing)


def applicant_queue(applications: DataFrame, k: int | None = None) -> DataFrame:
    """Applications with their place in their job's queue: subscribers first (null before true), then by time.

    With k, only the first k of each job: the plan prunes them before the shuffle. Without, a job's queue is ranked in
    parts, by subscription and hour, and each part starts where counts say the earlier ones end; so no task ranks a whole
    viral job, nor its whole best day.
    """
    if k is not None:
        order = Window.partitionBy("job_id").orderBy(F.desc_nulls_first("subscribed"), F.asc_nulls_last("applied_at"), "application_id")
        return applications.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    kind = F.when(F.col("subscribed").isNull(), 0).when(F.col("subscribed"), 1).otherwise(2)
    hour = F.coalesce(F.date_diff("applied_at", F.lit("1970-01-01")) * 24 + F.hour("applied_at"), F.lit(2**31 - 1))
    rows = applications.withColumn("queue_kind", kind).withColumn("queue_hour", hour)
    part = ["job_id", "queue_kind", "queue_hour"]
    before = Window.partitionBy("job_id").orderBy("queue_kind", "queue_hour").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*part).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(F.asc_nulls_last("applied_at"), "application_id"))
    ranked = rows.withColumn("nth", inside).join(starts, part)
    return ranked.withColumn("place", F.col("start") + F.col("nth")).select(*applications.columns, "place")


def my_applications(applications: DataFrame, jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Each user's applications, found by email, with job_title, job_salary and job_location; inactive jobs too."""
    what = jobs.select("job_id", F.col("title").alias("job_title"), F.col("salary").alias("job_salary"), F.col("location").alias("job_location"))
    who = users.select("user_id", F.col("email").alias("applicant_email"))
    return applications.join(who, "applicant_email").join(what, "job_id")


def decide(applications: DataFrame, jobs: DataFrame, users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new applications, decisions, rejects) for requests (request_id, actor_user_id, application_id, status, requested_at).

    Any of STATUSES may follow any other; the last request for an application holds. Every accepted request is a decision,
    changed or not, and so sends a mail. Who does not own the job learns no more than that it is not found.
    """
    recruiters = users.filter("role = 'recruiter'").select(F.col("user_id").alias("actor_user_id"), F.lit(True).alias("recruits")).distinct()
    asked = requests.join(recruiters, "actor_user_id", "left")
    what = jobs.select("job_id", F.col("title").alias("job_title"), F.col("posted_by_recruiter_id").alias("owner"))
    held = applications.join(what, "job_id", "left").withColumn("found", F.col("applicant_email").isNotNull()).withColumn("posted", F.col("job_title").isNotNull())
    barred = (~F.coalesce("recruits", F.lit(False)), 403, "not_recruiter")
    bad = (~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), 400, "bad_status")
    reject = first_reason(
        barred,
        (~F.coalesce("found", F.lit(False)), 404, "application_not_found"),
        (~F.coalesce("posted", F.lit(False)), 404, "job_not_found"),
        (F.coalesce(F.col("owner") != F.col("actor_user_id"), F.lit(True)), 404, "not_owner"),
        bad,
    )
    rows = asked.join(held.select("application_id", "job_id", "applicant_email", "job_title", "owner", "found", "posted"), "application_id", "left").withColumn("reject", reject)
    decisions = rows.filter(F.col("reject").isNull()).select("request_id", "application_id", "applicant_email", "job_id", "job_title", "status", "requested_at")
    # An actor's last request for an application is known before the two meet, and counts where the actor owns the job. The
    # checks are no filter: where requests are made of applications, it would reach into these, and the plan would make them twice.
    sound = F.when(none_of([barred, bad]), F.struct("requested_at", "request_id", "status"))
    last = asked.groupBy("application_id", F.col("actor_user_id").alias("owner")).agg(F.max(sound).alias("last"))
    changed = F.when(F.col("found") & F.col("posted"), F.col("last.status"))
    updated = held.join(last, ["application_id", "owner"], "left").withColumn("status", F.coalesce(changed, "status")).select(applications.columns)
    return updated, decisions, rows.filter(F.col("reject").isNotNull()).select("request_id", "reject.code", "reject.reason")
