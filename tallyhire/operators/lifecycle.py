"""Batches of create, update and delete requests.

Each operator returns the new state and rejects (request_id, code, reason); every request is accounted for once. Checks
run in a fixed order and the first failing one is the reason. Requests of a batch count in order of (requested_at,
request_id).
"""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhire.functions.text import decimal_or_null, fits, is_falsy, or_else
from tallyhire.operators.applications import dedup_first, first_reason, latest_by
from tallyhire.sources.schemas import FOREIGN_KEYS, JOB_TYPES, WORK_LOCATIONS

ORDER = ["requested_at", "request_id"]


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejects) by the column reject."""
    return rows.filter(F.col("reject").isNull()).drop("reject"), rows.filter(F.col("reject").isNotNull()).select("request_id", "reject.code", "reject.reason")


def new_ids(rows: DataFrame, key: str, natural: list[str], taken: DataFrame) -> DataFrame:
    """rows with ids that follow the largest one taken: counts by part of a hash give each part its start, so no task numbers all rows."""
    part = F.pmod(F.xxhash64(*natural), F.lit(256))
    rows = rows.withColumn("part", part)
    starts = rows.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    top = taken.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*natural))).join(F.broadcast(starts), "part")
    return numbered.join(F.broadcast(top)).withColumn(key, (F.col("top") + F.col("start") + F.col("n")).cast("long")).drop("part", "n", "start", "top")


def unique_in_batch(rows: DataFrame, keys: list[str], code: int, reason: str) -> DataFrame:
    """rows whose later repeats of a key among the accepted ones get a reject as well."""
    good = rows.filter(F.col("reject").isNull())
    first = dedup_first(good.select(*keys, *ORDER), keys, ORDER).select(*keys, F.col("request_id").alias("first_request"))
    marked = rows.join(first, keys, "left")
    late = F.col("reject").isNull() & (F.col("request_id") != F.col("first_request"))
    return marked.withColumn("reject", F.when(late, F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))).otherwise(F.col("reject"))).drop("first_request")


def too_long(**limits: int) -> Column:
    """Whether one of the columns has more characters than its limit."""
    out = F.lit(False)
    for name, limit in limits.items():
        out = out | ~fits(F.col(name), limit)
    return out


def register_users(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: request_id, name, email, phone_number, role, bio, resume, resume_public_id, requested_at."""
    known = users.select("email", F.lit(True).alias("taken")).distinct()
    rows = requests.join(known, "email", "left")
    missing = is_falsy(F.col("name")) | is_falsy(F.col("email")) | is_falsy(F.col("phone_number")) | is_falsy(F.col("role"))
    rows = rows.withColumn("reject", first_reason(
        (missing, 400, "missing_field"),
        (F.coalesce("taken", F.lit(False)), 409, "email_exists"),
        (~F.col("role").isin("jobseeker", "recruiter"), 400, "invalid_role"),
        ((F.col("role") == "jobseeker") & is_falsy(F.col("resume")), 400, "no_resume"),
        (too_long(name=255, email=255, phone_number=20, resume=255, resume_public_id=255), 400, "too_long"),
    )).drop("taken")
    good, rejects = split(unique_in_batch(rows, ["email"], 409, "email_exists"))
    seeker = F.col("role") == "jobseeker"
    new = new_ids(good, "user_id", ["email"], users).select(
        "user_id", "name", "email", "phone_number", "role", F.when(seeker, F.coalesce("bio", F.lit(""))).alias("bio"), F.when(seeker, F.col("resume")).alias("resume"),
        F.when(seeker, F.col("resume_public_id")).alias("resume_public_id"), F.lit(None).cast("string").alias("profile_pic"), F.lit(None).cast("string").alias("profile_pic_public_id"),
        F.col("requested_at").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("subscription"),
    )
    return users.select(new.columns).unionByName(new), rejects


def with_role(requests: DataFrame, users: DataFrame) -> DataFrame:
    return requests.join(users.select(F.col("user_id").alias("actor_user_id"), F.col("role").alias("actor_role")), "actor_user_id", "left")


def not_recruiter() -> Column:
    return F.coalesce(F.col("actor_role") != "recruiter", F.lit(True))


def create_companies(companies: DataFrame, users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: request_id, actor_user_id, name, description, website, logo, logo_public_id, requested_at."""
    rows = with_role(requests, users).join(companies.select("name", F.lit(True).alias("taken")).distinct(), "name", "left")
    rows = rows.withColumn("reject", first_reason(
        (not_recruiter(), 403, "not_recruiter"),
        (is_falsy(F.col("name")) | is_falsy(F.col("description")) | is_falsy(F.col("website")), 409, "missing_field"),
        (F.coalesce("taken", F.lit(False)), 409, "name_exists"),
        (is_falsy(F.col("logo")), 400, "no_logo"),
        (F.col("logo_public_id").isNull(), 400, "no_logo"),
        (too_long(name=255, website=255, logo=255, logo_public_id=255), 400, "too_long"),
    )).drop("taken")
    good, rejects = split(unique_in_batch(rows, ["name"], 409, "name_exists"))
    new = new_ids(good, "company_id", ["name"], companies).select("company_id", "name", "description", "website", "logo", "logo_public_id", F.col("actor_user_id").alias("recruiter_id"), F.col("requested_at").alias("created_at"))
    return companies.select(new.columns).unionByName(new), rejects


def job_checks() -> list[tuple[Column, int, str]]:
    """What the table refuses: enumerations, decimals, lengths."""
    return [
        (~F.coalesce(F.col("job_type").isin(JOB_TYPES), F.lit(False)), 400, "bad_job_type"),
        (~F.coalesce(F.col("work_location").isin(WORK_LOCATIONS), F.lit(False)), 400, "bad_work_location"),
        (F.col("salary").isNotNull() & decimal_or_null(F.col("salary"), 10, 2).isNull(), 400, "bad_salary"),
        (decimal_or_null(F.col("openings"), 3, 1).isNull(), 400, "bad_openings"),
        (too_long(title=255, location=255, role=255), 400, "too_long"),
    ]


def judged_jobs(companies: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Creation requests with the column reject."""
    owned = companies.select("company_id", F.col("recruiter_id").alias("actor_user_id"), F.lit(True).alias("owned"))
    rows = with_role(requests, users).join(owned, ["company_id", "actor_user_id"], "left")
    texts = [F.col(c) for c in ("title", "description", "location", "role")]
    missing = is_falsy(F.col("salary"), numeric=True) | is_falsy(F.col("openings"), numeric=True)
    for c in texts:
        missing = missing | is_falsy(c)
    return rows.withColumn("reject", first_reason((not_recruiter(), 403, "not_recruiter"), (missing, 409, "missing_field"), (F.col("owned").isNull(), 404, "company_not_found"), *job_checks())).drop("owned")


def create_jobs(jobs: DataFrame, companies: DataFrame, users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: request_id, actor_user_id, the jobs' columns without ids, company_id, requested_at."""
    good, rejects = split(judged_jobs(companies, users, requests))
    new = new_ids(good, "job_id", ["request_id"], jobs).select(
        "job_id", "title", "description", decimal_or_null(F.col("salary"), 10, 2).alias("salary"), "location", "job_type", decimal_or_null(F.col("openings"), 3, 1).alias("openings"), "role", "work_location",
        "company_id", F.col("actor_user_id").alias("posted_by_recruiter_id"), F.col("requested_at").alias("created_at"), F.lit(True).alias("is_active"),
    )
    return jobs.select(new.columns).unionByName(new), rejects


JOB_UPDATE = ["title", "description", "salary", "location", "role", "job_type", "openings", "work_location", "is_active"]


def update_jobs(jobs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces nine columns of the owner's job (job_id, actor_user_id); the last request for a job holds whole.

    The table takes no null title, description or role.
    """
    rows = requests.join(jobs.select("job_id", F.col("posted_by_recruiter_id").alias("owner")), "job_id", "left")
    nulls = F.col("title").isNull() | F.col("description").isNull() | F.col("role").isNull()
    rows = rows.withColumn("reject", first_reason((F.col("owner").isNull(), 404, "job_not_found"), (F.coalesce(F.col("owner") != F.col("actor_user_id"), F.lit(True)), 403, "not_owner"), (nulls, 400, "null_field"), *job_checks()))
    good, rejects = split(rows)
    last = latest_by(good.select("job_id", *JOB_UPDATE, *ORDER), ["job_id"], ORDER).select("job_id", F.struct(*JOB_UPDATE).alias("new"))
    kinds = dict(jobs.dtypes)
    new = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}").try_cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in JOB_UPDATE else F.col(c) for c in jobs.columns]
    return jobs.join(last, "job_id", "left").select(new), rejects


def of_users(requests: DataFrame, users: DataFrame, *more: tuple[Column, int, str]) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, rejects): unknown users are rejected, and what `more` says."""
    rows = requests.join(users.select("user_id", F.lit(True).alias("known")), "user_id", "left")
    return split(rows.withColumn("reject", first_reason((F.col("known").isNull(), 404, "user_not_found"), *more)).drop("known"))


def update_profiles(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users, rejects) for requests (request_id, user_id, name, phone_number, bio, requested_at).

    Each of the three keeps its value unless an accepted request gives a non-empty one; the last such holds.
    """
    fields = ["name", "phone_number", "bio"]
    good, rejects = of_users(requests, users, (too_long(name=255, phone_number=20), 400, "too_long"))
    given = [F.max_by(F.nullif(c, F.lit("")), F.when(F.nullif(c, F.lit("")).isNotNull(), F.struct(*ORDER))).alias(f"new_{c}") for c in fields]
    merged = good.groupBy("user_id").agg(*given)
    new = [or_else(F.col(f"new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in users.columns]
    return users.join(merged, "user_id", "left").select(new), rejects


def replace_files(users: DataFrame, requests: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(users, rejects): overwrites (resume, resume_public_id) or (profile_pic, profile_pic_public_id).

    requests: request_id, user_id, url, public_id, requested_at; the last accepted one for a user holds.
    """
    pair = {"resume": ("resume", "resume_public_id"), "profile_pic": ("profile_pic", "profile_pic_public_id")}[kind]
    good, rejects = of_users(requests, users, (is_falsy(F.col("url")), 400, "no_file"), (too_long(url=255, public_id=255), 400, "too_long"))
    last = latest_by(good.select("user_id", "url", "public_id", *ORDER), ["user_id"], ORDER).select("user_id", F.struct("url", "public_id").alias("new"))
    new = {pair[0]: "new.url", pair[1]: "new.public_id"}
    columns = [F.when(F.col("new").isNotNull(), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in users.columns]
    return users.join(last, "user_id", "left").select(columns), rejects


def delete_companies(companies: DataFrame, jobs: DataFrame, applications: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(companies, jobs, applications, rejects) after the owners' deletions and their cascade."""
    rows = requests.join(companies.select("company_id", F.col("recruiter_id").alias("owner")), "company_id", "left")
    wrong = F.coalesce(F.col("owner") != F.col("actor_user_id"), F.lit(True))
    good, rejects = split(rows.withColumn("reject", first_reason((wrong, 404, "company_not_found"))))
    gone = good.select("company_id").distinct()
    gone_jobs = jobs.join(gone, "company_id", "left_semi").select("job_id")
    return companies.join(gone, "company_id", "left_anti"), jobs.join(gone, "company_id", "left_anti"), applications.join(gone_jobs, "job_id", "left_anti"), rejects


def delete_cascading(tables: dict[str, DataFrame], removed: dict[str, DataFrame], keys: list[tuple[str, str, str, str]] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """All tables after rows were removed, and what refers to them, along the declared keys.

    removed: for some tables, the values of one of their columns (a frame of that column alone) whose rows go. Tables are
    taken parents first, so each is read once for itself and once for its children; references in a circle are a ValueError.
    Null references and keys remove nothing.
    """
    parents: dict[str, set[str]] = {name: set() for name in tables}
    for child, _, parent, _ in keys:
        if child in tables and parent in tables:
            parents[child].add(parent)
    try:
        order = list(TopologicalSorter(parents).static_order())
    except CycleError as e:
        raise ValueError(f"references in a circle: {' -> '.join(e.args[1])}") from None
    kept: dict[str, DataFrame] = {}
    gone: dict[str, DataFrame] = {}  # rows that go, for tables that lose any
    for name in order:
        table = tables[name]
        causes = [(removed[name].columns[0], removed[name])] if name in removed else []
        causes += [(column, gone[parent].select(F.col(key).alias(column))) for child, column, parent, key in keys if child == name and parent in gone]
        kept[name] = table
        for column, values in causes:
            values = values.select(F.col(values.columns[0]).cast(table.schema[column].dataType).alias(column)).filter(F.col(column).isNotNull()).distinct()
            lost = kept[name].join(values, column, "left_semi").select(table.columns)
            gone[name] = gone[name].unionByName(lost) if name in gone else lost
            kept[name] = kept[name].join(values, column, "left_anti").select(table.columns)
    return kept


def cascade(bridge: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows of a bridge table after its parents were removed (users or skills)."""
    return bridge.join(removed.select(key).distinct(), key, "left_anti").select(bridge.columns)
