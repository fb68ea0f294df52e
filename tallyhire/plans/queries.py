"""The registered portal queries and their DuckDB twins. Both give the same columns and rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhire.functions import documents as docs_fn
from tallyhire.functions.text import comma_list, contains_ilike, decimal_or_null, trimmed
from tallyhire.operators import analytics, applications, assets, companies, documents, lifecycle, notify, profiles, search, sketches, skills, tokens
from tallyhire.sources.io import to_json_rows
from tallyhire.sources.portal import Portal, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[Portal], DataFrame]], Callable[[Portal], DataFrame]]:
    """Registers a function of the portal tables under its name, with its SQL over the same views."""

    def register(f: Callable[[Portal], DataFrame]) -> Callable[[Portal], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Portal(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register


TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def text_ts(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


FEED = "j.job_id, j.title, j.description, j.salary, j.location, j.job_type, j.role, j.work_location, j.created_at, c.name AS company_name, c.logo AS company_logo, j.company_id"


@query(f"""SELECT {FEED} FROM jobs j JOIN companies c USING (company_id) WHERE j.is_active AND j.title ILIKE '%red%' AND j.location ILIKE '%nation_1%'""")
def active_job_search(p: Portal) -> DataFrame:
    return search.search_jobs(p.jobs(), p.companies(), title="red", location="nation_1")


@query("""SELECT job_id, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, job_id)::BIGINT AS place FROM jobs WHERE is_active AND title ILIKE '%r_d%' ESCAPE '\\'
QUALIFY place <= 20""")
def search_wildcard_input(p: Portal) -> DataFrame:
    feed = search.search_jobs(p.jobs(), p.companies(), title="r_d", location="", first=20)
    return feed.select("job_id", F.row_number().over(Window.orderBy(F.desc_nulls_first("created_at"), "job_id")).cast("long").alias("place"))


@query("SELECT s.search_id, j.job_id FROM saved_searches s JOIN jobs j ON j.is_active AND j.title ILIKE '%' || s.title || '%' AND j.location ILIKE '%' || s.location || '%'")
def saved_search_match(p: Portal) -> DataFrame:
    return search.match_saved_searches(p.saved_searches(), p.jobs())


@query("SELECT job_id, title, salary, is_active FROM jobs WHERE job_id IN (SELECT l_partkey FROM lineitem)")
def jobs_by_id(p: Portal) -> DataFrame:
    ids = p.star("lineitem").selectExpr("l_partkey AS job_id")
    return search.jobs_by_id(p.jobs(), ids).select("job_id", "title", "salary", "is_active")


@query("SELECT company_id, name, recruiter_id FROM companies WHERE recruiter_id IN (SELECT user_id FROM users WHERE role = 'recruiter')")
def recruiter_companies(p: Portal) -> DataFrame:
    ids = p.users().filter("role = 'recruiter'").select(F.col("user_id").alias("recruiter_id"))
    return companies.companies_of(p.companies(), ids).select("company_id", "name", "recruiter_id")


@query("""SELECT c.company_id, c.name, count(j.job_id)::BIGINT AS n_jobs, count(*) FILTER (j.is_active)::BIGINT AS n_active, coalesce(string_agg(j.job_id::VARCHAR, ',' ORDER BY j.job_id), '') AS job_ids
FROM companies c LEFT JOIN jobs j USING (company_id) GROUP BY ALL""")
def company_pages(p: Portal) -> DataFrame:
    pages = companies.company_pages(p.companies(), p.jobs())
    ids = F.array_join(F.transform("jobs", lambda j: j["job_id"].cast("string")), ",")
    active = F.size(F.filter("jobs", lambda j: F.coalesce(j["is_active"], F.lit(False)))).cast("long")
    return pages.select("company_id", "name", F.size("jobs").cast("long").alias("n_jobs"), active.alias("n_active"), ids.alias("job_ids"))


@query("""SELECT u.user_id, u.name, u.email, u.role, u.bio, u.resume, coalesce(string_agg(s.name, ',' ORDER BY s.name), '') AS skills
FROM users u LEFT JOIN user_skills us USING (user_id) LEFT JOIN skills s USING (skill_id) GROUP BY ALL""")
def user_profiles(p: Portal) -> DataFrame:
    found = profiles.user_profiles(p.users(), p.user_skills(), p.skills())
    return found.select("user_id", "name", "email", "role", "bio", "resume", comma_list(F.col("skills")).alias("skills"))


@query(f"SELECT attempt_id AS application_id, job_id, applicant_email, 'Submitted' AS status, resume, {TS.format('attempted_at')} AS applied_at, subscribed FROM ranked WHERE nth = 1")
def application_admission(p: Portal) -> DataFrame:
    new, _ = applications.admit(p.attempts(), p.users(), p.jobs())
    return new.withColumn("applied_at", text_ts("applied_at"))


@query("""SELECT coalesce(reason, 'duplicate') AS reason, count(*)::BIGINT AS n, count(DISTINCT job_id)::BIGINT AS n_jobs FROM
(SELECT reason, job_id FROM checked WHERE reason IS NOT NULL UNION ALL
 SELECT NULL, job_id FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM ranked f WHERE f.nth = 1 AND f.attempt_id = r.attempt_id AND f.job_id = r.job_id AND f.applicant_email = r.applicant_email)) GROUP BY 1""")
def application_rejects(p: Portal) -> DataFrame:
    _, rejects = applications.admit(p.attempts_of_users(), p.users(), p.jobs())
    return rejects.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("n_jobs"))


@query("SELECT attempt_id AS application_id, job_id, applicant_email, subscribed FROM ranked WHERE nth_literal = 1")
def admission_literal_key(p: Portal) -> DataFrame:
    new, _ = applications.admit(p.attempts(), p.users(), p.jobs(), scope="literal")
    return new.select("application_id", "job_id", "applicant_email", "subscribed")


QUEUE = "row_number() OVER (PARTITION BY job_id ORDER BY subscribed DESC NULLS FIRST, applied_at ASC NULLS LAST, application_id)::BIGINT AS place"


@query(f"SELECT job_id, application_id, subscribed, {QUEUE} FROM applications")
def applicant_queue(p: Portal) -> DataFrame:
    return applications.applicant_queue(p.applications()).select("job_id", "application_id", "subscribed", F.col("place").cast("long"))


@query(f"SELECT job_id, application_id, {QUEUE} FROM applications QUALIFY place <= 3")
def applicant_top_k(p: Portal) -> DataFrame:
    return applications.applicant_queue(p.applications(), k=3).select("job_id", "application_id", F.col("place").cast("long"))


@query("""SELECT u.user_id, a.application_id, a.status, j.title AS job_title, j.salary AS job_salary, j.location AS job_location
FROM applications a JOIN users u ON u.email = a.applicant_email JOIN jobs j ON j.job_id = a.job_id""")
def my_applications(p: Portal) -> DataFrame:
    return applications.my_applications(p.applications(), p.jobs(), p.users()).select("user_id", "application_id", "status", "job_title", "job_salary", "job_location")


def job_requests(p: Portal) -> DataFrame:
    """Creation requests made of parts: some with a foreign company, no salary, a bad type or too many openings."""
    return p.jobs().selectExpr(
        "job_id AS request_id", "CASE WHEN job_id % 11 = 0 THEN 1 ELSE posted_by_recruiter_id END AS actor_user_id", "CASE WHEN job_id % 13 = 0 THEN '' ELSE title END AS title", "description",
        "CASE WHEN job_id % 7 = 0 THEN 0 ELSE salary * CASE WHEN job_id % 17 = 0 THEN 1000000 ELSE 1 END END AS salary", "location", "role", "CASE WHEN job_id % 19 = 0 THEN 'Gig' ELSE job_type END AS job_type", "work_location",
        "CASE WHEN job_id % 23 = 0 THEN company_id + 1 ELSE company_id END AS company_id", "CAST(openings AS DOUBLE) * CASE WHEN job_id % 29 = 0 THEN 50 ELSE 1 END AS openings", "created_at AS requested_at",
    )


@query("""SELECT r.request_id, CASE WHEN u.role IS DISTINCT FROM 'recruiter' THEN 'not_recruiter' WHEN r.title = '' OR r.salary = 0 THEN 'missing_field' WHEN c.company_id IS NULL THEN 'company_not_found'
  WHEN r.job_type = 'Gig' THEN 'bad_job_type' WHEN r.salary >= 100000000 THEN 'bad_salary' WHEN r.openings >= 99.95 THEN 'bad_openings' ELSE 'ok' END AS outcome
FROM (SELECT job_id AS request_id, CASE WHEN job_id % 11 = 0 THEN 1 ELSE posted_by_recruiter_id END AS actor, CASE WHEN job_id % 13 = 0 THEN '' ELSE title END AS title,
  CASE WHEN job_id % 7 = 0 THEN 0 ELSE salary * CASE WHEN job_id % 17 = 0 THEN 1000000 ELSE 1 END END AS salary, CASE WHEN job_id % 19 = 0 THEN 'Gig' ELSE job_type END AS job_type,
  CASE WHEN job_id % 23 = 0 THEN company_id + 1 ELSE company_id END AS company_id, openings * CASE WHEN job_id % 29 = 0 THEN 50 ELSE 1 END AS openings FROM jobs) r
LEFT JOIN users u ON u.user_id = r.actor LEFT JOIN companies c ON c.company_id = r.company_id AND c.recruiter_id = r.actor""")
def job_validation(p: Portal) -> DataFrame:
    judged = lifecycle.judged_jobs(p.companies(), p.users(), job_requests(p))
    return judged.select("request_id", F.coalesce("reject.reason", F.lit("ok")).alias("outcome"))


@query("""SELECT j.job_id, c.company_id IS NOT NULL AS owned FROM jobs j LEFT JOIN companies c ON c.company_id = j.company_id AND c.recruiter_id = CASE WHEN j.job_id % 2 = 0 THEN j.posted_by_recruiter_id ELSE 1000001 END""")
def owner_gate(p: Portal) -> DataFrame:
    asked = p.jobs().selectExpr("job_id", "company_id", "CASE WHEN job_id % 2 = 0 THEN posted_by_recruiter_id ELSE 1000001 END AS actor_user_id")
    return companies.owned(asked, p.companies(), "company_id", "recruiter_id").select("job_id", "owned")


def company_requests(p: Portal) -> DataFrame:
    """Names from parts' first words and from some suppliers; several requests share a name."""
    words = p.star("part").selectExpr("p_partkey AS request_id", "concat('Co ', split_part(p_name, ' ', 1)) AS name", "CAST(1000000 + p_partkey % 25 AS BIGINT) AS actor_user_id")
    old = p.star("supplier").selectExpr("1000000 + s_suppkey AS request_id", "s_name AS name", "CAST(1000000 + s_nationkey AS BIGINT) AS actor_user_id")
    return words.union(old).selectExpr("*", "'about' AS description", "'https://x.example.com' AS website", "'logo' AS logo", "concat('logo/new/', request_id) AS logo_public_id", "TIMESTAMP_NTZ '1996-01-01 00:00:00' AS requested_at")


@query("""SELECT request_id, CASE WHEN name IN (SELECT name FROM companies) OR n > 1 THEN 'name_exists' ELSE 'ok' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY request_id) AS n FROM
(SELECT p_partkey AS request_id, concat('Co ', split_part(p_name, ' ', 1)) AS name FROM part UNION ALL SELECT 1000000 + s_suppkey, s_name FROM supplier))""")
def company_name_conflicts(p: Portal) -> DataFrame:
    new, rejects = lifecycle.create_companies(p.companies(), p.users(), company_requests(p))
    made = new.filter(F.col("logo_public_id").startswith("logo/new/")).select(F.substring_index("logo_public_id", "/", -1).cast("long").alias("request_id"), F.lit("ok").alias("outcome"))
    return made.unionByName(rejects.select("request_id", F.col("reason").alias("outcome")))


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN 'email_exists'
  WHEN row_number() OVER (PARTITION BY o_orderkey % 3 = 0, o_custkey ORDER BY o_orderdate, o_orderkey) > 1 THEN 'email_exists' ELSE 'ok' END AS outcome FROM orders""")
def user_email_conflicts(p: Portal) -> DataFrame:
    asked = p.star("orders").selectExpr(
        "o_orderkey AS request_id", "concat('Name ', o_orderkey) AS name", "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'user' ELSE 'new' END, o_custkey, '@example.com') AS email", "'+3' AS phone_number",
        "'jobseeker' AS role", "CAST(NULL AS STRING) AS bio", "'https://cdn.example.com/r' AS resume", "concat('resume/new/', o_orderkey) AS resume_public_id", "CAST(o_orderdate AS TIMESTAMP_NTZ) AS requested_at",
    )
    new, rejects = lifecycle.register_users(p.users(), asked)
    made = new.filter(F.col("resume_public_id").startswith("resume/new/")).select(F.substring_index("resume_public_id", "/", -1).cast("long").alias("request_id"), F.lit("ok").alias("outcome"))
    return made.unionByName(rejects.select("request_id", F.col("reason").alias("outcome")))


@query("""SELECT u.user_id, coalesce(n.name, u.name) AS name, u.phone_number, coalesce(b.bio, u.bio) AS bio FROM users u
LEFT JOIN (SELECT o_custkey AS user_id, arg_max(o_clerk, (o_orderdate, o_orderkey)) AS name FROM (SELECT o_custkey, o_orderdate, o_orderkey, concat('N', o_orderkey) AS o_clerk FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1) n USING (user_id)
LEFT JOIN (SELECT o_custkey AS user_id, arg_max(concat('B', o_orderkey), (o_orderdate, o_orderkey)) AS bio FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1) b USING (user_id)""")
def profile_merge(p: Portal) -> DataFrame:
    asked = p.star("orders").selectExpr(
        "o_orderkey AS request_id", "o_custkey AS user_id", "CASE WHEN o_orderkey % 2 = 1 THEN concat('N', o_orderkey) ELSE '' END AS name", "CAST(NULL AS STRING) AS phone_number",
        "CASE WHEN o_orderkey % 3 = 1 THEN concat('B', o_orderkey) END AS bio", "o_orderdate AS requested_at",
    )
    return lifecycle.update_profiles(p.users(), asked)[0].select("user_id", "name", "phone_number", "bio")


@query("""SELECT a.job_id, a.applicant_email, arg_max(a.status, (a.attempted_at, a.attempt_id)) AS status FROM ranked a GROUP BY 1, 2""")
def latest_status(p: Portal) -> DataFrame:
    rows = applications.checked(p.attempts(), p.users(), p.jobs()).filter("reject IS NULL").select("job_id", "applicant_email", "status", "attempted_at", "attempt_id")
    return applications.latest_by(rows, ["job_id", "applicant_email"], ["attempted_at", "attempt_id"]).select("job_id", "applicant_email", "status")


def skill_requests(p: Portal) -> DataFrame:
    return p.star("orders").selectExpr("o_orderkey AS request_id", "o_custkey AS user_id", "CASE WHEN o_orderkey % 10 = 0 THEN '  ' ELSE concat(' Brand#', 11 + o_orderkey % 40, '\\t') END AS skill_name", "o_orderdate AS requested_at")


@query("""SELECT DISTINCT r.user_id, r.skill, (s.user_id IS NULL) AS added FROM (SELECT o_custkey AS user_id, concat('Brand#', 11 + o_orderkey % 40) AS skill FROM orders WHERE o_orderkey % 10 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)) r
LEFT JOIN (SELECT us.user_id, k.name FROM user_skills us JOIN skills k USING (skill_id)) s ON s.user_id = r.user_id AND s.name = r.skill""")
def skill_add(p: Portal) -> DataFrame:
    _, _, results, _ = skills.add_skills(p.skills(), p.user_skills(), p.users(), skill_requests(p))
    return results.groupBy("user_id", "skill").agg(F.bool_or(F.col("outcome") == "added").alias("added"))


@query("""SELECT us.user_id, us.skill_id FROM user_skills us JOIN skills k USING (skill_id) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = us.user_id AND o_orderkey % 10 <> 0 AND concat('Brand#', 11 + o_orderkey % 40) = k.name)""")
def skill_remove(p: Portal) -> DataFrame:
    links, _ = skills.remove_skills(p.skills(), p.user_skills(), p.users(), skill_requests(p))
    return links.select("user_id", "skill_id")


def company_deletions(p: Portal) -> DataFrame:
    return p.companies().selectExpr("company_id AS request_id", "company_id", "CASE WHEN company_id % 3 = 0 THEN recruiter_id WHEN company_id % 3 = 1 THEN CAST(5 AS BIGINT) END AS actor_user_id", "created_at AS requested_at")


def deleted(p: Portal) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return lifecycle.delete_companies(p.companies(), p.jobs(), p.applications(), company_deletions(p))


@query("SELECT job_id, company_id FROM jobs WHERE company_id % 3 <> 0")
def company_cascade_jobs(p: Portal) -> DataFrame:
    return deleted(p)[1].select("job_id", "company_id")


@query("SELECT application_id, job_id FROM applications WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE company_id % 3 = 0)")
def company_cascade_applications(p: Portal) -> DataFrame:
    return deleted(p)[2].select("application_id", "job_id")


@query("""SELECT 'companies.recruiter_id' AS reference, recruiter_id::VARCHAR AS key FROM companies WHERE recruiter_id NOT IN (SELECT user_id FROM users WHERE name NOT LIKE '%1')
UNION ALL SELECT 'jobs.posted_by_recruiter_id', posted_by_recruiter_id::VARCHAR FROM jobs WHERE posted_by_recruiter_id NOT IN (SELECT user_id FROM users WHERE name NOT LIKE '%1')
UNION ALL SELECT 'applications.applicant_email', applicant_email FROM applications WHERE applicant_email NOT IN (SELECT email FROM users WHERE name NOT LIKE '%1')""")
def fk_audit(p: Portal) -> DataFrame:
    return companies.reference_audit(p.companies(), p.jobs(), p.applications(), p.users().filter("name NOT LIKE '%1'"))


@query("SELECT public_id FROM stored_assets WHERE public_id NOT IN (SELECT resume_public_id FROM users WHERE resume_public_id IS NOT NULL UNION ALL SELECT logo_public_id FROM companies)")
def orphan_assets(p: Portal) -> DataFrame:
    return assets.orphans(p.stored_assets(), p.users(), p.companies())


def decided(p: Portal) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One decision request for each application, every fifth by somebody who does not own the job."""
    found = p.applications("status")
    made = found.join(p.jobs().select("job_id", "posted_by_recruiter_id"), "job_id").selectExpr(
        "application_id AS request_id", "application_id", "CASE WHEN job_id % 5 = 0 THEN 1000000 + (posted_by_recruiter_id + 1) % 25 WHEN job_id % 7 = 0 THEN 1 ELSE posted_by_recruiter_id END AS actor_user_id",
        "CASE WHEN job_id % 11 = 0 THEN 'Paused' ELSE 'Hired' END AS status", "applied_at AS requested_at",
    )
    return applications.decide(found, p.jobs(), p.users(), made)


def decisions(p: Portal) -> DataFrame:
    return decided(p)[1]


DECISIONS = """asked AS (SELECT a.application_id, a.applicant_email, a.status, j.title, CASE WHEN j.job_id % 11 = 0 THEN 'Paused' ELSE 'Hired' END AS asks, j.posted_by_recruiter_id AS owner,
CASE WHEN j.job_id % 5 = 0 THEN 1000000 + (j.posted_by_recruiter_id + 1) % 25 WHEN j.job_id % 7 = 0 THEN 1 ELSE j.posted_by_recruiter_id END AS actor FROM applications a JOIN jobs j USING (job_id)),
judged AS (SELECT *, CASE WHEN actor < 1000000 THEN 'not_recruiter' WHEN actor <> owner THEN 'not_owner' WHEN asks = 'Paused' THEN 'bad_status' END AS reason FROM asked)"""


@query(f"""SELECT * FROM (WITH {DECISIONS} SELECT application_id, CASE WHEN reason IS NULL THEN 'Hired' ELSE status END AS status FROM judged)""")
def decided_applications(p: Portal) -> DataFrame:
    return decided(p)[0].select("application_id", "status")


@query(f"""SELECT * FROM (WITH {DECISIONS} SELECT application_id AS request_id, CASE reason WHEN 'not_recruiter' THEN 403 WHEN 'not_owner' THEN 404 ELSE 400 END AS code, reason FROM judged WHERE reason IS NOT NULL)""")
def decision_rejects(p: Portal) -> DataFrame:
    return decided(p)[2]


@query(f"""SELECT * FROM (WITH {DECISIONS} SELECT '{{"to":"' || applicant_email || '","subject":"{notify.STATUS_SUBJECT}","html":"' || replace('{notify.STATUS_TEMPLATE}', '{{title}}', title) || '"}}' AS value
FROM judged WHERE reason IS NULL)""")
def mail_events(p: Portal) -> DataFrame:
    return notify.to_mail_events(notify.status_mails(decisions(p)))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('user', user_id, '@example.com') END AS recipient, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_recipient' ELSE 'invalid_json' END AS outcome FROM events")
def mail_parse(p: Portal) -> DataFrame:
    events = p.star("events").selectExpr("event_id", "concat(CASE WHEN event_id % 3 = 1 THEN '{\"to\":\"\"' ELSE concat('{\"to\":\"user', user_id, '@example.com\"') END, ',\"subject\":\"s\",\"html\":\"h\"}', CASE WHEN event_id % 3 = 2 THEN ' x' ELSE '' END) AS value")
    parsed = notify.parse_mails(events)
    return parsed.select("event_id", F.when(F.col("reason").isNull(), F.col("mail.to")).alias("recipient"), F.coalesce("reason", F.lit("ok")).alias("outcome"))


@query("SELECT doc_id, doc_id % 4 < 2 AS ok, CASE doc_id % 4 WHEN 3 THEN '' ELSE trim(replace(replace(raw, '```json', ''), '```', ''), ' ' || chr(10)) END AS json FROM raw_documents")
def fence_strip_json(p: Portal) -> DataFrame:
    return documents.cleaned(p.raw_documents()).select("doc_id", "ok", "json")


@query("""SELECT us.user_id, concat('Suggest careers for someone with these skills: ', string_agg(s.name, ',' ORDER BY s.name)) AS prompt FROM user_skills us JOIN skills s USING (skill_id) GROUP BY 1""")
def career_prompts(p: Portal) -> DataFrame:
    return documents.career_prompts(profiles.user_profiles(p.users(), p.user_skills(), p.skills()))


@query("SELECT doc_id, concat('data:application/pdf;base64,', to_base64(encode(text))) AS uri, true AS same FROM documents WHERE text IS NOT NULL")
def data_uri_roundtrip(p: Portal) -> DataFrame:
    rows = p.star("documents").filter("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("content"))
    uri = docs_fn.data_uri(F.concat(F.lit("cv"), F.col("doc_id"), F.lit(".PDF")), F.col("content"))
    return rows.select("doc_id", uri.alias("uri"), (docs_fn.decoded_pdf(uri) == F.col("content")).alias("same"))


def reset_sql(seconds: int) -> str:
    return f"""SELECT event_id, request_id, CASE WHEN NOT live OR used > 0 THEN 'expired' ELSE 'ok' END AS outcome FROM
(SELECT *, coalesce(sum(CASE WHEN live THEN 1 ELSE 0 END) OVER (PARTITION BY email, request_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM
(SELECT a.*, coalesce(a.ts < a.request_ts + to_seconds({seconds}), false) AS live FROM
(SELECT *, last_value(CASE WHEN kind = 'request' THEN event_id END IGNORE NULLS) OVER o AS request_id, last_value(CASE WHEN kind = 'request' THEN ts END IGNORE NULLS) OVER o AS request_ts
 FROM (SELECT * FROM reset_log WHERE kind = 'attempt' OR email IN (SELECT email FROM users))
 WINDOW o AS (PARTITION BY email ORDER BY ts, CASE WHEN kind = 'request' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) a WHERE kind = 'attempt'))"""


@query(reset_sql(900))
def reset_asof_900s(p: Portal) -> DataFrame:
    return tokens.resolve_resets(p.reset_log(), p.users(), 900).select("event_id", "request_id", "outcome")


@query(reset_sql(86400))
def reset_asof_1d(p: Portal) -> DataFrame:
    return tokens.resolve_resets(p.reset_log(), p.users(), 86400).select("event_id", "request_id", "outcome")


@query("""SELECT 'active_jobs' AS measure, count(*)::BIGINT AS n FROM jobs WHERE is_active UNION ALL SELECT 'companies', count(*)::BIGINT FROM companies UNION ALL SELECT 'job_seekers', count(*)::BIGINT FROM users WHERE role = 'jobseeker'""")
def marketplace_totals(p: Portal) -> DataFrame:
    return analytics.marketplace_totals(p.jobs(), p.companies(), p.users())


@query("""SELECT recruiter_id, company_id, job_id, grouping(recruiter_id, company_id, job_id)::BIGINT AS level, count(*)::BIGINT AS applications, count(*) FILTER (status = 'Submitted')::BIGINT AS submitted, count(*) FILTER (status = 'Rejected')::BIGINT AS rejected,
count(*) FILTER (status = 'Hired')::BIGINT AS hired, count(*) FILTER (subscribed)::BIGINT AS subscribed, count(DISTINCT applicant_email)::BIGINT AS applicants, (10000 * count(*) FILTER (status = 'Hired') // count(*))::BIGINT AS hired_per_10000
FROM (SELECT a.*, j.company_id, j.posted_by_recruiter_id AS recruiter_id FROM applications a JOIN jobs j USING (job_id)) GROUP BY ROLLUP (recruiter_id, company_id, job_id)""")
def recruiter_rollup(p: Portal) -> DataFrame:
    return analytics.recruiter_rollup(p.applications(), p.jobs())


JOB_SKILLS = "job_skills AS (SELECT j.job_id, s.skill_id FROM jobs j JOIN skills s ON j.is_active AND list_contains(string_split_regex(lower(j.title || ' ' || j.description), '[^A-Za-z0-9#+.]+'), lower(s.name)))"


@query(f"""SELECT user_id, place, job_id, matched, n_skills FROM (SELECT user_id, job_id, matched, row_number() OVER (PARTITION BY user_id ORDER BY matched DESC, job_id)::BIGINT AS place FROM
(WITH {JOB_SKILLS} SELECT us.user_id, js.job_id, count(*)::BIGINT AS matched FROM user_skills us JOIN job_skills js USING (skill_id) GROUP BY 1, 2)) JOIN (SELECT user_id, count(*)::BIGINT AS n_skills FROM user_skills GROUP BY 1) USING (user_id) WHERE place <= 3""")
def skill_job_match(p: Portal) -> DataFrame:
    found = analytics.skill_job_match(p.jobs(), p.skills(), p.user_skills())
    return found.withColumn("place", F.col("place").cast("long"))


def jobs_with_two(p: Portal) -> DataFrame:
    """Jobs whose description asks for a second skill, that of the brand which follows by key."""
    second = F.concat(F.lit("Brand#"), (11 + F.col("job_id") % 15).cast("string"))
    return p.jobs().withColumn("description", F.concat_ws(" and ", "description", second))


JOBS_TWO = "two AS (SELECT job_id, title, description || ' and Brand#' || (11 + job_id % 15) AS description, is_active FROM jobs)"


@query(f"""SELECT user_id, place, skill_id, wanted FROM (SELECT user_id, skill_id, wanted, row_number() OVER (PARTITION BY user_id ORDER BY wanted DESC, skill_id)::BIGINT AS place FROM
(WITH {JOBS_TWO}, {JOB_SKILLS.replace('FROM jobs j', 'FROM two j')}, asks AS (SELECT job_id, count(DISTINCT skill_id) AS n FROM job_skills GROUP BY 1),
good AS (SELECT us.user_id, s.job_id FROM user_skills us JOIN (SELECT DISTINCT * FROM job_skills) s USING (skill_id) JOIN asks USING (job_id) GROUP BY 1, 2 HAVING 2 * count(*) >= max(n))
SELECT g.user_id, s.skill_id, count(*)::BIGINT AS wanted FROM good g JOIN (SELECT DISTINCT * FROM job_skills) s USING (job_id) WHERE NOT EXISTS (SELECT 1 FROM user_skills x WHERE x.user_id = g.user_id AND x.skill_id = s.skill_id) GROUP BY 1, 2)) WHERE place <= 3""")
def skills_to_learn(p: Portal) -> DataFrame:
    found = analytics.skills_to_learn(jobs_with_two(p), p.skills(), p.user_skills())
    return found.withColumn("place", F.col("place").cast("long"))


@query(r"""SELECT doc_id, len(regexp_extract_all(t, '(?im)^[ \t]*(experience|education|skills|projects|summary|certifications)\b'))::BIGINT AS headings, regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS has_email,
regexp_matches(t, '\+?[0-9][0-9 ()-]{7,}[0-9]') AS has_phone, len(regexp_extract_all(t, '\b(19|20)[0-9]{2}\b'))::BIGINT AS years, len(regexp_extract_all(t, '(?m)^[ \t]*[-*]\s'))::BIGINT AS bullets,
len(regexp_extract_all(t, '(?i)\b(led|built|managed|designed|created|improved|developed|delivered)\b'))::BIGINT AS action_verbs, len(regexp_extract_all(t, '[0-9]+'))::BIGINT AS numbers FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def resume_features(p: Portal) -> DataFrame:
    return analytics.resume_features(p.star("documents"))


@query(f"SELECT {TS.format('date_trunc($$hour$$, ts)')} AS window_start, kind, count(*)::BIGINT AS n FROM reset_log GROUP BY ALL".replace("$$", "'"))
def mail_volume_tumbling(p: Portal) -> DataFrame:
    return analytics.mail_volume(p.reset_log()).withColumn("window_start", text_ts("window_start"))


@query("SELECT user_id, name, email, phone_number, role, bio, subscription IS NOT NULL AS subscribed_once FROM users")
def public_profiles(p: Portal) -> DataFrame:
    return profiles.public_profile(p.users()).select("user_id", "name", "email", "phone_number", "role", "bio", F.col("subscription").isNotNull().alias("subscribed_once"))


@query("""SELECT j.job_id, CASE WHEN j.job_id % 4 = 0 THEN concat(j.title, ' II') ELSE j.title END AS title, CASE WHEN j.job_id % 4 = 0 THEN j.salary + 100 ELSE j.salary END AS salary, CASE WHEN j.job_id % 4 = 0 THEN true ELSE j.is_active END AS is_active FROM jobs j""")
def job_updates(p: Portal) -> DataFrame:
    asked = p.jobs().filter("job_id % 4 IN (0, 1)").selectExpr(
        "explode(sequence(0, 1)) AS nth", "*",
    ).selectExpr(
        "job_id * 2 + nth AS request_id", "job_id", "CASE WHEN job_id % 4 = 0 THEN posted_by_recruiter_id ELSE 7 END AS actor_user_id", "concat(title, CASE WHEN nth = 1 THEN ' II' ELSE ' draft' END) AS title", "description", "salary + 100 AS salary",
        "location", "role", "job_type", "openings", "work_location", "true AS is_active", "TIMESTAMP_NTZ '1997-01-01 00:00:00' AS requested_at",
    )
    return lifecycle.update_jobs(p.jobs(), asked)[0].select("job_id", "title", "salary", "is_active")


@query("""SELECT u.user_id, coalesce(f.url, u.resume) AS resume, coalesce(f.id, u.resume_public_id) AS resume_public_id FROM users u
LEFT JOIN (SELECT o_custkey AS user_id, concat('https://cdn.example.com/v/', max(o_orderkey)) AS url, concat('v/', max(o_orderkey)) AS id FROM orders GROUP BY 1) f USING (user_id)""")
def resume_replacements(p: Portal) -> DataFrame:
    asked = p.star("orders").selectExpr("o_orderkey AS request_id", "o_custkey AS user_id", "concat('https://cdn.example.com/v/', o_orderkey) AS url", "concat('v/', o_orderkey) AS public_id", "DATE '1997-01-01' AS requested_at")
    return lifecycle.replace_files(p.users(), asked, "resume")[0].select("user_id", "resume", "resume_public_id")


@query("SELECT job_id, applicant_email, count(*)::BIGINT AS n FROM ranked GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness_violations(p: Portal) -> DataFrame:
    rows = applications.checked(p.attempts(), p.users(), p.jobs()).filter("reject IS NULL")
    return applications.violations(rows, ["job_id", "applicant_email"])


@query("SELECT us.user_id, us.skill_id FROM user_skills us WHERE us.skill_id NOT IN (SELECT skill_id FROM skills WHERE name LIKE '%3') AND us.user_id % 2 <> 0")
def skill_cascade(p: Portal) -> DataFrame:
    without = lifecycle.cascade(p.user_skills(), p.skills().filter("name LIKE '%3'"), "skill_id")
    return lifecycle.cascade(without, p.users().filter("user_id % 2 = 0"), "user_id")


@query("""SELECT user_id, '[' || trim(lower(c)) || ']' AS trimmed, CASE WHEN n < 99999999.995 THEN n::DECIMAL(10,2) END AS salary, title ILIKE '%\\%%' ESCAPE '\\' AS has_percent FROM
(SELECT c_custkey AS user_id, c_mktsegment AS c, c_custkey * 123456.0 AS n, CASE WHEN c_custkey % 2 = 0 THEN '5%' ELSE '5 of 100' END AS title FROM customer)""")
def scalar_rules(p: Portal) -> DataFrame:
    rows = p.star("customer").selectExpr("c_custkey AS user_id", "concat('\\t\\u00a0 ', lower(c_mktsegment), ' \\ufeff\\n') AS c", "c_custkey * 123456.0 AS n", "CASE WHEN c_custkey % 2 = 0 THEN '5%' ELSE '5 of 100' END AS title")
    return rows.select("user_id", F.concat(F.lit("["), trimmed(F.col("c")), F.lit("]")).alias("trimmed"), decimal_or_null(F.col("n"), 10, 2).alias("salary"), contains_ilike(F.col("title"), F.lit(r"\%")).alias("has_percent"))


@query("""SELECT company_id, job_id, title, description, salary, location, job_type, openings, role, work_location, posted_by_recruiter_id, is_active FROM jobs""")
def company_page_jobs(p: Portal) -> DataFrame:
    pages = companies.company_pages(p.companies(), p.jobs()).select("company_id", F.explode("jobs").alias("j"))
    return pages.select("company_id", *(F.col(f"j.{c}") for c in companies.JOB_FIELDS if c not in ("company_id", "created_at")))


@query("""SELECT title, salary, openings, company_id FROM jobs""")
def created_jobs(p: Portal) -> DataFrame:
    """Every job posted again by its owner."""
    asked = p.jobs().selectExpr(
        "job_id AS request_id", "posted_by_recruiter_id AS actor_user_id", "title", "description", "salary", "location", "role", "job_type", "work_location", "company_id", "openings", "created_at AS requested_at",
    )
    old = p.jobs().agg(F.max("job_id").alias("top"))
    new, _ = lifecycle.create_jobs(p.jobs(), p.companies(), p.users(), asked)
    return new.join(F.broadcast(old), F.col("job_id") > F.col("top")).select("title", "salary", "openings", "company_id")


@query("""SELECT * FROM (SELECT o_orderkey AS request_id, CASE WHEN lost THEN 404 ELSE 400 END AS code, CASE WHEN lost THEN 'user_not_found' ELSE 'too_long' END AS reason
FROM (SELECT *, o_custkey % 2 = 1 OR o_custkey NOT IN (SELECT c_custkey FROM customer) AS lost FROM orders) WHERE lost OR o_orderkey % 3 = 0)""")
def profile_rejects(p: Portal) -> DataFrame:
    asked = p.star("orders").selectExpr(
        "o_orderkey AS request_id", "CASE WHEN o_custkey % 2 = 1 THEN -o_custkey ELSE o_custkey END AS user_id", "'N' AS name", "CASE WHEN o_orderkey % 3 = 0 THEN repeat('1', 21) END AS phone_number",
        "CAST(NULL AS STRING) AS bio", "o_orderdate AS requested_at",
    )
    return lifecycle.update_profiles(p.users(), asked)[1]


@query("""SELECT o_orderkey AS event_id, o_orderkey % 30 < 15 AS live FROM orders""")
def session_expiry(p: Portal) -> DataFrame:
    """Sessions issued on each order's date, looked at up to 29 days later."""
    issued = F.col("o_orderdate").cast("timestamp_ntz")
    seen = issued + F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"))
    return p.star("orders").select(F.col("o_orderkey").alias("event_id"), tokens.session_live(issued, seen).alias("live"))


def ats_answers(p: Portal) -> DataFrame:
    """Model-written ATS documents made of orders, some with a score that is out of range."""
    return p.star("orders").selectExpr("o_orderkey AS doc_id", """concat('```json{"atsScore": ', o_orderkey % 120, ', "scoreBreakdown": {"formatting": {"score": ', o_custkey % 101, ', "feedback": "f"}, "keywords": {"score": ', o_orderkey % 101,
        ', "feedback": "k"}}, "suggestions": [{"category": "c', o_custkey % 3, '", "issue": "i", "recommendation": "r", "priority": "', CASE o_orderkey % 2 WHEN 0 THEN 'high' ELSE 'low' END, '"}], "strengths": ["s"], "summary": "x"}```') AS raw""")


@query("""SELECT o_orderkey AS doc_id, o_orderkey % 120 AS score, o_custkey % 101 AS formatting, concat('c', o_custkey % 3) AS category FROM orders WHERE o_orderkey % 120 <= 100""")
def ats_typed(p: Portal) -> DataFrame:
    good, _ = documents.parse_ats(ats_answers(p))
    first = F.col("doc.suggestions")[0]["category"]
    return good.select("doc_id", F.col("doc.atsScore").cast("long").alias("score"), F.col("doc.scoreBreakdown")["formatting"]["score"].cast("long").alias("formatting"), first.alias("category"))


@query("SELECT o_orderkey AS doc_id, 'bad_score' AS reason FROM orders WHERE o_orderkey % 120 > 100")
def ats_rejects(p: Portal) -> DataFrame:
    return documents.parse_ats(ats_answers(p))[1].select("doc_id", "reason")


@query("""SELECT dimension, count(*)::BIGINT AS n, avg(score) AS mean_score, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.5) AS median_score, quantile_cont(score, 0.9) AS p90 FROM
(SELECT unnest(['total', 'formatting', 'keywords']) AS dimension, unnest([o_orderkey % 120, o_custkey % 101, o_orderkey % 101])::DOUBLE AS score FROM orders WHERE o_orderkey % 120 <= 100) GROUP BY 1""")
def ats_scores(p: Portal) -> DataFrame:
    return documents.ats_summary(documents.parse_ats(ats_answers(p))[0])


@query("SELECT CASE o_orderkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS priority, concat('c', o_custkey % 3) AS category, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 120 <= 100 GROUP BY 1, 2")
def ats_issue_counts(p: Portal) -> DataFrame:
    return documents.ats_issues(documents.parse_ats(ats_answers(p))[0])


@query("""SELECT o_orderkey AS doc_id, concat('s', o_custkey) AS summary, concat('t', o_orderkey) AS skill FROM orders""")
def career_typed(p: Portal) -> DataFrame:
    raw = p.star("orders").selectExpr("o_orderkey AS doc_id", """concat('{"summary": "s', o_custkey, '", "skillsToLearn": [{"category": "c", "skills": [{"title": "t', o_orderkey, '"}]}]}') AS raw""")
    good, _ = documents.parse_career(raw)
    return good.select("doc_id", "doc.summary", F.col("doc.skillsToLearn")[0]["skills"][0]["title"].alias("skill"))


@query(f"""SELECT m.user_id, m.job_id, coalesce(u.subscription > TIMESTAMP '1996-01-01', false) AS premium FROM (SELECT user_id, job_id FROM (SELECT user_id, job_id, row_number() OVER (PARTITION BY user_id ORDER BY matched DESC, job_id) AS place FROM
(WITH {JOB_SKILLS} SELECT us.user_id, js.job_id, count(*) AS matched FROM user_skills us JOIN job_skills js USING (skill_id) GROUP BY 1, 2)) WHERE place <= 3) m JOIN users u USING (user_id)""")
def premium_feed(p: Portal) -> DataFrame:
    matches = analytics.skill_job_match(p.jobs(), p.skills(), p.user_skills())
    return analytics.premium_feed(matches, p.users(), "1996-01-01 00:00:00").select("user_id", "job_id", "premium")


def mail_values(p: Portal) -> DataFrame:
    """Mail events of which some name no recipient and some are no JSON."""
    return p.star("events").selectExpr("concat(CASE WHEN event_id % 3 = 1 THEN '{\"to\":\"\"' ELSE concat('{\"to\":\"user', user_id, '@example.com\"') END, ',\"subject\":\"s', event_id, '\",\"html\":\"h\"}', CASE WHEN event_id % 3 = 2 THEN ' x' ELSE '' END) AS value")


@query(f"""SELECT '{notify.SENDER}' AS sender, concat('user', user_id, '@example.com') AS recipient, concat('s', event_id) AS subject, 'h' AS html FROM events WHERE event_id % 3 = 0""")
def mail_outbox(p: Portal) -> DataFrame:
    sent = notify.outbox(notify.parse_mails(mail_values(p)))
    return sent.select(F.col("from").alias("sender"), F.col("to").alias("recipient"), "subject", "html")


@query("""SELECT concat(CASE WHEN event_id % 3 = 1 THEN '{"to":""' ELSE concat('{"to":"user', user_id, '@example.com"') END, ',"subject":"s', event_id, '","html":"h"}', CASE WHEN event_id % 3 = 2 THEN ' x' ELSE '' END) AS value,
CASE WHEN event_id % 3 = 1 THEN 'no_recipient' ELSE 'invalid_json' END AS reason FROM events WHERE event_id % 3 <> 0""")
def mail_rejects(p: Portal) -> DataFrame:
    return notify.rejects(notify.parse_mails(mail_values(p)))


@query("""SELECT '{"company_id":' || company_id || ',"name":"' || name || '","bio":null}' AS value FROM companies""")
def json_rows(p: Portal) -> DataFrame:
    return to_json_rows(p.companies().select("company_id", "name", F.lit(None).cast("string").alias("bio")))


@query(f"SELECT {TS.format('w')} AS window_start, kind, count(*)::BIGINT AS n FROM (SELECT unnest([date_trunc($$hour$$, ts), date_trunc($$hour$$, ts) - INTERVAL 1 HOUR]) AS w, kind FROM reset_log) GROUP BY ALL".replace("$$", "'"))
def mail_volume_sliding(p: Portal) -> DataFrame:
    return analytics.mail_volume(p.reset_log(), window="2 hours", slide="1 hour").withColumn("window_start", text_ts("window_start"))


@query(f"""SELECT email, {TS.format('min(ts)')} AS session_start, count(*)::BIGINT AS n FROM (SELECT email, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY email ORDER BY ts, event_id) AS nth FROM
(SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY email ORDER BY ts, event_id) + INTERVAL 6 HOUR, true) AS gap FROM reset_log)) GROUP BY email, nth""")
def mail_sessions(p: Portal) -> DataFrame:
    found = analytics.mail_sessions(p.reset_log(), to="email", gap="6 hours")
    return found.select("email", text_ts("start").alias("session_start"), "n")


@query("""SELECT 'job' AS level, job_id AS key, count(DISTINCT applicant_email)::BIGINT AS applicants, true AS close FROM applications JOIN jobs USING (job_id) GROUP BY job_id
UNION ALL SELECT 'company', company_id, count(DISTINCT applicant_email)::BIGINT, true FROM applications JOIN jobs USING (job_id) GROUP BY company_id
UNION ALL SELECT 'recruiter', posted_by_recruiter_id, count(DISTINCT applicant_email)::BIGINT, true FROM applications JOIN jobs USING (job_id) GROUP BY posted_by_recruiter_id""")
def applicant_sketch_error(p: Portal) -> DataFrame:
    """Exact distinct applicants, and whether sketches by job and day, united upward, are within 3 %."""
    rows = p.applications().join(p.jobs().select("job_id", "company_id", F.col("posted_by_recruiter_id").alias("recruiter_id")), "job_id")
    kept = sketches.applicant_sketches(p.applications(), p.jobs())
    found = None
    for level, by in (("job", "job_id"), ("company", "company_id"), ("recruiter", "recruiter_id")):
        exact = rows.groupBy(by).agg(F.count_distinct("applicant_email").alias("exact"))
        both = exact.join(sketches.applicants(kept, by), by, "left")
        close = F.abs(F.col("applicants") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))
        each = both.select(F.lit(level).alias("level"), F.col(by).alias("key"), F.col("exact").alias("applicants"), F.coalesce(close, F.lit(False)).alias("close"))
        found = each if found is None else found.unionByName(each)
    return found


@query("""SELECT dimension, count(*)::BIGINT AS n, true AS close FROM
(SELECT unnest(['total', 'formatting', 'keywords']) AS dimension FROM orders WHERE o_orderkey % 120 <= 100) GROUP BY 1""")
def ats_sketch_quantiles(p: Portal) -> DataFrame:
    """Scores counted by sketches of days, merged; whether the 10th, 50th and 90th percentile hold their rank within 2 %."""
    good = documents.parse_ats(ats_answers(p))[0].join(p.star("orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day")), "doc_id")
    at = (0.1, 0.5, 0.9)
    found = sketches.score_quantiles(sketches.score_sketches(good, "day"), "dimension", at=at)
    parts = good.select(F.explode(F.map_entries("doc.scoreBreakdown")).alias("e")).select(F.col("e.key").alias("dimension"), F.col("e.value.score").alias("score"))
    scores = parts.unionByName(good.select(F.lit("total").alias("dimension"), F.col("doc.atsScore").alias("score")))
    close = F.lit(True)
    ranks = []
    for k, q in enumerate(at):
        v = F.col("quantiles")[k]
        ranks += [F.avg((F.col("score") < v).cast("int")).alias(f"below_{k}"), F.avg((F.col("score") <= v).cast("int")).alias(f"upto_{k}")]
        close = close & (F.col(f"below_{k}") - 0.02 <= q) & (F.col(f"upto_{k}") + 0.02 >= q)
    return scores.join(F.broadcast(found), "dimension").groupBy("dimension", "n").agg(*ranks).select("dimension", "n", close.alias("close"))  # a row for each dimension


@query("""SELECT 'companies' AS table_name, count(*)::BIGINT AS n FROM companies WHERE company_id % 7 <> 0
UNION ALL SELECT 'jobs', count(*)::BIGINT FROM jobs WHERE company_id % 7 <> 0
UNION ALL SELECT 'applications', count(*)::BIGINT FROM applications JOIN jobs USING (job_id) WHERE company_id % 7 <> 0
UNION ALL SELECT 'users', count(*)::BIGINT FROM users WHERE user_id % 5 <> 1
UNION ALL SELECT 'skills', count(*)::BIGINT FROM skills WHERE name NOT LIKE '%3'
UNION ALL SELECT 'user_skills', count(*)::BIGINT FROM user_skills JOIN skills USING (skill_id) WHERE user_id % 5 <> 1 AND name NOT LIKE '%3'""")
def declared_cascade(p: Portal) -> DataFrame:
    """Rows left in each table after companies, users and skills were removed with all that refers to them."""
    tables = {"companies": p.companies(), "jobs": p.jobs(), "applications": p.applications(), "users": p.users(), "skills": p.skills(), "user_skills": p.user_skills()}
    removed = {"companies": p.companies().filter("company_id % 7 = 0").select("company_id"), "users": p.users().filter("user_id % 5 = 1").select("user_id"), "skills": p.skills().filter("name LIKE '%3'").select("skill_id")}
    found = None
    for name, rows in lifecycle.delete_cascading(tables, removed).items():
        each = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        found = each if found is None else found.unionByName(each)
    return found


@query("""SELECT company_id, name, shard, n_shards, job_ids FROM (SELECT company_id, shard::INTEGER AS shard, string_agg(job_id::VARCHAR, ',' ORDER BY job_id) AS job_ids, any_value(n_shards)::INTEGER AS n_shards
  FROM (SELECT company_id, job_id, (row_number() OVER (PARTITION BY company_id ORDER BY job_id) - 1) // 7 AS shard, (count(*) OVER (PARTITION BY company_id) + 6) // 7 AS n_shards FROM jobs) GROUP BY company_id, shard) JOIN companies USING (company_id)
UNION ALL SELECT company_id, name, 0, 1, '' FROM companies WHERE company_id NOT IN (SELECT company_id FROM jobs)""")
def company_page_shards(p: Portal) -> DataFrame:
    shards = companies.company_page_shards(p.companies(), p.jobs(), size=7)
    return shards.select("company_id", "name", "shard", "n_shards", F.array_join(F.transform("jobs", lambda j: j["job_id"].cast("string")), ",").alias("job_ids"))
