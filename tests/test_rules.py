"""Unit tests of text rules, reject reasons and traps on hand-made rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyhire.functions import documents as d
from tallyhire.functions.text import contains_ilike, decimal_or_null, is_falsy, trimmed
from tallyhire.operators import applications, assets, documents, lifecycle, notify, search, skills, tokens
from tallyhire.sources.io import read_table, to_json_rows, write_table
from tallyhire.sources.schemas import TABLES

T0 = datetime(1995, 1, 1)


def at(seconds: int) -> datetime:
    return datetime.fromtimestamp(T0.timestamp() + seconds)


@pytest.fixture(scope="module")
def users(spark):
    rows = [
        (1, "Ann", "ann@x", "1", "jobseeker", "bio", "r1", "resume/1", None, None, T0, datetime(1996, 1, 1)),
        (2, "Bob", "bob@x", "2", "jobseeker", None, None, None, None, None, T0, None),
        (3, "Cy", "cy@x", "3", "jobseeker", None, "", None, None, None, T0, None),
        (10, "Rec", "rec@x", "4", "recruiter", None, None, None, None, None, T0, None),
        (11, "Rex", "rex@x", "5", "recruiter", None, None, None, None, None, T0, None),
    ]
    return spark.createDataFrame(rows, TABLES["users"])


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame([(1, "Acme", "d", "w", "l", "logo/1", 10, T0), (2, "Bolt", "d", "w", "l", "logo/2", 11, T0), (3, "Idle", "d", "w", "l", "logo/3", 10, T0)], TABLES["companies"])


@pytest.fixture(scope="module")
def jobs(spark):
    from decimal import Decimal as D

    def job(i, title, location, company, owner, active):
        return (i, title, "desc", D("10.00"), location, "Full-time", D("1.0"), "dev", "Remote", company, owner, at(i), active)

    return spark.createDataFrame([job(1, "Red 50% off", "Oslo", 1, 10, True), job(2, "red_team", None, 1, 10, True), job(3, "Blue", "Oslo", 1, 10, None), job(4, "Green", "Rome", 2, 11, False), job(5, r"back\slash", "Oslo", 2, 11, True)], TABLES["jobs"])


def ids(df, c):
    return sorted(r[c] for r in df.collect())


@pytest.mark.parametrize(("title", "location", "want"), [
    (None, None, [1, 2, 5]), ("", "", [1, 2, 5]), ("RED", None, [1, 2]), ("%", None, [1, 2, 5]), ("d_t", None, [2]), (r"\%", None, [1]), ("a\\\\s", None, []), (r"back\\s", None, [5]), (r"t\ea", None, [2]), (None, "os", [1, 5]), ("zz", None, []),
])
def test_search_terms(jobs, companies, title, location, want):
    assert ids(search.search_jobs(jobs, companies, title, location), "job_id") == want


def test_search_order_and_projection(jobs, companies):
    feed = search.search_jobs(jobs, companies)
    assert [r["job_id"] for r in feed.collect()] == [5, 2, 1]
    assert len(feed.columns) == 12


def test_saved_searches(spark, jobs):
    s = spark.createDataFrame([("a", "red", ""), ("b", "e", "oslo"), ("c", "r_d", None), ("d", None, "OSLO")], "search_id string, title string, location string")
    got = sorted((r["search_id"], r["job_id"]) for r in search.match_saved_searches(s, jobs).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2), ("d", 1), ("d", 5)]


def test_saved_searches_of_all_kinds(spark, monkeypatch, capsys):
    """Long and short literals, wildcards alone, escapes and other letters: as all patterns on all jobs, without a nested loop."""
    monkeypatch.setattr(search, "BLOCK", 7)
    titles = ["Red Engineer", "b", "", "ab", "100% sure", "a_b", "ÉCOLE chef", "İstanbul ok", "x\\y", None, "Straße", "baker"]
    jobs = spark.createDataFrame([(k, t, p, k % 5 != 4) for k, (t, p) in enumerate((t, p) for t in titles for p in ("Oslo", "Os", "", None))], "job_id long, title string, location string, is_active boolean")
    terms = [None, "", "%", "_", "__", "a", "AB", "b%", "red", "r_d", "%e_g%", "\\%", "\\_", "é", "école", "i", "sure%", "ok", "STRASSE", "ß", "x\\\\y"]
    asked = spark.createDataFrame([(f"{k}/{m}", t, p) for k, t in enumerate(terms) for m, p in enumerate(("", None, "os", "%", "_s", "oslo", "o"))], "search_id string, title string, location string")
    found = search.match_saved_searches(asked.union(asked.limit(5)), jobs)
    fits = lambda c, term: F.coalesce(F.col(term) == "", F.lit(True)) | contains_ilike(F.col(c), F.col(term))
    both = asked.withColumnsRenamed({"title": "t", "location": "l"}).crossJoin(jobs.filter("is_active"))
    want = both.filter(fits("title", "t") & fits("location", "l"))
    pairs = lambda df: sorted((r["search_id"], r["job_id"]) for r in df.select("search_id", "job_id").collect())
    assert pairs(found) == pairs(want) and want.count() > 1000
    found.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scalars(spark):
    df = spark.createDataFrame([("﻿\t a b  \n", "2.25", "99.95", "")], "s string, a string, b string, e string")
    r = df.select(trimmed(F.col("s")).alias("s"), decimal_or_null(F.col("a"), 3, 1).alias("a"), decimal_or_null(F.col("b"), 3, 1).alias("b"), is_falsy(F.col("e")).alias("e"), is_falsy(F.lit(0), numeric=True).alias("z"), is_falsy(F.lit(None).cast("string")).alias("n")).first()
    assert (r["s"], str(r["a"]), r["b"], r["e"], r["z"], r["n"]) == ("a b", "2.3", None, True, True, True)


def test_admission(spark, users, jobs):
    rows = [("a1", 1, 1, at(10)), ("a0", 1, 1, at(20)), ("b", 1, 2, at(5)), ("c", 1, 3, at(5)), ("d", 4, 1, at(5)), ("e", 3, 1, at(5)), ("f", 99, 1, at(5)), ("g", 0, 1, at(5)), ("h", 1, 10, at(5)), ("i", 2, 1, at(30))]
    attempts = spark.createDataFrame(rows, "attempt_id string, job_id long, user_id long, attempted_at timestamp_ntz")
    new, rejects = applications.admit(attempts, users, jobs)
    assert ids(new, "application_id") == ["a1", "i"]
    assert all(r["subscribed"] for r in new.collect())
    assert {r["attempt_id"]: r["reason"] for r in rejects.collect()} == {"a0": "duplicate", "b": "no_resume", "c": "no_resume", "d": "job_inactive", "e": "job_inactive", "f": "job_not_found", "g": "no_job_id", "h": "not_jobseeker"}
    literal, again = applications.admit(attempts, users, jobs, scope="literal")
    assert ids(literal, "application_id") == ["a1"]
    assert {r["attempt_id"] for r in again.filter("code = 409").collect()} == {"a0", "i"}
    existing = spark.createDataFrame([(1, "ann@x")], "job_id long, applicant_email string")
    assert ids(applications.admit(attempts, users, jobs, existing)[0], "application_id") == ["i"]


def apps(spark):
    rows = [("x", 1, "ann@x", "Submitted", "r", at(3), True), ("y", 1, "bob@x", "Submitted", "r", at(1), False), ("z", 1, "cy@x", "Hired", "r", at(9), None), ("w", 4, "ann@x", "Submitted", "r", at(2), True)]
    return spark.createDataFrame(rows, TABLES["applications"])


def test_queue_puts_null_first(spark):
    ranked = applications.applicant_queue(apps(spark)).filter("job_id = 1").orderBy("place").collect()
    assert [r["application_id"] for r in ranked] == ["z", "x", "y"]
    assert applications.applicant_queue(apps(spark), k=1).count() == 2


def test_decisions(spark, users, jobs):
    asked = spark.createDataFrame([(1, 10, "x", "Hired", at(1)), (2, 10, "x", "Submitted", at(2)), (3, 11, "x", "Hired", at(3)), (4, 10, "nope", "Hired", at(1)), (5, 1, "x", "Hired", at(1)), (6, 10, "z", "Hired", at(1)), (7, 10, "x", "hired", at(4)), (8, 10, "x", None, at(5))], "request_id long, actor_user_id long, application_id string, status string, requested_at timestamp_ntz")
    new, made, rejects = applications.decide(apps(spark), jobs, users, asked)
    assert {r["application_id"]: r["status"] for r in new.collect()} == {"x": "Submitted", "y": "Submitted", "z": "Hired", "w": "Submitted"}
    assert ids(made, "request_id") == [1, 2, 6]
    assert {r["request_id"]: (r["code"], r["reason"]) for r in rejects.collect()} == {3: (404, "not_owner"), 4: (404, "application_not_found"), 5: (403, "not_recruiter"), 7: (400, "bad_status"), 8: (400, "bad_status")}


def test_register(spark, users):
    asked = spark.createDataFrame([
        (1, "N", "n@x", "1", "jobseeker", None, "r", "p", at(1)), (2, "N2", "n@x", "1", "jobseeker", None, "r", "p", at(2)), (3, "A", "ann@x", "1", "jobseeker", None, "r", "p", at(1)), (4, "B", "b@x", "1", "jobseeker", None, None, None, at(1)),
        (5, "", "c@x", "1", "jobseeker", None, "r", "p", at(1)), (6, "D", "d@x", "1", "admin", None, "r", "p", at(1)), (7, "E", "e@x", "1", "recruiter", "bio", "r", "p", at(1)),
    ], "request_id long, name string, email string, phone_number string, role string, bio string, resume string, resume_public_id string, requested_at timestamp_ntz")
    new, rejects = lifecycle.register_users(users, asked)
    made = {r["email"]: r for r in new.filter("user_id > 11").collect()}
    assert set(made) == {"n@x", "e@x"} and made["n@x"]["bio"] == "" and made["e@x"]["bio"] is None and made["e@x"]["resume"] is None
    assert sorted(r["user_id"] for r in made.values()) == [12, 13]
    assert {r["request_id"]: r["reason"] for r in rejects.collect()} == {2: "email_exists", 3: "email_exists", 4: "no_resume", 5: "missing_field", 6: "invalid_role"}


def test_job_requests(spark, users, companies, jobs):
    base = dict(actor_user_id=10, title="t", description="d", salary="5", location="l", role="r", job_type="Contract", work_location="Hybrid", company_id=1, openings="2.25", requested_at=at(1))
    changes = [{}, {"salary": "0"}, {"salary": None}, {"salary": "100000000"}, {"openings": "99.95"}, {"job_type": "contract"}, {"company_id": 2}, {"title": "t" * 256}, {"actor_user_id": 1}, {"job_type": None}]
    schema = "request_id long, actor_user_id long, title string, description string, salary string, location string, role string, job_type string, work_location string, company_id long, openings string, requested_at timestamp_ntz"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    asked = spark.createDataFrame([tuple(({"request_id": k} | base | c)[n] for n in names) for k, c in enumerate(changes)], schema)
    asked = asked.withColumn("salary", F.col("salary").cast("decimal(20,4)")).withColumn("openings", F.col("openings").cast("decimal(20,4)"))
    new, rejects = lifecycle.create_jobs(jobs, companies, users, asked)
    assert [str(r["openings"]) for r in new.filter("job_id > 5").collect()] == ["2.3"]
    assert {r["request_id"]: r["reason"] for r in rejects.collect()} == {1: "missing_field", 2: "missing_field", 3: "bad_salary", 4: "bad_openings", 5: "bad_job_type", 6: "company_not_found", 7: "too_long", 8: "not_recruiter", 9: "bad_job_type"}


def test_profile_updates_fold(spark, users):
    asked = spark.createDataFrame([(1, 1, "New", "", None, at(1)), (2, 1, "", "99", None, at(2)), (3, 2, None, None, "hi", at(1)), (4, 77, "x", None, None, at(1)), (5, 2, "y", "1" * 21, None, at(9))], "request_id long, user_id long, name string, phone_number string, bio string, requested_at timestamp_ntz")
    new, rejects = lifecycle.update_profiles(users, asked)
    got = {r["user_id"]: (r["name"], r["phone_number"], r["bio"]) for r in new.collect()}
    assert {r["request_id"]: (r["code"], r["reason"]) for r in rejects.collect()} == {4: (404, "user_not_found"), 5: (400, "too_long")}
    assert got[1] == ("New", "99", "bio") and got[2] == ("Bob", "2", "hi") and got[3] == ("Cy", "3", None)


def test_delete_cascade(spark, companies, jobs):
    asked = spark.createDataFrame([(1, 1, 10, at(1)), (2, 2, 10, at(1)), (3, 9, 10, at(1))], "request_id long, company_id long, actor_user_id long, requested_at timestamp_ntz")
    c, j, a, rejects = lifecycle.delete_companies(companies, jobs, apps(spark), asked)
    assert ids(c, "company_id") == [2, 3] and ids(j, "job_id") == [4, 5] and ids(a, "application_id") == ["w"] and ids(rejects, "request_id") == [2, 3]


def test_skills_twice_is_once(spark, users):
    have = spark.createDataFrame([(7, "Python")], TABLES["skills"])
    links = spark.createDataFrame([(1, 7)], TABLES["user_skills"])
    asked = spark.createDataFrame([(1, 1, " Python ", at(1)), (2, 1, "python", at(2)), (3, 2, "python\t", at(3)), (4, 2, "   ", at(4)), (5, 77, "x", at(5)), (6, 1, "python", at(6))], "request_id long, user_id long, skill_name string, requested_at timestamp_ntz")
    s, us, results, rejects = skills.add_skills(have, links, users, asked)
    assert {r["request_id"]: r["outcome"] for r in results.collect()} == {1: "already_had", 2: "added", 3: "added", 6: "already_had"}
    assert {r["request_id"]: r["reason"] for r in rejects.collect()} == {4: "blank_skill", 5: "user_not_found"}
    assert sorted((r["skill_id"], r["name"]) for r in s.collect()) == [(7, "Python"), (8, "python")]
    s2, us2, again, _ = skills.add_skills(s, us, users, asked)
    assert sorted(us2.collect()) == sorted(us.collect()) and s2.count() == 2 and {r["outcome"] for r in again.collect()} == {"already_had"}
    left, missing = skills.remove_skills(s, us, users, asked)
    assert left.count() == 0 and ids(missing, "request_id") == [4, 5, 6]


def test_resets(spark, users):
    log = [
        (1, "ann@x", at(0), "request", "t1"), (2, "ann@x", at(899), "attempt", "t1"), (3, "ann@x", at(899), "attempt", "t1"), (4, "ann@x", at(1000), "request", "t2"), (5, "ann@x", at(1000), "attempt", "t1"), (6, "ann@x", at(1900), "attempt", "t2"),
        (7, "bob@x", at(0), "request", "b1"), (8, "bob@x", at(900), "attempt", "b1"), (9, "bob@x", at(950), "request", "b2"), (10, "bob@x", at(951), "attempt", "bad"), (11, "bob@x", at(952), "attempt", "b2"), (12, "who@x", at(0), "request", "w"), (13, "who@x", at(1), "attempt", "w"),
    ]
    df = spark.createDataFrame(log, "event_id long, email string, ts timestamp_ntz, kind string, token string")
    got = {r["event_id"]: r["outcome"] for r in tokens.resolve_resets(df, users).collect()}
    assert got == {2: "ok", 3: "expired", 5: "mismatch", 6: "expired", 8: "expired", 10: "mismatch", 11: "ok", 13: "expired"}


def test_mail_values(spark):
    values = ['{"to":"a@x","subject":"s","html":"<b \\"q\\">"}', None, "{}", "null", "[1]", '{"to":1} x', '{"to":"a', '{"to":""}', "NaN"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    parsed = notify.parse_mails(df)
    assert notify.outbox(parsed).collect()[0]["html"] == '<b "q">'
    assert [r["reason"] for r in parsed.collect()] == [None, "no_recipient", "no_recipient", "not_an_object", "not_an_object", "invalid_json", "invalid_json", "no_recipient", "invalid_json"]


def test_documents(spark, tmp_path):
    ats = '{"atsScore": 80, "scoreBreakdown": {"formatting": {"score": 70, "feedback": "f"}}, "suggestions": [{"category": "c", "issue": "i", "recommendation": "r", "priority": "high"}], "strengths": ["s"], "summary": "x"}'
    raw = spark.createDataFrame([(1, f"```json\n{ats}\n```"), (2, ats.replace("80", "101")), (3, "here: {}"), (4, "``` ```"), (5, '{"a": NaN}'), (6, None)], "doc_id long, raw string")
    good, rejects = documents.parse_ats(raw)
    assert ids(good, "doc_id") == [1]
    assert {r["doc_id"]: r["reason"] for r in rejects.collect()} == {2: "bad_score", 3: "invalid_json", 4: "empty", 5: "invalid_json", 6: "empty"}
    assert {r["dimension"]: r["median_score"] for r in documents.ats_summary(good).collect()} == {"total": 80, "formatting": 70}
    assert documents.ats_issues(good).first()["n"] == 1
    career, _ = documents.parse_career(spark.createDataFrame([(1, '{"summary": "s", "skillsToLearn": [{"category": "c", "skills": [{"title": "t"}]}]}')], "doc_id long, raw string"))
    assert career.first()["doc"]["skillsToLearn"][0]["skills"][0]["title"] == "t"
    (tmp_path / "cv.pdf").write_bytes(b"x" * 100)
    (tmp_path / "big.pdf").write_bytes(b"x" * 200)
    files, large = assets.ingest_files(spark, str(tmp_path / "*.pdf"), max_bytes=150)
    assert [(r["length"], r["code"], r["reason"]) for r in large.collect()] == [(200, 413, "too_large")]
    row = files.first()
    assert row["mime"] == "application/pdf" and "\n" not in row["data_uri"]
    df = spark.createDataFrame([(row["data_uri"],), ("data:image/png;base64,AAAA",), ("!!",), ("QUJD",)], "pdf_base64 string")
    assert [r["content"] and bytes(r["content"]) for r in documents.decode_pdfs(df).collect()] == [b"x" * 100, None, None, b"ABC"]


def test_mails_escape(spark):
    made = spark.createDataFrame([("a@x", "R&D <b>")], "applicant_email string, job_title string")
    assert "R&D <b>" in notify.status_mails(made).first()["html"] and "R&amp;D &lt;b&gt;" in notify.status_mails(made, escape=True).first()["html"]
    html = notify.reset_mails(spark.createDataFrame([("a@x", "tok"), ("b@x", "t2")], "email string, token string"), spark.createDataFrame([("a@x",)], "email string"), "https://h/").collect()
    assert len(html) == 1 and html[0]["html"].count("https://h/reset/tok") == 2


def test_tables(spark, users, tmp_path):
    write_table(users, str(tmp_path / "u"))
    assert read_table(spark, "users", str(tmp_path / "u")).count() == users.count()
    assert '"bio":null' in to_json_rows(users.filter("user_id = 2")).first()["value"]
    assert d.PDF_PREFIX.startswith("data:")


def test_job_updates_keep_the_tables_rules(spark, jobs):
    base = dict(job_id=1, actor_user_id=10, title="t", description="d", salary="5", location="l", role="r", job_type="Contract", work_location="Hybrid", openings="2", is_active=None, requested_at=at(1))
    changes = [{}, {"title": None}, {"description": None}, {"role": None}, {"actor_user_id": 11}, {"job_id": 99}, {"role": "r" * 256}, {"location": None, "requested_at": at(2)}]
    schema = "request_id long, job_id long, actor_user_id long, title string, description string, salary string, location string, role string, job_type string, work_location string, openings string, is_active boolean, requested_at timestamp_ntz"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    asked = spark.createDataFrame([tuple(({"request_id": k} | base | c)[n] for n in names) for k, c in enumerate(changes)], schema)
    new, rejects = lifecycle.update_jobs(jobs, asked)
    assert {r["request_id"]: r["reason"] for r in rejects.collect()} == {1: "null_field", 2: "null_field", 3: "null_field", 4: "not_owner", 5: "job_not_found", 6: "too_long"}
    row = new.filter("job_id = 1").first()
    assert (row["title"], row["location"], row["is_active"]) == ("t", None, None)


def test_files_and_their_rejects(spark, users):
    asked = spark.createDataFrame([(1, 1, "u1", "p1", at(1)), (2, 1, "u2", "p2", at(2)), (3, 50, "u", "p", at(1)), (4, 2, "", "p", at(1)), (5, 2, "u" * 256, "p", at(1))], "request_id long, user_id long, url string, public_id string, requested_at timestamp_ntz")
    new, rejects = lifecycle.replace_files(users, asked, "profile_pic")
    assert {r["user_id"]: r["profile_pic"] for r in new.collect()} == {1: "u2", 2: None, 3: None, 10: None, 11: None}
    assert {r["request_id"]: r["reason"] for r in rejects.collect()} == {3: "user_not_found", 4: "no_file", 5: "too_long"}


def test_company_pages_hold_whole_jobs(companies, jobs):
    from tallyhire.operators.companies import company_pages

    pages = {r["company_id"]: r["jobs"] for r in company_pages(companies, jobs).collect()}
    assert [j["job_id"] for j in pages[1]] == [1, 2, 3] and pages[3] == []
    assert set(pages[1][0].asDict()) == set(jobs.columns)
    first = {r["company_id"]: [j["job_id"] for j in r["jobs"]] for r in company_pages(companies, jobs, max_jobs=1).collect()}
    assert first == {1: [1], 2: [4], 3: []}


def test_queue_parts_equal_one_window(spark):
    import random
    from datetime import timedelta

    rng = random.Random(4)
    rows = [(f"a{k}", 1 + k % 2, f"u{k}@x", "Submitted", "r", None if rng.random() < 0.1 else T0 + timedelta(hours=rng.randrange(200)), rng.choice([None, True, False])) for k in range(300)]
    df = spark.createDataFrame(rows, TABLES["applications"])
    whole = {r["application_id"]: r["place"] for r in applications.applicant_queue(df, k=1000).collect()}
    assert {r["application_id"]: r["place"] for r in applications.applicant_queue(df).collect()} == whole


def test_approximate_counts_are_close(spark):
    from tallyhire.operators.analytics import approximate_applicants

    df = spark.range(20_000).selectExpr("id % 2 AS job_id", "concat('u', id % 3000) AS applicant_email")
    assert all(abs(r["applicants"] - 1500) < 120 for r in approximate_applicants(df).collect())


def test_plans_have_no_cartesian_product_and_no_single_window(spark):
    from tallyhire.plans.queries import QUERIES

    for name in ("active_job_search", "company_pages", "application_admission", "applicant_queue", "skill_job_match", "skills_to_learn", "reset_asof_900s", "decided_applications"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        above = [x for k, line in enumerate(lines) if "Exchange SinglePartition" in line for x in lines[max(0, k - 3) : k]]
        assert "CartesianProduct" not in plan and not any("Window" in x for x in above), name
    plan = QUERIES["jobs_by_id"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_partkey" in plan and "l_comment" not in plan


def test_declared_cascade_equals_the_written_ones(spark, companies, jobs):
    applications = spark.createDataFrame([(f"a{k}", k % 9) for k in range(40)] + [("none", None)], "application_id string, job_id long")
    requests = companies.select(F.col("company_id"), F.col("recruiter_id").alias("actor_user_id"), F.col("company_id").cast("string").alias("request_id")).limit(1)
    by_hand = lifecycle.delete_companies(companies, jobs, applications, requests)
    tables = {"applications": applications, "jobs": jobs, "companies": companies}
    declared = lifecycle.delete_cascading(tables, {"companies": requests.select("company_id")})
    for name, want in zip(("companies", "jobs", "applications"), by_hand, strict=False):
        assert sorted(map(str, declared[name].collect())) == sorted(map(str, want.select(declared[name].columns).collect()))
    users, skills = spark.range(6).withColumnRenamed("id", "user_id"), spark.range(4).withColumnRenamed("id", "skill_id")
    bridge = users.join(skills, F.lit(True)).unionByName(spark.createDataFrame([(None, 1)], "user_id long, skill_id long"))
    removed = {"users": users.filter("user_id < 2"), "skills": skills.filter("skill_id = 3")}
    want = lifecycle.cascade(lifecycle.cascade(bridge, removed["users"], "user_id"), removed["skills"], "skill_id")
    found = lifecycle.delete_cascading({"users": users, "skills": skills, "user_skills": bridge}, removed)
    assert sorted(map(str, found["user_skills"].collect())) == sorted(map(str, want.collect())) and found["users"].count() == 4
    assert found["skills"].count() == 3 and found["user_skills"].filter("user_id IS NULL").count() == 1


def test_circles_are_an_error(spark):
    one = spark.createDataFrame([(1, 1)], "id long, of long")
    with pytest.raises(ValueError, match="circle"):
        lifecycle.delete_cascading({"a": one, "b": one}, {}, [("a", "of", "b", "id"), ("b", "of", "a", "id")])


def test_hot_email_is_dealt_out_by_hours(spark, capsys):
    """Carrying requests forward by hours gives what one pass over each email's whole log gives; its plan orders no whole email."""
    rng = random.Random(21)
    start = datetime(1995, 3, 25, 12)
    log = [(k, "hot@x" if k % 3 else f"u{k % 5}@x" if k % 7 else None, start + timedelta(seconds=rng.choice([0, 1, 5, 1800, 3599, 3600, rng.randrange(600_000)])), rng.choice(["request", "attempt", "attempt"]), rng.choice("ab")) for k in range(1500)]
    log += [(9000, "only@x", None, "attempt", "a"), (9001, "hot@x", None, "attempt", "a")]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(log, "event_id long, email string, ts timestamp, kind string, token string").withColumn("ts", F.col("ts").cast(kind))
        found = {r["event_id"]: r["request_id"] for r in tokens.latest_request(df).collect()}
        last, want = {}, {}
        for i, email, ts, what, _ in sorted(log, key=lambda r: (r[2] or datetime(1, 1, 1), r[3] != "request", r[0])):
            if what == "request":
                last[email] = i
            else:
                want[i] = last.get(email)
        assert found == want
    tokens.latest_request(df).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan


def test_white_space_before_a_mail(spark):
    values = [f'{w}{{"to": "a@x", "subject": "s", "html": "h"}}{w}' for w in ("", " ", "\n", "\t", "\r\n ")]
    assert notify.outbox(notify.parse_mails(spark.createDataFrame([(v,) for v in values], "value string"))).count() == 5
