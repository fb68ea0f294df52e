"""Properties that hold for any batch of requests."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyhire.operators import applications, lifecycle, search, skills
from tallyhire.sources.schemas import TABLES

T0 = datetime(1995, 1, 1)
few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ids = st.integers(0, 5)


@pytest.fixture(scope="module")
def users(spark):
    rows = [(k, f"N{k}", f"u{k}@x", "1", "recruiter" if k > 3 else "jobseeker", None, "r" if k != 2 else None, None, None, None, T0, None) for k in range(1, 6)]
    return spark.createDataFrame(rows, TABLES["users"])


@pytest.fixture(scope="module")
def jobs(spark):
    from decimal import Decimal as D

    rows = [(k, f"t{k}", "d", D(1), "l", "Contract", D(1), "r", "Remote", k % 2, 4, T0, [True, False, None][k % 3]) for k in range(1, 6)]
    return spark.createDataFrame(rows, TABLES["jobs"])


@few
@given(st.lists(st.tuples(ids, ids, st.integers(0, 3)), max_size=25))
def test_each_attempt_is_admitted_or_rejected_once(spark, users, jobs, attempts):
    rows = [(f"a{k}", j, u, T0 + timedelta(seconds=s)) for k, (j, u, s) in enumerate(attempts)]
    df = spark.createDataFrame(rows, "attempt_id string, job_id long, user_id long, attempted_at timestamp_ntz")
    new, rejects = applications.admit(df, users, jobs)
    made = [r["application_id"] for r in new.collect()]
    assert sorted(made + [r["attempt_id"] for r in rejects.collect()]) == sorted(r[0] for r in rows)
    keys = [(r["job_id"], r["applicant_email"]) for r in new.collect()]
    assert len(keys) == len(set(keys))
    again, late = applications.admit(df, users, jobs, existing=new)
    assert again.count() == 0 and late.count() == len(rows)


@few
@given(st.lists(st.tuples(ids, st.sampled_from(["a", " a", "b\t", "", "  ", "A", "x" * 101])), max_size=20))
def test_skills_twice_is_once(spark, users, requests):
    rows = [(k, u, s, T0) for k, (u, s) in enumerate(requests)]
    asked = spark.createDataFrame(rows, "request_id long, user_id long, skill_name string, requested_at timestamp_ntz")
    have, links = spark.createDataFrame([(7, "a")], TABLES["skills"]), spark.createDataFrame([(1, 7)], TABLES["user_skills"])
    all_skills, mine, results, rejects = skills.add_skills(have, links, users, asked)
    assert sorted(r["request_id"] for r in results.select("request_id").union(rejects.select("request_id")).collect()) == list(range(len(rows)))
    more, same, outcomes, _ = skills.add_skills(all_skills, mine, users, asked)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, mine.collect())) and more.count() == all_skills.count()
    assert {r["outcome"] for r in outcomes.collect()} <= {"already_had"}


@few
@given(st.lists(st.tuples(st.integers(0, 2), ids), max_size=8))
def test_deletions_leave_no_orphans(spark, jobs, requests):
    companies = spark.createDataFrame([(k, f"C{k}", "d", "w", "l", "p", 4 + k, T0) for k in (0, 1)], TABLES["companies"])
    apps = spark.createDataFrame([(f"x{k}", k, "u1@x", "Submitted", "r", T0, None) for k in range(1, 6)], TABLES["applications"])
    asked = spark.createDataFrame([(k, c, u, T0) for k, (c, u) in enumerate(requests)], "request_id long, company_id long, actor_user_id long, requested_at timestamp_ntz")
    c, j, a, rejects = lifecycle.delete_companies(companies, jobs, apps, asked)
    assert j.join(c, "company_id", "left_anti").count() == 0 and a.join(j, "job_id", "left_anti").count() == 0
    gone = {(k, o) for k, o in ((0, 4), (1, 5)) if (k, o) in requests}
    assert c.count() == 2 - len(gone) and rejects.count() == sum((k, o) not in {(0, 4), (1, 5)} for k, o in requests)


def test_no_terms_find_all_active_jobs(spark, jobs):
    companies = spark.createDataFrame([(k, f"C{k}", "d", "w", "l", "p", 4, T0) for k in (0, 1)], TABLES["companies"])
    want = sorted(r["job_id"] for r in jobs.filter("is_active").collect())
    for title, location in ((None, None), ("", ""), (None, ""), ("%", None)):
        assert sorted(r["job_id"] for r in search.search_jobs(jobs, companies, title, location).collect()) == want


@few
@given(st.lists(st.tuples(ids, st.integers(0, 3), st.integers(0, 9)), max_size=15))
def test_first_rows_are_stable(spark, rows):
    df = spark.createDataFrame(rows, "k long, at long, id long")
    once = applications.dedup_first(df, ["k"], ["at", "id"])
    assert sorted(map(tuple, once.collect())) == sorted(min((r for r in rows if r[0] == k), key=lambda r: r[1:]) for k in {r[0] for r in rows})
    assert sorted(map(tuple, applications.dedup_first(once, ["k"], ["at", "id"]).collect())) == sorted(map(tuple, once.collect()))
    assert applications.violations(once, ["k"]).count() == 0
