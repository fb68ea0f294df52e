"""Admission and decisions: what they shuffle, and their rows against loops."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tallyhire.operators import applications
from tallyhire.sources.schemas import TABLES

T0 = datetime(1995, 1, 1)
ATTEMPTS = "attempt_id string, job_id long, user_id long, attempted_at timestamp_ntz"
REQUESTS = "request_id long, actor_user_id long, application_id string, status string, requested_at timestamp_ntz"


@pytest.fixture(scope="module")
def users(spark):
    rows = [(k, f"N{k}", None if k == 4 else f"u{k % 4}@x", "1", "recruiter" if k > 8 else "jobseeker", None, "" if k == 2 else "r", None, None, None, T0, None) for k in range(1, 11)]
    return spark.createDataFrame(rows, TABLES["users"])


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(k, f"t{k}", "d", Decimal(1), "l", "Contract", Decimal(1), "r", "Remote", 1, 9 + k % 2, T0, [True, True, False, None][k % 4]) for k in range(1, 9)]
    return spark.createDataFrame(rows, TABLES["jobs"])


@pytest.fixture
def shuffles(spark):
    """Plans with every join shuffled, as between large tables, in which exchanges that repeat are marked."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)

    def plan(name: str) -> str:
        from tallyhire.plans.queries import QUERIES

        return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    yield plan
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["decided_applications", "decision_rejects", "mail_events", "application_rejects"])
def test_lines_are_shuffled_once_by_order_and_once_by_job(shuffles, name):
    lines = [x for x in shuffles(name).splitlines() if "FileScan parquet [l_orderkey" in x]
    assert len(lines) == 1


@pytest.mark.parametrize("name", ["decided_applications", "decision_rejects", "mail_events"])
def test_decisions_meet_applications_in_one_shuffle_of_each(shuffles, name):
    by = [x for x in shuffles(name).splitlines() if "Exchange hashpartitioning(" in x and "ReusedExchange" not in x]
    assert len([x for x in by if "hashpartitioning(application_id" in x]) == 2
    assert not any("hashpartitioning(actor_user_id" in x and "request_id" in x for x in by)


def admitted_by_loop(attempts, users, jobs, keys, existing):
    """(ids of applications, ids and reasons of rejects), one attempt after the other."""
    who, what = {r["user_id"]: r for r in users.collect()}, {r["job_id"]: r for r in jobs.collect()}
    first, new, rejects = {}, [], []
    for i, job, user, _ in sorted(attempts, key=lambda a: (a[3], a[0])):
        u, j = who.get(user), what.get(job)
        key = tuple({"job_id": job, "applicant_email": u and u["email"]}[k] for k in keys)
        reason = "not_jobseeker" if u is None or u["role"] != "jobseeker" else "no_resume" if not u["resume"] else "no_job_id" if not job else "job_not_found" if j is None else "job_inactive" if not j["is_active"] else None
        if reason is None and key in existing:
            reason = "duplicate"
        if reason is None and key not in first:
            first[key] = i
            new.append(i)
        elif reason is not None or first[key] != i:
            rejects.append((i, reason or "duplicate"))
    return Counter(new), Counter(rejects)


@pytest.mark.parametrize("scope", ["declared", "literal"])
@pytest.mark.parametrize("held", [False, True])
def test_admission_equals_a_loop(spark, users, jobs, scope, held):
    """Null emails, emails of several users, attempts that repeat, unknown users and jobs, equal times."""
    dice = random.Random(7)
    rows = [(f"a{dice.randrange(300)}", dice.choice([None, *range(10)]), dice.choice([None, *range(12)]), T0 + timedelta(seconds=dice.randrange(40))) for _ in range(400)]
    keys = {"declared": ["job_id", "applicant_email"], "literal": ["applicant_email"]}[scope]
    old = [(1, "u1@x"), (1, "u1@x"), (5, "u3@x"), (4, None)] if held else []
    existing = spark.createDataFrame(old, "job_id long, applicant_email string") if held else None
    new, rejects = applications.admit(spark.createDataFrame(rows, ATTEMPTS), users, jobs, existing, scope)
    taken = {tuple({"job_id": j, "applicant_email": e}[k] for k in keys) for j, e in old if e}
    want = admitted_by_loop(rows, users, jobs, keys, taken)
    assert Counter(r["application_id"] for r in new.collect()) == want[0] and sum(want[0].values()) > 1
    assert Counter((r["attempt_id"], r["reason"]) for r in rejects.collect()) == want[1]


def test_attempts_may_bring_their_users(spark, users, jobs):
    rows = spark.createDataFrame([("a", 1, 1, T0), ("b", 1, 1, T0), ("c", 1, 2, T0), ("d", 1, 99, T0)], ATTEMPTS)
    for attempts in (rows, applications.with_users(rows, users)):
        new, rejects = applications.admit(attempts, users, jobs)
        assert [r["application_id"] for r in new.collect()] == ["a"]
        assert {r["attempt_id"]: r["reason"] for r in rejects.collect()} == {"b": "duplicate", "c": "no_resume", "d": "not_jobseeker"}


def test_an_id_of_two_users_judges_a_request_once(spark, users, jobs):
    """Six-fold tables have customers whose number is a recruiter's id, too."""
    both = users.union(users.filter("user_id = 1").selectExpr("CAST(9 AS BIGINT) AS user_id", *users.columns[1:]))
    held = spark.createDataFrame([("x", 2, "u1@x", "Submitted", "r", T0, True), ("y", 1, "u2@x", "Submitted", "r", T0, True)], TABLES["applications"])
    asked = spark.createDataFrame([(1, 9, "x", "Hired", T0), (2, 9, "y", "Hired", T0)], REQUESTS)
    new, made, rejects = applications.decide(held, jobs, both, asked)
    assert sorted((r["application_id"], r["status"]) for r in new.collect()) == [("x", "Hired"), ("y", "Submitted")]
    assert [r["request_id"] for r in made.collect()] == [1]
    assert [(r["request_id"], r["reason"]) for r in rejects.collect()] == [(2, "not_owner")]


def test_decisions_equal_a_loop(spark, users, jobs):
    """Owners and others, bad and missing statuses, equal times, applications without an email, an owner or a job."""
    dice = random.Random(3)
    pick = lambda *x: dice.choice(x)
    unowned = jobs.selectExpr(*(f"IF(job_id = 3, NULL, {c}) AS {c}" if c == "posted_by_recruiter_id" else f"IF(job_id = 6, NULL, {c}) AS {c}" if c == "title" else c for c in jobs.columns))
    held = [(f"p{k}", k % 10 or None, None if k % 7 == 0 else "u@x", pick("Submitted", "Rejected"), "r", T0, True) for k in range(40)]
    asked = [(k, pick(None, 1, 9, 9, 10, 10), pick(None, *(f"p{k}" for k in range(45))), pick("Hired", "Rejected", "Submitted", "Paused", None), T0 + timedelta(seconds=dice.randrange(3))) for k in range(500)]
    what = {r["job_id"]: r for r in unowned.collect()}
    rows, status, made, reasons = {a[0]: a for a in held}, {a[0]: a[3] for a in held}, [], {}
    for k, actor, i, to, _ in sorted(asked, key=lambda r: (r[4], r[0])):
        a = rows.get(i)
        job = a and what.get(a[1])
        reasons[k] = "not_recruiter" if actor not in (9, 10) else "application_not_found" if not a or a[2] is None else "job_not_found" if not job or job["title"] is None else "not_owner" if job["posted_by_recruiter_id"] != actor else "bad_status" if to in (None, "Paused") else None
        if reasons[k] is None:
            made.append(k)
            status[i] = to
    new, decisions, rejects = applications.decide(spark.createDataFrame(held, TABLES["applications"]), unowned, users, spark.createDataFrame(asked, REQUESTS))
    assert sorted((r["application_id"], r["status"]) for r in new.collect()) == sorted(status.items())
    assert sorted(r["request_id"] for r in decisions.collect()) == sorted(made) and len(made) > 30
    assert {r["request_id"]: r["reason"] for r in rejects.collect()} == {k: v for k, v in reasons.items() if v} and rejects.count() + len(made) == 500
