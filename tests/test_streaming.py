"""Streams over files: batch twins, restarts, state."""

from __future__ import annotations

import base64
import hashlib
import random
from datetime import datetime, timedelta

import pytest

from tallyhire.operators import applications, tokens
from tallyhire.streaming import jobs as streams
from tallyhire.streaming.state import VERDICT

T0 = datetime(1995, 1, 1)


def drained(query):
    query.awaitTermination(120)


def test_delivery_survives_a_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([('{"to":"a@x","subject":"s","html":"h"}',), ("{bad",)], "value string").write.parquet(source)
    events = spark.readStream.schema("value string").parquet(source)
    drained(streams.deliver(events, out, check).trigger(availableNow=True).start())
    spark.createDataFrame([('{"to":"b@x","subject":"s","html":"h"}',)], "value string").write.mode("append").parquet(source)
    drained(streams.deliver(events, out, check).trigger(availableNow=True).start())
    assert sorted(r["to"] for r in spark.read.parquet(f"{out}/outbox").collect()) == ["a@x", "b@x"]
    assert spark.read.parquet(f"{out}/mail_rejects").count() == 1


def test_first_application_stays(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, "a@x", 1), (2, "a@x", 2)], "job_id long, applicant_email string, n int").write.parquet(path)
    spark.createDataFrame([(1, "a@x", 3)], "job_id long, applicant_email string, n int").write.mode("append").parquet(path)
    stream = streams.first_applications(spark.readStream.schema("job_id long, applicant_email string, n int").option("maxFilesPerTrigger", 1).parquet(path))
    q = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drained(q)
    assert spark.table("firsts").count() == 2


def test_status_mails_and_volume(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("x", "a@x", 1, "Hired")], "application_id string, applicant_email string, job_id long, status string").write.parquet(path)
    jobs = spark.createDataFrame([(1, "Dev")], "job_id long, title string")
    stream = streams.status_mail_stream(spark.readStream.schema("application_id string, applicant_email string, job_id long, status string").parquet(path), jobs)
    drained(stream.writeStream.format("memory").queryName("mails").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert "Dev" in spark.table("mails").first()["value"]
    rows = [(T0 + timedelta(minutes=m), "request", "a@x") for m in (1, 2, 61, 300)]
    spark.createDataFrame(rows, "ts timestamp, kind string, to string").write.parquet(str(tmp_path / "v"))
    events = spark.readStream.schema("ts timestamp, kind string, to string").parquet(str(tmp_path / "v"))
    drained(streams.mail_volume_stream(events).writeStream.format("memory").queryName("volume").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start())
    assert sorted(r["n"] for r in spark.table("volume").collect()) == [1, 2]


def run(stream, name, tmp_path):
    drained(stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start())
    return stream.sparkSession.table(name).collect()


LOG = "event_id long, email string, ts timestamp, kind string, token string"


def test_reset_stream_equals_batch(spark, tmp_path):
    users = spark.createDataFrame([("ann@x",), ("bob@x",), ("bob@x",)], "email string")
    log = [(1, "ann@x", 0, "request", "t1"), (2, "ann@x", 899, "attempt", "t1"), (3, "ann@x", 899, "attempt", "t1"), (4, "ann@x", 1000, "request", "t2"), (5, "ann@x", 1000, "attempt", "t1"), (6, "ann@x", 1900, "attempt", "t2")]
    log += [(7, "bob@x", 0, "request", "b"), (8, "bob@x", 900, "attempt", "b"), (9, "bob@x", 950, "request", "b2"), (10, "bob@x", 951, "attempt", "b2"), (11, "who@x", 0, "request", "w"), (12, "who@x", 1, "attempt", "w")]
    df = spark.createDataFrame([(i, e, T0 + timedelta(seconds=s), k, t) for i, e, s, k, t in log], LOG)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = run(streams.reset_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), users), "resets", tmp_path)
    want = {r["event_id"]: r["outcome"] for r in tokens.resolve_resets(df, users).collect()}
    assert want[10] == "ok" and want[12] == "expired"
    assert {r["event_id"]: r["outcome"] for r in found} == want and len(found) == len(want)


def to_files(stream, tmp_path, name="out", mode="append"):
    """Runs what there is into Parquet, from the checkpoint on; the rows of all runs, and the query."""
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c_{name}")).outputMode(mode).trigger(availableNow=True).start()
    drained(q)
    assert q.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name)).collect(), q


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_reset_state_goes_with_the_watermark(spark, tmp_path):
    users = spark.createDataFrame([("ann@x",), ("bob@x",)], "email string")
    path = str(tmp_path / "in")
    for rows in [[(1, "ann@x", 0, "request", "t")], [(2, "bob@x", 9000, "request", "b")], [(3, "bob@x", 9001, "attempt", "b")], [(4, "who@x", 20000, "attempt", "b")]]:
        spark.createDataFrame([(i, e, at(s), k, t) for i, e, s, k, t in rows], LOG).coalesce(1).write.mode("append").parquet(path)
        found, q = to_files(streams.reset_stream(spark.readStream.schema(LOG).parquet(path), users, delay="1 minute"), tmp_path)
        left = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert {r["event_id"]: r["outcome"] for r in found} == {3: "ok", 4: "expired"}
    assert left[-1] == 0


def test_stored_tokens_are_used_up(spark, tmp_path):
    """A job begun with live tokens takes them once, knows their ends, and lets later requests replace them."""
    users = spark.createDataFrame([(f"{n}@x",) for n in "abcd"], "email string")
    stored = spark.createDataFrame([("a@x", "old", at(-800)), ("a@x", "older", at(-850)), ("b@x", "old", at(-800)), ("c@x", "old", at(-800)), ("d@x", "old", at(-800))], "email string, token string, issued_at timestamp")
    rows = [(1, "a@x", 50, "attempt", "older"), (2, "a@x", 51, "attempt", "old"), (3, "a@x", 52, "attempt", "old"), (4, "b@x", 100, "attempt", "old"), (5, "c@x", 10, "request", "new"), (6, "c@x", 20, "attempt", "old"), (7, "c@x", 700, "attempt", "new")]
    spark.createDataFrame([(i, e, at(s), k, t) for i, e, s, k, t in rows], LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    found, q = to_files(streams.reset_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), users, delay="1 minute", stored=stored), tmp_path)
    assert {r["event_id"]: r["outcome"] for r in found} == {1: "mismatch", 2: "ok", 3: "expired", 4: "expired", 6: "mismatch", 7: "ok"}
    left = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert left[-1] == 0  # d's token went by its timer alone


ATTEMPTS = "attempt_id string, user_id long, job_id long, attempted_at timestamp"


def portal_of(spark):
    users = spark.createDataFrame(
        [(k, "recruiter" if k == 7 else "jobseeker", f"u{k % 6}@x" if k != 8 else None, "" if k == 9 else "cv", at(100) if k % 2 else None) for k in range(1, 11)],
        "user_id long, role string, email string, resume string, subscription timestamp",
    )
    jobs = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None), (5, True)], "job_id long, is_active boolean")
    rng = random.Random(12)
    rows = [(f"t{k % 230}" if k < 240 else f"t{k}", rng.randrange(0, 13), rng.choice([0, 1, 1, 1, 2, 2, 3, 4, 5, 6, None]), at(rng.randrange(300))) for k in range(400)]
    rows = [r if r[0] not in {x[0] for x in rows[:k]} else next(x for x in rows if x[0] == r[0]) for k, r in enumerate(rows)]  # what repeats is the same attempt
    return users, jobs, rows


def as_batch(spark, users, jobs, rows, **options):
    new, rejects = applications.admit(spark.createDataFrame(rows, ATTEMPTS), users, jobs, **options)
    return sorted(map(tuple, new.collect()), key=str), sorted(map(tuple, rejects.collect()), key=str)


def from_stream(spark, tmp_path, found):
    done = spark.createDataFrame(found, VERDICT)
    return sorted(map(tuple, streams.admitted(done).collect()), key=str), sorted(map(tuple, streams.refused(done).collect()), key=str)


@pytest.mark.parametrize("scope", ["declared", "literal"])
def test_shuffled_admission_equals_batch(spark, tmp_path, scope):
    """Attempts in any order of arrival, over files, a restart and a stored table: every one of them as in the batch, row for row."""
    users, jobs, rows = portal_of(spark)
    existing = spark.createDataFrame([("e1", 1, "u1@x"), ("e2", 5, "u2@x")], "application_id string, job_id long, applicant_email string")
    path, shuffled = str(tmp_path / "in"), random.Random(1).sample(rows, len(rows))
    stream = lambda: streams.admission_stream(spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(path), users, jobs, existing, scope, wait="10 minutes")
    for k, part in enumerate([shuffled[:90], shuffled[90:200], shuffled[200:], [("end", 1, None, at(100_000))]]):
        spark.createDataFrame(part, ATTEMPTS).coalesce(1).write.mode("append").parquet(path)
        if k in (1, 3):
            found, _ = to_files(stream(), tmp_path)
    want = as_batch(spark, users, jobs, [*rows, ("end", 1, None, at(100_000))], existing=existing, scope=scope)
    assert from_stream(spark, tmp_path, found) == want
    assert want[0] and {r[4] for r in want[1]} == {"not_jobseeker", "no_resume", "no_job_id", "job_not_found", "job_inactive", "duplicate"}


def test_admission_by_arrival(spark, tmp_path):
    """Without waiting, in order of arrival: the same as the batch where files come in order; a late attempt is a duplicate, never lost."""
    users, jobs, rows = portal_of(spark)
    ordered = sorted(rows, key=lambda r: (r[3], r[0]))
    path = str(tmp_path / "in")
    stream = lambda: streams.admission_stream(spark.readStream.schema(ATTEMPTS).parquet(path), users, jobs)
    cut = next(k for k in range(200, 400) if ordered[k][3] != ordered[k - 1][3])
    for part in (ordered[:cut], ordered[cut:]):
        spark.createDataFrame(part, ATTEMPTS).coalesce(1).write.mode("append").parquet(path)
        found, _ = to_files(stream(), tmp_path)
    assert from_stream(spark, tmp_path, found) == as_batch(spark, users, jobs, rows)
    winner = next(r for r in ordered if r[0] == streams.admitted(spark.createDataFrame(found, VERDICT)).first()["application_id"])
    spark.createDataFrame([("early", winner[1], winner[2], at(-5)), winner], ATTEMPTS).coalesce(1).write.mode("append").parquet(path)
    more, _ = to_files(stream(), tmp_path)
    assert {(r["attempt_id"], r["code"]) for r in more} - {(r["attempt_id"], r["code"]) for r in found} == {("early", 409)}


def test_sessions_and_sliding_windows(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=m), "request", "a@x") for m in (1, 2, 61, 600)]
    spark.createDataFrame(rows, "ts timestamp, kind string, to string").write.parquet(str(tmp_path / "v"))
    events = lambda: spark.readStream.schema("ts timestamp, kind string, to string").parquet(str(tmp_path / "v"))
    assert sorted(r["n"] for r in run(streams.mail_sessions(events()), "sessions", tmp_path)) == [1, 2]
    sliding = run(streams.mail_volume_stream(events(), window="2 hours", slide="1 hour"), "sliding", tmp_path)
    assert sorted(r["n"] for r in sliding) == [1, 2, 3]


def test_repeated_mails_go_out_once(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=m), "a@x", s, "h") for m, s in ((1, "s"), (2, "s"), (3, "t"))]
    spark.createDataFrame(rows, "ts timestamp, to string, subject string, html string").write.parquet(str(tmp_path / "m"))
    mails = spark.readStream.schema("ts timestamp, to string, subject string, html string").parquet(str(tmp_path / "m"))
    assert sorted(r["subject"] for r in run(streams.without_repeats(mails), "once", tmp_path)) == ["s", "t"]


def test_files_are_stored_once(spark, tmp_path):
    """The same content under two names, in one batch or after a restart, is one asset; large files are rejects, unread."""
    folder = tmp_path / "files"
    folder.mkdir()
    stream = lambda: streams.ingest_stream(spark, str(folder), max_bytes=100)
    for name, content in (("a.pdf", b"one"), ("b.pdf", b"two"), ("c.txt", b"one"), ("large.bin", b"x" * 101)):
        (folder / name).write_bytes(content)
    found, _ = to_files(stream(), tmp_path)
    assert len(found) == 3
    for name, content in (("again.pdf", b"two"), ("new.png", b"three"), ("edge.bin", b"y" * 100)):
        (folder / name).write_bytes(content)
    found, _ = to_files(stream(), tmp_path)
    kept = {r["public_id"]: r for r in found if r["code"] is None}
    assert {hashlib.sha256(c).hexdigest() for c in (b"one", b"two", b"three", b"y" * 100)} == set(kept) and len(found) == 5
    assert all(base64.b64decode(r["data_uri"].split(",", 1)[1]) in (b"one", b"two", b"three", b"y" * 100) for r in kept.values())
    assert [(r["path"].rsplit("/", 1)[1], r["length"], r["code"], r["reason"]) for r in found if r["code"]] == [("large.bin", 101, 413, "too_large")]
