"""Keyed state of the streams: admission and reset tokens, on the arbitrary-state API with timers.

The RocksDB state store must be set (spark.sql.streaming.stateStore.providerClass). Event times are UTC.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyhire.operators.applications import checked
from tallyhire.operators.tokens import TTL_SECONDS
from tallyhire.sources.shipping import ship

KEYS = {"declared": ["job", "applicant_email"], "literal": ["applicant_email"]}
VERDICT = "attempt_id string, job_id long, user_id long, applicant_email string, resume string, attempted_at timestamp, subscribed boolean, code int, reason string"
#: What the state machine sees: numbers as texts, keys too, as pandas makes doubles of columns of numbers with nulls.
PENDING = "attempt_id string, job string, user string, applicant_email string, resume string, attempted_at timestamp, subscribed boolean"
SEEN = PENDING + ", code string, reason string"
COLUMNS = ["attempt_id", "job", "user", "applicant_email", "resume", "attempted_at", "subscribed", "code", "reason"]
#: Rejected rows need no state; they pass under so many keys.
LANES = 4096


def plain(value: Any) -> Any:
    """A cell as Python has it, null as None."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value


def rows_of(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return [tuple(plain(x) for x in row) for row in frame[columns].itertuples(index=False)]


def millis(ts: Any) -> int:
    ts = pd.Timestamp(ts)
    return int((ts.tz_localize("UTC") if ts.tzinfo is None else ts).timestamp() * 1000)


class Admission(StatefulProcessor):
    """State: the admitted attempt of a key, for good, as the rule has no time limit; with wait, the attempts that are yet to be judged.

    Without wait, the attempts of a micro-batch are judged in order, after those of earlier ones. With wait, an attempt is
    judged once the watermark has passed it, so that the order of arrival doesn't count.
    """

    def __init__(self, wait: bool) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "attempt_id string")
        self.pending = handle.getListState("pending", PENDING) if self.wait else None

    def judged(self, rows: list[tuple]) -> pd.DataFrame:
        held = self.first.get()
        first = held[0] if held is not None else None
        known, out = held is not None, []
        for row in sorted(rows, key=lambda r: (r[5], r[0])):
            if not known:
                known, first = True, row[0]
                self.first.update((first,))
                out.append((*row, None, None))
            elif row[0] != first:  # the admitted attempt may arrive again: it is the same one
                out.append((*row, "409", "duplicate"))
        return frame_of(out)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        refused = found["code"].notna()
        out = [frame_of(rows_of(found[refused], COLUMNS))]
        new = rows_of(found[~refused], COLUMNS[:7])
        if new and not self.wait:
            out.append(self.judged(new))
        elif new:
            self.pending.appendList(new)
            for due in {millis(r[5]) for r in new}:
                self.handle.registerTimer(due)
        return iter(out)  # not a generator, which would run when the state is another key's

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        pending = [tuple(r) for r in self.pending.get()]
        due = [r for r in pending if millis(r[5]) <= passed]
        if not due:
            return iter([])
        rest = [r for r in pending if millis(r[5]) > passed]
        self.pending.put(rest) if rest else self.pending.clear()
        return iter([self.judged(due)])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.first.update((plain(initialState["attempt_id"].min()),))

    def close(self) -> None:
        pass


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({"subscribed": "boolean", "attempted_at": "datetime64[ns]"})


def admission_stream(attempts: DataFrame, users: DataFrame, jobs: DataFrame, existing: DataFrame | None = None, scope: str = "declared", wait: str | None = None) -> DataFrame:
    """Every attempt of a stream as an application (code and reason null) or a reject: applications.admit, continuously.

    attempts: attempt_id, user_id, job_id, attempted_at (timestamp). users and jobs are static tables. existing:
    applications made before the stream began (application_id and the scope's keys).

    wait: None judges by arrival, and nothing is ever late. With a delay such as '1 hour', attempts that arrive out of order
    by less are judged in order of (attempted_at, attempt_id), once the watermark has passed them; later ones are dropped.
    """
    ship(attempts.sparkSession)
    keys = KEYS[scope]
    timed = attempts.withColumn("attempted_at", F.col("attempted_at").cast("timestamp"))
    timed = timed.withWatermark("attempted_at", wait) if wait else timed
    text = lambda name: F.col(name).cast("string")
    found = checked(timed, users, jobs)
    rows = found.select("attempt_id", text("job_id").alias("job"), text("user_id").alias("user"), *COLUMNS[3:7], text("reject.code").alias("code"), "reject.reason")
    lane = F.when(F.col("code").isNotNull(), F.pmod(F.xxhash64("attempt_id"), F.lit(LANES)).cast("int")).otherwise(-1)
    grouped = rows.withColumn("lane", lane).groupBy(*keys, "lane")
    before = None
    if existing is not None:
        held = existing.withColumn("job", F.col("job_id").cast("string")) if scope == "declared" else existing
        before = held.select(*keys, F.lit(-1).alias("lane"), F.col("application_id").cast("string").alias("attempt_id")).groupBy(*keys, "lane")
    out = grouped.transformWithStateInPandas(Admission(bool(wait)), SEEN, "Append", "EventTime" if wait else "None", before)
    return out.select("attempt_id", F.col("job").cast("long").alias("job_id"), F.col("user").cast("long").alias("user_id"), *COLUMNS[3:7], F.col("code").cast("int").alias("code"), "reason")


def admitted(verdicts: DataFrame) -> DataFrame:
    """The applications among the verdicts of admission_stream, as admit has them."""
    return verdicts.filter("code IS NULL").select(F.col("attempt_id").alias("application_id"), "job_id", "applicant_email", F.lit("Submitted").alias("status"), "resume", F.col("attempted_at").alias("applied_at"), "subscribed")


def refused(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("code IS NOT NULL").select("attempt_id", "job_id", "user_id", "code", "reason")


OUTCOME = "event_id long, email string, ts timestamp, outcome string"


class ResetTokens(StatefulProcessor):
    """State: an email's latest token and when it was asked for. A right attempt uses it up; a timer removes it at its end."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.token = handle.getValueState("token", "token string, issued long")

    def store(self, token: str | None, issued: int, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if issued + self.ttl > watermark:
            self.token.update((token, issued))
            self.handle.registerTimer(issued + self.ttl)
        else:
            self.token.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        found = found.assign(o=(found["kind"] != "request").astype(int)).sort_values(["ts", "o", "event_id"])
        before = held = self.token.get() if self.token.exists() else None
        out = []
        for r in found.itertuples():
            at = millis(r.ts)
            if r.kind == "request":
                held = (plain(r.token), at) if r.known else held
                continue
            if held is None or at >= held[1] + self.ttl:
                outcome = "expired"
            elif held[0] != plain(r.token):
                outcome = "mismatch"
            else:
                outcome, held = "ok", None
            out.append((r.event_id, key[0], r.ts, outcome))
        if held is None and before is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.token.clear()
        elif held is not None and (before is None or tuple(held) != tuple(before)):
            self.store(held[0], held[1], timerValues.getCurrentWatermarkInMs())
        return iter([pd.DataFrame(out, columns=["event_id", "email", "ts", "outcome"]).astype({"event_id": "Int64", "ts": "datetime64[ns]"})])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.token.clear()
        return iter([])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        last = initialState.sort_values("issued_at").iloc[-1]
        self.store(plain(last["token"]), millis(last["issued_at"]), -1)

    def close(self) -> None:
        pass


def reset_stream(log: DataFrame, users: DataFrame, ttl_seconds: int = TTL_SECONDS, delay: str = "10 minutes", stored: DataFrame | None = None) -> DataFrame:
    """(event_id, email, ts, outcome) of the attempts of a stream like tokens.resolve_resets' log, by event time in a UTC session.

    stored: tokens that live when the stream begins (email, token, issued_at timestamp); the last of an email counts.
    A request of an unknown email leaves no token, so its attempts are 'expired'. Rows later than the delay are dropped;
    a token's state goes once the watermark has passed its end.
    """
    ship(log.sparkSession)
    known = users.select("email").distinct().withColumn("found", F.lit(True))
    marked = log.withWatermark("ts", delay).join(known, "email", "left").withColumn("known", F.coalesce("found", F.lit(False))).drop("found")
    before = None if stored is None else stored.select("email", "token", F.col("issued_at").cast("timestamp").alias("issued_at")).groupBy("email")
    return marked.groupBy("email").transformWithStateInPandas(ResetTokens(ttl_seconds), OUTCOME, "Append", "EventTime", before)
