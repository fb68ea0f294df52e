"""Password-reset tokens in batch: as-of matching with a lifetime, one use for each token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 900
SESSION_DAYS = 15


def live_until(issued: Column, seconds: int) -> Column:
    """The end of a token's life, at which it is no longer valid."""
    return issued + F.expr(f"INTERVAL '{seconds}' SECOND")


def session_live(issued: Column, at: Column, days: int = SESSION_DAYS) -> Column:
    """Whether a session issued at one time is valid at another."""
    return F.coalesce((at >= issued) & (at < live_until(issued, days * 86_400)), F.lit(False))


def latest_request(log: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Attempts of a log (event_id, email, ts, kind 'request' or 'attempt') with the latest request at or before each.

    request_id and request_ts are null without one; live says that it is younger than the lifetime. At equal times a
    request comes before an attempt.

    The last request is carried forward within an email's hours, and from hour to hour over one row for each: so the rows of
    an email that holds a third of the log are dealt out by hours, and no task orders them all.
    """
    is_request = F.col("kind") == "request"
    hour = F.date_diff("ts", F.lit("1970-01-01").cast("date")) * 24 + F.hour("ts")
    rows = log.withColumn("hour", hour).withColumn("asked", F.when(is_request, F.struct("event_id", "ts", "token")))
    heads = rows.groupBy("email", "hour").agg(F.max_by("asked", F.when(is_request, F.struct("ts", "event_id"))).alias("head"))
    earlier = Window.partitionBy("email").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(F.col("email").alias("of"), F.col("hour").alias("at"), F.last("head", ignorenulls=True).over(earlier).alias("carried"))
    order = Window.partitionBy("email", "hour").orderBy("ts", F.when(is_request, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("within", F.last("asked", ignorenulls=True).over(order)).filter(F.col("kind") == "attempt")
    found = within.join(carried, F.col("email").eqNullSafe(F.col("of")) & F.col("hour").eqNullSafe(F.col("at")), "left").withColumn("last", F.coalesce("within", "carried"))
    live = F.coalesce(F.col("ts") < live_until(F.col("last.ts"), ttl_seconds), F.lit(False))
    return found.select("event_id", "email", "ts", "token", F.col("last.event_id").alias("request_id"), F.col("last.ts").alias("request_ts"), F.col("last.token").alias("request_token"), live.alias("live"))


def resolve_resets(log: DataFrame, users: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """(event_id, email, ts, request_id, outcome) of every attempt.

    A request for an email without a user stores no token. outcome: 'expired' without a live token or after it was used;
    'mismatch' for another token, which uses nothing up; 'ok' for the first attempt that is right.
    """
    known = users.select("email").distinct()
    stored = log.join(known.withColumn("known", F.lit(True)), "email", "left").filter((F.col("kind") != "request") | F.col("known")).drop("known")
    rows = latest_request(stored, ttl_seconds)
    right = rows.filter(F.col("live") & F.col("token").eqNullSafe(F.col("request_token")))
    # the first right attempt uses a token up; an aggregate finds it, which combines before the shuffle
    first = right.groupBy(F.col("request_id").alias("used_id"), F.col("email").alias("used_by")).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    rows = rows.join(first, F.col("request_id").eqNullSafe(F.col("used_id")) & F.col("email").eqNullSafe(F.col("used_by")), "left")
    used = F.coalesce(F.struct("ts", "event_id") > F.col("first"), F.lit(False))
    outcome = F.when(~F.col("live") | used, "expired").when(~F.col("token").eqNullSafe(F.col("request_token")), "mismatch").otherwise("ok")
    return rows.select("event_id", "email", "ts", "request_id", outcome.alias("outcome"))
