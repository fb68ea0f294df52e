"""Mails as events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhire.functions.documents import is_strict_json, rendered
from tallyhire.sources.schemas import MAIL

SENDER = "Hiring portal <no-reply>"
STATUS_SUBJECT = "Update on your application"
STATUS_TEMPLATE = "<p>The status of your application for <b>{title}</b> has changed.</p>"
RESET_SUBJECT = "Reset your password"
RESET_TEMPLATE = '<p><a href="{link}">Choose a new password</a>, or open {link} within 15 minutes.</p>'


def status_mails(decisions: DataFrame, escape: bool = False) -> DataFrame:
    """(to, subject, html): one for each decision (applicant_email, job_title)."""
    return decisions.select(F.col("applicant_email").alias("to"), F.lit(STATUS_SUBJECT).alias("subject"), rendered(STATUS_TEMPLATE, escape, title=F.col("job_title")).alias("html"))


def reset_mails(requests: DataFrame, users: DataFrame, base_url: str) -> DataFrame:
    """(to, subject, html) of reset requests (email, token); unknown emails get none."""
    known = requests.join(users.select("email"), "email", "left_semi")
    link = F.concat(F.lit(f"{base_url.rstrip('/')}/reset/"), F.col("token"))
    return known.select(F.col("email").alias("to"), F.lit(RESET_SUBJECT).alias("subject"), rendered(RESET_TEMPLATE, link=link).alias("html"))


def to_mail_events(mails: DataFrame) -> DataFrame:
    """(value): the JSON of to, subject and html, without a key."""
    return mails.select(F.to_json(F.struct("to", "subject", "html")).alias("value"))


def parse_mails(events: DataFrame) -> DataFrame:
    """events (value) with mail and reason: null for a JSON object with a non-empty `to`, else why it is rejected.

    A null value is read as {}.
    """
    value = F.coalesce("value", F.lit("{}"))
    rows = events.withColumn("text", value).withColumn("ok", is_strict_json("text")).withColumn("mail", F.when(F.col("ok"), F.from_json("text", MAIL)))
    is_object = F.col("text").rlike(r"^[ \t\r\n]*\{")  # JSON's white space
    reason = F.when(~F.col("ok"), "invalid_json").when(~is_object, "not_an_object").when(F.coalesce(F.col("mail.to"), F.lit("")) == "", "no_recipient")
    return rows.withColumn("reason", reason).drop("text", "ok")


def outbox(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason IS NULL").select(F.lit(SENDER).alias("from"), "mail.to", "mail.subject", "mail.html")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason IS NOT NULL").select("value", "reason")
