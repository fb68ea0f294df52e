"""Streams: mails, status updates, reset tokens, admission.

The portal takes events as they arrive. Where these jobs use event time (resets, volumes), rows of a key are ordered by
their timestamps within a micro-batch, and windows close with the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyhire.functions.documents import data_uri, mime_of
from tallyhire.operators.assets import MAX_BYTES
from tallyhire.operators.notify import outbox, parse_mails, rejects, status_mails, to_mail_events
from tallyhire.streaming.state import admission_stream, admitted, refused, reset_stream

__all__ = ["admission_stream", "admitted", "deliver", "first_applications", "ingest_stream", "mail_sessions", "mail_volume_stream", "read_mail_stream", "refused", "reset_stream", "status_mail_stream", "without_repeats"]


def read_mail_stream(spark: SparkSession, servers: str, topic: str = "send-mail", group: str = "mail-service-group") -> DataFrame:
    """(value) of the topic from its end on. Needs Spark's Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.group.id": group, "startingOffsets": "latest"}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))


def deliver(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes good mails to path/outbox and the rest to path/mail_rejects. A failing mail stops nothing."""

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_mails(batch).persist()
        # a batch that is repeated after a failure overwrites its own folder
        outbox(parsed).write.mode("overwrite").parquet(f"{path}/outbox/batch={number}")
        rejects(parsed).write.mode("overwrite").parquet(f"{path}/mail_rejects/batch={number}")
        parsed.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def status_mail_stream(decisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """(value): mail events of a stream of decisions (application_id, applicant_email, job_id, status)."""
    return to_mail_events(status_mails(decisions.join(jobs.select("job_id", F.col("title").alias("job_title")), "job_id")))


def first_applications(attempts: DataFrame) -> DataFrame:
    """The first attempt to arrive for each (job_id, applicant_email). The rule has no time limit, so the state has none."""
    return attempts.dropDuplicates(["job_id", "applicant_email"])


def ingest_stream(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(public_id, path, mime, length, data_uri, code, reason) of the files that arrive in a folder.

    public_id is the content's digest: content that arrives again, under whatever name, is stored once, for the state
    remembers every digest. Files of more than max_bytes have a code and a reason instead; their content is not read.
    """
    files = lambda: spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    small = files().filter(F.col("length") <= max_bytes)
    stored = small.select(F.sha2("content", 256).alias("public_id"), "path", mime_of(name).alias("mime"), "length", data_uri(name, F.col("content")).alias("data_uri")).dropDuplicates(["public_id"])
    large = files().filter(F.col("length") > max_bytes).select("path", "length")
    none = lambda n: F.lit(None).cast("string").alias(n)
    rejects = large.select(none("public_id"), "path", none("mime"), "length", none("data_uri"), F.lit(413).alias("code"), F.lit("too_large").alias("reason"))
    return stored.select("*", F.lit(None).cast("int").alias("code"), none("reason")).unionByName(rejects)


def mail_volume_stream(events: DataFrame, ts: str = "ts", delay: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, kind, n) once a window closes."""
    by = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, delay).groupBy(by.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def mail_sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(to, start, end, n): each recipient's sessions of mails."""
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), "to").agg(F.count("*").alias("n")).select("to", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(mails: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drops a mail that equals another within the delay."""
    return mails.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["to", "subject", "html"])
